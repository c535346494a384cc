import random

from tesselon.llm import minhash


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def corpus(seed, n_groups=12, size=8):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(1, size)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(df).collect())


def test_against_brute_force(documents):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Two words"), (1004, "two WORDS"), (1005, "É é É é É"), (1006, "É é É é É")]
    assert got(documents(*rows)) == brute(rows)


def test_long_lists_are_split(documents, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 6)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for d in range(90):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((d, " ".join(t)))
    rows += [(100 + d, " ".join(base[:40] + [rng.choice(words) for _ in range(40)])) for d in range(30)]
    assert got(documents(*rows)) == brute(rows)


def test_texts_are_shuffled_when_many_are_wanted(documents, monkeypatch):
    monkeypatch.setattr(minhash, "SEND_IDS", 0)
    rows = corpus(4, 6)
    assert got(documents(*rows)) == brute(rows)


def test_null_ids_repeated_rows_and_empty(documents):
    text = " ".join(f"t{i}" for i in range(30))
    got_rows = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(documents((None, text), (2, text), (2, text), (1, text + " more"))).collect()), key=str)
    assert got_rows == [(1, 1, True), (2, 1, False), (2, 1, False), (None, None, True)]
    assert minhash.near_groups(documents((1, "a")).limit(0)).count() == 0


def test_keep_one(documents):
    text = " ".join(f"t{i}" for i in range(40))
    kept = minhash.keep_one(documents((3, text), (1, text + " x"), (1, text + " x"), (2, "other words here"), (None, text), (4, None)))
    assert sorted(((r.doc_id, r.value) for r in kept.collect()), key=str) == [(1, "x"), (2, "x"), (4, "x"), (None, "x")]


def test_keep_one_judges_rows_of_one_id_by_their_texts(documents):
    from pyspark.sql import functions as F

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = documents((1, a), (5, a + " x"), (5, b), (5, c), (5, c + " y"), (None, a), (None, a), (7, ""), (7, ""), (7, None))
    docs = docs.withColumns({n: F.lit("mine") for n in ("__n", "column1", "key", "group", "text_key", "place", "digest")})
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["key"] for r in kept.collect()} == {"mine"}
    got = sorted((str(r.doc_id), (r.text or str(r.text))[:2]) for r in kept.collect())
    assert got == [("1", "a0"), ("5", "b0"), ("5", "c0"), ("7", ""), ("7", "No"), ("None", "a0"), ("None", "a0")]


def test_a_list_far_longer_than_a_part(documents, monkeypatch):
    """Near copies whose similarities lie around the bound, so that lists hold many components, beside a passage that many share."""
    monkeypatch.setattr(minhash, "PART", 16)
    monkeypatch.setattr(minhash, "BLOCK", 12)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base, passage = ([rng.choice(words) for _ in range(n)] for n in (90, 60))
    rows = []
    for d in range(260):
        t = list(base)
        for _ in range(rng.choice([1, 3, 4, 5, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((d, " ".join(t)))
    for d in range(300, 420):
        rows.append((d, " ".join(passage + [rng.choice(words) for _ in range(40)])))
    have, want = got(documents(*rows)), brute(rows)
    assert 10 < len({r[2] for r in want if r[0] < 260}) < 250
    assert have == want


def test_very_long_texts(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 10_000)
    monkeypatch.setattr(minhash, "PART", 2)
    words = [f"w{i * i % 9973}" for i in range(30_000)]
    rows = [(k, " ".join(words[: 30_000 - 100 * k])) for k in range(6)] + [(9, " ".join(words[:9_000]))]
    assert got(documents(*rows)) == brute(rows)


def test_prefix_meets_what_agrees_enough():
    t = minhash.agreeing(75)
    assert 8 <= t <= 16 and minhash.agreeing(100) == minhash.POSTED and minhash.agreeing(1) == 1
