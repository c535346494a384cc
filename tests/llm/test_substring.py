import hashlib
import random

import duckdb

from tesselon.llm import queries, substring_dedup


def brute(rows, window):
    first = {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def got(df, window):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df, window).collect())


def test_against_brute_force(documents):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for d in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if d % 3:
            a = rng.randrange(0, 30)
            t[len(t) // 2 : len(t) // 2] = passage[a : a + rng.randrange(5, 40)]
        rows.append((d, " \t\n"[d % 3].join(t)))
    rows += [(70, rows[10][1]), (71, rows[10][1]), (72, " ".join(["same"] * 80)), (73, " ".join(["same"] * 90)), (74, None), (75, ""), (75, rows[1][1]), (75, rows[1][1])]
    for window in (12, 20):
        assert got(documents(*rows), window) == brute(rows, window)


def test_production_window(documents):
    text = " ".join(f"t{i}" for i in range(200))
    rows = [(5, text), (3, "a b " + " ".join(text.split()[20:75]) + " c"), (9, " ".join(text.split()[:49])), (7, text)]
    assert got(documents(*rows), 50) == brute(rows, 50)


def test_null_ids_and_empty_table(documents, spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(documents((None, text), (None, text), (1, text), (2, text))).collect()}
    assert rows == {(None, 0), (1, 0), (2, 60)}
    assert substring_dedup.remove_repeats(documents((1, "a")).limit(0)).count() == 0


def test_factors_carry_their_source(documents):
    text = " ".join(f"t{i}" for i in range(100))
    r = next(r for r in substring_dedup.remove_repeats(documents((1, "x y " + text), (2, text))).collect() if r.doc_id == 2)
    assert [(s.start, s.n_words, s.source, s.source_start) for s in r.spans] == [(0, 100, 1, 2)]


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        mine = queries.queries()[name](spark, sf).toPandas()
        theirs = con.execute(sql).df()[list(mine.columns)]
        key = lambda df: sorted(df.itertuples(index=False, name=None))
        assert key(mine) == key(theirs), name


def test_digest_is_of_kept_words(spark):
    r = substring_dedup.op1_substring_dedup(spark, "/root/testdata/sf0.001").first()
    assert len(r.kept_sha256) == len(hashlib.sha256(b"").hexdigest())


def test_greedy_parse():
    match = lambda start, n, source, at: {"start": start, "n_words": n, "source": source, "source_start": at}
    # two matches that overlap: the second factor begins at the boundary and counts with the words before it
    assert substring_dedup.factorize([match(0, 60, 1, 5), match(40, 55, 2, 0)], 50) == [(0, 60, 1, 5), (60, 35, 2, 20)]
    # in step they are one; one inside another is passed over; the farthest wins
    assert substring_dedup.factorize([match(0, 50, 1, 0), match(1, 50, 1, 1), match(10, 50, 1, 10)], 50) == [(0, 60, 1, 0)]
    assert substring_dedup.factorize([match(3, 80, 1, 0), match(10, 50, 2, 0)], 50) == [(3, 80, 1, 0)]
    assert substring_dedup.factorize([match(3, 50, 4, 0), match(3, 70, 9, 0), match(100, 50, 1, 7)], 50) == [(3, 70, 9, 0), (100, 50, 1, 7)]
    assert substring_dedup.factorize([], 50) == []


def test_very_long_text(documents):
    text = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    rows = [(1, " ".join(text.split()[500:9_000])), (2, text), (3, text + " x")]
    assert got(documents(*rows), 50) == brute(rows, 50)
