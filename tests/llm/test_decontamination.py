import random

from tesselon.llm import decontamination as D

WORDS = [f"w{i}" for i in range(500)]
RNG = random.Random(9)
ITEMS = [(k, " ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(4, 40)))) for k in range(30)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items):
    out = set()
    clean = lambda t: "".join(" " if c in D.MARKS.decode() else c for c in (t or "").lower()).split()
    for d, t in docs:
        words = clean(t)
        for k, it in items:
            item = clean(it)
            n = min(len(item), len(words))
            if item and words and min(distance(words[s : s + n], item) for s in range(len(words) - n + 1)) <= int(0.2 * len(item) + 1e-9):
                out.add((d, k))
    return out


def corpus():
    docs = []
    for d in range(120):
        noise = [RNG.choice(WORDS) + "x" * (d % 2) for _ in range(RNG.randrange(0, 40))]
        item = RNG.choice(ITEMS)[1].split()
        for _ in range(RNG.randrange(0, max(1, len(item) // 4))):
            p = RNG.randrange(len(item))
            item[p : p + 1] = RNG.choice([[], ["zz"], [item[p], "qq"]])
        docs.append((d, " ".join(noise[:10]) + " " + (" ".join(item).upper() + ", " if d % 4 else "") + " ".join(noise[10:])))
    return docs


def test_edit_distance():
    for _ in range(2000):
        a, b = [RNG.randrange(1, 5) for _ in range(RNG.randrange(12))], [RNG.randrange(1, 5) for _ in range(RNG.randrange(12))]
        assert D.edits(a, b) == distance(a, b)


def test_recall_and_precision(documents, spark):
    docs = corpus() + [(500, None), (501, ""), (502, "..."), (503, ITEMS[3][1]), (504, " ".join(ITEMS[3][1].split()[1:]))]
    bench = spark.createDataFrame([*ITEMS, (99, None), (98, ""), (97, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminations(documents(*docs), bench).collect()}
    want = brute(docs, ITEMS)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40
    kept = {r.doc_id for r in D.remove_contaminated(documents(*docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_of_items(documents, spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    docs = [(k, f"before {t} after") for k, t in ITEMS]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminations(documents(*docs), bench).collect()} >= {(k, k) for k, _ in ITEMS}
    assert D.remove_contaminated(documents(*docs, (100, "clean words only")), bench).count() == 1


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contaminations(documents((1, "a b c")), none).count() == 0
    assert D.remove_contaminated(documents((1, "a b c")), none).count() == 1
    assert D.contaminations(documents((1, "a")).limit(0), some).count() == 0


def test_planted_items_of_the_tables(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    exact = {tuple(r) for r in duckdb.sql(f"select doc_id, item_id from read_parquet('{sf}/documents.parquet') d join read_parquet('{sf}/benchmark.parquet') b on contains(d.text, b.text)").fetchall()}
    got = {(r.doc_id, r.item_id) for r in D.op7_decontamination(spark, sf).collect()}
    assert exact <= got
