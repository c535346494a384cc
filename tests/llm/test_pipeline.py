"""The pipeline's stages against brute force, each on the rows that the one before kept."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from tesselon.llm import langid


def test_stages_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"start": docs}
    for name, stage in P.STAGES[:-1]:
        kept[name] = stage(spark, list(kept.values())[-1], sf).cache()
        assert kept[name].columns == docs.columns and kept[name].count() > 0.6 * docs.count()
    pieces = P.STAGES[-1][1](spark, kept["benchmark"], sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept["benchmark"].collect()}
    from tests.llm.test_decontamination import brute as contaminated
    from tests.llm.test_lines import brute as lines
    from tests.llm.test_minhash import brute as groups

    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = {d: t for d, _, n, t in lines(rows(kept["language"])) if not n or t.split()}
    assert dict(rows(kept["lines"])) == want
    assert all(r.n_chars == len(r.text) for r in kept["lines"].collect())
    assert {d for d, _ in rows(kept["near_duplicates"])} == {d for d, _, _, keep in groups(rows(kept["lines"])) if keep}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, _ in rows(kept["near_duplicates"])} - {d for d, _ in rows(kept["benchmark"])}
    some = [r for r in rows(kept["near_duplicates"]) if r[0] in leaks or r[0] % 15 == 0]
    assert {d for d, _ in contaminated(some, items)} == leaks & {d for d, _ in some}
    assert P.run(spark, sf).count() == pieces.count()


def test_edges_and_clashing_columns(spark, documents, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "and", "word", "house"]) + str(rng.randrange(50)) for _ in range(30))
    rows = [(k, text(), "en") for k in range(20)] + [(100, None), (101, ""), (102, "1 2 3"), (None, text(), "en"), (5, text(), "fr"), (103, "x " * 3000)]
    spark.createDataFrame([(1, "some benchmark item of a few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(*rows).withColumn("__x", F.lit(1)).withColumn("score", F.lit("s")).withColumn("n_dropped", F.lit(9)).withColumn("digest", F.lit("d")).withColumn("component", F.lit(0))
    clashing = ("__lines", "__dropped", "__lang", "__score", "__n", "__gone", "lines_before", "lines_dropped", "lang_found", "lang_score", "gone", "column1", "key", "group", "place")
    docs = docs.withColumns({c: F.lit(f"my {c}") for c in clashing})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        assert out.count() > 15
        assert {(r.score, r.n_dropped, r.digest, r.n_lines) for r in out.collect()} == {("s", 9, "d", 1)}
        assert all(r[c] == f"my {c}" for r in out.collect() for c in clashing)
        docs = out
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 20


def test_empty_documents(spark, documents, tmp_path):
    spark.createDataFrame([(1, "some benchmark item of a few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents((1, "a")).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_rejects_what_has_no_language(spark, documents):
    out = P.language(spark, documents((1, "the house and the dog", "en"), (2, "123 456"), (3, None), (4, "a house of the people", "en")), "")
    assert {r.doc_id for r in out.collect()} <= {1, 4}
    assert langid.Model([]).predict("text") == ("und", 0.0)
    # where no language can be learned, all that has letters stays
    out = P.language(spark, documents((1, "the house and the dog"), (2, "123 456"), (3, None), (4, "eine andere Sprache")), "")
    assert {r.doc_id for r in out.collect()} == {1, 4}


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_names(name):
    assert name and len(name) < 40
