import math
from collections import Counter

from pyspark.sql import functions as F

from tesselon.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_labels_agree_with_the_table(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in Q.op10_quality(spark, SF).collect()}
    assert len(rows) == 10000
    clean = [rows[d].keep for d, x in labels.items() if x == (1, 0)]
    junk = [rows[d].keep for d, x in labels.items() if x[0] == 0]
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / len(junk) < 0.05


def vote(text, name, stems=None):
    return Q.votes(text, stems)[Q.LABELLERS.index(name)]


def test_votes_and_patterns():
    assert Q.votes(None) == Q.votes("") == [2] + [0] * 16 and len(Q.LABELLERS) == 17
    junk = {
        "de " * 50: ("repeats", "commonest", "variety"),
        "a*** b$$$ c### d%%% e&&& f*** g$$$ h### i%%% j&&&": ("symbols", "symbol_runs", "letters"),
        "THIS IS ALL IN CAPITAL LETTERS!! AND SO IS THE REST!! OF IT!!": ("case", "capitals", "marks"),
        "one | two | three | four | five | six | seven | eight | nine | ten | eleven": ("bare_symbols", "sentences"),
    }
    plain = "This is a plain text. It has some sentences, of several words each. None of them is odd, as far as one can see. So it goes on."
    for text, names in junk.items():
        for name in names:
            assert vote(text, name) == 2 and vote(plain, name) != 2, name
    assert Q.pattern([0, 1, 2] + [0] * 14) == 3 + 18


def brute_posterior(rows, labellers):
    """Expectation-maximisation over documents, one by one, in plain Python."""
    good = [[0.95, 0.5, 0.05][min(2, sum(r[k] == 2 for k in labellers))] for r in rows]
    for _ in range(Q.ROUNDS):
        share = sum(good) / len(rows)
        chance = {}
        for k in labellers:
            for c in (0, 1):
                seen = [(1 - Q.PRIOR[c]) / 2 * Q.PRIOR_DOCUMENTS, (1 - Q.PRIOR[c]) / 2 * Q.PRIOR_DOCUMENTS, Q.PRIOR[c] * Q.PRIOR_DOCUMENTS]
                for r, g in zip(rows, good, strict=True):
                    seen[r[k]] += g if c else 1 - g
                for v in range(3):
                    chance[k, c, v] = seen[v] / sum(seen)
        for i, r in enumerate(rows):
            odds = math.log(max(1e-9, 1 - share)) - math.log(max(1e-9, share))
            odds += sum(math.log(chance[k, 0, r[k]]) - math.log(chance[k, 1, r[k]]) for k in labellers)
            good[i] = 1 / (1 + math.exp(min(50, max(-50, odds))))
    return good


def test_posteriors_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    cast = [Q.votes(r.text) for r in rows]
    want = [a * b for a, b in zip(brute_posterior(cast, Q.QUALITY), brute_posterior(cast, Q.TOXIC), strict=True)]
    got = {r.doc_id: r for r in Q.score_documents(spark.createDataFrame(rows)).collect()}
    for r, v, p in zip(rows, cast, want, strict=True):
        assert list(got[r.doc_id].votes) == v and abs(got[r.doc_id].posterior - p) < 1e-6


def test_the_corpus_decides_not_the_prior_nor_any_bad_vote(spark):
    """Each labeller's estimated accuracies leave the prior; the posterior agrees with the labels more often than "any bad vote"."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    cast = {r.doc_id: Q.votes(r.text) for r in docs}
    counts = Counter(map(Q.pattern, cast.values()))
    share, chance, good = Q.label_model(counts, Q.QUALITY)
    assert 0.75 < share < 0.95
    assert (abs(chance[:, 0, 2] - Q.PRIOR[0]) > 0.03).sum() >= 10 and chance[1:12, 1, 2].max() < 0.005 < Q.PRIOR[1]
    right = sum((good[Q.pattern(cast[d])] >= 0.5) == bool(q) for d, q in labels.items())
    any_vote = sum((2 not in cast[d][:14]) == bool(q) for d, q in labels.items())
    assert right > any_vote and right / len(labels) > 0.99


def test_edges(documents):
    good = " ".join(f"This is a quite ordinary text, with words like number{i} and thing{i * 7}. It goes on so." for i in range(10))
    rows = [(k, good + f" {k}") for k in range(30)] + [(100 + k, "spam " * 40) for k in range(10)] + [(200, None), (201, ""), (None, good), (0, good + " 0")]
    got = Q.score_documents(documents(*rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    clash = documents(*rows).withColumn("votes", F.lit("v")).withColumn("score", F.lit("s")).withColumn("posterior", F.lit(1)).withColumn("keep", F.lit(0))
    assert sorted(r.score for r in Q.score_documents(clash).collect()) == sorted(r.score for r in got)
    assert by[1].keep and not by[100].keep and by[None].keep and by[201].votes[0] == 2
    assert Q.score_documents(documents((1, "a")).limit(0)).count() == 0


def test_toxic_of_every_language_held_out(spark):
    """Recall on labelled documents that no stem was learned from, by language; false alarms of the labeller on the others."""
    from tesselon.llm.langid import held_out

    rows = {r.doc_id: r for r in Q.op10_quality(spark, SF).collect()}
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").where(held_out()).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs]
    for lang in ("en", "de", "fr", "es"):
        toxic = [rows[r.doc_id] for r in labels if r.toxic == 1 and docs[r.doc_id] == lang]
        clean = [rows[r.doc_id] for r in labels if (r.quality, r.toxic) == (1, 0) and docs[r.doc_id] == lang]
        found, alarms, gone = (sum(x) / len(y) for x, y in ((["2" in r.votes[-3:-1] for r in toxic], toxic), (["2" in r.votes[-3:-1] for r in clean], clean), ([not r.keep for r in toxic], toxic)))
        print(lang, len(toxic), found, gone, len(clean), alarms)
        assert found >= 0.85 and gone >= 0.85 and alarms <= 0.02


def test_learns_stems():
    words = lambda k, more: " ".join([f"word{(k * 7 + i) % 90}" for i in range(40)] + more)
    toxic = [words(k, [f"abgrümpel{k % 3}", "x"]) for k in range(20)]
    stems, least = Q.learn_stems(toxic, [words(k, []) for k in range(60)])
    found = Q.Words({"xx": (stems, least)})
    assert all(found.toxic(t.encode().split()) for t in toxic) and not found.toxic(words(3, []).encode().split())
    assert vote(toxic[0], "stems", found) == 2 and vote(toxic[0], "stems") == 0
