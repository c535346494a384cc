import zlib

from tesselon.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.op2_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_families_and_edges(spark, documents):
    texts = {"en": "the cat and the dog of the house", "de": "der hund und die katze des hauses", "fr": "le chat et le chien de la maison", "es": "el gato y el perro de la casa"}
    rows = [(k, f"{t} {k}", lang) for k, (lang, t) in enumerate([*texts.items()] * 12)]
    model = langid.fit(documents(*rows, (1000, None, "en"), (None, "the house", "en"), (1001, "x" * 30, None)))
    assert sum(map(len, model.families)) == 4 and len(model.families) == 2
    assert any(kind == "f" for kind, _, _ in model.machines) and any(kind == "l" for kind, _, _ in model.machines)
    out = {r.doc_id: r for r in langid.identify(documents((1, None), (2, ""), (3, "12 !?"), (4, texts["de"]), (5, "the " * 5000)), model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["und", "und", "und", "de", "en"]
    assert out[1].score == 0.0 and out[4].value == "x"


def test_nothing_to_learn_from(spark, documents):
    empty = documents((1, "a")).limit(0)
    model = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(documents((1, "some text")), model).first().lang_pred == "und"


def test_columns_that_clash_are_replaced(documents):
    from pyspark.sql import functions as F

    df = documents((1, "some text")).withColumn("score", F.lit("old"))
    assert langid.identify(df, langid.Model([])).first().score == 0.0


def test_short_texts_teach_and_bytes_are_bounded(documents, monkeypatch):
    rows = [(k, f"le {k}", "fr") for k in range(30)] + [(100 + k, f"the house and the dog {k}", "en") for k in range(30)]
    assert langid.fit(documents(*rows)).languages == ["en", "fr"]
    monkeypatch.setattr(langid, "LANGUAGE_BYTES", 60)
    assert langid.fit(documents(*rows)).languages == ["en", "fr"]


def test_prediction_against_brute_force(spark):
    """Votes of machines taken one by one over features in plain dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    for r in docs.collect():
        text = r.text
        if not text or not any(c.isalpha() for c in text):
            assert model.predict(text) == ("und", 0.0)
            continue
        cleaned = "".join(c if c.isalpha() else " " for c in text.lower())
        data = (" " + " ".join(cleaned.split()) + " ").encode()
        count = {}
        for n in langid.ORDERS:
            for i in range(len(data) - n + 1):
                h = 0
                for k in range(n):
                    h = (h + data[i + k] + 1) * int(langid.MULTIPLY[k]) & 0xFFFFFFFF
                    h ^= h >> 15
                at = (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16
                count[at] = count.get(at, 0) + 1
        size = sum(count.values()) ** 0.5
        margin = [sum(count[at] ** 0.5 / size * float(model.weights[at, m]) for at in count) + float(model.weights[-1, m]) for m in range(len(model.machines))]

        def best(kind, names, margin=margin):
            score = {x: [0, 0.0] for x in names}
            for (k, a, b), v in zip(model.machines, margin, strict=True):
                if k == kind and a in score and b in score:
                    score[a if v >= 0 else b][0] += 1
                    score[a][1] += v
                    score[b][1] -= v
            return max(names, key=lambda x: score[x])

        family = model.families[best("f", list(range(len(model.families))))]
        assert model.predict(text)[0] == best("l", family)


def test_rejection(spark, documents):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    other = "Αυτό είναι ένα κανονικό ελληνικό κείμενο για τον καιρό και τους ανθρώπους. " * 3
    own = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 300").first().text
    rows = langid.identify(documents((1, other), (2, own), (3, None), (4, "12"), (5, "a")), model)
    assert {r.doc_id for r in rows.where(~langid.is_rejected(model, "text", "lang_pred", "score")).collect()} == {2, 5}
    none = langid.Model([])
    rows = langid.identify(documents((1, other), (3, None), (4, "12"), (5, "a")), none)
    assert {r.doc_id for r in rows.where(~langid.is_rejected(none, "text", "lang_pred", "score")).collect()} == {1, 5}
