"""Language identification by hierarchical discrimination.

Languages are first put into families: the two groups of languages whose mean profiles are closest are merged again and
again until as many are left as the square root of the number of languages, rounded up. A text's family is the one with most votes of one-versus-one linear
support vector machines between families; within the family one-versus-one machines separate its languages.

Features are hashed byte 1- to 4-grams of the lower-cased text with white space and everything but letters as one blank,
as shares of the text; the whole text counts. Machines are trained here, on a sample bounded by `per_language` texts of
each language, chosen by a hash of the id from the rows that may be learned from.

Rows: null text and text without a letter are `und` with score 0. A null doc_id is not learned from and not held out.
Repeated rows are predicted each. With no row to learn from, everything is `und`. Extra columns stay as they are. Texts of
any length are predicted whole; short texts are learned from where a language has too few longer ones. Ties between
languages go to the larger sum of margins, then to the first by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm import common

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Texts of each language that a model is fitted on, at most, and bytes of all of them (a longer first text is taken alone).
PER_LANGUAGE, LANGUAGE_BYTES = 400, 8 << 20
#: Score below which a text of so many letters is in none of the learned languages (see `is_rejected`). Of 51,282 texts in four
#: languages two fall below it, both one word over and over; text in Greek letters does, in other languages and scripts
#: it scores 0.46 to 0.61, where texts of the learned languages may lie too (from 0.48 on) and so stay.
LEAST_SCORE, LEAST_LETTERS = 0.45, 60
EPOCHS, COST, SEED = 12, 4.0, 11
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}]+")


def grams(text: str | None) -> np.ndarray | None:
    """Buckets of all grams of the text; None if it has no letter."""
    if not text or not LETTER.search(text):
        return None
    b = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode(), np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in ORDERS:
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] + b[n - 1 :] + np.uint32(1)) * MULTIPLY[n - 1]
        h ^= h >> np.uint32(15)
        out.append(h * np.uint32(0x2C1B3C6D) >> np.uint32(16))
    return np.concatenate(out)


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and their weights, of unit length."""
    g = grams(text)
    if g is None:
        return None
    at, n = np.unique(g, return_counts=True)
    v = np.sqrt(n / len(g))
    return at, v / np.linalg.norm(v)


def train_machine(xs: list, ys: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine, by dual coordinate descent."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(xs))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(xs)):
            at, v = xs[i]
            g = ys[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / 2, 0.0), COST)  # squared length of a row: 1, and 1 for the bias
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * ys[i] * v
                w[-1] += (new - alpha[i]) * ys[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """families: lists of languages; machines: for pairs of families (by number) and of languages, positive for the first."""

    def __init__(self, texts: list[tuple[str, str]]):
        rows = [(lang, p) for lang, text in texts if (p := profile(text))]
        self.languages = sorted({lang for lang, _ in rows})
        of = {lang: [p for x, p in rows if x == lang] for lang in self.languages}
        means = {}
        for lang, ps in of.items():
            m = np.zeros(BUCKETS)
            for at, v in ps:
                m[at] += v
            means[lang] = m / np.linalg.norm(m)
        families = [[x] for x in self.languages]
        center = lambda f: (m := sum(means[x] for x in f)) / np.linalg.norm(m)
        while len(families) > max(1, np.ceil(len(self.languages) ** 0.5)):
            _, i, j = max((float(center(a) @ center(b)), i, j) for i, a in enumerate(families) for j, b in enumerate(families) if i < j)
            families[i] += families.pop(j)
        self.families = [sorted(f) for f in families]
        self.machines: list[tuple[str, object, object]] = []
        weights = []
        pairs = [("f", i, j, families[i], families[j]) for i in range(len(families)) for j in range(i + 1, len(families))]
        pairs += [("l", a, b, [a], [b]) for f in self.families for k, a in enumerate(f) for b in f[k + 1 :]]
        for kind, a, b, one, two in pairs:
            left, right = ([p for x in side for p in of[x]] for side in (one, two))
            weights.append(train_machine(left + right, np.array([1.0] * len(left) + [-1.0] * len(right))))
            self.machines.append((kind, a, b))
        self.weights = np.stack(weights, axis=1) if weights else np.zeros((BUCKETS + 1, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if self.languages else None
        if g is None:
            return "und", 0.0
        n = np.bincount(g, minlength=BUCKETS) if len(g) > BUCKETS // 4 else None
        at, n = (np.flatnonzero(n), n[np.flatnonzero(n)]) if n is not None else np.unique(g, return_counts=True)
        v = np.sqrt(n / len(g))
        v /= np.linalg.norm(v)
        margin = dict(zip(self.machines, (v.astype(np.float32) @ self.weights[at] + self.weights[-1]).tolist(), strict=True))
        family, p = self._vote("f", list(range(len(self.families))), margin)
        lang, q = self._vote("l", self.families[family], margin)
        return lang, min(1.0, max(0.0, p * q))

    @staticmethod
    def _vote(kind, names, margin):
        """The name with most machines won (the larger sum of margins decides a tie) and the mean confidence of its machines."""
        if len(names) == 1:
            return names[0], 1.0
        won = dict.fromkeys(names, 0)
        total = dict.fromkeys(names, 0.0)
        for (k, a, b), m in margin.items():
            if k == kind and a in won and b in won:
                won[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        best = max(names, key=lambda x: (won[x], total[x]))
        sure = [1 / (1 + np.exp(-4 * (m if best == a else -m))) for (k, a, b), m in margin.items() if k == kind and best in (a, b)]
        return best, float(np.mean(sure))


def held_out():
    """Whether a row is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of at most per_language whole texts of each language, of LANGUAGE_BYTES together."""
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return Model([])
    # of each language a share by a hash of the id that leaves about twice as many rows as are wanted; then the first of them
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * per_language / n + 50 / n)))])
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    first = Window.partitionBy("lang").orderBy(F.length("text") <= 20, F.xxhash64("doc_id"), "doc_id", "text")
    rows = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("n"))
    rows = rows.withColumn("size", size).where((F.col("n") == 1) | (F.col("size") <= LANGUAGE_BYTES)).select("lang", "text", "doc_id").collect()  # bounded by both
    return Model([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])


def is_rejected(model: Model, text: str, lang: str, score: str) -> Column:
    """Whether a text is in none of the model's languages: it has no letter, or enough of them and the machines are not sure of
    any language. A model without languages rejects only what has no letter."""
    if not model.languages:
        return ~F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return (F.col(lang) == "und") | ((F.col(score) < LEAST_SCORE) & (letters >= LEAST_LETTERS))


def identify(docs: DataFrame, model: Model, columns: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns more, the language and how sure it is (in the place of columns so named)."""
    common.tune(docs.sparkSession)
    docs = docs.drop(*columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each pair of languages
    names = docs.columns
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(at).to_pylist()]
            cols = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, *columns])

    return docs.mapInArrow(common.lean(run), f"{schema}, `{columns[0]}` string, `{columns[1]}` double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
