"""Quality classifier by a weak-label model.

Heuristic labellers look at whole texts and vote good, bad or nothing; several overlap on every kind of junk (symbols,
capitals, repetition, lists, toxic words), each by another measure. How often each vote pattern occurs over all documents
is counted (all labellers but three never vote good, so there are at most 2^14 * 3^3 patterns), and
expectation-maximisation over these counts estimates the share of good documents and each labeller's chance of every vote
given good or bad: once for quality and once for toxicity, which are apart (toxic text may be well written). Its start is
by the number of bad votes; its prior counts as much as PRIOR_DOCUMENTS documents, so that the corpus decides. The
posterior of a document's pattern, good in both, is its label; a linear scorer over hashed words and word shapes is fitted by logistic loss to the posterior labels of a sample of at most `sample` documents, of SAMPLE_BYTES together,
chosen by a hash of the id, and scores every document.

The labeller of toxic text knows some English words and, of every language with MIN_TOXIC labelled toxic documents, stems
(pieces of words) learned from the labels: those that stand in toxic documents far more often than in others, until every
toxic document of the sample holds one, and the share of words with a stem that tells toxic documents from all others best. At
most LEARNED documents of each language and label are learned from, whole, chosen by a hash of the id; a third is held out.

Rows: null or empty text gets the votes of an empty text (bad by its length). A null doc_id is scored, never sampled.
Repeated rows are scored each. An empty table gives no rows; extra columns are ignored, whatever their names. Texts of any
length are read whole. Ties: a score of just 0.5 is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm import common
from tesselon.llm.langid import held_out

#: Of words, and of their shapes.
BUCKETS = 1 << 18
SAMPLE = 4000
SAMPLE_BYTES = 24 << 20
#: For bad and good documents: the chance of a bad vote that is expected of a labeller, and of how many documents this weighs.
PRIOR, PRIOR_DOCUMENTS = (0.3, 0.01), 10.0
#: Words remembered by a worker.
CACHE_WORDS = 300_000
ROUNDS, EPOCHS, RATE, SEED = 60, 6, 4.0, 3
SYMBOLS = np.frombuffer(rb"#$%&*=@^_~<>|{}\[]", np.uint8)
# Words that no clean text is made of.
RUDE = frozenset(b"clown disgusting dumb idiot idiots loser losers moron morons pathetic scum stupid trash worthless".split())
#: Documents learned from of each language, at most, by toxic; toxic ones that are needed to learn at all; letters of a stem.
LEARNED, MIN_TOXIC, STEM = {0: 600, 1: 200}, 10, range(4, 10)
#: Share of the toxic documents that a stem must stand in, how many times more common there than elsewhere, and stems at most.
SEEN, TIMES, STEMS = 0.1, 5, 32
#: Words that a text counts as longer than it is, so that one stem by chance in a short text is no proof.
SMOOTH = 20
LABELLERS = ("length", "symbols", "symbol_runs", "letters", "bare_symbols", "case", "capitals", "marks", "repeats", "variety", "commonest", "lines", "sentences", "word_length", "rude", "stems", "stem_words")
#: The labellers of each of the two label models.
QUALITY, TOXIC = range(14), range(14, 17)


class Words(dict):
    """What is to be known of a word, in one number: buckets of the word and of its shape, whether it is rude, and the set of languages whose toxic stems it holds.

    stems: by language the learned stems and the share of words holding one above which a text is toxic.
    """

    def __init__(self, stems: dict[str, tuple[list[str], float]] | None = None):
        super().__init__()
        self.learned = {k: v for k, v in (stems or {}).items() if v[0]}
        self.sets: list[int] = [0]  # the sets of languages that words hold stems of, each as bits
        self.number = {0: 0}
        self.shapes: dict[bytes, int] = {}
        self.automaton = None
        if self.learned:
            of: dict[str, int] = {}
            for k, (found, _) in enumerate(self.learned.values()):
                for stem in found:
                    of[stem] = of.get(stem, 0) | 1 << k
            self.automaton = ahocorasick.Automaton()
            for stem, bits in of.items():
                self.automaton.add_word(stem, bits)
            self.automaton.make_automaton()

    def __reduce__(self):
        return Words, (self.learned,)

    def __missing__(self, word: bytes) -> int:
        lower = word.lower()
        pattern = word.translate(SHAPE)
        shape = self.shapes.get(pattern)
        if shape is None:
            shape = xxhash.xxh3_64_intdigest(b"\0" + RUN.sub(rb"\1", pattern)) % BUCKETS << 18
            if len(self.shapes) < 100_000:
                self.shapes[pattern] = shape
        x = xxhash.xxh3_64_intdigest(lower) % BUCKETS | shape
        if len(word) < 16 and lower.strip(b".,!?#$%&*|") in RUDE:
            x |= 1 << 36
        if self.automaton is not None:
            text = lower.decode(errors="ignore")
            bits = 0
            for _, more in self.automaton.iter(text if text.isascii() else text.lower()):
                bits |= more
            if bits:
                if bits not in self.number:
                    self.number[bits] = len(self.sets)
                    self.sets.append(bits)
                x |= self.number[bits] << 37
        if len(word) <= 64:
            self[word] = x
        return x

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def judge(self, at: np.ndarray) -> tuple[bool, bool]:
        """Of a text's words: whether the share of those with a stem of some language is a toxic text's, and whether two different ones hold one."""
        if not self.learned or not len(held := at[at >> 37 > 0]):
            return False, False
        kinds, times = np.unique(held, return_counts=True)
        sets = [self.sets[k] for k in (kinds >> 37).tolist()]
        toxic = two = False
        for k, (_, least) in enumerate(self.learned.values()):
            mine = [n for x, n in zip(sets, times.tolist(), strict=True) if x >> k & 1]
            toxic = toxic or sum(mine) / (len(at) + SMOOTH) > least
            two = two or len(mine) > 1
        return toxic, two

    def toxic(self, words: list[bytes]) -> bool:
        return self.judge(self.of(words))[0]


def _pieces(word: str) -> set[str]:
    word = word.strip(".,!?#$%&*|")
    return {word[i : i + n] for n in STEM for i in range(len(word) - n + 1)}


def learn_stems(toxic: list[str], other: list[str], foreign: list[str] = ()) -> tuple[list[str], float]:
    """Stems and the share of words holding one above which a text is toxic; foreign: texts of other languages that are not toxic."""
    bags = [Counter(t.lower().split()) for t in toxic]
    pieces: dict[str, set[str]] = {}
    rate, held = Counter(), []
    for bag in bags:
        seen = Counter()
        for w, n in bag.items():
            for s in pieces.get(w) or pieces.setdefault(w, _pieces(w)):
                seen[s] += n
        held.append(seen.keys())
        for s, n in seen.items():
            rate[s] += n / bag.total() / len(toxic)
    count = Counter(s for seen in held for s in seen)
    kept = {s for s, n in count.items() if n >= max(2, SEEN * len(toxic))}
    beside, pieces = Counter(), {}
    others = [Counter(t.lower().split()) for t in other]
    for bag in others:
        for w, n in bag.items():
            if w not in pieces:
                pieces[w] = kept & _pieces(w)
            for s in pieces[w]:
                beside[s] += n / bag.total() / len(others)
    value = {s: math.log(rate[s] / (beside[s] + 1e-4)) for s in kept if rate[s] > TIMES * beside[s]}
    left, stems = [value.keys() & seen for seen in held], []
    while left and len(stems) < STEMS:
        here = Counter(s for seen in left for s in seen)
        best = max(here, key=lambda s: (value[s] * here[s], len(s), s), default=None)
        if best is None or here[best] < 2:
            break
        stems.append(best)
        left = [seen for seen in left if best not in seen]
    if not stems:
        return [], 1.0
    search = re.compile("|".join(map(re.escape, stems))).search
    has: dict[str, bool] = {}
    hit = lambda w: has[w] if w in has else has.setdefault(w, search(w) is not None)
    share = lambda bag: sum(n for w, n in bag.items() if hit(w)) / (bag.total() + SMOOTH)
    marks = sorted([(share(bag), 1) for bag in bags] + [(share(bag), 0) for bag in others] + [(share(Counter(t.lower().split())), 0) for t in foreign])
    wrong = sum(1 - y for _, y in marks)  # all called toxic
    least, fewest = marks[0][0] - 1.0, wrong
    for (x, y), (following, _) in zip(marks, [*marks[1:], (1.0, 0)], strict=True):
        wrong += 1 if y else -1
        if following > x and wrong < fewest:
            least, fewest = (x + following) / 2, wrong
    return (stems, least) if least > 0 else ([], 1.0)


def fit_stems(docs: DataFrame, labels: DataFrame) -> Words:
    """Stems of every language with enough labelled toxic documents that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    tongue = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    group = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]") & ~held_out()).select("doc_id", tongue.alias("lang"), "text")
    ids = group.select("doc_id", "lang").join(known, "doc_id").distinct()
    counts = {(r["lang"], r["toxic"]): r["n"] for r in ids.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows per language
    counts = {k: n for k, n in counts.items() if counts.get((k[0], 1), 0) >= MIN_TOXIC}
    if not counts:
        return Words()
    # as in langid.fit: a share by a hash of the id that leaves about twice as many rows as are wanted, then the first of them
    share = F.create_map(*[x for (lang, y), n in counts.items() for x in (F.lit(f"{y}{lang}"), F.lit(min(1.0, 2.0 * LEARNED[y] / n + 50 / n)))])
    some = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.concat("toxic", "lang")] * (1 << 20))
    first = Window.partitionBy("lang", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = F.when(F.col("toxic") == 1, LEARNED[1]).otherwise(LEARNED[0])
    some = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).drop("n")
    rows = group.join(F.broadcast(some), ["doc_id", "lang"]).select("doc_id", "lang", "toxic", "text").orderBy("doc_id", "text").collect()  # bounded by LEARNED of each language
    by: dict[tuple[str, int], list[str]] = {}
    for r in rows:
        by.setdefault((r["lang"], r["toxic"]), []).append(r["text"])
    known = sorted({lang for lang, _ in by})
    return Words({lang: learn_stems(by[lang, 1], by.get((lang, 0), []), [t for x in known if x != lang for t in by.get((x, 0), [])]) for lang in known if (lang, 1) in by})


POWERS = [3**k for k in range(len(LABELLERS))]
SHAPE = bytes(0x61 if 97 <= b <= 122 or b >= 128 else 0x41 if 65 <= b <= 90 else 0x39 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.S)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[SYMBOLS] = True


def votes(text: str | None, table: Words | None = None) -> list[int]:
    """One vote per labeller: 1 good, 2 bad, 0 nothing."""
    return _judged(text, Words() if table is None else table)[0]


def _judged(text: str | None, table: Words) -> tuple[list[int], np.ndarray]:
    """The votes and the words' numbers."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    at = table.of(words)
    if not n:
        return [2, *[0] * (len(LABELLERS) - 1)], at
    data = np.frombuffer(raw, np.uint8)
    count = np.bincount(data, minlength=256)
    upper = int(count[65:91].sum()) + (int(((data[:-1] == 0xC3) & (data[1:] < 0x9F)).sum()) if count[0xC3] else 0)  # A-Z, and Latin-1 capitals
    letters = int(count[65:91].sum() + count[97:123].sum() + count[0xC0:].sum())  # other letters by their first byte
    shown = int(len(data) - count[SPACES].sum() - count[0x80:0xC0].sum())
    symbols = int(count[SYMBOLS].sum())
    runs = lone = initials = 0
    if symbols > 0.1 * n:  # fewer decide nothing
        symbol = SYMBOL[data]
        before, after = np.concatenate([[True], SPACES[data[:-1]]]), np.append(SPACES[data[1:]], True)
        runs, lone = int((symbol[1:] & (data[1:] == data[:-1])).sum()), int((symbol & before & after).sum())
    if upper > 0.4 * n:
        initials = int((CAPITAL[data] & np.concatenate([[True], SPACES[data[:-1]]])).sum())
    kinds = np.unique(at & BUCKETS - 1, return_counts=True)[1]
    lines = raw.split(b"\n") if count[10] > 2 else ()
    ends = int(count[33] + count[46] + count[63])
    toxic, two_words = table.judge(at)
    bad = lambda x, most: 2 if x > most else 0
    cast = [
        2 if n < 3 else 1 if n >= 20 else 0,
        bad(symbols / n, 0.3),
        bad(runs / n, 0.15),
        bad(1 - (letters + int(count[48:58].sum())) / shown, 0.25) if n >= 10 else 0,
        bad(lone / n, 0.1),
        bad(upper / max(1, letters), 0.4) if letters > 20 else 0,
        bad(initials / n, 0.5) if n >= 10 else 0,
        bad(int(count[33]) / n, 0.3) if n >= 5 else 0,
        bad(int((at[1:] == at[:-1]).sum()) / max(1, n - 1), 0.3) if n >= 10 else 0,
        bad(2.0, len(kinds) / n**0.5) if n >= 20 else 0,
        bad(int(kinds.max()) / n, 0.3) if n >= 10 else 0,
        bad(1 - len(set(lines)) / len(lines), 0.4) if len(lines) >= 4 else 0,
        (1 if 0.03 <= ends / n <= 0.3 else 2 if ends / n < 0.01 else 0) if n >= 20 else 0,
        1 if 3 <= letters / n <= 10 else 2 if letters / n < 1.5 or letters / n > 20 else 0,
        bad(int((at >> 36 & 1).sum()), 1),
        2 * toxic,
        2 * two_words,
    ]
    return cast, at


def pattern(vote: list[int]) -> int:
    return sum(v * p for v, p in zip(vote, POWERS, strict=True))


def label_model(counts: dict[int, int], labellers: range) -> tuple[float, np.ndarray, dict[int, float]]:
    """Of some labellers: the share of good documents, the chance of each vote [labeller, class, vote], the posterior of good for each pattern."""
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], np.float64)
    vote = patterns[:, None] // 3 ** np.array(labellers) % 3
    good = np.array([0.95, 0.5, 0.05])[np.minimum((vote == 2).sum(1), 2)]
    share, chance = 0.5, np.full((len(labellers), 2, 3), 1 / 3)
    expected = [np.array([(1 - alarm) / 2, (1 - alarm) / 2, alarm]) * PRIOR_DOCUMENTS for alarm in PRIOR]
    for _ in range(ROUNDS):
        share = float((n * good).sum() / n.sum())
        for k in range(len(labellers)):
            for c, p in enumerate((1 - good, good)):
                seen = np.array([(n * p)[vote[:, k] == v].sum() for v in range(3)]) + expected[c]
                chance[k, c] = seen / seen.sum()
        log = np.log(np.array([[max(1e-9, 1 - share)], [max(1e-9, share)]])) + np.log(chance[np.arange(len(labellers)), :, vote]).sum(1).T
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return share, chance, dict(zip(patterns.tolist(), good.tolist(), strict=True))


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """For each pattern the posterior of good in quality and not toxic."""
    if not counts:
        return {}
    (_, _, good), (_, _, clean) = (label_model(counts, x) for x in (QUALITY, TOXIC))
    return {p: good[p] * clean[p] for p in counts}


def features(at: np.ndarray, toxic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words (upper half) and shapes (lower half), and their weights."""
    n = len(at)
    same = int((at[1:] == at[:-1]).sum()) / max(1, n - 1)
    (words, times), (shapes, more) = (np.unique(x, return_counts=True) for x in (at & BUCKETS - 1, at >> 18 & BUCKETS - 1))
    v = np.sqrt(np.concatenate([times, more]) / max(1, n))
    v /= max(1e-9, float(np.sqrt(v @ v)))
    extra = [2 * BUCKETS, 2 * BUCKETS + 1, 2 * BUCKETS + 2, 2 * BUCKETS + 3]
    return np.concatenate([words + BUCKETS, shapes, extra]), np.append(v, [1.0, same, min(1.0, n / 20), float(toxic)])


def train(rows: list[tuple[np.ndarray, bool, float]]) -> np.ndarray:
    """Weights by logistic loss from (the words' numbers, whether a toxic vote fell, the posterior)."""
    w, rng = np.zeros(2 * BUCKETS + 4), np.random.default_rng(SEED)
    xs = [(*features(at, toxic), y) for at, toxic, y in rows]
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(xs)):
            at, v, y = xs[i]
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(w[at] @ v)))))
            w[at] += RATE / (1 + epoch) * (y - p) * v / 3
    return w.astype(np.float32)


def score_documents(docs: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, votes (array of 0, 1, 2), posterior, score (0 to 1), keep (score of at least 0.5)."""
    spark = docs.sparkSession
    common.tune(spark)
    table = fit_stems(docs, labels) if labels is not None else Words()

    def count(batches):
        for batch in batches:
            p, n = np.unique([pattern(votes(t, table)) for t in batch.column(0).to_pylist()], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    counts = {r["pattern"]: r["n"] for r in docs.select("text").mapInArrow(common.lean(count), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # at most as many rows as patterns
    posterior = posteriors(counts)
    total = sum(counts.values())
    some = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, 1.2 * sample / max(1, total)) * (1 << 20)) + 1))
    rows = some.select("doc_id", "text", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
    upto = F.sum(F.coalesce("size", F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text"))  # of at most `sample` rows
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).collect()  # bounded by sample and SAMPLE_BYTES
    judged = [_judged(r["text"], table) for r in rows]
    w = train([(at, 2 in v[-3:-1], posterior[pattern(v)]) for v, at in judged])
    sent = spark.sparkContext.broadcast((w, posterior))  # a fixed number of weights, a posterior for each pattern

    def run(batches):
        w, posterior = sent.value
        for batch in batches:
            casts, score = [], []
            for t in batch.column(1).to_pylist():
                vote, words = _judged(t, table)
                at, v = features(words, 2 in vote[-3:-1])
                casts.append(vote)
                score.append(1 / (1 + math.exp(-min(30.0, max(-30.0, float(w[at] @ v))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(casts, pa.list_(pa.int32())), pa.array([posterior[pattern(v)] for v in casts], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= 0.5 for s in score], pa.bool_())], names=["doc_id", "votes", "posterior", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, votes array<int>, posterior double, score double, keep boolean")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    try:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException:  # a corpus without labels
        labels = None
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels=labels)
    return out.select("doc_id", F.concat_ws("", "votes").alias("votes"), "posterior", "score", "keep")
