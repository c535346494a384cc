"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with equal shingle sets form a class; classes are compared, copies never expand. A signature has COORDINATES
minima. Of these the first POSTED are posted: a class stands in the list of each of its coordinate-value pairs.

* Prefix. A pair at the least similarity agrees in T or more of the POSTED coordinates (all but one pair in 100,000
  right there). Each class orders its lists from the shortest to the longest and stays in the first POSTED - T + 1 alone:
  two classes that agree in T coordinates meet in one of these at least, whatever is left out. So what many documents
  share by a common line or passage makes no candidates, as such a class has rarer lists enough.
* Counts. Within a list collisions are counted over the whole signature (as bytes); pairs at or above a match threshold
  are candidates: 3.8 standard deviations below the mean at the least similarity (a pair right there is missed once in
  10,000).
* Skips, since only connection counts:
  1. Lists are cut into parts of some PART classes. Within a part the pairs of a spanning forest with the most matches are
     taken, all others skipped. They are confirmed on the full sets, list by list of the first coordinate, then those of
     the other coordinates whose ends are not yet connected (of several between two components, the one with the most
     matches).
  2. Lists that still hold several components are cut into blocks anew, those of the list's largest component apart, and
     blocks meet two by two (but for two of the largest component). A block is one row, so that what meets is rows of
     blocks, not of members. Every candidate pair between components is taken in the first list that it shares, and
     confirmed on the full sets unless others have joined its components within the two blocks.
So each candidate that joins different components is confirmed, at any length of a list, hot lists are split, and tight
groups cost a few pairs a document.

Rows: null text, text without words: empty set, no links. A null doc_id: its own component (null), never linked, kept.
Rows that repeat a doc_id each get their row. Empty tables stay empty. Extra columns are ignored (`keep_one` keeps them,
whatever their names). Texts of any length count whole; blocks are bounded by the shingles of their members too. Ties: of
equal counts of matches any pair may be taken, which changes no component; the least doc_id of a component is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm import common, graph

SHINGLE = 5
COORDINATES = 256
POSTED = 32
PART = 512
#: Members of a block, and shingles of all of them together, about.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Ids up to which the classes to be confirmed are sent to the scan of texts instead of shuffling the texts.
SEND_IDS = 500_000
BASE = 0x9E3779B97F4A7C15 | 1


def threshold(percent: int) -> int:
    """Least number of equal bytes of COORDINATES: 3.8 standard deviations below the mean at that similarity."""
    s = percent / 100
    return int(COORDINATES * (s + (1 - s) / 256) - 3.8 * (COORDINATES * s * (1 - s)) ** 0.5)


def agreeing(percent: int) -> int:
    """T: the most that all but one in 100,000 pairs at that similarity agree in, of the POSTED coordinates."""
    s, below = percent / 100, 0.0
    for t in range(POSTED):
        below += math.comb(POSTED, t) * s**t * (1 - s) ** (POSTED - t)
        if below > 1e-5:
            return max(1, t)
    return POSTED


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, COORDINATES + 1, dtype=np.uint64)
    a, b = common.mix(k * np.uint64(0xD1342543DE82EF95)), common.mix(k + np.uint64(0x632BE59BD9B4E019))
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (b >> np.uint64(32)).astype(np.uint32)


class Shingler:
    def __init__(self):
        self.words, self.powers, (self.a, self.b) = common.WordHash(), common.Powers(BASE), _coefficients()

    def set_of(self, text: bytes | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles."""
        words = (text or b"").lower().split()  # bytes: A-Z only
        if not words:
            return np.zeros(0, np.uint64)
        h = self.words.of(words)
        if len(words) < SHINGLE:
            return common.mix(common.ngrams(h, len(h), self.powers) + np.uint64(len(h)))
        return np.unique(common.ngrams(h, SHINGLE, self.powers))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        h, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(h), 1024):
            out = np.minimum(out, (h[k : k + 1024, None] * self.a + self.b).min(0))
        return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, digest (16 bytes of the set; null if empty), posted (32-bit minima), matches (a byte per coordinate)."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            n, digest, posted, matches = [], [], [], []
            for text in common.raw(batch.column(1)):
                s = shingler.set_of(text)
                n.append(len(s))
                if not len(s):
                    digest.append(None), posted.append(None), matches.append(None)
                    continue
                m = shingler.minima(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                posted.append(m[:POSTED].view(np.int32))
                matches.append((m * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(posted, pa.list_(pa.int32())), pa.array(matches, pa.binary())], names=["doc_id", "text_key", "n_shingles", "digest", "posted", "matches"])

    return docs.select("doc_id", "text", text_key("text").alias("text_key")).mapInArrow(common.lean(run), "doc_id long, text_key binary, n_shingles long, digest binary, posted array<int>, matches binary")


def groups(batches, n_keys: int):
    """Rows of equal leading columns from sorted batches: (key, columns after them)."""
    key, held = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def _find(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def forest(least: int):
    """mapInArrow over sorted (coordinate, list, part, digest, matches): spanning-forest pairs, and whether pairs were skipped."""

    def run(batches):
        out = [[] for _ in range(6)]

        def flush():
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["coordinate", "list", "a", "b", "n", "more"])

        for (coordinate, name, _), rows in groups(batches, 3):
            if len(rows) < 2:
                continue
            sig = np.frombuffer(b"".join([r[1] for r in rows]), np.uint8).reshape(len(rows), -1)
            found = []
            for i in range(len(rows) - 1):
                n = (sig[i] == sig[i + 1 :]).sum(1)
                found += [(int(n[j]), i, i + 1 + int(j)) for j in np.flatnonzero(n >= least)]
            if not found:
                continue
            up, taken = list(range(len(rows))), 0
            for n, i, j in sorted(found, reverse=True):
                x, y = _find(up, i), _find(up, j)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    taken += 1
                    for c, v in zip(out, (coordinate, name, rows[i][0], rows[j][0], n, taken < len(found)), strict=True):
                        c.append(v)
            out[5][-1] = taken < len(found)
            if len(out[0]) > 5000:
                yield flush()
                out = [[] for _ in range(6)]
        yield flush()

    return run


#: A member in a block: digest, component, the coordinates it kept (bits), the posted minima, a byte per coordinate.
MEMBER = np.dtype([("digest", "V16"), ("component", "V16"), ("kept", "<u4"), ("posted", "<u4", POSTED), ("matches", "u1", COORDINATES)])


def packed(batches):
    """mapInArrow over sorted (list, part, coordinate, digest, component, kept, posted, matches): a row (list, part, coordinate, members) for each block."""
    for (name, part, coordinate), rows in groups(batches, 3):
        out = np.zeros(len(rows), MEMBER)
        for k, (digest, component, kept, posted, matches) in enumerate(rows):
            out[k] = (digest, component, kept & 0xFFFFFFFF, np.array(posted, np.int32).view(np.uint32), np.frombuffer(matches, np.uint8))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((name, part, coordinate, out.tobytes()), kinds, strict=True)], names=["list", "part", "coordinate", "members"])


def _candidates(a: np.ndarray, b: np.ndarray, same: bool, coordinate: int, least: int):
    """(matches, x, y): x in a and y in b (same: one block) of different components whose first common list is that of the coordinate, with enough matches."""
    label: dict = {}
    of_a, of_b = (np.array([label.setdefault(bytes(c), len(label)) for c in m["component"]]) for m in (a, b))
    bit = np.uint32(1) << np.arange(POSTED, dtype=np.uint32)
    in_list = (b["kept"][:, None] & bit) > 0
    for x in range(len(a)):
        ok = of_b != of_a[x]
        if same:
            ok[: x + 1] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        common_lists = (b["posted"][at] == a["posted"][x]) & in_list[at] & ((a["kept"][x] & bit) > 0)
        at = at[common_lists.argmax(1) == coordinate]
        n = (b["matches"][at] == a["matches"][x]).sum(1)
        for k in np.flatnonzero(n >= least).tolist():
            yield int(n[k]), x, int(at[k])


INVOLVED = "list long, i int, j int, part int, coordinate int, digest binary, member binary"


def involved(least: int):
    """mapInArrow over (list, i, j, coordinate, members of block i, of block j): the members that have a candidate there."""

    def run(batches):
        for batch in batches:
            for name, i, j, coordinate, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(one, MEMBER), np.frombuffer(two, MEMBER)
                some: dict[tuple, bytes] = {}
                for _, x, y in _candidates(a, b, i == j, coordinate, least):
                    some[i, x] = a[x].tobytes()
                    some[j, y] = b[y].tobytes()
                if some:
                    n = len(some)
                    cols = ([name] * n, [i] * n, [j] * n, [part for part, _ in some], [coordinate] * n, [m[:16] for m in some.values()], list(some.values()))
                    kinds = [pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["list", "i", "j", "part", "coordinate", "digest", "member"])

    return run


def joining(least: int, percent: int):
    """mapInArrow over sorted (list, i, j, coordinate, part, member, shingles): confirmed pairs that join components; pairs that others have joined are skipped."""

    def run(batches):
        for (_, i, j, coordinate), rows in groups(batches, 4):
            sides = [[r for r in rows if r[0] == part] for part in dict.fromkeys((i, j))]
            members = [np.frombuffer(b"".join([r[1] for r in side]), MEMBER) for side in sides]
            sets = [[np.array(r[2], np.int64) for r in side] for side in sides]
            number: dict = {}
            of = [[number.setdefault(bytes(c), len(number)) for c in m["component"]] for m in members]
            up, a, b = list(range(len(number))), [], []
            for _, x, y in sorted(_candidates(members[0], members[-1], i == j, coordinate, least), reverse=True):
                u, v = _find(up, of[0][x]), _find(up, of[-1][y])
                if u == v:
                    continue
                few, many = sorted((sets[0][x], sets[-1][y]), key=len)
                both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                if 100 * both >= percent * (len(few) + len(many) - both):
                    up[max(u, v)] = min(u, v)
                    a.append(members[0]["digest"][x].tobytes())
                    b.append(members[-1]["digest"][y].tobytes())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def posting_lists(classes: DataFrame, percent: int) -> DataFrame:
    """Saved coordinate, list, digest, kept (bits of the coordinates whose lists the class stays in), parts, part: each class in its shortest lists, lists of one left out."""
    prefix = POSTED - agreeing(percent) + 1
    post = classes.select("digest", F.posexplode("posted").alias("coordinate", "value")).select("digest", "coordinate", F.xxhash64("coordinate", "value").alias("list"))
    # counts are saved before they are joined: then Spark can split the partitions of very long lists
    sizes = common.save(post.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "list-sizes")
    shared = post.join(sizes, "list").groupBy("digest").agg(F.collect_list(F.struct("m", "list", "coordinate")).alias("l"))  # POSTED at most
    # a list that is not shared is shorter than all others and holds no pair
    shared = shared.withColumn("l", F.slice(F.array_sort("l"), 1, F.greatest(F.lit(0), F.lit(prefix - POSTED) + F.size("l"))))
    kept = F.aggregate("l", F.lit(0), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["coordinate"])))
    short = common.save(shared.select("digest", kept.alias("kept"), F.explode("l").alias("x")).select("digest", "kept", "x.list", "x.coordinate"), "short-lists")
    common.drop(sizes)
    left = common.save(short.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "list-sizes")
    parts = F.ceil(F.col("m") / PART).cast("int")
    out = short.join(left, "list").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("digest", "coordinate"), F.col("parts")).cast("int"))
    out = common.save(out.select("coordinate", "list", "digest", "kept", "parts", "part"), "lists")
    common.drop(short)
    common.drop(left)
    return out


def blocks(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Saved list, part, coordinate, members: blocks of lists of several components; parts of a list's largest component are numbered below 0."""
    lists = common.save(lists.join(classes.select("digest", "n_shingles", "posted", "matches"), "digest"), "open-lists")
    n = lists.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    size = lambda c: F.greatest(F.ceil(F.col(f"{c}.n") / BLOCK), F.ceil(F.col(f"{c}.w") / BLOCK_SHINGLES)).cast("int")
    per_list = n.groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max(F.struct("n", "component", "w")).alias("major"), F.struct((F.sum("n") - F.max("n")).alias("n"), F.sum("w").alias("w")).alias("minor"))
    per_list = per_list.where("minor.n > 0").select("list", "largest", size("major").alias("n_major"), size("minor").alias("n_minor"))
    per_list = common.save(per_list, "list-components")
    at = F.xxhash64("digest", "list")
    part = F.when(F.col("component") == F.col("largest"), -1 - F.pmod(at, F.col("n_major"))).otherwise(F.pmod(at, F.col("n_minor"))).cast("int")
    rows = lists.join(per_list, "list").select("list", part.alias("part"), "coordinate", "digest", "component", "kept", "posted", "matches")
    keys = ["list", "part", "coordinate"]
    out = common.save(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(common.lean(packed), "list long, part int, coordinate int, members binary"), "blocks", "lz4")
    common.drop(lists)
    return out


def last_links(lists: DataFrame, classes: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (a, b) that join components of lists(coordinate, list, digest, kept, component), confirmed."""
    packs = blocks(lists, classes)
    one = packs.select("list", F.col("part").alias("i"), "coordinate", F.col("members").alias("one"))
    two = packs.select("list", F.col("part").alias("j"), F.col("members").alias("two"))
    met = one.join(two, "list").where("i <= j and j >= 0").select("list", "i", "j", "coordinate", "one", "two")
    some = common.save(met.mapInArrow(common.lean(involved(least)), INVOLVED), "involved")
    keys = ["list", "i", "j", "coordinate"]
    rows = some.join(sets, "digest").select(*keys, "part", "member", "shingles")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(common.lean(joining(least, percent)), "a binary, b binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Saved (digest, shingles) of the classes in wanted(digest, doc); doc is a document that has the set."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            digests, sets = [], []
            for digest, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True):
                s = shingler.set_of(text)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:  # else another row of the same doc_id
                    digests.append(digest)
                    sets.append(np.sort(common.signed(s)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])

    few = wanted.count() <= SEND_IDS
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(F.broadcast(wanted) if few else wanted, "doc").select("digest", "text")
    return common.save(texts.mapInArrow(common.lean(run), "digest binary, shingles array<long>"), "shingle-sets", "lz4")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Saved pairs (a, b) of at least that similarity on the full sets."""
    a, b = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    ok = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return common.save(pairs.select("a", "b").distinct().join(a, "a").join(b, "b").where(ok).select("a", "b"), "links")


def _moved(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with ca, cb: the components of their ends; pairs within one are gone."""
    a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    out = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return out.where("ca <> cb")


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """near_groups with text_key and a column more, group: what the rows of a component have in common; null of an empty set."""
    common.tune(docs.sparkSession)
    least, before = threshold(percent), common.written()
    signed = common.save(signatures(docs), "signatures")
    one = lambda c: F.first(c).alias(c)
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), one("n_shingles"), one("posted"), one("matches"))
    classes = common.save(classes, "classes")
    lists = posting_lists(classes, percent)
    keys = ["coordinate", "list", "part"]
    with_matches = lists.join(classes.select("digest", "matches"), "digest").select(*keys, "digest", "matches")
    trees = with_matches.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(common.lean(forest(least)), "coordinate int, list long, a binary, b binary, n int, more boolean")
    trees = common.save(trees, "forest")
    pairs = trees.select("coordinate", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")

    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    # parts of long lists may hold candidates that no forest shows
    far = lists.where("parts > 1").select("digest").distinct()
    wanted = classes.join(ends.union(far).distinct(), "digest", "left_semi").select("digest", "doc")
    sets = shingle_sets(docs, common.save(wanted, "wanted"))

    links = confirmed(pairs.where("coordinate = 0"), sets, percent)
    labels = graph.components(links)
    left = _moved(pairs.where("coordinate > 0"), labels)
    left = left.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.max_by(F.struct("a", "b"), "n").alias("p")).select("p.a", "p.b")
    links = common.save(links.union(confirmed(left, sets, percent)), "links")
    labels = graph.components(links)

    open_lists = trees.where("more").select("list").union(lists.where("parts > 1").select("list")).distinct()
    left = lists.join(open_lists, "list", "left_semi").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    left = left.select("coordinate", "list", "digest", "kept", F.coalesce("component", "digest").alias("component"))
    links = common.save(links.union(last_links(left, classes, sets, least, percent)), "links")
    labels = graph.components(links)

    smallest = classes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "doc", F.coalesce("component", "digest").alias("component"))
    smallest = common.save(smallest, "class-components")
    common.tidy(before, signed, smallest)
    least_doc = smallest.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_class = smallest.join(least_doc, "component").select("digest", F.col("component_id").alias("c"), F.col("component").alias("group"))
    out = signed.select("doc_id", "text_key", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("c", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", "group")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def text_key(column: str):
    """128 bits that tell the texts of one doc_id apart; null of null."""
    return F.unhex(F.md5(F.encode(column, "UTF-8")))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without those that have a near-duplicate of a smaller doc_id in their component.

    Rows that repeat a doc_id are judged each by its own text; of those in one component (or of equal texts without words)
    one stays. All rows of a null doc_id stay.
    """
    judged = _grouped(docs.select("doc_id", "text"), percent).where("kept and doc_id is not null").select("doc_id", "text_key", "group").distinct()
    names = [f"column{k}" for k in range(len(docs.columns))]  # inner names, so that none can clash
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    known = rows.where(F.col(doc).isNotNull()).withColumn("key", text_key(text))
    known = known.join(judged, (F.col(doc) == F.col("doc_id")) & F.col("key").eqNullSafe(F.col("text_key")))
    one = Window.partitionBy("doc_id", F.coalesce("group", "key")).orderBy("key")
    known = known.withColumn("place", F.row_number().over(one)).where("place = 1")
    return known.select(*names).union(rows.where(F.col(doc).isNull())).toDF(*docs.columns)


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle.
OP4_SQL = r"""
with recursive words as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), shingle as (
  select distinct r, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)
), size as (select r, count(*) as n from shingle group by r),
shared as (select a.r, b.r as s, count(*) as k from shingle a join shingle b on a.g = b.g and a.r < b.r group by a.r, b.r),
link as (select shared.r, shared.s from shared join size x on x.r = shared.r join size y on y.r = shared.s where 100 * k >= 75 * (x.n + y.n - k)),
links as (select r, s from link union all select s, r from link),
reach as (select r, r as s from words union select reach.r, links.s from reach join links on links.r = reach.s)
select w.doc_id, coalesce(any_value(size.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id, w.doc_id = min(o.doc_id) as kept
from words w join reach on reach.r = w.r join words o on o.r = reach.s left join size on size.r = w.r group by w.r, w.doc_id
"""
