"""HTML extraction by nearest-URL page differencing.

A page is read into lines: the text of its blocks, with character references decoded, white space turned into one
blank, and the zone each stands in: article (in an article or main element), frame (in a main element that holds articles
with more text than stands beside them: beside these), boilerplate (in an element, or one with a class, id or role, that
names a menu, header, footer, sidebar, notice, advert, form, script, style or comment), or open. Classes and ids are matched as whole tokens, on inline elements only those that name adverts and sharing. An article inside
a wrapper that only its class or id names so is the article where the page declares no other.

Pages of a host with equal lines outside the article, and if these hold a frame with equal articles too, form a class, for
which its first page stands; classes are ordered by URL path. A class's partner is the neighbour with the longer common
start of the path (of equals the one before), so a page is compared with the nearest page that is not a copy of it. The lines outside the article of both are aligned by their longest common subsequence and lines both share are
deleted, unless more than MOST_SHARED of the lines that may be text, those of the article included, are shared: such pages
are near copies, of which differencing cannot tell what is the text, and the other neighbour is tried. Where a page declares
its article, that and the lines of the frame that are not shared (a title, but no path of menus and no heading of what else
there is) are the text: open lines go whether shared or not, and lines of the article stay although a neighbour may hold the
same article. Where it does not, the open lines that are not shared are the text.

A page is parsed once, to a table of its lines; only a key, a path and line hashes of each class travel for the pairing.
Hot hosts are no group: order and partners come from one range-partitioned sort.

Rows: null html is an empty page, null URLs are a host of their own. Repeated rows are pages of their own, and copies of each
other. An empty table gives no rows; extra columns are ignored, whatever their names. Pages of any length are read whole.
Quotes that are never closed end with their tag.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import common

ARTICLE, OPEN, BOILERPLATE, FRAME, WRAPPED, WRAPPED_FRAME = range(6)  # wrapped: in a wrapper named as boilerplate, while a page is read
#: Zones of elements that declare the article: as they are, and in such a wrapper.
DECLARED = {"article": (ARTICLE, WRAPPED), "main": (FRAME, WRAPPED_FRAME)}
# a quoted value belongs to an attribute, and holds no tag; a quote anywhere else is a character like others
VALUE = r"=\s*\"(?:[^\"<]|<(?![a-zA-Z/!]))*\"|=\s*'(?:[^'<]|<(?![a-zA-Z/!]))*'"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|{VALUE}|=)*)(?:>|\Z)", re.S)
#: Share of a page's lines that may be text that a partner may have too; beyond it the two are copies.
MOST_SHARED = 0.9
# fixed names of HTML elements
RAW = frozenset("script style noscript template textarea iframe title svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
# elements that end where one of their group begins
GROUPS = ({"p"}, {"li"}, {"dt", "dd"}, {"td", "th"}, {"tr", "td", "th"}, {"thead", "tbody", "tfoot", "tr", "td", "th"}, {"option"})
ENDS = {"p": GROUPS[0], "li": GROUPS[1], "dt": GROUPS[2], "dd": GROUPS[2], "td": GROUPS[3], "th": GROUPS[3], "tr": GROUPS[4], "thead": GROUPS[5], "tbody": GROUPS[5], "tfoot": GROUPS[5], "option": GROUPS[6]}
SKIPPED = frozenset("head nav header footer aside form button select menu dialog".split())
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer masthead menu nav navbar navigation newsletter notice notices popup promo promoted related respond reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
NAMES |= frozenset("ad-banner comment-list comments-area cookie-banner cookie-notice main-menu main-nav newsletter-signup related-posts share-buttons site-footer site-header site-navigation social-share user-comments".split())
INLINE_NAMES = frozenset("ad ads advert advertisement adverts promo promoted sponsor sponsored share sharing share-buttons social-share newsletter-signup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _named(attributes: str, names: frozenset = NAMES) -> tuple[bool, bool]:
    """Whether a role, and whether a class or id, names boilerplate."""
    role = name = False
    if "=" in attributes:
        for kind, *values in ATTRIBUTE.findall(attributes):
            tokens = "".join(values).lower().split()
            if kind.lower() == "role":
                role = role or not ROLES.isdisjoint(tokens)
            else:
                name = name or not names.isdisjoint(tokens)
    return role, name


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block that has text, in page order."""
    out, held, at, stack, zone, wrapper, main = [], [], 0, [], OPEN, False, False
    size: Counter = Counter()  # code points of main elements: of their articles, and beside these
    page = page or ""

    def block():
        for z in dict.fromkeys(z for z, _ in held):  # one, but for adverts within a line
            text = " ".join(entities.unescape("".join([t for y, t in held if y == z])).split())
            if text:
                out.append((z, text))
                if main:
                    size[z] += len(text)
        held.clear()

    def leave(depth: int):
        nonlocal zone, wrapper, main
        zone, wrapper, main = stack[depth][1:]
        del stack[depth:]

    while True:
        tag = TAG.search(page, at)
        held.append((zone, page[at : tag.start() if tag else len(page)]))
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name in INLINE:
            if closing:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name or stack[k][0] not in INLINE), None)
                if depth is not None and stack[depth][0] == name:
                    leave(depth)
            elif name not in VOID and not tag[3].endswith("/"):
                stack.append((name, zone, wrapper, main))
                if zone != BOILERPLATE and _named(tag[3], INLINE_NAMES)[1]:
                    zone = BOILERPLATE
            continue
        block()
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                leave(depth)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        # what ends here: of elements that end by themselves the outermost of the group; a paragraph before any block
        group, depth = ENDS.get(name, GROUPS[0]), None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] not in ENDS and stack[k][0] not in INLINE:
                break
            if stack[k][0] in group:
                depth = k
        if depth is not None:
            leave(depth)
        stack.append((name, zone, wrapper, main))
        role, token = _named(tag[3]) if name not in ("body", "html") else (False, False)
        if zone != BOILERPLATE:
            if name in DECLARED:
                if name == "article" or zone not in (ARTICLE, WRAPPED):
                    zone, main = DECLARED[name][zone in (WRAPPED, WRAPPED_FRAME)], main or name == "main"
            elif name in SKIPPED and not (name == "header" and zone != OPEN) or role:
                zone, wrapper = BOILERPLATE, False
            elif token:
                zone, wrapper = BOILERPLATE, zone == OPEN
        elif name in SKIPPED or role:
            wrapper = False
        elif wrapper and name in DECLARED:
            zone, wrapper, main = DECLARED[name][1], False, main or name == "main"
    block()
    if any(z in (ARTICLE, FRAME) for z, _ in out):
        final, frame = {WRAPPED: BOILERPLATE, WRAPPED_FRAME: BOILERPLATE}, size[ARTICLE] > size[FRAME]
    else:
        final, frame = {WRAPPED: ARTICLE, WRAPPED_FRAME: FRAME}, size[WRAPPED] > size[WRAPPED_FRAME]
    out = [(final.get(z, z), t) for z, t in out]
    return out if frame else [(ARTICLE if z == FRAME else z, t) for z, t in out]  # without a frame a main element is all article


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


def common_lines(a: list, b: list) -> list[int]:
    """Places in a of one longest common subsequence of a and b."""
    start, ea, eb = 0, len(a), len(b)
    while start < min(ea, eb) and a[start] == b[start]:
        start += 1
    while min(ea, eb) > start and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    where: dict = {}
    for j in range(eb - 1, start - 1, -1):  # descending: a line of a is taken once
        where.setdefault(b[j], []).append(j)
    ends, chain = [], []  # chain: (place in a, the one before)
    tails: list[int] = []
    for i in range(start, ea):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            chain.append((i, tails[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                tails.append(len(chain) - 1)
            else:
                ends[k], tails[k] = j, len(chain) - 1
    middle, at = [], tails[-1] if tails else -1
    while at >= 0:
        middle.append(chain[at][0])
        at = chain[at][1]
    return [*range(start), *reversed(middle), *range(ea, len(a))]


def _common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


LINES = "page_id long, url string, host string, path string, key long, zones binary, texts array<string>, lines array<long>, body array<long>"


def _key(zones: bytes, lines: np.ndarray, body: np.ndarray) -> int:
    """A hash of what the pages of a class have in common."""
    parts = [bytes([len(body) > 0]), zones.replace(bytes([ARTICLE]), b""), lines.tobytes(), body.tobytes() if FRAME in zones else b""]
    return xxhash.xxh3_64_intdigest(b"".join(len(x).to_bytes(8, "little") + x for x in parts)) - (1 << 63)


def page_lines(pages: DataFrame) -> DataFrame:
    """Saved: each page's zones (a byte for each line) and texts, the hashes of its lines outside the article and in it (body), and the key of its class."""
    common.tune(pages.sparkSession)

    def read(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = lines_of(page)
                zones = bytes(z for z, _ in lines)
                hashes = [np.array([xxhash.xxh3_64_intdigest(t) for z, t in lines if (z == ARTICLE) == inside], np.uint64).view(np.int64) for inside in (False, True)]
                for c, v in zip(cols, (*host_and_path(url), _key(zones, *hashes), zones, [t for _, t in lines], *hashes), strict=True):
                    c.append(v)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in LINES.split(", ")])

    return common.save(pages.select("page_id", "url", "html").mapInArrow(common.lean(read), LINES), "page-lines")


def shared_lines(read_pages: DataFrame) -> DataFrame:
    """Saved host, key, partner (its page_id), shared: for each class of a host's pages, the places among the lines outside the article of those that its partner has too."""

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(n, n + batch.num_rows), pa.int64())], names=[*batch.schema.names, "part", "place"])
            n += batch.num_rows

    schema = "host string, key long, path string, page_id long, zones binary, lines array<long>, body array<long>"
    keys = ["host", "path", "page_id", "key"]
    first = F.min(F.struct("path", "page_id", "zones", "body"))
    classes = read_pages.groupBy("host", "key").agg(first.alias("first"), F.first("lines").alias("lines"))
    classes = common.save(classes.select("host", "key", "first.path", "first.page_id", "first.zones", "lines", "first.body"), "page-classes")
    ordered = classes.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(common.lean(number), f"{schema}, part int, place long")
    ordered = common.save(ordered, "page-order")
    base, total = {}, 0
    for part, n in sorted(map(tuple, ordered.groupBy("part").agg(F.count(F.lit(1))).collect())):  # a row for each partition
        base[part], total = total, total + n
    if not total:
        return read_pages.sparkSession.createDataFrame([], "host string, key long, partner long, shared array<int>")
    numbers = F.create_map(*[F.lit(x) for p, b in base.items() for x in (p, b)])
    placed = ordered.withColumn("n", F.col("place") + numbers[F.col("part")])
    mine = placed.select("host", "path", "key", "zones", "lines", "body", "n")
    near = placed.select("host", "n", F.struct("path", "page_id", "lines", "body").alias("near"))
    before = near.select(F.col("host").alias("host_b"), (F.col("n") + 1).alias("n"), F.col("near").alias("before"))
    after = near.select(F.col("host").alias("host_a"), (F.col("n") - 1).alias("n"), F.col("near").alias("after"))
    met = mine.join(before, "n", "left").join(after, "n", "left")
    met = met.select("host", "key", "path", "zones", "lines", "body", F.when(F.col("host_b") == F.col("host"), F.col("before")).alias("before"), F.when(F.col("host_a") == F.col("host"), F.col("after")).alias("after"))

    def align(batches):
        for batch in batches:
            partners, shared = [], []
            for path, zones, lines, body, *sides in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                partner, places = None, []
                may = [z == (FRAME if body else OPEN) for z in zones if z != ARTICLE]  # be text
                for near in sorted((x for x in sides if x), key=lambda x: -_common_start(path, x["path"])):
                    same = common_lines(lines, near["lines"])
                    alike = sum(may[i] for i in same) + (Counter(body) & Counter(near["body"])).total()
                    if alike <= MOST_SHARED * (sum(may) + len(body)):
                        partner, places = near["page_id"], same
                        break
                partners.append(partner)
                shared.append(places)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(partners, pa.int64()), pa.array(shared, pa.list_(pa.int32()))], names=["host", "key", "partner", "shared"])

    return common.save(met.mapInArrow(common.lean(align), "host string, key long, partner long, shared array<int>"), "shared-lines")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, partner, n_shared (lines deleted because the partner has them)."""
    rows, before = page_lines(pages), common.written()
    shared = shared_lines(rows)
    common.tidy(before, shared)
    joined = rows.join(shared, ["host", "key"], "left").select("page_id", "url", "zones", "texts", "partner", "shared")

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for zones, lines, places in zip(*(batch.column(k).to_pylist() for k in (2, 3, 5)), strict=True):
                gone, outside = set(places or ()), iter(range(len(lines)))
                deleted = [z != ARTICLE and next(outside) in gone for z in zones]
                wanted = (ARTICLE, FRAME) if ARTICLE in zones else (OPEN,)
                texts.append(" ".join([t for z, t, d in zip(zones, lines, deleted, strict=True) if z in wanted and not d]))
                counts.append(sum(deleted))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(4), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars", "partner", "n_shared"])

    return joined.mapInArrow(common.lean(run), "page_id long, url string, text string, n_chars long, partner long, n_shared long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


#: Holds for pages that declare their article and use the references named here only, as the driver's pages do.
OP8_SQL = r"""
with body as (
  select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') as b from pages
), bare as (
  select page_id, url, regexp_replace(regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '<[/a-z0-9]*$', '') as b from body
), decoded as (
  select page_id, url, replace(replace(replace(replace(b, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as b from bare
), plain as (select page_id, url, trim(regexp_replace(regexp_replace(b, '&amp$', '&'), '\s+', ' ', 'g')) as text from decoded)
select page_id, url, text, length(text)::bigint as n_chars from plain
"""
