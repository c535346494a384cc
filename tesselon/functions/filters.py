"""The textual filter language: text -> tree -> Column predicates.

A tree is compiled at three places: over versions (what exists at all, and so what is created or deleted), over snapshot
rows, and over contribution rows, where a creation is judged by its state after, a deletion by its state before, and any
other change passes if either side does, each part of an `and` by itself. Metrics of geometries never decide at the
version level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselon.functions import areas

TYPES = ("node", "way", "relation")
GEOMETRIES = ("point", "line", "polygon", "other")
#: Conjunctions a normal form may have.
MOST_TERMS = 10_000


@dataclass(frozen=True)
class State:
    """Columns of one state of an entity; what is None is unknown there."""

    osm_type: Column
    osm_id: Column
    tags: Column
    members: Column | None = None
    geometry: Column | None = None  # one of GEOMETRIES
    area: Column | None = None
    length: Column | None = None
    perimeter: Column | None = None
    vertices: Column | None = None
    outers: Column | None = None
    inners: Column | None = None
    roundness: Column | None = None
    squareness: Column | None = None
    changeset: Column | None = None
    contributor: Column | None = None

    @staticmethod
    def of(columns: list[str], prefix: str = "", suffix: str = "") -> State:
        """From columns named alike, of a row or of one side of it."""
        name = lambda c: F.col(f"{prefix}{c}{suffix}") if f"{prefix}{c}{suffix}" in columns or prefix.endswith(".") else None
        base = lambda c: name(c) if name(c) is not None else F.col(c)
        optional = {f: name(f) for f in ("members", "geometry", "area", "length", "perimeter", "vertices", "outers", "inners", "roundness", "squareness")}
        first = lambda *cs: next((F.col(c) for c in cs if c in columns), None)
        return State(base("osm_type"), base("osm_id"), base("tags"), **optional, changeset=first("changeset_id"), contributor=first("contributor_id"))


class Node:
    def negated(self) -> Node:
        raise NotImplementedError

    def version(self, s: State) -> Column:
        raise NotImplementedError

    def row(self, s: State) -> Column:
        return self.version(s)

    def contribution(self, before: State, after: State, creation: Column, deletion: Column) -> Column:
        a, b = self.row(before), self.row(after)
        return F.when(creation, b).when(deletion, a).otherwise(a | b)

    def types(self) -> frozenset[str]:
        """OSM types that may pass."""
        return frozenset(TYPES)

    def keys(self) -> frozenset[str]:
        """Tag keys that all that passes has."""
        return frozenset()

    def metrics(self) -> frozenset[str]:
        """What of a geometry must be known: `geometry` (its type) and metrics."""
        return frozenset()

    def terms(self) -> list[list[Node]]:
        return [[self]]


@dataclass(frozen=True)
class Constant(Node):
    value: bool

    def negated(self):
        return Constant(not self.value)

    def version(self, s):
        return F.lit(self.value)

    def __str__(self):
        return str(self.value).lower()


@dataclass(frozen=True)
class Tag(Node):
    """key with one of the values, or any (None); or not."""

    key: str
    values: tuple[str, ...] | None
    no: bool = False

    def negated(self):
        return replace(self, no=not self.no)

    def version(self, s):
        value = F.element_at(s.tags, F.lit(self.key))
        hit = value.isNotNull() if self.values is None else F.coalesce(value.isin(*self.values) if len(self.values) > 1 else value == self.values[0], F.lit(False))
        return ~hit if self.no else hit

    def keys(self):
        return frozenset() if self.no else frozenset((self.key,))

    def __str__(self):
        values = "*" if self.values is None else self.values[0] if len(self.values) == 1 else None
        if values is not None:
            return f"{self.key}{'!' * self.no}={values}"
        return f"{'not ' * self.no}{self.key} in ({', '.join(self.values)})"


@dataclass(frozen=True)
class Type(Node):
    name: str

    def negated(self):
        a, b = (Type(t) for t in TYPES if t != self.name)
        return Or(a, b)

    def version(self, s):
        return s.osm_type == self.name

    def types(self):
        return frozenset((self.name,))

    def __str__(self):
        return f"type:{self.name}"


@dataclass(frozen=True)
class Geometry(Node):
    name: str

    def negated(self):
        a, b, c = (Geometry(g) for g in GEOMETRIES if g != self.name)
        return Or(Or(a, b), c)

    def version(self, s):
        if self.name == "point":
            return s.osm_type == "node"
        if self.name == "line":
            return s.osm_type == "way"
        if self.name == "other":
            return s.osm_type == "relation"
        closed = F.lit(True)
        if s.members is not None:
            closed = F.coalesce((F.size(s.members) >= 4) & (F.element_at(s.members, 1)["id"] == F.element_at(s.members, -1)["id"]), F.lit(False))
        return (s.osm_type == "way") & closed | (s.osm_type == "relation") & areas.relation_is_area_column(s.tags)

    def row(self, s):
        return self.version(s) if s.geometry is None else F.coalesce(s.geometry == self.name, F.lit(False))

    def types(self):
        return frozenset({"point": ("node",), "line": ("way",), "polygon": ("way", "relation"), "other": ("relation",)}[self.name])

    def metrics(self):
        return frozenset(("geometry",))

    def __str__(self):
        return f"geometry:{self.name}"


@dataclass(frozen=True)
class Ids(Node):
    """Ids, a range of ids (bounds in either order), or not."""

    values: tuple[int, ...] = ()
    low: int | None = None
    high: int | None = None
    no: bool = False

    def negated(self):
        return replace(self, no=not self.no)

    def version(self, s):
        hit = s.osm_id.isin(*self.values) if self.values else _between(s.osm_id, self.low, self.high)
        return ~hit if self.no else hit

    def __str__(self):
        return f"{'not ' * self.no}id:" + (str(self.values[0]) if len(self.values) == 1 else f"({', '.join(map(str, self.values))})" if self.values else f"({_bound(self.low)}..{_bound(self.high)})")


@dataclass(frozen=True)
class Measure(Node):
    """A metric of the geometry, or a changeset or contributor, in a list or a range. Its negation is of the row's result."""

    what: str
    values: tuple[int, ...] = ()
    low: float | None = None
    high: float | None = None
    no: bool = False

    def negated(self):
        return replace(self, no=not self.no)

    def version(self, s):
        return F.lit(True)

    def types(self):
        """Nodes are points, or nowhere: where none of the metrics that these have passes, no node does."""
        of_nodes = {"changeset": (), "contributor": (), "vertices": (0, 1), "outers": (-1,), "inners": (-1,)}.get(self.what, (0,))
        hit = lambda x: x in self.values if self.values else (self.low is None or x >= self.low) and (self.high is None or x <= self.high)
        return frozenset(TYPES) if not of_nodes or any(hit(x) != self.no for x in of_nodes) else frozenset(("way", "relation"))

    def metrics(self):
        return frozenset() if self.what in ("changeset", "contributor") else frozenset((self.what,))

    def _hit(self, s):
        column = getattr(s, self.what)
        if column is None:
            raise ValueError(f"{self.what}: is not known here" + (" (it needs contributions)" if self.what in ("changeset", "contributor") else ""))
        return F.coalesce(column.isin(*self.values) if self.values else _between(column, self.low, self.high), F.lit(False))

    def row(self, s):
        if self.what in ("changeset", "contributor"):
            raise ValueError(f"{self.what}: can only be used with contributions")
        return ~self._hit(s) if self.no else self._hit(s)

    def contribution(self, before, after, creation, deletion):
        if self.what in ("changeset", "contributor"):
            hit = self._hit(after)
        else:
            a, b = self._hit(before), self._hit(after)
            hit = F.when(creation, b).when(deletion, a).otherwise(a | b)
        return ~hit if self.no else hit

    def __str__(self):
        name = {"vertices": "geometry.vertices", "outers": "geometry.outers", "inners": "geometry.inners", "roundness": "geometry.roundness", "squareness": "geometry.squareness"}.get(self.what, self.what)
        return f"{'not ' * self.no}{name}:" + (f"({', '.join(map(str, self.values))})" if self.values else f"({_bound(self.low)}..{_bound(self.high)})")


@dataclass(frozen=True)
class And(Node):
    a: Node
    b: Node

    def negated(self):
        return Or(self.a.negated(), self.b.negated())

    def version(self, s):
        return self.a.version(s) & self.b.version(s)

    def row(self, s):
        return self.a.row(s) & self.b.row(s)

    def contribution(self, *args):
        return self.a.contribution(*args) & self.b.contribution(*args)

    def types(self):
        return self.a.types() & self.b.types()

    def keys(self):
        return self.a.keys() | self.b.keys()

    def metrics(self):
        return self.a.metrics() | self.b.metrics()

    def terms(self):
        a, b = self.a.terms(), self.b.terms()
        if len(a) * len(b) > MOST_TERMS:
            raise OverflowError("the normal form has too many terms")
        return [x + y for x in a for y in b]

    def __str__(self):
        return f"{_inner(self.a)} and {_inner(self.b)}"


@dataclass(frozen=True)
class Or(Node):
    a: Node
    b: Node

    def negated(self):
        return And(self.a.negated(), self.b.negated())

    def version(self, s):
        return self.a.version(s) | self.b.version(s)

    def row(self, s):
        return self.a.row(s) | self.b.row(s)

    def contribution(self, *args):
        return self.a.contribution(*args) | self.b.contribution(*args)

    def types(self):
        return self.a.types() | self.b.types()

    def keys(self):
        return self.a.keys() & self.b.keys()

    def metrics(self):
        return self.a.metrics() | self.b.metrics()

    def terms(self):
        out = self.a.terms() + self.b.terms()
        if len(out) > MOST_TERMS:
            raise OverflowError("the normal form has too many terms")
        return out

    def __str__(self):
        return f"{self.a} or {self.b}"


@dataclass(frozen=True)
class Predicate(Node):
    """A predicate of the user over a state, for filters built in code."""

    of: object = field(compare=False)
    no: bool = False

    def negated(self):
        return replace(self, no=not self.no)

    def version(self, s):
        return ~self.of(s) if self.no else self.of(s)


def selective(node: Node) -> bool:
    """Whether a tree may refuse versions by more than their type."""
    if isinstance(node, (And, Or)):
        return selective(node.a) or selective(node.b)
    return not isinstance(node, (Constant, Measure, Type))


def _inner(node: Node) -> str:
    return f"({node})" if isinstance(node, Or) else str(node)


def _bound(x) -> str:
    return "" if x is None else str(x)


def _between(column: Column, low, high) -> Column:
    out = F.lit(True)
    if low is not None:
        out &= column >= low
    if high is not None:
        out &= column <= high
    return out


TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<sign>!=|\.\.|[=*(),/])|(?P<word>[a-zA-Z_0-9:-]+(?:\.(?!\.)[a-zA-Z_0-9:+-]+)*|\.\d[0-9eE+-]*))')
# fixed values: selectors of metrics
METRICS = {"area": "area", "length": "length", "perimeter": "perimeter", "geometry.vertices": "vertices", "geometry.outers": "outers", "geometry.inners": "inners", "geometry.roundness": "roundness", "geometry.squareness": "squareness"}


class Parser:
    """Parentheses before `not` before `and` before `or`; an empty text lets all pass. `contributor:` must be allowed."""

    def __init__(self, text: str, contributors: bool = False):
        self.text, self.contributors, self.tokens, at = text, contributors, [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the filter at: {text[at:]!r}")
            at = m.end()
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.at = 0

    def parse(self) -> Node:
        if not self.tokens:
            return Constant(True)
        out = self._or()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r} in the filter {self.text!r}")
        return out

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def _next(self, *wanted: str) -> str:
        token = self._peek()
        if token is None or wanted and token not in wanted:
            raise ValueError(f"expected {' or '.join(wanted) or 'more'} in the filter {self.text!r}")
        self.at += 1
        return token

    def _or(self) -> Node:
        out = self._and()
        while self._peek() == "or":
            self.at += 1
            out = Or(out, self._and())
        return out

    def _and(self) -> Node:
        out = self._not()
        while self._peek() == "and":
            self.at += 1
            out = And(out, self._not())
        return out

    def _not(self) -> Node:
        if self._peek() == "not":
            self.at += 1
            return self._not().negated()
        if self._peek() == "(":
            self.at += 1
            out = self._or()
            self._next(")")
            return out
        return self._selector()

    def _string(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "sign":
            raise ValueError(f"a key or value is missing in the filter {self.text!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        return re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "text" else text

    def _selector(self) -> Node:
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        head, colon, rest = word.partition(":") if kind == "word" else ("", "", "")
        following = self.tokens[self.at + 1][1] if self.at + 1 < len(self.tokens) else None
        if colon and following not in ("=", "!=", "in") and (head in ("type", "id", "geometry", "changeset", "contributor") or head in METRICS):
            self.at += 1
            return self._special(head, rest)
        key = self._string()
        sign = self._next("=", "!=", "in")
        if sign == "in":
            self._next("(")
            values = [self._string()]
            while self._next(",", ")") == ",":
                values.append(self._string())
            return Tag(key, tuple(values))
        if self._peek() == "*":
            self.at += 1
            return Tag(key, None, sign == "!=")
        return Tag(key, (self._string(),), sign == "!=")

    def _special(self, head: str, rest: str) -> Node:
        if head == "type":
            if rest not in TYPES:
                raise ValueError(f"not an OSM type: {rest}")
            return Type(rest)
        if head == "geometry":
            if rest not in GEOMETRIES:
                raise ValueError(f"not a geometry type: {rest}")
            return Geometry(rest)
        if head == "contributor" and not self.contributors:
            raise ValueError("contributor: is not allowed by this parser")
        whole = head not in ("area", "length", "perimeter", "geometry.roundness", "geometry.squareness")
        number = (lambda x: int(x)) if whole else float
        if head == "id":
            return self._ids(rest)
        what = METRICS.get(head, head)
        if rest:
            if head in ("area", "length", "perimeter", "geometry.vertices", "geometry.roundness", "geometry.squareness"):
                raise ValueError(f"{head}: needs a range")
            return Measure(what, (number(rest),))
        values, low, high = self._list(number)
        if values and head in METRICS:
            raise ValueError(f"{head}: needs a range")
        return Measure(what, tuple(values), low, high)

    def _list(self, number) -> tuple[list, object, object]:
        """(a, b), (a..b), (a..) or (..b)"""
        self._next("(")
        first = None if self._peek() == ".." else number(self._next())
        if self._peek() == "..":
            self.at += 1
            last = None if self._peek() == ")" else number(self._next())
            self._next(")")
            if first is None and last is None:
                raise ValueError("a range without bounds")
            return [], first, last
        values = [first]
        while self._next(",", ")") == ",":
            values.append(number(self._next()))
        return values, None, None

    def _ids(self, rest: str) -> Node:
        if rest in TYPES:
            self._next("/")
            return And(Type(rest), Ids((int(self._next()),)))
        if rest:
            return Ids((int(rest),))
        if self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] in TYPES:
            self._next("(")
            out = None
            while True:
                kind = self._next(*TYPES)
                self._next("/")
                one = And(Type(kind), Ids((int(self._next()),)))
                out = one if out is None else Or(out, one)
                if self._next(",", ")") == ")":
                    return out
        values, low, high = self._list(int)
        if low is not None and high is not None and low > high:
            low, high = high, low
        return Ids(tuple(values), low, high)


def parse(text: str, contributors: bool = False) -> Node:
    return Parser(text, contributors).parse()


def normal_form(node: Node) -> list[list[Node]]:
    """Alternatives of conjunctions; refused beyond MOST_TERMS."""
    return node.terms()
