"""Query trees. Nodes are frozen and compare by structure; str() gives the usual clause notation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

MAX_CLAUSES = 1024


class Visitor:
    def enter(self, query: Query) -> bool:
        return True

    def leaf(self, query: Query) -> None:
        pass


class Query:
    def children(self) -> tuple[Query, ...]:
        return ()

    def walk(self) -> Iterator[Query]:
        yield self
        for c in self.children():
            yield from c.walk()

    def terms(self) -> set[tuple[str, str]]:
        return {(q.field, q.term) for q in self.walk() if isinstance(q, Term)} | set().union(*[q.terms() for q in self.walk() if isinstance(q, Phrase)] or [set()])

    def visit(self, visitor: Visitor) -> None:
        """Shows the tree to a visitor, which may decline a node and all below it."""
        if visitor.enter(self):
            for c in self.children():
                c.visit(visitor)
            if not self.children():
                visitor.leaf(self)


class Occur(Enum):
    MUST = "+"
    FILTER = "#"
    SHOULD = ""
    MUST_NOT = "-"


@dataclass(frozen=True)
class Term(Query):
    """Documents with the exact term, scored. df and docs, if given, replace the index's statistics."""

    field: str
    term: str
    df: int | None = None
    docs: int | None = None

    def __str__(self) -> str:
        return f"{self.field}:{self.term}"


@dataclass(frozen=True)
class Phrase(Query):
    """Documents with the terms in this order and at most slop other positions between them; needs a field with positions.

    Occurrences count like those of one term whose idf is the sum of the terms'."""

    field: str
    words: tuple[str, ...]
    slop: int = 0

    def __post_init__(self) -> None:
        if not self.words or self.slop < 0:
            raise ValueError("a phrase needs words and a slop of at least 0")

    def terms(self) -> set[tuple[str, str]]:
        return {(self.field, w) for w in self.words}

    def __str__(self) -> str:
        return f'{self.field}:"{" ".join(self.words)}"' + (f"~{self.slop}" if self.slop else "")


@dataclass(frozen=True)
class MatchAll(Query):
    def __str__(self) -> str:
        return "*:*"


@dataclass(frozen=True)
class MatchNone(Query):
    reason: str = ""

    def __str__(self) -> str:
        return "-*:*"


@dataclass(frozen=True)
class PointRange(Query):
    """Every dimension within [lower, upper]. columns names one column a dimension; with `points`, an array column of structs of which one must fit in all dimensions."""

    columns: tuple[str, ...]
    lower: tuple
    upper: tuple
    points: str | None = None

    def __post_init__(self) -> None:
        if not self.columns or not len(self.columns) == len(self.lower) == len(self.upper):
            raise ValueError("as many bounds as dimensions are needed")

    def __str__(self) -> str:
        return " ".join(f"{c}:[{a} TO {b}]" for c, a, b in zip(self.columns, self.lower, self.upper, strict=True))


def point(column: str, value) -> PointRange:
    return PointRange((column,), (value,), (value,))


@dataclass(frozen=True)
class PointSet(Query):
    """Points (tuples, one value a dimension) of which the document holds one."""

    columns: tuple[str, ...]
    values: tuple[tuple, ...]

    def __str__(self) -> str:
        return f"{','.join(self.columns)}:{{{' '.join(map(str, self.values))}}}"


class Relation(Enum):
    INTERSECTS = "intersects"
    WITHIN = "within"
    CONTAINS = "contains"
    CROSSES = "crosses"


@dataclass(frozen=True)
class RangeField(Query):
    """Relation of the document's box (columns of mins and maxs, one pair a dimension) to the query's box."""

    mins: tuple[str, ...]
    maxs: tuple[str, ...]
    lower: tuple
    upper: tuple
    relation: Relation = Relation.INTERSECTS

    def __post_init__(self) -> None:
        if not self.mins or len({len(self.mins), len(self.maxs), len(self.lower), len(self.upper)}) > 1:
            raise ValueError("as many bounds as dimensions are needed")
        if any(a != a or b != b or a > b for a, b in zip(self.lower, self.upper, strict=True)):
            raise ValueError("bounds must be ordered and not NaN")

    def __str__(self) -> str:
        return f"{self.relation.value}({','.join(self.mins)}:[{self.lower} TO {self.upper}])"


@dataclass(frozen=True)
class TermSet(Query):
    field: str
    values: frozenset[str]

    def __str__(self) -> str:
        return f"{self.field}:({' '.join(sorted(self.values))})"


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str

    def __str__(self) -> str:
        return f"{self.field}:{self.prefix}*"


@dataclass(frozen=True)
class TermRange(Query):
    """Terms in byte order between two ends, either of which may be open (None)."""

    field: str
    lower: str | None = None
    upper: str | None = None
    include_lower: bool = True
    include_upper: bool = True

    def __str__(self) -> str:
        return f"{self.field}:{'[' if self.include_lower else '{'}{self.lower or '*'} TO {self.upper or '*'}{']' if self.include_upper else '}'}"


@dataclass(frozen=True)
class Regex(Query):
    """Documents with any term that the whole pattern accepts."""

    field: str
    pattern: str

    def __str__(self) -> str:
        return f"{self.field}:/{self.pattern}/"


def wildcard(field: str, pattern: str) -> Regex:
    """* any run, ? any one character, backslash quotes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c = "\\" + pattern[i] if not pattern[i].isalnum() else pattern[i]
        elif c == "*":
            c = ".*"
        elif c == "?":
            c = "."
        elif not c.isalnum():
            c = "\\" + c if ord(c) < 128 else c
        out.append(c)
        i += 1
    return Regex(field, "(?s)" + "".join(out))


@dataclass(frozen=True)
class Scoring(Query):
    """A multi-term query rewritten to scored clauses of the `most` most frequent of its terms, instead of a constant score for all.

    The dictionary is asked when the query runs; the terms kept are as many as a boolean query may have."""

    field: str
    condition: str  # SQL over term
    most: int = MAX_CLAUSES

    def rewritten(self, index) -> Query:
        found = index.term_stats.where(f"field = '{self.field}' and ({self.condition})").orderBy("df", "term", ascending=[False, True]).limit(min(self.most, MAX_CLAUSES)).collect()
        return boolean(should=[Term(self.field, r.term) for r in found]) if found else MatchNone("no terms")

    def __str__(self) -> str:
        return f"{self.field}:<{self.condition}>"


@dataclass(frozen=True)
class Exists(Query):
    column: str

    def __str__(self) -> str:
        return f"exists({self.column})"


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    boost: float

    def __post_init__(self) -> None:
        if not 0 <= self.boost < 2**31 - 1:
            raise ValueError("boost must be at least 0 and finite")

    def children(self) -> tuple[Query, ...]:
        return (self.query,)

    def __str__(self) -> str:
        return f"({self.query})^{self.boost}"


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query

    def children(self) -> tuple[Query, ...]:
        return (self.query,)

    def __str__(self) -> str:
        return f"ConstantScore({self.query})"


@dataclass(frozen=True)
class DisMax(Query):
    """Union; the best sub-score plus tie times the others."""

    queries: tuple[Query, ...]
    tie: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.tie <= 1:
            raise ValueError("tie must be between 0 and 1")

    def children(self) -> tuple[Query, ...]:
        return self.queries

    def __str__(self) -> str:
        return f"({' | '.join(map(str, self.queries))})~{self.tie}"


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[tuple[Occur, Query], ...]
    minimum: int = 0
    max_clauses: int = MAX_CLAUSES

    def __post_init__(self) -> None:
        if not self.clauses:
            raise ValueError("a boolean query needs clauses")
        if len(self.clauses) > self.max_clauses:
            raise ValueError(f"more than {self.max_clauses} clauses")

    def children(self) -> tuple[Query, ...]:
        return tuple(q for _, q in self.clauses)

    def of(self, occur: Occur) -> tuple[Query, ...]:
        return tuple(q for o, q in self.clauses if o is occur)

    def __str__(self) -> str:
        inner = " ".join(o.value + (f"({q})" if isinstance(q, Boolean) else str(q)) for o, q in self.clauses)
        return f"({inner})~{self.minimum}" if self.minimum else inner


def boolean(must=(), filter=(), should=(), must_not=(), minimum: int = 0) -> Boolean:  # noqa: A002
    groups = ((Occur.MUST, must), (Occur.FILTER, filter), (Occur.SHOULD, should), (Occur.MUST_NOT, must_not))
    return Boolean(tuple((o, q) for o, qs in groups for q in qs), minimum)
