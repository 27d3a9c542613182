"""Rewrites of query trees to a fixpoint, before any DataFrame exists. None of them changes matches or scores."""

from __future__ import annotations

from collections import Counter

from siftwell.operators.query import Boolean, Boost, ConstantScore, DisMax, MatchAll, MatchNone, Occur, Query

M, FI, S, N = Occur.MUST, Occur.FILTER, Occur.SHOULD, Occur.MUST_NOT


def rewrite(query: Query, scores: bool = True, limit: int = 1000) -> Query:
    for _ in range(limit):
        new = step(query, scores)
        if new == query:
            return query
        query = new
    raise RuntimeError("rewriting doesn't settle")


def step(q: Query, scores: bool) -> Query:
    if isinstance(q, Boost):
        inner = step(q.query, scores and q.boost > 0)
        if isinstance(inner, MatchNone) or q.boost == 1:
            return inner
        if isinstance(inner, Boost):
            return Boost(inner.query, inner.boost * q.boost)
        if q.boost == 0 and not isinstance(inner, ConstantScore | MatchAll):
            return Boost(ConstantScore(inner), 0.0)
        return Boost(inner, q.boost)
    if isinstance(q, ConstantScore):
        inner = step(q.query, False)
        while isinstance(inner, ConstantScore | Boost):
            inner = inner.query
        return inner if isinstance(inner, MatchNone | MatchAll) else ConstantScore(inner)
    if isinstance(q, DisMax):
        inner = tuple(x for x in (step(c, scores) for c in q.queries) if not isinstance(x, MatchNone))
        return inner[0] if len(inner) == 1 else DisMax(inner, q.tie) if inner else MatchNone("nothing to choose from")
    return _boolean(q, scores) if isinstance(q, Boolean) else q


def _boosted(q: Query, n: float) -> Query:
    return q if n == 1 else Boost(q.query, q.boost * n) if isinstance(q, Boost) else Boost(q, float(n))


def _merged(queries: tuple[Query, ...]) -> list[Query]:
    """Equal queries once, their boosts summed."""
    weights: Counter = Counter()
    for q in queries:
        base, w = (q.query, q.boost) if isinstance(q, Boost) else (q, 1.0)
        weights[base] += w
    return [_boosted(base, w) for base, w in weights.items()]


def _boolean(q: Boolean, scores: bool) -> Query:
    must, filters, should, without = (list(q.of(o)) for o in (M, FI, S, N))
    if q.minimum > len(should):
        return MatchNone("too few optional clauses")
    minimum = q.minimum
    must, should = [step(x, scores) for x in must], [step(x, scores) for x in should]
    filters, without = [step(x, False) for x in filters], [step(x, False) for x in without]
    if any(isinstance(x, MatchNone) for x in must + filters):
        return MatchNone("a required clause matches nothing")
    without = list(dict.fromkeys(x for x in without if not isinstance(x, MatchNone)))
    should = [x for x in should if not isinstance(x, MatchNone)]
    if minimum > len(should):
        return MatchNone("too few optional clauses")
    if any(isinstance(x, MatchAll) for x in without) or set(without) & set(must + filters):
        return MatchNone("excluded")
    if not must and not filters and not should:
        return MatchNone("only exclusions")
    filters = list(dict.fromkeys(x.query if isinstance(x, ConstantScore) else x for x in filters))
    filters = [x for x in filters if x not in must]
    if must or minimum > 0 or any(not isinstance(x, MatchAll) for x in filters):  # something else is required
        filters = [x for x in filters if not isinstance(x, MatchAll)]
    if should and minimum == len(should) and minimum > 0:
        must, should, minimum = must + should, [], 0
    both = [x for x in should if x in filters]
    if both:  # required anyway, so its score always counts
        filters = [x for x in filters if x not in both]
        must += list(dict.fromkeys(both))
        for x in dict.fromkeys(both):
            should.remove(x)
        minimum = max(0, minimum - len(dict.fromkeys(both)))
    if minimum <= 1:
        flat: list[Query] = []
        for x in should:
            flat += x.of(S) if isinstance(x, Boolean) and x.minimum <= 1 and len(x.of(S)) == len(x.clauses) else [x]
        should = _merged(tuple(flat))
    must = _merged(tuple(must))
    if not scores:
        filters, must = list(dict.fromkeys(filters + [x.query if isinstance(x, Boost | ConstantScore) else x for x in must])), []
        if filters and minimum == 0:
            should = []
    if len(must) == 1 and isinstance(must[0], MatchAll) and filters and not should and not without:
        return ConstantScore(filters[0] if len(filters) == 1 else Boolean(tuple((FI, x) for x in filters)))
    if not filters and not without and minimum <= 1:
        if len(must) == 1 and not should:
            return must[0]
        if len(should) == 1 and not must:
            return should[0]
    if len(filters) == 1 and not must and not should and not without:
        return Boost(ConstantScore(filters[0]), 0.0)
    clauses = tuple((o, x) for o, xs in ((M, must), (FI, filters), (S, should), (N, without)) for x in xs)
    return Boolean(clauses, minimum)
