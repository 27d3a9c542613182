"""Prospective search: each arriving document against stored queries, as if it were the only document of an index.

With one document N = 1, df = 1 and avgdl = dl, so a term's score depends on its count and the document's length alone: no state
and no shuffle are needed, and the same expression serves batches and streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.analysis import STANDARD, Analyzer, with_tokens
from siftwell.functions.similarity import BM25
from siftwell.operators import query as Q
from siftwell.plans.rewrite import rewrite


def score_column(query: Q.Query, fields: dict[str, str], similarity: BM25 | None = None) -> Column:
    """Score of the row for the query, null where it doesn't match. fields: query field -> column of terms (array<string>)."""
    sim = similarity or BM25()

    def term(q: Q.Term) -> Column:
        terms = F.col(fields[q.field])
        tf = F.size(F.filter(terms, lambda t: t == q.term))
        dl = F.size(terms)
        idf = sim.idf(F.lit(1), F.lit(1))
        return F.when(tf > 0, sim.score(tf, dl, idf, F.greatest(dl, F.lit(1)).cast("double")))

    def any_term(field: str, test) -> Column:
        return F.when(F.exists(fields[field], test), F.lit(1.0))

    def visit(q: Q.Query) -> Column:
        match q:
            case Q.Term():
                return term(q)
            case Q.MatchAll():
                return F.lit(1.0)
            case Q.MatchNone():
                return F.lit(None).cast("double")
            case Q.Boost():
                return visit(q.query) * q.boost
            case Q.ConstantScore():
                return F.when(visit(q.query).isNotNull(), F.lit(1.0))
            case Q.TermSet():
                return any_term(q.field, lambda t: t.isin(*sorted(q.values)))
            case Q.Prefix():
                return any_term(q.field, lambda t: t.startswith(q.prefix))
            case Q.Regex():
                return any_term(q.field, lambda t: t.rlike(f"^(?:{q.pattern})$"))
            case Q.PointRange() if q.points is None:
                return F.when(reduce(lambda a, b: a & b, [F.col(c).between(x, y) for c, x, y in zip(q.columns, q.lower, q.upper, strict=True)]), F.lit(1.0))
            case Q.Exists():
                return F.when(F.col(q.column).isNotNull(), F.lit(1.0))
            case Q.DisMax():
                parts = [F.coalesce(visit(c), F.lit(0.0)) for c in q.queries]
                total, best = reduce(lambda a, b: a + b, parts), F.greatest(*parts) if len(parts) > 1 else parts[0]
                hit = reduce(lambda a, b: a | b, [visit(c).isNotNull() for c in q.queries])
                return F.when(hit, best + q.tie * (total - best))
            case Q.Boolean():
                ok, total, n = F.lit(True), F.lit(0.0), F.lit(0)
                needs = bool(q.of(Q.Occur.MUST) or q.of(Q.Occur.FILTER))
                for o, c in q.clauses:
                    s = visit(c)
                    if o is Q.Occur.MUST:
                        ok, total = ok & s.isNotNull(), total + F.coalesce(s, F.lit(0.0))
                    elif o is Q.Occur.FILTER:
                        ok = ok & s.isNotNull()
                    elif o is Q.Occur.MUST_NOT:
                        ok = ok & s.isNull()
                    else:
                        total, n = total + F.coalesce(s, F.lit(0.0)), n + F.when(s.isNotNull(), 1).otherwise(0)
                return F.when(ok & (n >= max(q.minimum, 0 if needs else 1)), total)
        raise TypeError(f"can't match {q!r} against single documents")

    return visit(rewrite(query))


def percolate(docs: DataFrame, queries: dict[int, Q.Query], text_fields: list[str], id_col: str = "doc_id", analyzer: Analyzer = STANDARD, similarity: BM25 | None = None) -> DataFrame:
    """(id, query_id, score) of every stored query that a document matches. docs may be a stream; text fields may be arrays of values."""
    columns = {f: f"__{f}_terms" for f in text_fields}

    def terms(name: str) -> Column:
        if docs.schema[name].dataType.typeName() != "array":
            return analyzer.terms(F.coalesce(F.col(name), F.lit("")))
        return F.flatten(F.transform(F.filter(F.coalesce(name, F.array().cast("array<string>")), lambda v: v.isNotNull()), analyzer.terms))

    prepared = docs.withColumns({c: terms(f) for f, c in columns.items()})
    scores = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), score_column(q, columns, similarity).alias("score")) for i, q in sorted(queries.items())])
    return prepared.select(F.col(id_col), F.inline(F.filter(scores, lambda s: s["score"].isNotNull())))


def positions(docs: DataFrame, field: str, words: list[str], id_col: str = "doc_id", analyzer: Analyzer = STANDARD, gap: int = 0) -> DataFrame:
    """(id, term, pos, start, end): where the words stand in each arriving document; values of an array field follow one another, gap apart."""
    found = with_tokens(docs.select(id_col, field), field, analyzer, gap)
    return found.select(id_col, F.inline(F.filter("__tokens", lambda t: t["term"].isin(*words))))
