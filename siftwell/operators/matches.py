"""Where and why documents match: positions of the terms of a query, and the parts of a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators import query as Q
from siftwell.plans.compile import Searcher
from siftwell.plans.rewrite import rewrite


def matches(searcher: Searcher, query: Q.Query, name: str | None = None) -> DataFrame:
    """(doc_id, field, term, position, start, end[, name]) for documents that match the whole query, by position. Excluded clauses add nothing."""
    found = sorted(_wanted(query))
    docs = searcher.search(query, scores=False).select("doc_id")
    fields, words = sorted({f for f, _ in found}), sorted({t for _, t in found})
    pairs = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("term") == t) for f, t in found], F.lit(False))
    hits = searcher.index.postings.where(F.col("field").isin(*fields) & F.col("term").isin(*words) & pairs).join(docs, "doc_id", "left_semi")
    out = hits.select("doc_id", "field", "term", F.inline(F.arrays_zip("positions", "starts", "ends"))).toDF("doc_id", "field", "term", "position", "start", "end")
    return out.withColumn("name", F.lit(name)) if name else out


def merged(*found: DataFrame) -> DataFrame:
    """Several match lists as one, in the order of positions inside each document and field; equal occurrences of different lists stay."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    order = Window.partitionBy("doc_id", "field").orderBy("position", "end", "term")
    return every.withColumn("nth", F.row_number().over(order) - 1)


def spans(searcher: Searcher, phrase: Q.Phrase) -> DataFrame:
    """(doc_id, field, start, end): first and last position of every occurrence of a phrase."""
    return searcher.phrase_hits(phrase).select("doc_id", F.lit(phrase.field).alias("field"), F.inline("spans"))


def _wanted(q: Q.Query) -> set[tuple[str, str]]:
    if isinstance(q, Q.Boolean):
        return set().union(*[_wanted(c) for o, c in q.clauses if o is not Q.Occur.MUST_NOT] or [set()])
    return set().union(*[_wanted(c) for c in q.children()]) if q.children() else q.terms()


def explain(searcher: Searcher, query: Q.Query) -> DataFrame:
    """(doc_id, field, term, boost, df, docs, idf, tf, dl, avgdl, score): a row for each scoring term clause of each match."""
    parts: list[tuple[Q.Term, float]] = []

    def visit(q: Q.Query, boost: float) -> None:
        if isinstance(q, Q.Term):
            parts.append((q, boost))
        elif isinstance(q, Q.Boost):
            visit(q.query, boost * q.boost)
        elif isinstance(q, Q.Boolean):
            for c in q.of(Q.Occur.MUST) + q.of(Q.Occur.SHOULD):
                visit(c, boost)
        elif isinstance(q, Q.DisMax):
            for c in q.queries:
                visit(c, boost)

    visit(rewrite(query), 1.0)
    if not parts:
        raise ValueError("no scoring terms to explain")
    rows = searcher.spark.createDataFrame([(t.field, t.term, b) for t, b in parts], "field string, term string, boost double")
    stats = rows.join(searcher.index.term_stats, ["field", "term"]).join(searcher.index.field_stats, "field")
    sim = searcher.similarity
    idf, avgdl = sim.idf(F.col("df"), F.col("doc_count")), F.col("sum_ttf") / F.col("doc_count")
    hits = searcher.index.postings.where(F.col("term").isin(*[t.term for t, _ in parts])).join(F.broadcast(stats.select("field", "term", "boost", "df", F.col("doc_count").alias("docs"), idf.alias("idf"), avgdl.alias("avgdl"))), ["field", "term"])
    live = searcher.search(query).select("doc_id")
    score = sim.score(F.col("tf"), F.col("dl"), F.col("boost") * F.col("idf"), F.col("avgdl"))
    return hits.join(live, "doc_id", "left_semi").select("doc_id", "field", "term", "boost", "df", "docs", "idf", "tf", "dl", "avgdl", score.alias("score"))


def explain_tree(searcher: Searcher, query: Q.Query) -> DataFrame:
    """(doc_id, value, description, details): the sum of a document's clauses, each with weight, idf, count, length and how they were combined."""
    part = F.struct(
        F.col("score").alias("value"), F.concat(F.lit("weight("), "field", F.lit(":"), "term", F.lit(")")).alias("description"),
        F.array(*[F.struct(F.col(c).cast("double").alias("value"), F.lit(c).alias("description")) for c in ("boost", "idf", "df", "docs", "tf", "dl", "avgdl")]).alias("details"),
    )
    rows = explain(searcher, query).groupBy("doc_id").agg(F.sum("score").alias("value"), F.array_sort(F.collect_list(part)).alias("details"))
    return rows.select("doc_id", "value", F.lit("sum of").alias("description"), "details")
