"""Query trees to DataFrames (doc_id, score), a row per matching document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.similarity import BM25, Similarity
from siftwell.operators import query as Q
from siftwell.plans.rewrite import rewrite
from siftwell.sources.index import Index

#: Above so many terms a multi-term query joins the dictionary instead of listing them in the plan.
TERMS_IN_PLAN = 1000


class Searcher:
    def __init__(self, index: Index, similarity: Similarity | None = None):
        self.index, self.similarity, self.spark = index, similarity or BM25(), index.docs.sparkSession

    def search(self, query: Q.Query, scores: bool = True, rewritten: bool = True) -> DataFrame:
        """Live matching documents with their scores."""
        found = self.compile(rewrite(query, scores) if rewritten else query)
        if self.index.tombstones is not None:
            found = found.join(self.index.tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
        return found

    # leaves

    def none(self) -> DataFrame:
        return self.index.docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))

    def matching(self, condition: Column) -> DataFrame:
        """A document matches once, whichever of its rows does."""
        rows = self.index.docs.where(condition).select("doc_id")
        return (rows.distinct() if self.index.repeated else rows).withColumn("score", F.lit(1.0))

    def weights(self, terms: list[tuple[int, Q.Term, float]]) -> DataFrame:
        """(clause, field, term, weight, avgdl): a row per clause, so its size is that of the query."""
        rows = self.spark.createDataFrame([(i, t.field, t.term, t.df, t.docs, float(b)) for i, t, b in terms], "clause int, field string, term string, df0 long, docs0 long, boost double")
        names = sorted({t.field for _, t, _ in terms})
        words = sorted({t.term for _, t, _ in terms})
        stats = self.index.term_stats.where(F.col("field").isin(*names) & F.col("term").isin(*words))
        fields = self.index.field_stats.where(F.col("field").isin(*names))
        joined = rows.join(stats, ["field", "term"], "left").join(F.broadcast(fields), "field", "left")
        idf = self.similarity.idf(F.coalesce("df0", "df", F.lit(0)), F.coalesce("docs0", "doc_count", F.lit(0)))
        return joined.select("clause", "field", "term", (F.col("boost") * idf).alias("weight"), (F.col("sum_ttf") / F.col("doc_count")).alias("avgdl"))

    def term_hits(self, terms: list[tuple[int, Q.Term, float]]) -> DataFrame:
        """(clause, doc_id, score) for term clauses, in one pass over the postings of their fields."""
        names = sorted({t.field for _, t, _ in terms})
        words = sorted({t.term for _, t, _ in terms})
        hits = self.index.postings.where(F.col("field").isin(*names) & F.col("term").isin(*words)).join(F.broadcast(self.weights(terms)), ["field", "term"])
        return hits.select("clause", "doc_id", self.similarity.score(F.col("tf"), F.col("dl"), F.col("weight"), F.col("avgdl")).alias("score"))

    def multi_term(self, field: str, condition: Column) -> DataFrame:
        """Constant score for documents with any term of the dictionary that meets the condition; the same test prunes the postings."""
        hits = self.index.postings.where((F.col("field") == field) & condition)
        return hits.select("doc_id").distinct().withColumn("score", F.lit(1.0))

    def term_set(self, q: Q.TermSet) -> DataFrame:
        if len(q.values) <= TERMS_IN_PLAN:
            return self.multi_term(q.field, F.col("term").isin(*sorted(q.values)) if q.values else F.lit(False))
        values = self.spark.createDataFrame([(v,) for v in sorted(q.values)], "term string")
        hits = self.index.postings.where(F.col("field") == q.field).join(values, "term", "left_semi")
        return hits.select("doc_id").distinct().withColumn("score", F.lit(1.0))

    def point_range(self, q: Q.PointRange) -> Column:
        bounds = list(zip(q.columns, q.lower, q.upper, strict=True))
        if q.points:
            return F.exists(q.points, lambda p: reduce(lambda x, y: x & y, [p[c].between(a, b) for c, a, b in bounds]))
        return reduce(lambda x, y: x & y, [F.col(c).between(a, b) for c, a, b in bounds])

    def boxed(self, q: Q.PointRange) -> DataFrame:
        """By the clustered copy of the points where it has all the columns: its row groups are narrow in every dimension."""
        points = self.index.points
        if points is None or q.points or not set(q.columns) <= set(points.columns):
            return self.matching(self.point_range(q))
        found = points.where(self.point_range(q)).select("doc_id").distinct().withColumn("score", F.lit(1.0))
        return found.join(self.index.docs.select("doc_id"), "doc_id", "left_semi")

    def point_set(self, q: Q.PointSet) -> DataFrame:
        if len(q.values) <= TERMS_IN_PLAN:
            values = [F.struct(*[F.lit(x).cast(self.index.docs.schema[c].dataType) for c, x in zip(q.columns, v, strict=True)]) for v in q.values]
            return self.matching(F.struct(*[F.col(c) for c in q.columns]).isin(*values) if values else F.lit(False))
        values = self.spark.createDataFrame(list(q.values), self.index.docs.select(*q.columns).schema)
        rows = self.index.docs.join(values, list(q.columns), "left_semi").select("doc_id")  # Spark broadcasts the values if they are few
        return (rows.distinct() if self.index.repeated else rows).withColumn("score", F.lit(1.0))

    def phrase_hits(self, q: Q.Phrase) -> DataFrame:
        """(doc_id, score, spans): the postings of the words meet by document; the occurrences are found inside the row."""
        words = list(dict.fromkeys(q.words))
        rows = self.index.postings.where((F.col("field") == q.field) & F.col("term").isin(*words))
        rows = rows.groupBy("doc_id").agg(F.max("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("p")).where(F.size("p") == len(words))

        def next_to(word: str, end: Column) -> Column:
            return F.array_min(F.filter(F.element_at("p", word), lambda x: x > end))

        def span(start: Column) -> Column:
            return F.struct(start.alias("start"), reduce(lambda end, w: next_to(w, end), q.words[1:], start).alias("end"))

        spans = F.filter(F.transform(F.element_at("p", q.words[0]), span), lambda s: s["end"] - s["start"] - (len(q.words) - 1) <= q.slop)
        weights = self.weights([(i, Q.Term(q.field, w), 1.0) for i, w in enumerate(q.words)]).agg(F.sum("weight").alias("weight"), F.max("avgdl").alias("avgdl"))
        found = rows.withColumn("spans", spans).where(F.size("spans") > 0).crossJoin(F.broadcast(weights))  # one row
        return found.select("doc_id", self.similarity.score(F.size("spans"), F.col("dl"), F.col("weight"), F.col("avgdl")).alias("score"), "spans")

    def range_field(self, q: Q.RangeField) -> Column:
        dims = [(F.col(a), F.col(b), lo, hi) for a, b, lo, hi in zip(q.mins, q.maxs, q.lower, q.upper, strict=True)]
        every = lambda tests: reduce(lambda x, y: x & y, tests)
        meets = every([(a <= hi) & (b >= lo) for a, b, lo, hi in dims])
        within = every([(a >= lo) & (b <= hi) for a, b, lo, hi in dims])
        contains = every([(a <= lo) & (b >= hi) for a, b, lo, hi in dims])
        return {Q.Relation.INTERSECTS: meets, Q.Relation.WITHIN: within, Q.Relation.CONTAINS: contains, Q.Relation.CROSSES: meets & ~within}[q.relation]

    # trees

    def compile(self, q: Q.Query) -> DataFrame:
        match q:
            case Q.Term():
                return self.term_hits([(0, q, 1.0)]).select("doc_id", "score")
            case Q.MatchAll():
                return self.matching(F.lit(True))
            case Q.MatchNone():
                return self.none()
            case Q.Phrase():
                return self.phrase_hits(q).select("doc_id", "score")
            case Q.PointRange():
                return self.boxed(q)
            case Q.PointSet():
                return self.point_set(q)
            case Q.RangeField():
                return self.matching(self.range_field(q))
            case Q.Exists():
                return self.matching(F.col(q.column).isNotNull())
            case Q.TermSet():
                return self.term_set(q)
            case Q.Prefix():
                return self.multi_term(q.field, F.col("term").startswith(q.prefix))
            case Q.TermRange():
                ends = [(F.col("term") >= q.lower) if q.include_lower else (F.col("term") > q.lower)] if q.lower is not None else []
                ends += [(F.col("term") <= q.upper) if q.include_upper else (F.col("term") < q.upper)] if q.upper is not None else []
                return self.multi_term(q.field, reduce(lambda x, y: x & y, ends, F.lit(True)))
            case Q.Regex():
                return self.multi_term(q.field, F.col("term").rlike(f"^(?:{q.pattern})$"))
            case Q.Scoring():
                return self.compile(q.rewritten(self.index))
            case Q.Boost():
                if isinstance(q.query, Q.Term):
                    return self.term_hits([(0, q.query, q.boost)]).select("doc_id", "score")
                return self.compile(q.query).select("doc_id", (F.col("score") * q.boost).alias("score"))
            case Q.ConstantScore():
                return self.compile(q.query).select("doc_id", F.lit(1.0).alias("score"))
            case Q.DisMax():
                hits = self.clauses([(i, c) for i, c in enumerate(q.queries)])
                best, total = F.max("score"), F.sum("score")
                return hits.groupBy("doc_id").agg((best + q.tie * (total - best)).alias("score"))
            case Q.Boolean():
                return self.boolean(q)
        raise TypeError(f"can't compile {q!r}")

    def clauses(self, numbered: list[tuple[int, Q.Query]]) -> DataFrame:
        """(clause, doc_id, score) of all clauses; plain terms share one scan of the postings."""
        terms, parts = [], []
        for i, c in numbered:
            if isinstance(c, Q.Term):
                terms.append((i, c, 1.0))
            elif isinstance(c, Q.Boost) and isinstance(c.query, Q.Term):
                terms.append((i, c.query, c.boost))
            else:
                parts.append(self.compile(c).select(F.lit(i).alias("clause"), "doc_id", "score"))
        if terms:
            parts.append(self.term_hits(terms))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def boolean(self, q: Q.Boolean) -> DataFrame:
        """One shuffle on doc_id for all clauses: sums, and counts of the required, optional and excluded ones."""
        kinds = [o for o, _ in q.clauses]
        required = sum(o in (Q.Occur.MUST, Q.Occur.FILTER) for o in kinds)
        least = max(q.minimum, 0 if required else 1)
        if not required and not q.of(Q.Occur.SHOULD):
            return self.none()

        def of(*wanted: Q.Occur) -> Column:
            ids = [i for i, o in enumerate(kinds) if o in wanted]
            return F.col("clause").isin(*ids) if ids else F.lit(False)

        # clauses match a document once each, so counting rows counts clauses
        count = lambda test: F.count(F.when(test, 1))
        found = self.clauses(list(enumerate(c for _, c in q.clauses))).groupBy("doc_id").agg(
            F.coalesce(F.sum(F.when(of(Q.Occur.MUST, Q.Occur.SHOULD), F.col("score"))), F.lit(0.0)).alias("score"),
            count(of(Q.Occur.MUST, Q.Occur.FILTER)).alias("n_required"), count(of(Q.Occur.SHOULD)).alias("n_optional"), count(of(Q.Occur.MUST_NOT)).alias("n_excluded"),
        )
        return found.where((F.col("n_required") == required) & (F.col("n_optional") >= least) & (F.col("n_excluded") == 0)).select("doc_id", "score")
