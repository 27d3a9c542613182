"""Collecting hits: top-k, pages, counts, sorting by fields, merging of shards, statistics and dictionary lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators import query as Q
from siftwell.plans.compile import Searcher
from siftwell.plans.rewrite import rewrite

def rounded(hits: DataFrame, decimals: int = 6) -> DataFrame:
    """For comparisons: sums taken in another order differ in the last digits."""
    return hits.withColumn("score", F.round("score", decimals))


def top_n(hits: DataFrame, n: int, after: tuple[float, int] | None = None) -> DataFrame:
    """Best scores first, then smaller doc_id; after continues behind a (score, doc_id)."""
    if after is not None:
        hits = hits.where((F.col("score") < after[0]) | (F.col("score") == after[0]) & (F.col("doc_id") > after[1]))
    return hits.orderBy(F.desc("score"), "doc_id").limit(max(n, 1))


def page(hits: DataFrame, start: int, size: int) -> DataFrame:
    """Hits start to start + size of the ranking; out of range is empty."""
    return hits.orderBy(F.desc("score"), "doc_id").offset(max(start, 0)).limit(max(size, 0))


def count(searcher: Searcher, query: Q.Query) -> DataFrame:
    """Exact number of live matches; a lone term without deletes is answered by the dictionary."""
    q = rewrite(query, scores=False)
    while isinstance(q, Q.ConstantScore | Q.Boost):
        q = q.query
    if isinstance(q, Q.Term) and searcher.index.tombstones is None:
        return searcher.index.term_stats.where((F.col("field") == q.field) & (F.col("term") == q.term)).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("hits"))
    return searcher.search(q, scores=False).agg(F.count("*").alias("hits"))


@dataclass(frozen=True)
class SortKey:
    """missing stands in for nulls, or puts them first or last; selector picks from arrays: min, max, middle_min, middle_max.

    column is a name (score and doc_id too), a Column for an order of one's own, or a function from the hits' DataFrame to one of
    these, for keys that are only known when the query runs."""

    column: object
    descending: bool = False
    missing: object = "last"
    selector: str | None = None

    def rewritten(self, df: DataFrame) -> SortKey:
        return SortKey(self.column(df), self.descending, self.missing, self.selector) if callable(self.column) and not isinstance(self.column, Column) else self

    def value(self) -> Column:
        c = F.col(self.column) if isinstance(self.column, str) else self.column
        if self.selector:
            s = F.array_sort(F.filter(c, lambda x: x.isNotNull()))
            n = F.size(s)
            at = {"min": F.lit(1), "max": n, "middle_min": F.floor((n + 1) / 2).cast("int"), "middle_max": (F.floor(n / 2) + 1).cast("int")}[self.selector]
            c = F.when(n > 0, F.get(s, at - 1))
        return c if self.missing in ("first", "last") else F.coalesce(c, F.lit(self.missing))

    def order(self) -> Column:
        c = self.value()
        if self.missing == "first":
            return c.desc_nulls_first() if self.descending else c.asc_nulls_first()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


SCORE = SortKey("score", descending=True)


def sort_by(hits: DataFrame, docs: DataFrame, keys: list[SortKey], n: int, after: tuple | None = None) -> DataFrame:
    """The first n hits by several keys, then doc_id; after is (values of the keys, doc_id) of the last hit before."""
    joined = hits.join(docs, "doc_id")
    keys = [k.rewritten(joined) for k in keys]
    if after is not None:
        values, doc = after[:-1], after[-1]
        beyond, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, values, strict=True):
            c = k.value()
            if v is None:
                further = c.isNotNull() if k.missing == "first" else F.lit(False)
            else:
                further = (c < v if k.descending else c > v) | (c.isNull() if k.missing == "last" else F.lit(False))
            beyond = beyond | equal & F.coalesce(further, F.lit(False))
            equal = equal & c.eqNullSafe(F.lit(v))
        joined = joined.where(beyond | equal & (F.col("doc_id") > doc))
    return joined.orderBy(*[k.order() for k in keys], "doc_id").limit(n)


def merge_top(shards: list[DataFrame], start: int, size: int) -> DataFrame:
    """Merges ranked shards: score, then shard, then place within the shard. Adds shard and total (hits of all shards).

    Each shard is computed once: ranks and the total come from counts of the same rows by partition."""
    parts = [s.withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]
    return merge_sharded(reduce(lambda a, b: a.unionByName(b), parts), start, size)


def merge_sharded(hits: DataFrame, start: int, size: int) -> DataFrame:
    """merge_top for hits that carry their shard already. One aggregate keeps the best start + size of each shard beside its count."""
    most = max(start + size, 0)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "doc_id"))), 1, max(most, 1))
    # a first aggregate by (shard, salt) bounds every list before the lists of a shard meet
    part = hits.groupBy("shard", F.spark_partition_id().alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt")).agg(F.count("*").alias("n"), best.alias("best"))
    shard = part.groupBy("shard").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, max(most, 1)).alias("best"))
    every = shard.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row per shard
    rows = every.select("shard", "total", F.inline("best")).select("doc_id", (-F.col("minus")).alias("score"), "shard", "total")
    return rows.orderBy(F.desc("score"), "shard", "doc_id").offset(start).limit(size)


def total_hits(hits: DataFrame, threshold: int = 1000) -> DataFrame:
    """(hits, relation): exact up to the threshold, beyond it a lower bound; counting then stops early."""
    n = hits.limit(threshold + 1).agg(F.count("*").alias("hits"))
    return n.select("hits", F.when(F.col("hits") > threshold, "GREATER_THAN_OR_EQUAL_TO").otherwise("EQUAL_TO").alias("relation"))


class Collector:
    """Custom collection in two steps, as partial and final aggregates: `collect` says what is kept of the hits, `reduce` joins shards' results."""

    scores = True

    def collect(self, hits: DataFrame) -> DataFrame:
        raise NotImplementedError

    def reduce(self, parts: DataFrame) -> DataFrame:
        return parts


def collect(searcher: Searcher, query: Q.Query, collector: Collector) -> DataFrame:
    return collector.reduce(collector.collect(searcher.search(query, scores=collector.scores)))


def sorted_by_index(search_sort: list[SortKey], index_sort: list[SortKey]) -> bool:
    """Whether the index's own order answers a search sort: it is a prefix of it."""
    return search_sort == index_sort[: len(search_sort)]


def top_by_index_sort(hits: DataFrame, keys: list[SortKey], index_sort: list[SortKey], n: int) -> DataFrame:
    """The first n of hits read from an index sorted by index_sort; where that order fits, each task stops after its first n rows."""
    if sorted_by_index(keys, index_sort):
        window = Window.partitionBy(F.spark_partition_id()).orderBy(*[k.order() for k in keys], "doc_id")
        hits = hits.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n).drop("__n")
    return hits.orderBy(*[k.order() for k in keys], "doc_id").limit(n)


def top_n_pruned(searcher: Searcher, terms: list[Q.Term], n: int, impacts: DataFrame, block: int = 128) -> DataFrame:
    """top_n of a disjunction of terms, reading only blocks of documents whose best possible score can still enter the first n.

    impacts: (field, term, block, tf, dl) as `sources.index.impacts` gives them. The n blocks with the highest bounds are scored
    first; the n-th score found there is what other blocks have to reach."""
    numbered = [(i, t, 1.0) for i, t in enumerate(terms)]
    weights = F.broadcast(searcher.weights(numbered))
    wanted = F.col("field").isin(*{t.field for t in terms}) & F.col("term").isin(*{t.term for t in terms})
    bound = searcher.similarity.score(F.col("tf"), F.col("dl"), F.col("weight"), F.col("avgdl"))
    bounds = impacts.where(wanted).join(weights, ["field", "term"]).groupBy("block", "clause").agg(F.max(bound).alias("b")).groupBy("block").agg(F.sum("b").alias("bound"))
    hits = searcher.term_hits(numbered).withColumn("block", F.floor(F.col("doc_id") / block))
    first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(n).collect()]
    scored = hits.where(F.col("block").isin(*first)).groupBy("doc_id").agg(F.sum("score").alias("score")) if first else hits.select("doc_id", "score").limit(0)
    best = [r.score for r in top_n(scored, n).collect()]
    if len(best) < n:
        return top_n(hits.groupBy("doc_id").agg(F.sum("score").alias("score")), n)
    rest = bounds.where(F.col("bound") >= best[-1] * (1 - 1e-9)).select("block")
    return top_n(hits.join(rest, "block", "left_semi").groupBy("doc_id").agg(F.sum("score").alias("score")), n)


def top_per_group(hits: DataFrame, docs: DataFrame, group: str, n: int) -> DataFrame:
    """The n best hits of each value of a column."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "doc_id")
    return hits.join(docs.select("doc_id", group), "doc_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fetch(hits: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Stored columns of the hits, only these being read."""
    return hits.join(docs.select("doc_id", *columns), "doc_id", "left")


# terms


def terms(index, field: str) -> DataFrame:
    return index.term_stats.where(F.col("field") == field).orderBy("term")


def seek_exact(index, field: str, term: str) -> DataFrame:
    return index.term_stats.where((F.col("field") == field) & (F.col("term") == term))


def seek_ceil(index, field: str, term: str) -> DataFrame:
    """The first term at or after the given one, in byte order."""
    return index.term_stats.where((F.col("field") == field) & (F.col("term") >= term)).orderBy("term").limit(1)


def seek_floor(index, field: str, term: str) -> DataFrame:
    return index.term_stats.where((F.col("field") == field) & (F.col("term") <= term)).orderBy(F.desc("term")).limit(1)


def accepted(index, field: str, accept: Column, until: Column | None = None) -> DataFrame:
    """Terms that a test accepts, from the start of the dictionary up to the first that `until` names (all)."""
    rows = index.term_stats.where(F.col("field") == field)
    if until is not None:
        end = rows.where(until).agg(F.min("term").alias("end"))
        rows = rows.crossJoin(F.broadcast(end)).where(F.col("end").isNull() | (F.col("term") < F.col("end"))).drop("end")  # one row
    return rows.where(accept).orderBy("term")


def by_ordinal(index, field: str, ordinal: int) -> DataFrame:
    """The term at a place of the dictionary, counted from 0."""
    return index.term_stats.where(F.col("field") == field).orderBy("term").offset(ordinal).limit(1)


def term_vector(index, doc_id: int) -> DataFrame:
    return index.postings.where(F.col("doc_id") == doc_id)


def counts(index) -> DataFrame:
    """max_doc (deleted documents count), num_docs, num_deleted."""
    total = (index.docs if index.all_docs is None else index.all_docs).agg(F.count("*").alias("max_doc"))
    live = index.live.agg(F.count("*").alias("num_docs"))
    return total.crossJoin(F.broadcast(live)).select("max_doc", "num_docs", (F.col("max_doc") - F.col("num_docs")).alias("num_deleted"))  # one row each
