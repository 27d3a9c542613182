"""Registered queries for the versioned store: each writes a small store of its own in the shared folder and reads it back."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import collect as C
from siftwell.operators import query as Q
from siftwell.plans.compile import Searcher
from siftwell.queries import Query, table
from siftwell.sources import shared
from siftwell.sources.index import Keyword, Text
from siftwell.sources.store import IndexStore, MergePolicy, reader

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FIELDS = {"key": Keyword(), "body": Text()}


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("key"), F.lower("c_name").alias("body"), F.col("c_acctbal").alias("balance"))


def stored(name: str, sql: str, use: Callable[[SparkSession, str, DataFrame], DataFrame]) -> None:
    """Registers use(spark, path of a fresh store, customers as documents). A path is used again by the same query over the same tables only."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = f"{shared.shared_dir(spark)}/siftwell-store/{name}-{hashlib.sha256((spark.sparkContext.applicationId + d).encode()).hexdigest()[:16]}"
        shared.delete(spark, path)
        return use(spark, path, customers(spark, d))

    QUERIES[name], ORACLE[name] = run, sql


ALL = "SELECT c_custkey AS doc_id, c_mktsegment AS key FROM customer"


def read(spark: SparkSession, path: str, generation: int | None = None, **options) -> DataFrame:
    return reader(spark, path, FIELDS).open(generation, **options).live.select("doc_id", "key")


def one(spark: SparkSession, **values) -> DataFrame:
    kinds = {int: "long", str: "string", bool: "boolean"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def create(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    for _ in range(2):  # creating again starts afresh
        with IndexStore(spark, path, FIELDS, "create") as s:
            s.add(docs)
    return read(spark, path)


def append(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    for mode, part in (("create", docs.where("balance < 0")), ("append", docs.where("balance >= 0 and balance < 4000")), ("create_or_append", docs.where("balance >= 4000"))):
        with IndexStore(spark, path, FIELDS, mode) as s:
            s.add(part)
    return read(spark, path)


def add(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
    return C.rounded(Searcher(reader(spark, path, FIELDS).open()).search(Q.Term("key", "BUILDING")))


def renamed(docs: DataFrame) -> DataFrame:
    return docs.where("key = 'BUILDING'").withColumn("key", F.lit("REBUILT"))


def update(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
    with IndexStore(spark, path, FIELDS, "append") as s:
        s.update(F.col("key") == "BUILDING", renamed(docs))
    return read(spark, path)


def soft_update(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
        s.soft_update(F.col("key") == "BUILDING", renamed(docs))
    kinds = [read(spark, path).withColumn("kind", F.lit("live")), read(spark, path, include_soft=True).withColumn("kind", F.lit("all"))]
    return reduce(DataFrame.unionByName, kinds)


def delete(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
    with IndexStore(spark, path, FIELDS) as s:
        s.delete((F.col("balance") < 1000) & (F.col("key") != "MACHINERY"))
    return C.rounded(Searcher(reader(spark, path, FIELDS).open()).search(Q.boolean(should=[Q.Term("key", "BUILDING"), Q.Term("key", "MACHINERY")])))


def two_phase(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs.where("balance < 0"))
    s = IndexStore(spark, path, FIELDS, "append")
    s.add(docs.where("balance >= 0"))
    s.prepare({"by": "test"})
    before = read(spark, path).count()
    s.rollback()
    s.add(docs.where("balance >= 0"))
    s.prepare()
    s.commit()
    s.__exit__(None, None, None)
    return one(spark, before=before, after=read(spark, path).count(), generation=reader(spark, path, FIELDS).version())


def policy(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
        s.commit()
        s.delete(F.col("key") == "BUILDING")
        s.commit()
        s.compact()
        before = len(shared.names(spark, f"{path}/docs"))
        s.vacuum(keep_last=1)
        after = len(shared.names(spark, f"{path}/docs"))
    return one(spark, before=before, after=after, rows=read(spark, path).count())


def unfinished(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
        s.commit()
        s.add(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
        s.prepare()
        s.rollback()  # what was written for it is left behind
        s.vacuum()
        left = len(shared.names(spark, f"{path}/postings"))
    return one(spark, segments=left, rows=read(spark, path).count())


def pending(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs.where("balance < 0"))
    s = IndexStore(spark, path, FIELDS)
    s.add(docs.where("balance >= 0"))
    near = s.open_pending().live.select("doc_id", "key", F.lit("pending").alias("reader"))
    s._unlock()
    return near.unionByName(read(spark, path).withColumn("reader", F.lit("committed")))


def travel(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    update(spark, path, docs)
    return read(spark, path, 1).withColumn("generation", F.lit(1)).unionByName(read(spark, path, 2).withColumn("generation", F.lit(2)))


def current(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    update(spark, path, docs)
    r = reader(spark, path, FIELDS)
    return one(spark, version=r.version(), first=r.is_current(1), last=r.is_current(2))


def add_indexes(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
    with IndexStore(spark, f"{path}/other", FIELDS) as s:
        s.add(docs)
        s.delete(F.col("key") != "BUILDING")
    with IndexStore(spark, path, FIELDS) as s:
        try:
            s.add_index(reader(spark, f"{path}/other", FIELDS).open(), 1)
            raise RuntimeError("clashing ids were taken")
        except ValueError:
            pass
        s.add_index(reader(spark, f"{path}/other", FIELDS).open(), 1_000_000_000)
    return read(spark, path)


def compacted(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS, merge_policy=MergePolicy(most=2)) as s:
        for low, high in ((-10_000, 0), (0, 3000), (3000, 6000), (6000, 20_000)):
            s.add(docs.where(f"balance >= {low} and balance < {high}"))
            s.commit()
        n = len(s.commits()), len(s._segments)
    assert n[1] == 2, n
    return reader(spark, path, FIELDS).open().term_stats.where("field = 'key'").select("term", "df", "ttf")


def ignoring_deletes(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
        s.delete(F.col("balance") < 2000)
    index = reader(spark, path, FIELDS).open()
    return index.term_stats.where("field = 'key'").select("term", "df").crossJoin(F.broadcast(C.counts(index)))  # one row


def index_sort(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    keys = [C.SortKey("key"), C.SortKey("balance")]
    with IndexStore(spark, path, FIELDS, sort_by=["key", "balance"]) as s:
        s.add(docs)
    return C.top_by_index_sort(reader(spark, path, FIELDS).open().docs, keys, keys, 40).select("doc_id", "key", "balance")


def locks(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    first, refused = IndexStore(spark, path, FIELDS), False
    try:
        IndexStore(spark, path, FIELDS)
    except RuntimeError:
        refused = True
    second = IndexStore(spark, path, FIELDS, lock_seconds=-1)  # an owner that is gone is relieved
    lost = not first._holds()
    first.add(docs.limit(1))
    try:
        first.commit()
        kept = True
    except RuntimeError:
        kept = False
    second._unlock()
    return one(spark, refused=refused, taken_over=lost, old_owner_commits=kept)


def layout(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS, points=["balance"]) as s:
        s.add(docs)
        s.delete(F.col("key") == "BUILDING")
    rows = []
    for kind in ("docs", "postings", "terms", "fields", "impacts", "points", "tombstones"):
        n = spark.read.parquet(*[f"{path}/{kind}/{x}" for x in shared.names(spark, f"{path}/{kind}")]).count()
        rows.append((kind, n))
    return spark.createDataFrame(rows, "kind string, n long").where("kind in ('docs', 'postings', 'points', 'tombstones', 'fields')")


def stored_fields(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    with IndexStore(spark, path, FIELDS) as s:
        s.add(docs)
    index = reader(spark, path, FIELDS).open()
    return C.fetch(Searcher(index).search(Q.Term("key", "BUILDING")).select("doc_id"), index.docs, ["balance"])


def immense(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    s = IndexStore(spark, path, {"body": Text(max_term_bytes=10)})
    s.add(docs)
    try:
        s.commit()
        raised = False
    except ValueError:
        raised = True
    s.rollback()
    s._unlock()
    return one(spark, raised=raised, commits=len(s.commits()))


_TERMS = "term_counts AS (SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS b, count(*) FILTER (c_mktsegment = 'MACHINERY') AS m FROM customer)"
_KEY = "ln(1 + (n - {0} + 0.5) / ({0} + 0.5)) * (1 - 1 / (1 + 1 / 1.2))"
stored("s1_create", ALL, create)
stored("s2_open_modes", ALL, append)
stored("s3_add", f"WITH {_TERMS} SELECT c_custkey AS doc_id, round({_KEY.format('b')}, 6) AS score FROM customer, term_counts WHERE c_mktsegment = 'BUILDING'", add)
_UPDATED = "SELECT c_custkey AS doc_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'REBUILT' ELSE c_mktsegment END AS key"
stored("s4_update", f"{_UPDATED} FROM customer", update)
stored("s5_soft_update", f"{_UPDATED}, 'live' AS kind FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'all' FROM customer UNION ALL SELECT c_custkey, 'REBUILT', 'all' FROM customer WHERE c_mktsegment = 'BUILDING'", soft_update)
stored("s6_delete", f"WITH {_TERMS} SELECT c_custkey AS doc_id, round(CASE c_mktsegment WHEN 'BUILDING' THEN {_KEY.format('b')} ELSE {_KEY.format('m')} END, 6) AS score FROM customer, term_counts WHERE c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' AND c_acctbal >= 1000", delete)
stored("s7_two_phase", "SELECT count(*) FILTER (c_acctbal < 0) AS before, count(*) AS after, 2::BIGINT AS generation FROM customer", two_phase)
stored("s8_close_commits", ALL, create)
stored("s9_keep_last", "SELECT 2::BIGINT AS before, 1::BIGINT AS after, count(*) AS rows FROM customer WHERE c_mktsegment <> 'BUILDING'", policy)
stored("s10_vacuum", "SELECT 1::BIGINT AS segments, count(*) AS rows FROM customer", unfinished)
stored("s11_pending_reader", f"SELECT *, 'pending' AS reader FROM ({ALL}) UNION ALL SELECT c_custkey, c_mktsegment, 'committed' FROM customer WHERE c_acctbal < 0", pending)
stored("s12_time_travel", f"{_UPDATED}, 2 AS generation FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer", travel)
stored("s13_is_current", "SELECT 2::BIGINT AS version, false AS first, true AS last", current)
stored("s14_add_indexes", f"{ALL} UNION ALL SELECT c_custkey + 1000000000, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", add_indexes)
stored("s15_merge_policy", "SELECT c_mktsegment AS term, count(*) AS df, count(*) AS ttf FROM customer GROUP BY 1", compacted)
stored("s16_index_sort", "SELECT c_custkey AS doc_id, c_mktsegment AS key, c_acctbal AS balance FROM customer ORDER BY key, balance, doc_id LIMIT 40", index_sort)
stored("s19_locks", "SELECT true AS refused, true AS taken_over, false AS old_owner_commits", locks)
stored("s21_layout", "SELECT 'docs' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'postings', 2 * count(*) FROM customer UNION ALL SELECT 'points', count(*) FROM customer UNION ALL SELECT 'tombstones', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'fields', 2", layout)
stored("s22_stored_fields", "SELECT c_custkey AS doc_id, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'", stored_fields)
stored("s25_term_limit", "SELECT true AS raised, 0::BIGINT AS commits", immense)
stored("b6_stats_ignore_deletes", "SELECT c_mktsegment AS term, count(*) AS df, (SELECT count(*) FROM customer) AS max_doc, (SELECT count(*) FROM customer WHERE c_acctbal >= 2000) AS num_docs, (SELECT count(*) FROM customer WHERE c_acctbal < 2000) AS num_deleted FROM customer GROUP BY 1", ignoring_deletes)
