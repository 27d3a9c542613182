"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.analysis import token_table
from siftwell.functions.similarity import BM25
from siftwell.operators import collect as C
from siftwell.operators import matches as MM
from siftwell.operators import query as Q
from siftwell.plans.compile import Searcher
from siftwell.sources import shared
from siftwell.sources.index import Index, Keyword, Text
from siftwell.sources.store import IndexStore, reader
from siftwell.streaming.percolate import percolate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

W1, W2, W3, W4 = "the", "was", "with", "on"
TOK = r"""tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\s\x0B\x{85}\p{Z}]'), lambda x: x <> '')) AS term FROM documents),
post AS (SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY ALL),
norms AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
fs AS (SELECT count(*) AS n, sum(dl) / CAST(count(*) AS DOUBLE) AS avgdl FROM norms),
ts AS (SELECT term, count(*) AS df, sum(tf) AS ttf FROM post GROUP BY term),
sc AS (SELECT p.doc_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w, ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 - 1 / (1 + p.tf * (1 / (1.2 * (0.25 + 0.75 * dl / avgdl))))) AS s
FROM post p JOIN ts USING (term) JOIN norms USING (doc_id) CROSS JOIN fs WHERE p.term IN ('the', 'was', 'with', 'on'))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FIELDS = {"text": Text(positions=True, offsets=True), "source": Keyword(), "lang": Keyword()}
#: Changes with the layout of the store, so that no index of another layout is read.
LAYOUT = "3"
_open: dict[tuple[str, str], Index] = {}


def text_index(spark: SparkSession, sf_dir: str) -> Index:
    """The documents' index, written once for each state of the table and read by every query after that."""
    source = f"{sf_dir}/documents.parquet"
    path = f"{shared.shared_dir(spark)}/siftwell-index/{hashlib.sha256((LAYOUT + source + shared.stamp(spark, source)).encode()).hexdigest()[:32]}"
    known = (spark.sparkContext.applicationId, path)
    if known not in _open or not shared.exists(spark, f"{path}/commits"):
        if not reader(spark, path, FIELDS).commits():
            with IndexStore(spark, path, FIELDS) as store:
                store.add(table(spark, sf_dir, "documents"))
        _open[known] = reader(spark, path, FIELDS).open()
    return replace(_open[known])


def t(word: str) -> Q.Term:
    return Q.Term("text", word)


def register(name: str, sql: str | None, f: Query) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def searching(name: str, query: Q.Query, sql: str | None, similarity: BM25 | None = None) -> None:
    """Registers all hits (doc_id, score) of a query over the documents' index."""
    register(name, sql and f"WITH {TOK} {sql}", lambda spark, d: C.rounded(Searcher(text_index(spark, d), similarity).search(query)))


def docs_query(name: str, tbl: str, id_col: str, query: Q.Query, sql: str, extra=None, repeated: bool = False) -> None:
    """Registers hits of a query that needs columns only."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, tbl)
        df = extra(df, spark, d) if extra else df
        docs = df.withColumnRenamed(id_col, "doc_id")
        return Searcher(Index(docs, docs, docs, docs, repeated=repeated)).search(query)

    register(name, sql, run)


ONE = "SELECT doc_id, round(s, 6) AS score FROM sc"
RANKED = "ORDER BY score DESC, doc_id"
register("q1_term_top10", f"WITH {TOK} SELECT doc_id, score, source, lang FROM ({ONE} WHERE term = 'was' {RANKED} LIMIT 10) JOIN documents USING (doc_id)",
         lambda spark, d: (lambda i: C.fetch(C.top_n(C.rounded(Searcher(i).search(t(W2))), 10), i.docs, ["source", "lang"]))(text_index(spark, d)))
searching("q1_term", t(W2), f"{ONE} WHERE term = 'was'")
searching("q2_term_preset_stats", Q.Term("text", W2, df=7, docs=100), "SELECT doc_id, round(ln(1 + (100 - 7 + 0.5) / 7.5) / w * s, 6) AS score FROM sc WHERE term = 'was'")
searching("k6_keyword_term", Q.Term("source", "src3"), "SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 - 1 / (1 + 1 / 1.2)), 6) AS score FROM documents, (SELECT count(*) AS n, count(*) FILTER (source = 'src3') AS df FROM documents) WHERE source = 'src3'")
searching("k4_byte_norms", t(W2), "SELECT p.doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 - 1 / (1 + p.tf * (1 / (1.2 * (0.25 + 0.75 * (CAST(dl AS BIGINT) & 255) / avgdl))))), 6) AS score FROM post p JOIN ts USING (term) JOIN norms USING (doc_id) CROSS JOIN fs WHERE p.term = 'was'", BM25(norms="byte"))
docs_query("q3_match_all", "documents", "doc_id", Q.Boost(Q.MatchAll(), 2.5), "SELECT doc_id, 2.5::DOUBLE AS score FROM documents")
docs_query("q4_match_none", "documents", "doc_id", Q.MatchNone(), "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
docs_query("q5_point_range", "documents", "doc_id", Q.PointRange(("n_chars",), (500,), (2000,)), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars BETWEEN 500 AND 2000")
docs_query("q5_point_range_4d", "lineitem", "l_orderkey", Q.PointRange(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), (5.0, 1000.0, 0.02, 0.01), (30.0, 60000.0, 0.08, 0.06)),
           "SELECT DISTINCT l_orderkey AS doc_id, 1.0::DOUBLE AS score FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 AND l_extendedprice BETWEEN 1000 AND 60000 AND l_discount BETWEEN 0.02 AND 0.08 AND l_tax BETWEEN 0.01 AND 0.06", repeated=True)
docs_query("q6_point_set", "part", "p_partkey", Q.PointSet(("p_size",), ((3,), (14,), (15,), (49,))), "SELECT p_partkey AS doc_id, 1.0::DOUBLE AS score FROM part WHERE p_size IN (3, 14, 15, 49)")
docs_query("q7_exact_point", "part", "p_partkey", Q.point("p_size", 7), "SELECT p_partkey AS doc_id, 1.0::DOUBLE AS score FROM part WHERE p_size = 7")


def boxes(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return df.groupBy("l_orderkey").agg(F.min("l_quantity").alias("q_min"), F.max("l_quantity").alias("q_max"), F.min("l_discount").alias("d_min"), F.max("l_discount").alias("d_max"))


BOX = "(SELECT l_orderkey, min(l_quantity) AS q_min, max(l_quantity) AS q_max, min(l_discount) AS d_min, max(l_discount) AS d_max FROM lineitem GROUP BY 1)"
MEET, IN = "q_min <= 30 AND q_max >= 10 AND d_min <= 0.07 AND d_max >= 0.03", "q_min >= 10 AND q_max <= 30 AND d_min >= 0.03 AND d_max <= 0.07"
for _r, _w in ((Q.Relation.INTERSECTS, MEET), (Q.Relation.WITHIN, IN), (Q.Relation.CONTAINS, "q_min <= 10 AND q_max >= 30 AND d_min <= 0.03 AND d_max >= 0.07"), (Q.Relation.CROSSES, f"{MEET} AND NOT ({IN})")):
    docs_query(f"q8_range_{_r.value}", "lineitem", "l_orderkey", Q.RangeField(("q_min", "d_min"), ("q_max", "d_max"), (10.0, 0.03), (30.0, 0.07), _r), f"SELECT l_orderkey AS doc_id, 1.0::DOUBLE AS score FROM {BOX} WHERE {_w}", boxes)
DISTINCT = "SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE"
searching("q10_term_set", Q.TermSet("text", frozenset({"from", "reand", "die", "que"})), f"{DISTINCT} term IN ('from', 'reand', 'die', 'que')")
searching("q11_regex", Q.Regex("text", "th[aeiou]+n.*g"), f"{DISTINCT} regexp_full_match(term, 'th[aeiou]+n.*g')")
searching("q11_wildcard", Q.wildcard("text", "h?r*es"), f"{DISTINCT} regexp_full_match(term, 'h.r.*es')")
searching("q12_prefix", Q.Prefix("text", "tion"), f"{DISTINCT} starts_with(term, 'tion')")
searching("q13_term_range", Q.TermRange("text", "ou", "oy", True, False), f"{DISTINCT} term >= 'ou' AND term < 'oy'")
docs_query("q14_exists", "documents", "doc_id", Q.Exists("quality"), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL", lambda df, s, d: df.join(table(s, d, "labels"), "doc_id", "left"))

PIV = "piv AS (SELECT doc_id, max(s) FILTER (term = 'the') AS a, max(s) FILTER (term = 'was') AS b, max(s) FILTER (term = 'with') AS c, max(s) FILTER (term = 'on') AS d FROM sc GROUP BY doc_id)"


def boolean_query(name: str, query: Q.Query, score: str, where: str) -> None:
    searching(name, query, None)
    ORACLE[name] = f"WITH {TOK}, {PIV} SELECT doc_id, round({score}, 6) AS score FROM piv WHERE {where}"


boolean_query("c1a_must_must", Q.boolean(must=[t(W1), t(W2)]), "a + b", "a IS NOT NULL AND b IS NOT NULL")
boolean_query("c1b_must_filter", Q.boolean(must=[t(W1)], filter=[t(W2)]), "a", "a IS NOT NULL AND b IS NOT NULL")
boolean_query("c1c_must_not", Q.boolean(must=[t(W1)], must_not=[t(W2), t(W3)]), "a", "a IS NOT NULL AND b IS NULL AND c IS NULL")
boolean_query("c1d_should", Q.boolean(should=[t(W1), t(W2), t(W3)]), "coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)", "coalesce(a, b, c) IS NOT NULL")
boolean_query("c1e_must_should", Q.boolean(must=[t(W1)], should=[t(W2)]), "a + coalesce(b, 0)", "a IS NOT NULL")
boolean_query("c1f_minimum_should", Q.boolean(should=[t(W1), t(W2), t(W3), t(W4)], minimum=3), "coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)", "(a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 3")
boolean_query("c1g_should_equals_minimum", Q.boolean(should=[t(W1), t(W2)], minimum=2), "a + b", "a IS NOT NULL AND b IS NOT NULL")
boolean_query("c1_nested", Q.boolean(must=[Q.boolean(should=[t(W1), t(W2)]), t(W3)], must_not=[t(W4)]), "coalesce(a, 0) + coalesce(b, 0) + c", "coalesce(a, b) IS NOT NULL AND c IS NOT NULL AND d IS NULL")
boolean_query("c1h_only_exclusions", Q.boolean(must_not=[t(W1)]), "a", "false")
boolean_query("c2_boost", Q.Boost(Q.Boost(t(W1), 2.0), 1.5), "3 * a", "a IS NOT NULL")
boolean_query("c3_constant_score", Q.Boost(Q.ConstantScore(Q.boolean(must=[t(W1), t(W2)])), 4.0), "4.0::DOUBLE", "a IS NOT NULL AND b IS NOT NULL")
boolean_query("c4_dismax", Q.DisMax((t(W1), t(W2), t(W3)), 0.3), "greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)) + 0.3 * (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) - greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)))", "coalesce(a, b, c) IS NOT NULL")

ANY = Q.boolean(should=[t(W2), t(W3)])
ANY_SQL = f"WITH {TOK}, hits AS (SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('was', 'with') GROUP BY doc_id)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    return C.rounded(Searcher(text_index(spark, d)).search(ANY))


register("t1_top_n", f"{ANY_SQL} SELECT * FROM hits {RANKED} LIMIT 25", lambda s, d: C.top_n(hits(s, d), 25))
register("t2_search_after", f"{ANY_SQL} SELECT * FROM hits WHERE score < 1.0 OR (score = 1.0 AND doc_id > 5) {RANKED} LIMIT 25", lambda s, d: C.top_n(hits(s, d), 25, after=(1.0, 5)))
register("t3_count", f"{ANY_SQL} SELECT count(*) AS hits FROM hits", lambda s, d: C.count(Searcher(text_index(s, d)), ANY))
register("t3_count_term", f"WITH {TOK} SELECT df AS hits FROM ts WHERE term = 'was'", lambda s, d: C.count(Searcher(text_index(s, d)), t(W2)))
register("t6_page", f"{ANY_SQL} SELECT * FROM hits {RANKED} LIMIT 20 OFFSET 40", lambda s, d: C.page(hits(s, d), 40, 20))
register("t7_merge_shards", f"{ANY_SQL} SELECT doc_id, score, shard, (SELECT count(*) FROM hits) AS total FROM (SELECT *, CAST(doc_id % 3 AS INTEGER) AS shard FROM hits) ORDER BY score DESC, shard, doc_id LIMIT 30",
         lambda s, d: C.merge_sharded(hits(s, d).withColumn("shard", (F.col("doc_id") % 3).cast("int")), 0, 30))
register("t8_sort_by_fields", f"{ANY_SQL} SELECT doc_id, source, n_chars FROM hits JOIN documents USING (doc_id) ORDER BY source, n_chars DESC, doc_id LIMIT 50",
         lambda s, d: C.sort_by(hits(s, d), table(s, d, "documents"), [C.SortKey("source"), C.SortKey("n_chars", True)], 50).select("doc_id", "source", "n_chars"))
register("t8_sort_missing_first", f"{ANY_SQL} SELECT doc_id, coalesce(quality, -1) AS quality FROM hits LEFT JOIN labels USING (doc_id) ORDER BY labels.quality DESC NULLS FIRST, doc_id LIMIT 300",
         lambda s, d: C.sort_by(hits(s, d), table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), [C.SortKey("quality", True, "first")], 300).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality")))
register("t10_sort_after", "SELECT o_orderkey AS doc_id, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
         lambda s, d: (lambda o: C.sort_by(o.select("doc_id", F.lit(1.0).alias("score")), o, [C.SortKey("o_totalprice", True)], 100, after=(200000.0, 10)).select("doc_id", "o_totalprice"))(table(s, d, "orders").withColumnRenamed("o_orderkey", "doc_id")))
register("t17_top_per_group", f"{ANY_SQL} SELECT doc_id, score, source, rank FROM (SELECT doc_id, score, source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hits JOIN documents USING (doc_id)) WHERE rank <= 3",
         lambda s, d: C.top_per_group(hits(s, d), table(s, d, "documents"), "source", 3))
register("t15_term_stats", f"WITH {TOK} SELECT term, df, CAST(ttf AS BIGINT) AS ttf FROM ts", lambda s, d: text_index(s, d).term_stats.where("field = 'text'").select("term", "df", "ttf"))
register("t15_field_stats", f"WITH {TOK} SELECT (SELECT count(*) FROM norms) AS doc_count, CAST(sum(tf) AS BIGINT) AS sum_ttf, count(*) AS sum_df FROM post", lambda s, d: text_index(s, d).field_stats.where("field = 'text'").select("doc_count", "sum_ttf", "sum_df"))
register("b1_postings", f"WITH {TOK} SELECT doc_id, term, tf FROM post", lambda s, d: text_index(s, d).postings.where("field = 'text'").select("doc_id", "term", "tf"))
register("a1_tokens", r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, toks[i] AS term FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s\x0B\x{85}\p{Z}]'), lambda x: x <> '') AS toks FROM documents), unnest(generate_series(1, len(toks))) AS u(i)",
         lambda s, d: token_table(table(s, d, "documents"), "doc_id", "text", offsets=False).select("doc_id", "pos", "term"))
register("e1_terms", f"WITH {TOK} SELECT term, df FROM ts WHERE term >= 'th'", lambda s, d: C.terms(text_index(s, d), "text").where("term >= 'th'").select("term", "df"))
register("e2_seek_ceil", f"WITH {TOK} SELECT term, df FROM ts WHERE term >= 'thz' ORDER BY term LIMIT 1", lambda s, d: C.seek_ceil(text_index(s, d), "text", "thz").select("term", "df"))
register("e7_seek_floor", f"WITH {TOK} SELECT term, df FROM ts WHERE term <= 'thz' ORDER BY term DESC LIMIT 1", lambda s, d: C.seek_floor(text_index(s, d), "text", "thz").select("term", "df"))
register("s22_term_vector", f"WITH {TOK} SELECT term, tf FROM post WHERE doc_id = 3", lambda s, d: C.term_vector(text_index(s, d), 3).where("field = 'text'").select("term", "tf"))
register("k7_explain", f"WITH {TOK} SELECT doc_id, term, tf, CAST(dl AS INTEGER) AS dl, round(w, 6) AS idf, round(avgdl, 6) AS avgdl, round(s, 6) AS score FROM sc JOIN post USING (doc_id, term) JOIN norms USING (doc_id) CROSS JOIN fs WHERE term IN ('was', 'with')",
         lambda s, d: MM.explain(Searcher(text_index(s, d)), ANY).select("doc_id", "term", "tf", "dl", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"), F.round("score", 6).alias("score")))
register("m1_matches", r"WITH t AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, toks[i] AS term FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s\x0B\x{85}\p{Z}]'), lambda x: x <> '') AS toks FROM documents), unnest(generate_series(1, len(toks))) AS u(i)), ok AS (SELECT doc_id FROM t GROUP BY doc_id HAVING count(*) FILTER (term = 'was') > 0 AND count(*) FILTER (term = 'with') > 0) SELECT doc_id, term, position FROM t JOIN ok USING (doc_id) WHERE term IN ('was', 'with')",
         lambda s, d: MM.matches(Searcher(text_index(s, d)), Q.boolean(must=[t(W2), t(W3)])).select("doc_id", "term", "position"))


def deleted(spark: SparkSession, d: str) -> DataFrame:
    index = text_index(spark, d)
    index.tombstones = index.docs.where("doc_id % 10 = 0").select("doc_id")
    return C.rounded(Searcher(index).search(ANY))


register("s6_deleted", f"{ANY_SQL} SELECT * FROM hits WHERE doc_id % 10 <> 0", deleted)
STORED = {1: t(W2), 2: Q.boolean(must=[t(W1), t(W3)]), 3: Q.boolean(should=[t("die"), t("que")], must_not=[t("de")])}
_P = "(ln(1 + 0.5 / 1.5) * (1 - 1 / (1 + {} * (1 / 1.2))))"
register("p1_percolate", rf"WITH k AS (SELECT conv_id, turn, string_split_regex(lower(text), '[\s\x0B\x{{85}}\p{{Z}}]') AS x FROM conversations), c AS (SELECT conv_id * 1000 + turn AS id, len(list_filter(x, lambda y: y = 'was')) AS was, len(list_filter(x, lambda y: y = 'the')) AS the, len(list_filter(x, lambda y: y = 'with')) AS wit, len(list_filter(x, lambda y: y = 'die')) AS die, len(list_filter(x, lambda y: y = 'que')) AS que, len(list_filter(x, lambda y: y = 'de')) AS de FROM k) SELECT id, 1::BIGINT AS query_id, round({_P.format('was')}, 6) AS score FROM c WHERE was > 0 UNION ALL SELECT id, 2, round({_P.format('the')} + {_P.format('wit')}, 6) FROM c WHERE the > 0 AND wit > 0 UNION ALL SELECT id, 3, round({_P.format('die')} + {_P.format('que')}, 6) FROM c WHERE die + que > 0 AND de = 0",
         lambda s, d: percolate(table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), STORED, ["text"], "id").withColumn("score", F.round("score", 6)))
