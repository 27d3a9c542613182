"""Registered queries for analysis, index structures, similarities, collectors, matches and the dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.analysis import LETTERS, STANDARD, WHITESPACE, Analyzer, attributes, stop_analyzer, token_table
from siftwell.functions.similarity import BM25, Similarity, byte4
from siftwell.operators import collect as C
from siftwell.operators import matches as MM
from siftwell.operators import query as Q
from siftwell.plans.compile import Searcher
from siftwell.queries import ANY, ANY_SQL, ONE, TOK, W1, W2, W3, W4, Query, hits, t, table, text_index
from siftwell.sources.index import Index, Keyword, Text, build, impacts, problems
from siftwell.streaming.percolate import percolate, positions

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str, f: Query) -> None:
    QUERIES[name], ORACLE[name] = f, sql


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


SPLIT = r"string_split_regex({}, '[\s\x0B\x{{85}}\p{{Z}}]')"
#: (doc_id, i, raw): the pieces between spaces, empty ones too, and (doc_id, pos, term, start, end) of the tokens
PIECES = rf"pieces AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS i, unnest(x) AS raw FROM (SELECT doc_id, {SPLIT.format('text')} AS x FROM documents))"
PLACED = f"""{PIECES}, placed AS (SELECT doc_id, i, raw, CAST(sum(length(raw) + 1) OVER w - length(raw) - 1 AS INTEGER) AS start,
CAST(sum(CASE WHEN raw <> '' THEN 1 ELSE 0 END) OVER w - 1 AS INTEGER) AS pos FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
tokens AS (SELECT doc_id, lower(raw) AS term, pos, start, CAST(start + length(raw) AS INTEGER) AS "end" FROM placed WHERE raw <> '')"""

# analysis
register("a2_max_length", f"WITH {PLACED} SELECT doc_id, pos, term FROM tokens WHERE length(term) <= 5", lambda s, d: token_table(docs_of(s, d), "doc_id", "text", Analyzer(max_length=5), offsets=False).select("doc_id", "pos", "term"))
register("a3_offsets", f'WITH {PLACED} SELECT doc_id, term, start, "end" FROM tokens', lambda s, d: token_table(docs_of(s, d), "doc_id", "text").select("doc_id", "term", "start", "end"))
STOP = ("the", "was", "with", "die", "que")
register("a5_stop_words", f"WITH {PLACED} SELECT doc_id, pos, term FROM tokens WHERE term NOT IN ('the', 'was', 'with', 'die', 'que')", lambda s, d: token_table(docs_of(s, d), "doc_id", "text", stop_analyzer(STOP), offsets=False).select("doc_id", "pos", "term"))
register("a6_word_set", "WITH k AS (SELECT doc_id, lower(source) AS term FROM documents) SELECT doc_id FROM k WHERE term IN ('src1', 'src2')", lambda s, d: docs_of(s, d).where(~Analyzer(stop=frozenset({"src1", "src2"})).wanted(F.lower("source"))).select("doc_id"))


def word_list(spark: SparkSession, d: str) -> DataFrame:
    """Region names as a word list: trimmed and lower-cased, they go from the nations' comments made of both names."""
    words = frozenset(r[0] for r in table(spark, d, "region").select(F.lower(F.trim("r_name"))).collect())  # a word list is driver data
    both = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat_ws(" ", "n_name", "r_name").alias("s"))
    return token_table(both, "id", "s", Analyzer(stop=words), offsets=False).select("id", "pos", "term")


register("a8_word_list", "WITH b AS (SELECT n_nationkey AS id, string_split(lower(n_name || ' ' || r_name), ' ') AS x FROM nation JOIN region ON n_regionkey = r_regionkey), u AS (SELECT id, CAST(unnest(generate_series(1, len(x))) - 1 AS INTEGER) AS pos, unnest(x) AS term FROM b) SELECT * FROM u WHERE term NOT IN (SELECT lower(r_name) FROM region)", word_list)
register("a9_char_tokenizer", "WITH x AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^A-Za-z]+'), lambda y: y <> '') AS x FROM (SELECT doc_id, text FROM documents)) SELECT doc_id, CAST(unnest(generate_series(1, len(x))) - 1 AS INTEGER) AS pos, unnest(x) AS term FROM x",
         lambda s, d: token_table(docs_of(s, d).withColumn("text", F.lower("text")), "doc_id", "text", LETTERS, offsets=False).select("doc_id", "pos", "term"))
register("a10_whitespace", f"WITH {PLACED} SELECT doc_id, pos, raw AS term FROM placed WHERE raw <> ''", lambda s, d: token_table(docs_of(s, d), "doc_id", "text", WHITESPACE, offsets=False).select("doc_id", "pos", "term"))
STRIP = Analyzer(char_filters=(lambda c: F.regexp_replace(c, "<[^>]*>", " "), lambda c: F.translate(c, ".,;", "   ")))
register("a11_char_filter", rf"WITH x AS (SELECT page_id, list_filter({SPLIT.format(chr(34) + 's' + chr(34))}, lambda y: y <> '') AS x FROM (SELECT page_id, lower(translate(regexp_replace(html, '<[^>]*>', ' ', 'g'), '.,;', '   ')) AS s FROM pages)) SELECT page_id, CAST(unnest(generate_series(1, len(x))) - 1 AS INTEGER) AS pos, unnest(x) AS term FROM x",
         lambda s, d: token_table(table(s, d, "pages"), "page_id", "html", STRIP, offsets=False).select("page_id", "pos", "term"))
register("a12_attributes", f"""WITH {PLACED}, kept AS (SELECT * FROM tokens WHERE term NOT IN ('the', 'was', 'with', 'die', 'que'))
SELECT doc_id, term, pos, CAST(pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS INTEGER) AS pos_inc, 1 AS pos_length, 'word' AS type, 1 AS term_freq FROM kept""",
         lambda s, d: attributes(docs_of(s, d), "doc_id", "text", stop_analyzer(STOP)).drop("payload", "start", "end"))
register("a14_position_gap", rf"""WITH l AS (SELECT doc_id, unnest(generate_series(0, len(v) - 1)) AS k, unnest(v) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents)),
x AS (SELECT doc_id, k, list_filter({SPLIT.format('lower(s)')}, lambda y: y <> '') AS x FROM l), n AS (SELECT *, sum(len(x)) OVER (PARTITION BY doc_id ORDER BY k) - len(x) AS before FROM x)
SELECT doc_id, CAST(before + k * 10 + unnest(generate_series(1, len(x))) - 1 AS INTEGER) AS pos, unnest(x) AS term FROM n""",
         lambda s, d: token_table(docs_of(s, d).select("doc_id", F.split("text", "\n").alias("text")), "doc_id", "text", STANDARD, gap=10, offsets=False).select("doc_id", "pos", "term"))
register("a15_untokenized", "SELECT doc_id, source AS term, 1 AS tf, 1 AS dl FROM documents", lambda s, d: text_index(s, d).postings.where("field = 'source'").select("doc_id", "term", "tf", "dl"))


# index structures
register("b2_problems", f"WITH {TOK} SELECT doc_id, 'text' AS field, 'immense term' AS problem FROM post WHERE octet_length(encode(term)) > 14", lambda s, d: problems(text_index(s, d).postings, {"text": Text(positions=True, max_term_bytes=14)}).select("doc_id", "field", "problem"))
register("b3_norms_docs_only", f"WITH {TOK} SELECT doc_id, term, 1 AS tf, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS dl FROM post", lambda s, d: build(docs_of(s, d), {"text": Text(docs_only=True)}).postings.select("doc_id", "term", "tf", "dl"))
SYNONYMS = Analyzer(synonyms=(("was", ("be", "were")), ("the", ("article",))))
register("b3_norms_overlaps", f"WITH {TOK} SELECT doc_id, CAST(dl AS INTEGER) AS dl, CAST(dl + coalesce(sum(tf * CASE term WHEN 'was' THEN 2 ELSE 1 END) FILTER (term IN ('was', 'the')), 0) AS BIGINT) AS tokens FROM norms JOIN post USING (doc_id) GROUP BY doc_id, dl",
         lambda s, d: build(docs_of(s, d), {"text": Text(SYNONYMS)}).postings.groupBy("doc_id", "dl").agg(F.sum("tf").alias("tokens")))
register("b7_impacts", f"WITH {TOK}, best AS (SELECT term, doc_id // 128 AS block, tf, CAST(min(dl) AS INTEGER) AS dl FROM post JOIN norms USING (doc_id) GROUP BY ALL) SELECT * FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.term = x.term AND y.block = x.block AND y.tf > x.tf AND y.dl <= x.dl)",
         lambda s, d: text_index(s, d).impacts.where("field = 'text'").select("term", "block", "tf", "dl"))


def doc_values(spark: SparkSession, d: str) -> DataFrame:
    """The five kinds of column values of a customer: a number, bytes, one string, and sorted numbers and strings of its orders."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("numbers"), F.sort_array(F.collect_set("o_orderpriority")).alias("words"))
    docs = table(spark, d, "customer").join(orders, "c_custkey", "left").withColumn("raw", F.encode("c_name", "UTF-8")).withColumnRenamed("c_custkey", "doc_id")
    index = Index(docs, docs, docs, docs)
    found = Searcher(index).search(Q.boolean(filter=[Q.Exists("words")], must=[Q.PointRange(("c_acctbal",), (0.0,), (5000.0,))]))
    return C.fetch(found, docs, ["c_acctbal", "raw", "c_mktsegment", "numbers", "words"]).select(
        "doc_id", "c_acctbal", F.length("raw").cast("long").alias("n_raw"), "c_mktsegment", F.size("numbers").cast("long").alias("n_numbers"), F.array_min("numbers").alias("least"), F.array_join("words", "|").alias("words"))


register("d1_doc_values", "SELECT c_custkey AS doc_id, c_acctbal, CAST(octet_length(encode(c_name)) AS BIGINT) AS n_raw, c_mktsegment, n_numbers, least, words FROM customer JOIN (SELECT o_custkey, count(*) AS n_numbers, min(o_orderkey) AS least, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS words FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal BETWEEN 0 AND 5000", doc_values)


def clustered_points(spark: SparkSession, d: str) -> DataFrame:
    from siftwell.sources.points import clustered

    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_quantity", "l_extendedprice", "l_discount")
    index = Index(rows.select("doc_id").distinct(), rows, rows, rows, points=clustered(rows, ["l_quantity", "l_extendedprice", "l_discount"]))
    return Searcher(index).search(Q.PointRange(("l_quantity", "l_extendedprice", "l_discount"), (10.0, 20000.0, 0.03), (20.0, 40000.0, 0.05)))


register("b9_clustered_points", "SELECT DISTINCT l_orderkey AS doc_id, 1.0::DOUBLE AS score FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 20000 AND 40000 AND l_discount BETWEEN 0.03 AND 0.05", clustered_points)
register("q6_point_set_2d", "SELECT DISTINCT l_orderkey AS doc_id, 1.0::DOUBLE AS score FROM lineitem WHERE (l_linenumber, l_suppkey) IN ((1, 3), (2, 5), (4, 7))",
         lambda s, d: Searcher(Index(i := table(s, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), i, i, i, repeated=True)).search(Q.PointSet(("l_linenumber", "l_suppkey"), ((1, 3), (2, 5), (4, 7)))))
register("q9_range_values", "SELECT l_orderkey AS doc_id, q_min, q_max FROM (SELECT l_orderkey, min(l_quantity) AS q_min, max(l_quantity) AS q_max FROM lineitem GROUP BY 1) WHERE q_max - q_min > 20",
         lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.struct(F.array(F.min("l_quantity")).alias("mins"), F.array(F.max("l_quantity")).alias("maxs")).alias("box")).select("doc_id", F.col("box.mins")[0].alias("q_min"), F.col("box.maxs")[0].alias("q_max")).where("q_max - q_min > 20"))
register("q15_scored_prefix", f"WITH {TOK}, top AS (SELECT term, df FROM ts WHERE starts_with(term, 'tha') ORDER BY df DESC, term LIMIT 20) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 - 1 / (1 + tf * (1 / (1.2 * (0.25 + 0.75 * dl / avgdl)))))), 6) AS score FROM post JOIN top USING (term) JOIN norms USING (doc_id) CROSS JOIN fs GROUP BY doc_id",
         lambda s, d: C.rounded(Searcher(text_index(s, d)).search(Q.Scoring("text", "startswith(term, 'tha')", 20))))
_NEAR = """WITH {tok}, x AS (SELECT doc_id, string_split_regex(lower(text), '[\\s\\x0B\\x{{85}}\\p{{Z}}]') AS x FROM documents), y AS (SELECT doc_id, list_filter(x, lambda v: v <> '') AS x FROM x),
p AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS i, unnest(x) AS term FROM y), a AS (SELECT doc_id, i FROM p WHERE term = 'was'), b AS (SELECT doc_id, i FROM p WHERE term = 'the'),
m AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM a JOIN b ON a.doc_id = b.doc_id AND b.i > a.i GROUP BY 1, 2), k AS (SELECT * FROM m WHERE j - i - 1 <= {slop})"""
_PHRASE = "SELECT doc_id, round(w - w / (1 + f * (1 / (1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM (SELECT doc_id, count(*) AS f FROM k GROUP BY doc_id) JOIN norms USING (doc_id) CROSS JOIN fs, (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS w FROM ts CROSS JOIN fs WHERE term IN ('was', 'the'))"
register("q16_span_near", f"{_NEAR.format(tok=TOK, slop=5)} {_PHRASE}", lambda s, d: C.rounded(Searcher(text_index(s, d)).search(Q.Phrase("text", ("was", "the"), 5))))
register("k5_multi_term_idf", f"{_NEAR.format(tok=TOK, slop=0)} {_PHRASE}", lambda s, d: C.rounded(Searcher(text_index(s, d)).search(Q.Phrase("text", ("was", "the")))))
register("q16_spans", f"{_NEAR.format(tok=TOK, slop=5)} SELECT doc_id, 'text' AS field, CAST(i - 1 AS INTEGER) AS start, CAST(j - 1 AS INTEGER) AS \"end\" FROM k", lambda s, d: MM.spans(Searcher(text_index(s, d)), Q.Phrase("text", ("was", "the"), 5)))


# similarities
@dataclass(frozen=True)
class Counts(Similarity):
    """A similarity of one's own: idf of the vector model times the root of the count over the root of the length."""

    def idf(self, df: Column, docs: Column) -> Column:
        return 1 + F.log((docs + 1) / (df + 1))

    def score(self, tf: Column, dl: Column, weight: Column, avgdl: Column) -> Column:
        return weight * F.sqrt(tf) / F.sqrt(dl)


register("k9_own_similarity", f"WITH {TOK} SELECT doc_id, round((1 + ln((n + 1) / (df + 1))) * sqrt(tf) / sqrt(dl), 6) AS score FROM post JOIN ts USING (term) JOIN norms USING (doc_id) CROSS JOIN fs WHERE term = 'was'", lambda s, d: C.rounded(Searcher(text_index(s, d), Counts()).search(t(W2))))
_B4 = "CASE WHEN dl < 24 THEN dl ELSE 24 + floor((dl - 24) / pow(2, greatest(floor(log2(greatest(dl - 24, 1))) - 3, 0))) * pow(2, greatest(floor(log2(greatest(dl - 24, 1))) - 3, 0)) END"
register("k10_byte4_norms", f"WITH {TOK} SELECT doc_id, CAST({_B4} AS BIGINT) AS length, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 - 1 / (1 + tf * (1 / (1.2 * (0.25 + 0.75 * ({_B4}) / avgdl))))), 6) AS score FROM post JOIN ts USING (term) JOIN norms USING (doc_id) CROSS JOIN fs WHERE term = 'was'",
         lambda s, d: (lambda i: C.rounded(Searcher(i, BM25(norms="byte4")).search(t(W2))).join(i.postings.where("field = 'text' and term = 'was'").select("doc_id", byte4(F.col("dl")).alias("length")), "doc_id"))(text_index(s, d)))
register("k1_parameters", f"WITH {TOK} SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 - 1 / (1 + tf * (1 / (2.0 * (0.5 + 0.5 * dl / avgdl))))), 6) AS score FROM post JOIN ts USING (term) JOIN norms USING (doc_id) CROSS JOIN fs WHERE term = 'was'", lambda s, d: C.rounded(Searcher(text_index(s, d), BM25(2.0, 0.5)).search(t(W2))))
register("k8_smoothing", f"WITH {TOK} SELECT doc_id, 0.0::DOUBLE AS score FROM norms", lambda s, d: text_index(s, d).postings.where("field = 'text'").select("doc_id", "dl").distinct().select("doc_id", BM25().smoothing(F.col("dl"), F.lit(2.0), F.lit(100.0)).alias("score")))
register("k7_explain_tree", f"{ANY_SQL} SELECT doc_id, score AS value, 'sum of' AS description, n AS n_details FROM hits JOIN (SELECT doc_id, count(*) AS n FROM sc WHERE term IN ('was', 'with') GROUP BY 1) USING (doc_id)",
         lambda s, d: MM.explain_tree(Searcher(text_index(s, d)), ANY).select("doc_id", F.round("value", 6).alias("value"), "description", F.size("details").cast("long").alias("n_details")))

# trees
class TermsOf(Q.Visitor):
    """Collects leaves, declining what is excluded."""

    def __init__(self) -> None:
        self.found: list[str] = []

    def enter(self, query: Q.Query) -> bool:
        return not isinstance(query, Q.ConstantScore)

    def leaf(self, query: Q.Query) -> None:
        self.found.append(str(query))


TREE = Q.boolean(must=[t(W1), Q.Boost(t(W2), 2.0)], should=[Q.ConstantScore(t(W3)), Q.Prefix("text", "th")], must_not=[t(W4)])


def visited(spark: SparkSession, d: str) -> DataFrame:
    v = TermsOf()
    TREE.visit(v)
    return spark.createDataFrame([(x,) for x in v.found], "leaf string")


register("c7_visitor", "SELECT * FROM (VALUES ('text:the'), ('text:was'), ('text:th*'), ('text:on')) AS v(leaf)", visited)
register("c8_to_string", f"SELECT '{TREE}' AS query", lambda s, d: s.createDataFrame([(str(TREE),)], "query string"))
register("c5_filtered_approximation", f"{ANY_SQL} SELECT doc_id, score FROM hits JOIN documents USING (doc_id) WHERE n_chars BETWEEN 1000 AND 3000 AND lang = 'en'",
         lambda s, d: C.rounded(Searcher(text_index(s, d)).search(Q.boolean(must=[ANY], filter=[Q.PointRange(("n_chars",), (1000,), (3000,)), Q.Term("lang", "en")]))))
register("c6_doc_sets", f"WITH {TOK} SELECT doc_id FROM post WHERE term = 'was' INTERSECT (SELECT doc_id FROM post WHERE term = 'the' UNION SELECT doc_id FROM documents WHERE n_chars < 300)",
         lambda s, d: (lambda x: x.search(t(W2)).select("doc_id").intersect(x.search(t(W1)).select("doc_id").union(x.search(Q.PointRange(("n_chars",), (0,), (299,))).select("doc_id"))))(Searcher(text_index(s, d))))

# collectors
register("t5_total_hits", f"{ANY_SQL} SELECT least(count(*), 101) AS hits, CASE WHEN count(*) > 100 THEN 'GREATER_THAN_OR_EQUAL_TO' ELSE 'EQUAL_TO' END AS relation FROM hits", lambda s, d: C.total_hits(hits(s, d), 100))
register("t5_total_hits_exact", f"{ANY_SQL} SELECT count(*) AS hits, 'EQUAL_TO' AS relation FROM hits", lambda s, d: C.total_hits(hits(s, d), 1 << 30))
register("t4_hit_count", f"{ANY_SQL} SELECT count(*) AS hits FROM hits", lambda s, d: hits(s, d).agg(F.count("*").alias("hits")))
register("t9_sort_types", f"{ANY_SQL} SELECT doc_id, score, source, n_chars FROM hits JOIN documents USING (doc_id) ORDER BY length(text) % 7, source DESC, score DESC, doc_id LIMIT 60",
         lambda s, d: C.sort_by(hits(s, d), docs_of(s, d), [C.SortKey(F.length("text") % 7), C.SortKey(lambda df: F.col("source") if "source" in df.columns else F.lit(None), True), C.SCORE], 60).select("doc_id", "score", "source", "n_chars"))


class Histogram(C.Collector):
    """Hits by tenths of a score."""

    def collect(self, found: DataFrame) -> DataFrame:
        return found.groupBy(F.floor(F.round("score", 6) * 10).alias("tenth")).agg(F.count("*").alias("n"))

    def reduce(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("tenth").agg(F.sum("n").alias("n"))


register("t14_collector", f"{ANY_SQL} SELECT CAST(floor(score * 10) AS BIGINT) AS tenth, CAST(count(*) AS BIGINT) AS n FROM hits GROUP BY 1", lambda s, d: C.collect(Searcher(text_index(s, d)), ANY, Histogram()))
register("t13_partial_aggregates", f"{ANY_SQL} SELECT lang, count(*) AS n, max(score) AS best FROM hits JOIN documents USING (doc_id) GROUP BY lang", lambda s, d: hits(s, d).join(docs_of(s, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.max("score").alias("best")))
register("t12_pruned_top_n", f"{ANY_SQL} SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT 20", lambda s, d: (lambda i: C.rounded(C.top_n_pruned(Searcher(i), [t(W2), t(W3)], 20, i.impacts)))(text_index(s, d)))
KEYS = [C.SortKey("o_orderdate"), C.SortKey("o_totalprice", True)]
register("t11_sorted_index", "SELECT o_orderkey AS doc_id, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_totalprice DESC, o_orderkey LIMIT 50",
         lambda s, d: C.top_by_index_sort(table(s, d, "orders").withColumnRenamed("o_orderkey", "doc_id"), KEYS, [*KEYS, C.SortKey("o_custkey")], 50).select("doc_id", "o_orderdate", "o_totalprice"))
register("t16_counts", "SELECT count(*) AS max_doc, count(*) FILTER (doc_id % 10 <> 0) AS num_docs, count(*) FILTER (doc_id % 10 = 0) AS num_deleted FROM documents",
         lambda s, d: (lambda i: C.counts(Index(i.docs, i.postings, i.field_stats, i.term_stats, i.docs.where("doc_id % 10 = 0").select("doc_id"))))(text_index(s, d)))
register("t1_scores_unrounded_order", f"{ANY_SQL} SELECT count(*) AS n FROM (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT 200)", lambda s, d: C.top_n(Searcher(text_index(s, d)).search(ANY), 200).agg(F.count("*").alias("n")))


def selectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list("o_orderpriority").alias("p"))
    every = docs.select("doc_id", *[C.SortKey("p", selector=k).value().alias(k) for k in ("min", "max", "middle_min", "middle_max")])
    return every


register("s17_selectors", "SELECT o_custkey AS doc_id, p[1] AS min, p[len(p)] AS max, p[(len(p) + 1) // 2] AS middle_min, p[len(p) // 2 + 1] AS middle_max FROM (SELECT o_custkey, list_sort(list(o_orderpriority)) AS p FROM orders GROUP BY 1)", selectors)

# matches
BOTH = "ok AS (SELECT doc_id FROM tokens GROUP BY doc_id HAVING count(*) FILTER (term = 'was') > 0 AND count(*) FILTER (term = 'with') > 0)"
register("m3_offsets", f'WITH {PLACED}, {BOTH} SELECT doc_id, term, pos AS position, start, "end" FROM tokens JOIN ok USING (doc_id) WHERE term IN (\'was\', \'with\')',
         lambda s, d: MM.matches(Searcher(text_index(s, d)), Q.boolean(must=[t(W2), t(W3)])).select("doc_id", "term", "position", "start", "end"))
_M2 = Q.boolean(should=[t(W1), t(W2), t(W3)], must_not=[t(W4)], minimum=2)
_M2_OK = "ok AS (SELECT doc_id FROM tokens GROUP BY doc_id HAVING count(DISTINCT term) FILTER (term IN ('the', 'was', 'with')) >= 2 AND count(*) FILTER (term = 'on') = 0)"
register("m2_boolean_matches", f"WITH {PLACED}, {_M2_OK} SELECT doc_id, term, pos AS position FROM tokens JOIN ok USING (doc_id) WHERE term IN ('the', 'was', 'with')", lambda s, d: MM.matches(Searcher(text_index(s, d)), _M2).select("doc_id", "term", "position"))
register("m4_in_order", f"WITH {PLACED}, {_M2_OK} SELECT doc_id, term, pos AS position, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS nth FROM tokens JOIN ok USING (doc_id) WHERE term IN ('the', 'was', 'with')", lambda s, d: MM.merged(MM.matches(Searcher(text_index(s, d)), _M2)).select("doc_id", "term", "position", "nth"))
register("m5_named", f"WITH {PLACED} SELECT doc_id, term, pos AS position, CASE term WHEN 'was' THEN 'verb' ELSE 'preposition' END AS name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS nth FROM tokens WHERE term IN ('was', 'with')",
         lambda s, d: (lambda x: MM.merged(MM.matches(x, t(W2), "verb"), MM.matches(x, t(W3), "preposition")).select("doc_id", "term", "position", "name", "nth"))(Searcher(text_index(s, d))))

# dictionary
register("e2_seek_exact", f"WITH {TOK} SELECT term, df FROM ts WHERE term = 'was'", lambda s, d: C.seek_exact(text_index(s, d), "text", "was").select("term", "df"))
register("e2_by_ordinal", f"WITH {TOK} SELECT term, df FROM ts ORDER BY term OFFSET 500 LIMIT 1", lambda s, d: C.by_ordinal(text_index(s, d), "text", 500).select("term", "df"))
register("e3_accepted", f"WITH {TOK} SELECT term, df FROM ts WHERE length(term) = 4 AND term < (SELECT min(term) FROM ts WHERE starts_with(term, 'm'))", lambda s, d: C.accepted(text_index(s, d), "text", F.length("term") == 4, F.col("term").startswith("m")).select("term", "df"))
register("e4_automaton_terms", f"WITH {TOK} SELECT term, df FROM ts WHERE regexp_full_match(term, '[a-c].*(ing|ed)')", lambda s, d: C.accepted(text_index(s, d), "text", F.col("term").rlike("^(?:[a-c].*(ing|ed))$")).select("term", "df"))
register("e5_term_list", f"WITH {TOK} SELECT DISTINCT p.doc_id, 1.0::DOUBLE AS score FROM post p JOIN (SELECT DISTINCT lower(n_name) AS term FROM nation UNION SELECT unnest(['was', 'with', 'die'])) USING (term)",
         lambda s, d: Searcher(text_index(s, d)).search(Q.TermSet("text", frozenset(r[0] for r in table(s, d, "nation").select(F.lower("n_name")).collect()) | {"was", "with", "die"})))

# prospective search
register("p2_positions", r"WITH k AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(lower(text), '[\s\x0B\x{85}\p{Z}]'), lambda y: y <> '') AS x FROM conversations), u AS (SELECT id, CAST(unnest(generate_series(1, len(x))) - 1 AS INTEGER) AS pos, unnest(x) AS term FROM k) SELECT * FROM u WHERE term IN ('was', 'the')",
         lambda s, d: positions(table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "text", ["was", "the"], "id").select("id", "pos", "term"))
register("p5_single_points", "SELECT p_partkey AS doc_id, 1::BIGINT AS query_id, 1.0::DOUBLE AS score FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1200",
         lambda s, d: percolate(table(s, d, "part").withColumnRenamed("p_partkey", "doc_id"), {1: Q.PointRange(("p_size", "p_retailprice"), (10, 900.0), (20, 1200.0))}, []))
_P4 = "(1 + ln(2.0 / 2.0)) * sqrt(n) / sqrt(dl)"
register("p4_own_similarity", rf"WITH k AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(lower(text), '[\s\x0B\x{{85}}\p{{Z}}]'), lambda y: y <> '') AS x FROM conversations), c AS (SELECT id, len(list_filter(x, lambda y: y = 'was')) AS n, len(x) AS dl FROM k) SELECT id, 1::BIGINT AS query_id, round({_P4}, 6) AS score FROM c WHERE n > 0",
         lambda s, d: percolate(table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), {1: t("was")}, ["text"], "id", similarity=Counts()).withColumn("score", F.round("score", 6)))
register("s24_memory_index", "SELECT doc_id, CASE WHEN n > 0 THEN round(ln(1 + 0.5 / 1.5) * (1 - 1 / (1 + n * (1 / 1.2))), 6) ELSE 0.0 END AS score FROM (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[\\s\\x0B\\x{85}\\p{Z}]'), lambda y: y = 'was')) AS n FROM documents)",
         lambda s, d: docs_of(s, d).select("doc_id").join(percolate(docs_of(s, d), {1: t("was")}, ["text"]), "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score")))
register("s18_memory_tables", f"WITH {TOK} {ONE} WHERE term = 'was'", lambda s, d: C.rounded(Searcher(build(docs_of(s, d), {"text": Text(), "source": Keyword()})).search(t(W2))))
