import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions.analysis import Analyzer, token_table
from siftwell.functions.similarity import BM25
from siftwell.operators import collect as C
from siftwell.operators import query as Q
from siftwell.plans.compile import Searcher
from siftwell.plans.rewrite import rewrite
from siftwell.sources.index import Keyword, Text, build
from siftwell.sources.store import IndexStore
from siftwell.streaming.percolate import percolate

WORDS = list("abcdefgh")


def t(w):
    return Q.Term("body", w)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 9)))) for i in range(40)]
    return rows, Searcher(build(spark.createDataFrame(rows, "doc_id long, body string").cache(), {"body": Text()}))


def naive(q, text):
    """(matches, whether a term's score counts as above zero) by plain evaluation."""
    words = text.split()
    if isinstance(q, Q.Term):
        return q.term in words
    if isinstance(q, Q.MatchAll):
        return True
    if isinstance(q, Q.MatchNone):
        return False
    if isinstance(q, Q.Boost | Q.ConstantScore):
        return naive(q.query, text)
    if isinstance(q, Q.DisMax):
        return any(naive(c, text) for c in q.queries)
    need = q.of(Q.Occur.MUST) + q.of(Q.Occur.FILTER)
    should = q.of(Q.Occur.SHOULD)
    if not need and not should:
        return False
    n = sum(naive(c, text) for c in should)
    return all(naive(c, text) for c in need) and not any(naive(c, text) for c in q.of(Q.Occur.MUST_NOT)) and n >= max(q.minimum, 0 if need else 1)


def random_query(r, depth=2):
    if depth == 0 or r.random() < 0.4:
        return r.choice([t(r.choice(WORDS)), t(r.choice(WORDS)), Q.Boost(t(r.choice(WORDS)), 2.0), Q.MatchAll()])
    kind = r.random()
    if kind < 0.15:
        return Q.DisMax((random_query(r, depth - 1), random_query(r, depth - 1)), 0.5)
    if kind < 0.3:
        return Q.ConstantScore(random_query(r, depth - 1))
    clauses = tuple((r.choice(list(Q.Occur)), random_query(r, depth - 1)) for _ in range(r.randint(1, 4)))
    return Q.Boolean(clauses, r.choice([0, 0, 1, 2]))


def test_random_trees_match_plain_evaluation_and_rewrites_keep_scores(corpus):
    rows, searcher = corpus
    r = random.Random(11)
    for _ in range(14):
        q = random_query(r)
        plain = {x.doc_id: x.score for x in searcher.search(q, rewritten=False).collect()}
        assert sorted(plain) == [i for i, text in rows if naive(q, text)], str(q)
        better = {x.doc_id: x.score for x in searcher.search(q).collect()}
        assert better.keys() == plain.keys(), (str(q), str(rewrite(q)))
        assert all(abs(better[i] - plain[i]) < 1e-9 for i in plain), (str(q), str(rewrite(q)))


def test_golden_score(spark):
    s = Searcher(build(spark.createDataFrame([(0, "some text")], "doc_id long, f1 string"), {"f1": Text()}))
    for word in ("some", "text"):
        assert abs(s.search(Q.Term("f1", word)).first().score - 0.13076457) < 1e-8
    assert s.search(Q.Term("f1", "some text")).count() == 0


def test_tokens_positions_and_offsets(spark):
    df = spark.createDataFrame([(1, "Aa  bb the cc ")], "id long, s string")
    rows = token_table(df, "id", "s", Analyzer(stop=frozenset({"the"}))).orderBy("pos").collect()
    assert [(r.term, r.pos, r.start, r.end) for r in rows] == [("aa", 0, 0, 2), ("bb", 1, 4, 6), ("cc", 3, 11, 13)]
    assert token_table(df, "id", "s", Analyzer(keep_empty=True)).count() == 6


def test_repeated_values_and_keywords(spark):
    docs = spark.createDataFrame([(1, ["la la", "foo bar foo bar foo"], "x")], "doc_id long, text array<string>, k string")
    for positions in (False, True):
        p = {(r.field, r.term): r.tf for r in build(docs, {"text": Text(positions=positions), "k": Keyword()}).postings.collect()}
        assert p == {("text", "la"): 2, ("text", "foo"): 3, ("text", "bar"): 2, ("k", "x"): 1}


def test_paging_and_ties(spark):
    hits = spark.createDataFrame([(i, 1.0 if i % 2 else 2.0) for i in range(10)], "doc_id long, score double")
    every = [r.doc_id for r in C.top_n(hits, 10).collect()]
    assert every == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    assert [r.doc_id for r in C.top_n(hits, 3, after=(2.0, 6)).collect()] == [8, 1, 3]
    assert [r.doc_id for r in C.page(hits, 4, 3).collect()] == [8, 1, 3]
    assert C.page(hits, 40, 3).count() == 0


def test_selectors(spark):
    docs = spark.createDataFrame([(1, [3, 1, 2, 9]), (2, [5]), (3, [])], "doc_id long, v array<int>")
    for kind, want in (("min", 1), ("max", 9), ("middle_min", 2), ("middle_max", 3)):
        got = docs.select("doc_id", C.SortKey("v", selector=kind).value().alias("x")).orderBy("doc_id").collect()
        assert [r.x for r in got] == [want, 5, None]


def test_validation():
    for bad in (lambda: Q.Boost(Q.MatchAll(), -1), lambda: Q.PointRange(("a",), (1, 2), (3,)), lambda: Q.RangeField(("a",), ("b",), (2,), (1,)), lambda: BM25(b=2), lambda: Q.boolean(should=[t("a")] * 1025)):
        with pytest.raises(ValueError):
            bad()
    assert str(Q.boolean(must=[t("a")], must_not=[t("b")])) == "+body:a -body:b"


def test_store_commits_updates_and_compacts(spark, tmp_path):
    path, fields = str(tmp_path / "index"), {"body": Text(), "key": Keyword()}
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, key string, body string")
    with IndexStore(spark, path, fields, "create") as s:
        s.add(make([(1, "x", "red fox"), (2, "y", "red dog"), (3, "z", "blue dog")]))
    with IndexStore(spark, path, fields) as s:
        s.update(F.col("key") == "y", make([(2, "y", "green dog")]))
        assert s.version() == 1
    s = IndexStore(spark, path, fields, "append")
    with pytest.raises(RuntimeError):
        IndexStore(spark, path, fields)
    found = lambda g=None: sorted((r.doc_id, r.body) for r in s.open(g).live.collect())
    assert found(1) == [(1, "red fox"), (2, "red dog"), (3, "blue dog")]
    assert found() == [(1, "red fox"), (2, "green dog"), (3, "blue dog")]
    hits = lambda w: sorted(r.doc_id for r in Searcher(s.open()).search(t(w)).collect())
    assert hits("red") == [1] and hits("green") == [2]
    stats = lambda: {r.term: r.df for r in s.open().term_stats.collect()}
    assert stats()["red"] == 2  # deletes don't change statistics until rows are rewritten
    s.compact()
    assert stats()["red"] == 1 and len(found()) == 3
    s.vacuum()
    assert len(found()) == 3
    s.__exit__(None, None, None)


def test_percolation_batch_and_stream_agree(spark, tmp_path):
    queries = {1: Q.Term("text", "fox"), 2: Q.boolean(must=[Q.Term("text", "red")], must_not=[Q.Term("text", "dog")])}
    docs = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, "some text"), (4, None)], "doc_id long, text string")
    want = {(r.doc_id, r.query_id) for r in percolate(docs, queries, ["text"]).collect()}
    assert want == {(1, 1), (1, 2)}
    docs.write.parquet(str(tmp_path / "in"))
    stream = percolate(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), queries, ["text"])
    run = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert {(r.doc_id, r.query_id) for r in spark.table("found").collect()} == want
    assert abs(percolate(docs, {9: Q.Term("text", "text")}, ["text"]).first().score - 0.13076457) < 1e-8


def test_pairs_of_occurs(corpus):
    rows, searcher = corpus
    for a, b in itertools.product(Q.Occur, repeat=2):
        q = Q.Boolean(((a, t("a")), (b, t("b"))))
        assert sorted(r.doc_id for r in searcher.search(q).collect()) == [i for i, text in rows if naive(q, text)], str(q)


def test_long_terms_are_indexed(spark):
    long = "x" * 40_000
    docs = spark.createDataFrame([(1, f"a {long}"), (2, "a b")], "doc_id long, text string")
    for positions in (False, True):
        index = build(docs, {"text": Text(positions=positions)})
        assert {(r.doc_id, r.term, r.dl) for r in index.postings.collect()} == {(1, "a", 2), (1, long, 2), (2, "a", 2), (2, "b", 2)}
        assert index.field_stats.first().sum_ttf == 4


def test_phrases_against_plain_search(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices("abc", k=r.randint(1, 12)))) for i in range(40)]
    s = Searcher(build(spark.createDataFrame(rows, "doc_id long, body string"), {"body": Text(positions=True)}))
    for words, slop in ((("a", "b"), 0), (("a", "b", "c"), 1), (("a", "a"), 0), (("b",), 0)):
        want = set()
        for i, text in rows:
            w = text.split()
            for start in range(len(w)):
                at = start if w[start] == words[0] else None
                for x in words[1:]:
                    at = None if at is None else next((k for k in range(at + 1, len(w)) if w[k] == x), None)
                if at is not None and at - start - (len(words) - 1) <= slop:
                    want.add((i, start, at))
        from siftwell.operators.matches import spans

        assert {(x.doc_id, x.start, x.end) for x in spans(s, Q.Phrase("body", words, slop)).collect()} == want


def test_total_hits_and_merging(spark):
    hits = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "doc_id long, score double")
    assert tuple(C.total_hits(hits, 20).first()) == (21, "GREATER_THAN_OR_EQUAL_TO")
    assert tuple(C.total_hits(hits, 50).first()) == (50, "EQUAL_TO")
    got = C.merge_top([hits.where("doc_id < 25"), hits.where("doc_id >= 25")], 2, 5).collect()
    want = sorted(((-float(i % 7), int(i >= 25), i) for i in range(50)))[2:7]
    assert [(-r.score, r.shard, r.doc_id) for r in got] == want and {r.total for r in got} == {50}


def test_failed_commit_can_be_repeated(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", "red fox")], "doc_id long, key string, body string")
    s = IndexStore(spark, str(tmp_path / "i"), {"body": Text(), "key": Keyword()})
    s.add(docs)
    record, s._record = s._record, lambda *_: (_ for _ in ()).throw(OSError("full"))
    with pytest.raises(OSError):
        s.commit()
    s._record = record
    assert s.commit() == 1 and s.open().docs.count() == 1
    s.vacuum()
    s.__exit__(None, None, None)


def test_empty_boolean_is_refused():
    with pytest.raises(ValueError):
        Q.boolean()
