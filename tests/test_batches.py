import itertools

import pytest
from pyspark.sql import functions as F

from siftwell.functions import analysis as A
from siftwell.sources import index as I
from siftwell.sources.store import IndexStore

ODD = ["", " ", "a", "The was the WAS", "İx ÀB\u0085straße ΑΣ Σ", "x\U0001f600y　  é\x1cz᠎w", "  the  the\n", "​ was was was", "ﬁ Ⅷ ẞ K"]
ANALYZERS = [A.STANDARD, A.WHITESPACE, A.Analyzer(stop=frozenset({"the"}), max_length=3), A.Analyzer(synonyms=(("was", ("be", "the", "the")), ("the", ("article",))))]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("k", range(len(ANALYZERS)))
def test_batches_agree_with_columns(spark, monkeypatch, k):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*ODD, None, *map("".join, itertools.permutations(ODD, 2))])], "doc_id long, text string").cache()
    kinds = [I.Text(ANALYZERS[k], positions=p, offsets=o, docs_only=n, discount_overlaps=not n) for p, o, n in ((False, False, False), (False, False, True), (True, True, False), (True, False, True))]
    found = lambda: [rows(A.token_table(df, "doc_id", "text", ANALYZERS[k])), rows(A.attributes(df, "doc_id", "text", ANALYZERS[k])), *(rows(I.postings_of(df, {"text": c})) for c in kinds)]
    quick = found()
    for c, want in zip(kinds, quick[2:], strict=True):
        assert rows(I.unpacked(I.postings_of(df, {"text": c}, packed=True).drop("problem"))) == want
    monkeypatch.setattr(A, "quick", lambda *_: False)
    monkeypatch.setattr(I, "quick", lambda *_: False)
    assert found() == quick
    for c, want in zip(kinds, quick[2:], strict=True):
        assert rows(I.unpacked(I.postings_of(df, {"text": c}, packed=True).drop("problem"))) == want


def test_postings_take_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    for c in (I.Text(), I.Text(positions=True, offsets=True), I.Text(docs_only=True), I.Text(A.Analyzer(synonyms=(("a", ("c",)),)))):
        assert "Exchange" not in I.postings_of(df, {"text": c})._jdf.queryExecution().executedPlan().toString()


def test_problems_travel_with_packed_postings(spark):
    import numpy as np

    from siftwell.functions import batches

    begins, pos = np.array([0, 2, 4, 5, 5]), np.array([3, 1, 1, 2, 7])
    places, spans, problem = batches._packed(begins, pos, pos, pos + np.array([1, 1, 1, -1, 0]))
    assert problem.to_pylist() == ["position", "offset", None, None]
    assert [x.to_pylist() for x in batches.lists(places, spans)] == [[[3, 1], [1, 2], [7], []], [[3, 1], [1, 2], [7], []], [[4, 2], [2, 1], [7], []]]


def test_impacts_of_split_files(spark, tmp_path):
    docs = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.expr("repeat('b ', cast(id * 7 % 5 as int))"), F.expr("repeat('c ', cast(id * 11 % 13 as int))"), F.concat(F.lit("w"), F.col("id") % 50)).alias("text"))
    keys = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1", "parquet.block.size": "4096"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        with IndexStore(spark, str(tmp_path / "i"), {"text": I.Text(positions=True)}) as s:
            s.add(docs)
        index = s.open()
        got = rows(index.impacts.select("field", "term", "block", "tf", "dl"))
        assert got == rows(I.impacts(index.postings)) and len(got) > 1000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_commit_shuffles_no_impacts_and_reports_failures(spark, tmp_path):
    with IndexStore(spark, str(tmp_path / "i"), {"text": I.Text()}) as s:
        s.add(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"))
    written = spark.read.parquet(str(tmp_path / "i" / "postings" / "*"))
    assert "Exchange" not in I.impacts_in_order(written)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ZeroDivisionError):
        s._together(lambda: None, lambda: 1 / 0)
