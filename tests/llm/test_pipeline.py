"""run() against a plain version of every stage but the classifier, whose own decisions are taken over."""

import corpus_pipeline
from siftwell.llm import decontaminate, ngram_join, toxicity
from tests.llm.test_operators import components, cut_repeats

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}
    parts = components(texts, ngram_join.Rule(5, 8, 10))
    texts = {i: t for i, t in texts.items() if parts[i][1] == i}
    cut = cut_repeats(texts)
    texts = {i: k.decode() if any(g) else texts[i] for i, (n, g, k) in cut.items() if not (n and all(g))}
    items = [(str(r.item_id), decontaminate.item_windows(r.text, 8)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {w: item for item, ws in items for w in ws}
    want = {}
    for i, t in texts.items():
        w = t.encode().translate(decontaminate.FOLD).split()
        found = {known[tuple(w[k : k + 8])] for k in range(len(w) - 7) if tuple(w[k : k + 8]) in known}
        if len(found) < 2:
            want[i] = (t, len(found))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].text == t and not n or len(got[i].text) < len(t) for i, (t, n) in want.items())
    assert sorted(r.mix_slot for r in got.values() if r.mix_place == 0) == list(range(len({r.mix_slot for r in got.values()})))
    given = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(r.text) == r.n_chars for i, r in got.items() if r.text != given[i])
