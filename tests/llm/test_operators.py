"""The corpus operators against brute-force versions, on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import gzip
import hashlib
import io
import time
from fractions import Fraction
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import buckets, decontaminate, fm_index, html, jpeg, mixing, ngram_join, quality, store, substring, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, sig long"


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edit(r, text, k):
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base, passage = words(r, 150), words(r, 60, 10**6)
    texts = [None, "", "  \n ", "one", "One two", "a b c", base, base, words(r, 20_000), "x" * 100_000, "!!! ### \x7f", "été ẞ naïve Ünï"]
    texts += [edit(r, base, k % 6) for k in range(40)]
    texts += [words(r, 30) + " " + passage + " " + words(r, 30) for _ in range(12)]
    texts += [words(r, r.randint(1, 60)) for _ in range(60)]
    chain = words(r, 120)
    for _ in range(25):
        chain = edit(r, chain, 1)
        texts.append(chain)
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3 and 0}", len(t or ""), 5, 6) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


def components(texts, rule):
    sets = {}
    for i, t in texts.items():
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + rule.n]) for k in range(len(w) - rule.n + 1)} if len(w) >= rule.n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.Rule(5, 8, 10), ngram_join.Rule(block=4)])
def test_ngram_join(docs, rows, rule):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs, rule).collect()}
    assert got == components({r[0]: r[1] for r in rows}, rule)


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
@pytest.mark.parametrize("frequent", [1, 40])
def test_spread_join_adds_no_join(spark, kind, frequent):
    """Frequent keys, whether few or many, go their own way by a filter: no semi or anti join passes the other rows on once more."""
    ids = spark.range(6_000)
    left = ids.select(F.when(F.col("id") % 11 != 0, F.when(F.col("id") % 3 == 0, F.col("id") % frequent).otherwise(100 + F.col("id"))).alias("k"), "id")
    right = spark.range(4_000).where("id % 5 <> 1").selectExpr("id as k", "id * 7 as v")
    both = [t.withColumn("k", F.col("k").cast("string").cast(kind)) for t in (left, right)]
    got = buckets.join_spread(*both, "k", most=200)
    want = sorted((i, 7 * k if (k := i % frequent if i % 3 == 0 else 100 + i) < 4_000 and k % 5 != 1 and i % 11 else -1) for i in range(6_000))
    assert sorted((r.id, -1 if r.v is None else r.v) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == plan.count("Join ") == 2, plan


def cut_repeats(texts, width=13):
    first, out = {}, {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    for i in texts:
        w = (texts[i] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), gone, b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(docs).collect()}
    assert got == {i: (n, sum(g), hashlib.sha256(k).hexdigest()) for i, (n, g, k) in cut_repeats({r[0]: r[1] for r in rows}).items()}


def test_fm_index_statistics():
    r = np.random.default_rng(1)
    seqs = [r.integers(1, 5, n) for n in (30, 1, 50, 7)]
    index = fm_index.FMIndex(seqs, 5, 8)
    query = r.integers(1, 5, 60)
    length, low, high = index.matching_statistics(query, np.arange(1, 61), 8)
    texts = ["".join(map(str, s)) for s in seqs]
    for e in range(1, 61):
        want = max(k for k in range(9) if k <= e and any("".join(map(str, query[e - k : e])) in t for t in texts))
        assert length[e - 1] == want
        if want:
            p = "".join(map(str, query[e - want : e]))
            assert high[e - 1] - low[e - 1] == sum(t.startswith(p, i) for t in texts for i in range(len(t)))


def test_decontaminate(spark, docs, rows):
    items = [(1, " ".join(rows[55][1].split()[35:60])), (2, rows[60][1]), (10, "One, TWO!"), (3, None), (4, ""), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: (t or "").encode().translate(decontaminate.FOLD).split()
    want = {}
    for i, t, *_ in rows:
        w = split(t)
        hit, found = [False] * len(w), set()
        for item, text in items:
            for x in decontaminate.item_windows(text, 8):
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit[k : k + len(x)] = [True] * len(x)
                        found.add(str(item))
        want[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench).collect()}
    assert got == want and any(x[4] for x in want.values())
    joined = decontaminate.scan(docs, bench, broadcast_bytes=0).select("doc_id", "n_words", "n_hit", F.size("items").alias("k")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.k) for r in joined} == {i: x[:3] for i, x in want.items()}
    kept = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
    assert kept.keys() == {i for i, x in want.items() if not x[4]} and kept[4] == "" and kept[5] == "a b c"


def test_token_counts_and_cache(spark, docs, rows, tmp_path):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = tokens.DigestCache(spark, str(tmp_path / "cache"))
    want = {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in rows}
    for known in (False, True):
        got = tokens.count_tokens(docs, path, cache).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and {r.cached for r in got} == {known}
    assert cache.read(tokens.tokenizer_digest(path)).count() == len({t or "" for _, t, *_ in rows})


def test_token_counts_of_null_ids(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    cache = tokens.DigestCache(spark, str(tmp_path / "cache"))
    docs = spark.createDataFrame([(None, "only here"), (None, "only here"), (None, "only thee"), (None, "also one"), (1, "also one"), (None, None)], "doc_id long, text string")
    got = tokens.count_tokens(docs, path, cache).collect()
    assert len(got) == 6 and all((r.n_tokens > 0) == (r.n_bytes > 0) for r in got)
    assert cache.read(tokens.tokenizer_digest(path)).count() == 4


def test_media_round_trip(docs, rows):
    got = {r.doc_id: r for r in jpeg.media_columns(store.Table(jpeg.stored_media(docs), "test-media").read(), with_tensor=True).collect()}
    for i, t, *_ in rows:
        raw = jpeg.pad((t or "").encode())
        assert (got[i].payload_bytes, got[i].payload_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert len(got[i].rgb) == got[i].height * got[i].width * 3 and got[i].media_sha256 == hashlib.sha256(jpeg.encode_payload(raw)).hexdigest()
    assert got[6].feature == got[7].feature


def test_general_scans_agree_with_fast_ones():
    """A file with zero runs, end-of-band runs and refinement of new coefficients, read bit by bit."""
    table = {4: [0x00, 0x10, 0x01, 0x11, 0x21, 0x02, 0x12, 0xF0, 0x03]}
    codes = {s: format(i, "04b") for i, s in enumerate(table[4])}
    frame = jpeg._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([2]) * 64) + frame + jpeg._table(0x00, jpeg.DC_SIZES) + jpeg._table(0x10, table)
    bits = lambda s: jpeg._pack(np.frombuffer(s.encode(), np.uint8) - 48)
    dc = jpeg._scan([1], 0x00, 0, 0, 0, 0, bits(jpeg._DC_BITS[5] + jpeg._DC_BITS[-3]))
    # block 0: k=1 +1<<1, k=20 -1<<1 (sixteen zeros, then two more); block 1: nothing
    first = jpeg._scan([1], 0x00, 1, 63, 0, 1, bits(codes[0x01] + "1" + codes[0xF0] + codes[0x21] + "0" + codes[0x10] + "1"))
    # refinement: block 0 gets +1 at k=2 (correcting k=1 upwards), k=20 corrected at the end of the band; block 1 gets nothing
    second = jpeg._scan([1], 0x00, 1, 63, 1, 0, bits(codes[0x01] + "1" + "1" + codes[0x00] + "1" + codes[0x00]))
    image = jpeg.Image(head + dc + first + second + b"\xff\xd9")
    flat = image.planes[0].reshape(2, 64)
    want = np.zeros((2, 64), int)
    want[0, [0, 1, 2, 20]], want[1, 0] = [5, 3, 1, -3], 2
    assert (flat == want).all() and image.pixels().shape == (8, 16, 3)
    with pytest.raises(ValueError):
        jpeg.Image(head + dc)


def test_warc(spark):
    pages = [(1, "http://a/ b", "x" * 99), (2, None, "x" * 99), (5, "u", "é" * 50), (3, "u", "é" * 50), (4, "u", "é" * 50), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1" * 30)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3), 5: ("revisit", 3), 6: ("response", None), 7: ("response", None)}
    for i, _, h in pages:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    raw = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>")], b"b" * k) for k in range(5)]
    done = io.BytesIO()
    index = warc.read_index(warc.index_lines(warc.normalise(io.BytesIO(gzip.compress(b"".join(raw[:3])) + gzip.compress(b"".join(raw[3:]))), done)))
    assert [gzip.decompress(done.getvalue()[offset : offset + length]) for offset, length, _ in index] == raw


def test_warc_files_repeats_and_clashes(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "p" * 200, 1), (3, "u", "p" * 200, 2), (3, "u", "p" * 200, 3), (9, None, None, 4)], "page_id long, url string, html string, digest long")
    (tmp_path / "out").mkdir()
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages, folder=f"file://{tmp_path}/out").collect()), key=str)
    assert got == [(0, "revisit", 3), (3, "response", None), (3, "response", None), (9, "response", None)]
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names and all(f"{n}.idx" in names for n in names if n.endswith(".warc.gz")) and not [n for n in names if n.endswith(".part")]
    for n in names:
        if n.endswith(".warc.gz"):  # any reader of such files can open them
            whole = gzip.decompress((tmp_path / "out" / n).read_bytes())
            assert whole.startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.where("false")).count() == 0


def test_html():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><header>H</header><nav><ul><li><a href="/">n</a></ul></nav>'
        '<div class="ad">Ad.</div><div id=main><h1>Title &amp; more</h1><p>First, <b>bo</b>ld  text.<br>Next<p>Second &copy; para, long enough, really.<aside>side</aside>'
        '<form><p>Form, text, here</p></form></div><div class="comments"><p>Comment, one, two, three</p></div><footer>F</footer></body>'
    )
    assert html.extract(page) == "Title & more First, bold text. Next Second © para, long enough, really."
    assert [html.extract(x) for x in (None, "", "  ", "<", "plain", "<p>a<p>b", "<script>x")] == ["", "", "", "<", "plain", "a b", ""]


def test_html_wrappers_named_after_what_they_have():
    prose = "".join(f"<p>Paragraph {i}, of the article, is long enough to be read.</p>" for i in range(8))
    want = " ".join(f"Paragraph {i}, of the article, is long enough to be read." for i in range(8))
    for name in ("has-sidebar", "no-comments", "elementor-widget-container", "page print"):
        for inner in (prose, f"<article>{prose}</article>", f"<main>{prose}</main>"):
            page = f'<body><div id=page class="{name}">{inner}<div class="sidebar"><p>Side, by side, of it all.</p></div></div><div class="ad"><p>Ad, ad.</p></div></body>'
            assert html.extract(page) == want, (name, inner[:9])
    for name in ("post social-science", "notice-board-history"):
        assert html.extract(f'<body><article><h1>T</h1><div class="{name}">{prose}</div></article></body>').endswith(want)
        assert html.extract(f'<body><div class="{name}">{prose}</div><div class="ad-slot"><p>Ad, ad, ad.</p></div></body>') == want
    assert html.extract(f'<body><article>{prose}<div class="share-this"><a href=x>Share it here</a></div></article></body>') == want
    comments = '<section class="comments-area">' + "<article><p>" + "A comment, long, longer. " * 90 + "</p></article></section>"
    assert html.extract(f"<body><article>{prose}{comments}</article></body>") == html.extract(f"<body><article>{prose}</article>{comments}</body>") == want


def test_html_references_and_damage():
    assert html.extract("<p>&am<b>p;lt;</b> &amp;lt; <![CDATA[&amp;]]> x&nbsp;y</p>") == "&amp;lt; &lt; &amp; x y".replace("&amp;lt; &lt;", "&am" + "p;lt; &lt;")
    assert html.extract('<p title=">a">b</p><p a=""">c</p>') == "b c"


def test_html_takes_time_in_proportion():
    for page in ("<a " * 300_000, "<div>" * 200_000 + "text, here", "</b>" * 250_000, "<td><b>" * 100_000 + "</i>" * 100_000, "<header>" * 120_000, "<p>a, b " * 120_000, "<" * 1_000_000, '<a b="' * 150_000, "<div class=x-ad>t" * 60_000, "<!--" * 250_000):
        began = time.process_time()
        html.extract(page)
        assert time.process_time() - began < 8, page[:20]


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, block_rows=2, temperature=1.0).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    blocks = {}
    for r in got:
        blocks.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_to_the_weights_over_many_frames(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "case when id < 800 then 'rare' when id % 3 = 0 then 'hot' else concat('s', id % 19) end as source")
    n = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}
    for weights in (None, {s: 3e-4 if s == "rare" else 0.37 if s == "hot" else 0.03 + 0.0017 * int(s[1:]) for s in n}):
        w = weights or {s: k**0.5 for s, k in n.items()}
        total = sum(w.values())
        end = int(min(n[s] / w[s] for s in n) * total)
        seen = {}
        for r in mixing.mix(docs, weights, block_rows=1).collect():
            seen.setdefault(r.source, []).append(r.mix_slot)
        assert {s: len(x) for s, x in seen.items()} == n and end > 20_000
        for s, slots in seen.items():
            slots = [t for t in sorted(slots) if t < end]
            # before and after each slot of the source, where the deviation is largest
            assert all(abs(k - t * w[s] / total) < 1 + 1e-4 and abs(k + 1 - (t + 1) * w[s] / total) < 1 + 1e-4 for k, t in enumerate(slots)), s


def test_plans_deviate_by_less_than_a_block():
    """Against the fluid mixture, by exact fractions, over many slots."""
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 1_000_000, "b": 1}, {"a": 5, "b": 3, "c": 3, "d": 1}):
        total, end = sum(weights.values()), 300_000
        blocks = {s: w * end // total + 1 for s, w in weights.items()}
        last = min(Fraction(blocks[s] * total, w) for s, w in weights.items())
        for s, slots, _, _ in mixing.plan(blocks, {s: float(w) for s, w in weights.items()}):
            for k, t in enumerate(slots.tolist()):
                if t + 1 < last:
                    assert abs(k - Fraction(t * weights[s], total)) < 1 + Fraction(1, 10**5) and abs(k + 1 - Fraction((t + 1) * weights[s], total)) < 1 + Fraction(1, 10**5)


def test_plan_is_earliest_deadline_first():
    r = random.Random(2)
    for _ in range(20):
        blocks = {f"s{i}": r.randint(1, 12) for i in range(r.randint(1, 5))}
        found = list(mixing.plan(blocks, {s: r.choice([1.0, 2.0, 0.3, 7.0]) for s in blocks}))
        jobs = [(int(d), s, k, int(t)) for s, _, release, due in found for k, (t, d) in enumerate(zip(release, due, strict=True))]
        want, done = {}, {s: 0 for s in blocks}
        for t in range(sum(blocks.values())):
            due, s, k, _ = min((j for j in jobs if j[3] <= t and j[2] == done[j[1]]), key=lambda j: (j[0], j[1]))
            assert t < due
            want[s, k], done[s] = t, done[s] + 1
        assert {(s, k): int(t) for s, slots, _, _ in found for k, t in enumerate(slots)} == want


def test_mixing_many_sources_large_tables_and_clashes(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('s', case when id < 200 then 0 else id % 50 end) as source", "id as mix_block", "'x' as mix_slot")
    got = mixing.mix(docs, max_sources=5, max_blocks=40)
    assert got.columns == [*docs.columns, *[f"_mix_{c}" for c in ("block", "slot", "release", "deadline", "place")]]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(400)) and all(r.mix_block == r.doc_id and r["_mix_release"] <= r["_mix_slot"] < r["_mix_deadline"] for r in rows)
    assert len({r["_mix_slot"] for r in rows}) <= 40 + 6 and max(r["_mix_place"] for r in rows) == 15


def fluid(n, w, at):
    """What has flowed of each source when `at` rows have in all."""
    v, left, open_ = 0, at, sorted(n, key=lambda s: n[s] / w[s])
    while open_ and left > 0:
        rate = sum(w[s] for s in open_)
        step = min(n[open_[0]] / w[open_[0]] - v, left / rate)
        v, left = v + step, left - step * rate
        open_ = [s for s in open_ if n[s] / w[s] - v > 1e-9]
    return {s: min(n[s], w[s] * v) for s in n}


@pytest.mark.parametrize("weighted", [False, True])
def test_mixing_keeps_to_the_weights_beyond_max_sources(spark, weighted):
    """No source, planned alone or not, is a block away from its target at any slot."""
    r = random.Random(5)
    n = {"a": 400, None: 12, "\x00others": 8} | {f"{c}{i}": 40 if weighted else r.choice([4, 8, 20]) for c in "hl" for i in range(10)}
    w = {s: 4.0 if str(s)[0] == "h" else 1.0 for s in n} if weighted else {s: k**0.5 for s, k in n.items()}
    size = 4 if weighted else 1
    data = [(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    docs = spark.createDataFrame(data, "doc_id long, source string")
    given = {s: x for s, x in w.items() if x != 1} if weighted else None
    got = sorted(mixing.mix(docs, given, block_rows=size, max_sources=2).collect(), key=lambda x: (x.mix_slot, x.mix_place))
    assert sorted((x.doc_id, x.source) for x in got) == data
    assert [(x.mix_slot, x.mix_place) for x in got] == [(k // size, k % size) for k in range(len(data))]
    seen = dict.fromkeys(n, 0)
    for k, x in enumerate(got, 1):
        seen[x.source] += 1
        if k % size == 0:
            want = fluid(n, w, k)
            assert all(abs(seen[s] - want[s]) <= size + 1e-6 for s in n), (k, {s: (seen[s], want[s]) for s in n if abs(seen[s] - want[s]) > size})


def test_null_and_repeated_ids_in_join_and_decontamination(spark):
    r = random.Random(7)
    base, alone, item = words(r, 120), words(r, 80), words(r, 40)
    near, middle, far = base + " x1", base + " x1 " + " ".join(f"y{i}" for i in range(20)), base + " x1 " + " ".join(f"y{i}" for i in range(40))
    data = [(1, base), (None, near), (None, alone), (None, alone), (5, alone + " z"), (None, None), (7, words(r, 50)), (7, words(random.Random(8), 50)), (None, words(r, 60)), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, k int")
    assert sorted(x.k for x in ngram_join.keep_one(docs).collect()) == [0, 4, 5, 6, 7, 8, 9]
    pair = spark.createDataFrame([(None, alone, 0), (None, alone + " z", 1), (None, alone, 2)], docs.schema)
    assert ngram_join.keep_one(pair).count() == 1
    chain = spark.createDataFrame([(1, base), (None, middle), (3, far)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.classes(chain, ngram_join.Rule(5, 8, 10)).collect()}
    assert got == {1: 1, None: 1, 3: 1}

    bench = spark.createDataFrame([(1, item), (2, words(r, 40))], "item_id long, text string")
    both = item + " " + bench.collect()[1].text
    data = [(1, "q " + item + " r"), (1, "q " + item + " r"), (None, both), (None, "clean"), (3, both), (4, None), (None, "s " + item)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, k int")
    want = [(1, "q  r", 0), (1, "q  r", 1), (None, "clean", 3), (4, None, 5), (None, "s ", 6)]
    assert sorted((tuple(x) for x in decontaminate.clean(docs, bench).collect()), key=lambda x: x[2]) == want
    shuffled = decontaminate.scan(docs, bench, broadcast_bytes=0, whole="__").collect()
    assert {x.k: len(x["__items"]) for x in shuffled} == {0: 1, 1: 1, 2: 2, 3: 0, 4: 2, 5: 0, 6: 1}


def test_clashing_columns(spark):
    r = random.Random(4)
    names = ["__items", "__spans", "__text", "__doc", "__info", "__id", "__candidates", "__n_words", "mix_slot", "__mix_s", "root", "key"]
    docs = spark.createDataFrame([(i, words(r, 40), "s", *["c"] * len(names)) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    bench = spark.createDataFrame([(1, docs.first().text)], "item_id long, text string")
    for found in (decontaminate.clean(docs, bench), substring.remove(docs), ngram_join.keep_one(docs), toxicity.keep_clean(docs, spark.createDataFrame([], "doc_id long, toxic int"))):
        assert found.columns == docs.columns and all(x[c] == "c" for x in found.collect() for c in names)
    assert mixing.mix(docs).columns[: len(docs.columns)] == docs.columns and mixing.mix(docs).count() == 6
    assert decontaminate.scan(docs, bench, broadcast_bytes=0, whole="___").count() == 6


def test_classifiers(spark):
    r = random.Random(1)
    bad = ["grumbo", "fleevix"]
    data = [(i, words(r, 60) + (" " + " ".join(r.choices(bad, k=2)) if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    junk = [(1000 + i, "".join(r.choice("#$%|&* ") for _ in range(300)), 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data + junk] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), y) for i, _, y in data + junk], "doc_id long, quality int, toxic int")
    tox = {x.doc_id: x for x in toxicity.classify(docs, labels).collect()}
    assert sum(tox[i].predicted == y for i, _, y in data if tox[i].held_out) >= 0.98 * sum(tox[i].held_out for i, _, _ in data)
    qua = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    assert all(qua[i].predicted == int(i < 1000) for i, _, _ in data + junk if qua[i].held_out)
    assert 0 <= tox[5000].score <= 1 and tox[5000].score == tox[5001].score and qua[5000].score == qua[5001].score
    assert toxicity.keep_clean(docs, labels).count() < 650
    none = labels.where("false")
    assert toxicity.classify(docs, none).count() == quality.classify(docs, none).count() == 752


def test_empty_tables_and_repeats(spark, empty, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    for f in (ngram_join.classes, substring.report, jpeg.stored_media, lambda d: decontaminate.report(d, bench), substring.remove, ngram_join.keep_one):
        assert f(empty).count() == 0
    twice = docs.union(docs)
    n = docs.count()
    assert ngram_join.classes(twice).count() == substring.report(twice).count() == 2 * n
    assert store.shared_dir(spark)
