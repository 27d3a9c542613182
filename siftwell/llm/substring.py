"""Substring deduplication with a compressed FM-index per shard.

A window is `width` consecutive words. It belongs to the shard of its anchor, the run of `gram` words inside it with the smallest
hash, so equal windows meet whatever surrounds them. Anchors of one text only are dropped by counting first. What remains of a
document is streamed as short segments into the shards; each shard holds the distinct segments in an FM-index whose backward search
over a wavelet matrix yields matching statistics, and intervals that reach `width` report the smallest document of the window.
Words of windows that start in a smaller document are removed; windows are judged on the input.

Copies of a whole text are one class, represented by the smallest doc_id; the others lose every window without a search. Windows
of anchors with more than `hot` holders are routed one by one, so no anchor gathers in a task; repeated segments travel without
their words. Words are split at ASCII white space. Null and blank texts have none; texts shorter than a window lose nothing; rows
with equal doc_id don't remove each other's words; other columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import buckets, store
from siftwell.llm import words as W
from siftwell.llm.fm_index import FMIndex

WIDTH, GRAM, HOT, SHARD_WORDS = 13, 6, 4096, 400_000


def anchors(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchor of every window."""
    g = W.windows(hashes, gram)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, W.U)
    least = g[:n].copy()
    for k in range(1, width - gram + 1):
        np.minimum(least, g[k : k + n], out=least)
    return least


def signature(hashes: np.ndarray) -> int | None:
    return buckets.signed(W.sequence_hash(hashes)) if len(hashes) else None


def segments(candidates: DataFrame, width: int, gram: int) -> DataFrame:
    """candidates (sig, doc, keys, hot, text): segments of consecutive windows with the same shared anchor.

    words is null where the same task has already sent an equal segment."""
    schema = "route long, seg long, doc long, at int, windows int, words binary"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in parts:
            sigs, docs, keys, hots = (part.column(k).to_pylist() for k in range(4))
            raw = W.utf8(part.column(4))
            for i, j, batch in W.batches(raw, W.NON_SPACE):
                out: list[tuple] = []
                for k in range(j - i):
                    h = batch.hashes[batch.first[k] : batch.last[k]]
                    if signature(h) != sigs[i + k]:
                        continue
                    a = anchors(h, width, gram)
                    shared = np.array(keys[i + k], np.int64).view(W.U)
                    hot = np.array(hots[i + k], bool)
                    order = np.argsort(shared)
                    shared, hot = shared[order], hot[order]
                    place = np.minimum(np.searchsorted(shared, a), len(shared) - 1)
                    found = shared[place] == a
                    single = found & hot[place]
                    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (found[1:] != found[:-1]) | single[1:]]) if len(a) else np.empty(0, np.int64)
                    stop = np.append(cut[1:], len(a))
                    keep = found[cut]
                    whole = W.windows(h, width)
                    total = np.r_[W.U(0), np.cumsum(W.mix(whole), dtype=W.U)]
                    for s, e in zip(cut[keep].tolist(), stop[keep].tolist(), strict=True):
                        seg = int(W.mix(total[e : e + 1] - total[s : s + 1] + whole[s : s + 1] * W.U(3))[0]) + (e - s) & (1 << 64) - 1
                        route = int(whole[s] if single[s] else a[s])
                        words = None if seg in seen else h[s : e + width - 1].tobytes()
                        seen.add(seg)
                        out.append((buckets.signed(route), buckets.signed(seg), docs[i + k], s, e - s, words))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["route", "seg", "doc", "at", "windows", "words"])

    return candidates.select("sig", "doc", "keys", "hot", "text").mapInArrow(run, schema)


def search_shard(rows: list[tuple[int, int, int, np.ndarray]], width: int, stream: int = 1 << 16) -> Iterator[tuple[int, list[int]]]:
    """rows: (segment, smallest doc, largest doc, words). For segments with a window found in a document smaller than their largest: the smallest document of each window.

    The shard's index is built first; the documents' segments are then streamed against it, about `stream` words at a time."""
    flat = np.concatenate([r[3] for r in rows])
    names, ids = np.unique(flat, return_inverse=True)
    lengths = np.array([len(r[3]) for r in rows])
    start = np.cumsum(lengths) - lengths
    ids = ids.astype(np.int64) + 1
    index = FMIndex([ids[s : s + n] for s, n in zip(start, lengths, strict=True)], len(names) + 1, 16 if width <= 16 else 1 << (width - 1).bit_length())
    smallest, largest = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    doc = np.append(smallest[index.owner], np.iinfo(np.int64).max)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(start, start[i] + stream)))
        query, here = ids[start[i] : start[j - 1] + lengths[j - 1]], lengths[i:j] - width + 1
        bounds = np.r_[0, np.cumsum(here)]
        ends = np.repeat(start[i:j] - start[i], here) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], here) + width
        length, low, high = index.matching_statistics(query, ends, width, least=2)
        result = np.repeat(smallest[i:j], here)
        full = np.flatnonzero(length == width)
        if len(full):
            spans, back = np.unique(np.stack([low[full], high[full]], 1), axis=0, return_inverse=True)
            result[full] = np.minimum.reduceat(doc, spans.ravel())[::2][back.ravel()]
        for k in np.flatnonzero(np.minimum.reduceat(result, bounds[:-1]) < largest[i:j]):
            yield rows[i + k][0], result[bounds[k] : bounds[k + 1]].tolist()
        i = j


def _search(dealt: DataFrame, width: int) -> DataFrame:
    """dealt (shard, seg, lo, hi, words), sorted by shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: dict) -> pa.RecordBatch:
            got = list(search_shard(list(rows.values()), width))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["seg", "docs"])

        shard, rows = None, {}
        for part in parts:
            for s, seg, lo, hi, words in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if s != shard and rows:
                    yield found(rows)
                    rows = {}
                shard = s
                rows[seg] = (seg, lo, hi, np.frombuffer(words, W.U))
        if rows:
            yield found(rows)

    return dealt.mapInArrow(run, "seg long, docs array<long>")


def covered(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, sig, n, copy, runs): for every row of docs whether a smaller document has its whole text, else the (at, windows) runs of windows found in smaller documents."""
    spark = docs.sparkSession

    def describe(h: np.ndarray) -> tuple[int, int | None, np.ndarray]:
        return len(h), signature(h), np.unique(anchors(h, width, gram))

    nodes = store.Table(buckets.keyed_nodes(docs, describe, W.NON_SPACE, None), "fm-nodes")
    held = buckets.shared_keys(nodes.read())
    light = store.Table(nodes.read().select("doc_id", "n", "sig"), "fm-docs")
    nodes.drop()
    first = light.read().where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"))

    per_doc = held.read().groupBy("sig").agg(F.collect_list("key").alias("keys"), F.collect_list(F.col("holders") > HOT).alias("hot"))
    wanted = per_doc.join(first, "sig").withColumnRenamed("first_id", "doc")
    texts = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    segs = store.Table(segments(texts.join(wanted.hint("shuffle_hash"), "doc"), width, gram), "fm-segments")
    held.drop()
    store.release(spark)

    ends = segs.read().groupBy("seg").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    sent = segs.read().where("words is not null").select("route", "seg", "words")
    size = sent.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    shards = max(1, -(-size // SHARD_WORDS))
    dealt = sent.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).join(ends, "seg")
    dealt = dealt.select("shard", "seg", "lo", "hi", "words").repartition("shard").sortWithinPartitions("shard", "seg")
    hits = store.Table(_search(dealt, width), "fm-hits")
    store.release(spark)

    refs = buckets.join_spread(segs.read().select("seg", "doc", "at"), hits.read(), "seg").where("docs is not null")
    hit = F.filter(F.transform("docs", lambda d, i: F.when(d < F.col("doc"), F.col("at") + i)), lambda x: x.isNotNull())
    runs = refs.select("doc", hit.alias("hit")).where(F.size("hit") > 0)
    runs = runs.groupBy("doc").agg(F.sort_array(F.flatten(F.collect_list("hit"))).alias("runs"))
    runs = store.Table(runs.select("doc", "runs"), "fm-runs")
    for t in (segs, hits):
        t.drop()
    store.release(spark)
    out = buckets.join_spread(light.read(), first, "sig").join(runs.read().withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    out = store.Table(out.select("doc_id", "sig", "n", (F.col("doc_id") > F.col("first_id")).alias("copy"), F.when(F.col("doc_id") == F.col("first_id"), F.col("runs")).alias("runs")), "fm-covered")
    for t in (light, runs):
        t.drop()
    store.release(spark)
    return out.read()


def _mark(n: int, copy: bool, runs: list[int] | None, width: int) -> np.ndarray:
    """Which words go."""
    if copy:
        return np.full(n, n >= width)
    step = np.zeros(n + 1, np.int64)
    if runs:
        at = np.array(runs)
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
    return np.cumsum(step)[:n] > 0


def _apply(docs: DataFrame, columns: list[str], width: int, gram: int, rows: str, edit) -> DataFrame:
    """Joins the decisions to the rows of docs and calls edit(batch of columns, kept words and number of words of each row)."""
    p = store.free_prefix(columns, "doc", "info")
    info = covered(docs, width, gram).groupBy(F.col("doc_id").alias(f"{p}doc")).agg(F.collect_set(F.struct("sig", "n", "copy", "runs")).alias(f"{p}info"))
    joined = docs.select(*columns).join(info.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(f"{p}doc"))).select(*columns, f"{p}info")
    at = columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, marks = W.utf8(part.column(at)), []
            for text, info in zip(texts, part.column(len(columns)).to_pylist(), strict=True):
                if len(info) > 1:  # the doc_id repeats with other texts
                    sig = signature(W.Batch([text], W.NON_SPACE).hashes)
                    info = [x for x in info if x["sig"] == sig]
                x = info[0]
                marks.append(_mark(x["n"], bool(x["copy"]), x["runs"], width))
            yield edit(part, texts, marks)

    return joined.mapInArrow(run, rows)


def report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def edit(part: pa.RecordBatch, texts: list[bytes], marks: list[np.ndarray]) -> pa.RecordBatch:
        digests = []
        for text, gone in zip(texts, marks, strict=True):
            words = text.split()
            digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(m) for m in marks], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _apply(docs, ["doc_id", "text"], width, gram, "doc_id long, n_words long, n_removed long, kept_sha256 string", edit)


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Documents without the words that a smaller document's windows cover; the rest joined by one space, other texts unchanged.

    Documents of which nothing is left go. n_chars, if present, follows the text; other columns stay."""
    columns = docs.columns
    schema = docs.schema
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def edit(part: pa.RecordBatch, texts: list[bytes], marks: list[np.ndarray]) -> pa.RecordBatch:
        out = {c: part.column(k).to_pylist() if c in ("text", "n_chars") else part.column(k) for k, c in enumerate(columns)}
        for k, (text, gone) in enumerate(zip(texts, marks, strict=True)):
            if gone.any():
                out["text"][k] = b" ".join([w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g]).decode()
                if chars is not None:
                    out["n_chars"][k] = len(out["text"][k])
        kept = pa.array([not (g.all() and len(g)) for g in marks], pa.bool_())
        arrays = [pa.array(out[c], part.schema.field(k).type) if isinstance(out[c], list) else out[c] for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, names=columns).filter(kept)

    return _apply(docs, columns, width, gram, schema, edit)
