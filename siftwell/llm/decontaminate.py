"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over training texts.

Words: A-Z are lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is n consecutive words of an item; an
item of fewer words, but not none, is one window. Every hash hit is verified word by word.

Null and empty texts have no words and no hits; items with a null item_id count as one named by the empty string; an empty benchmark gives no hits; repeated rows each get a result; columns
beyond the named ones are ignored. The benchmark is broadcast only if what is built of it stays below `broadcast_bytes`, by a bound proven from its counted bytes; beyond that
bound the windows meet in a shuffle join instead and each document carries only the windows it may contain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftwell.llm import store
from siftwell.llm import words as W

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if W.ALNUM[b] else 32 for b in range(256))


def item_windows(text: str | None, n: int) -> list[tuple[bytes, ...]]:
    words = (text or "").encode().translate(FOLD).split()
    if 0 < len(words) < n:
        return [tuple(words)]
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


class WindowSet:
    """Windows of items in arrays: the items' words in one buffer, and by length sorted hashes with item and place to verify, and a
    bitmap that rules most positions out. Some 17 bytes a window beside the text, see `bound`."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        kept = [(item, b" ".join((text or "").encode().translate(FOLD).split())) for item, text in items]
        kept = [x for x in kept if x[1]]
        self.names, self.n = [x[0] for x in kept], n
        self.batch = batch = W.Batch([x[1] for x in kept], W.ALNUM)
        length = batch.last - batch.first
        self.by_length = {}
        for size in np.unique(np.minimum(length, n)).tolist():
            whole = W.windows(batch.hashes, size)
            owner = np.searchsorted(batch.first, np.arange(len(whole)), "right") - 1
            fits = (np.arange(len(whole)) + size <= batch.last[owner]) & (np.minimum(length[owner], n) == size)
            at = np.flatnonzero(fits)
            order = np.argsort(whole[at], kind="stable")
            at = at[order].astype(np.uint32)
            hashes, maybe = whole[at], np.zeros(1 << 20, bool)
            maybe[(hashes >> W.U(44)).astype(np.int64)] = True
            self.by_length[size] = (hashes, maybe, at, owner[at].astype(np.uint32))

    @staticmethod
    def bound(text_bytes: int, items: int) -> int:
        """No WindowSet over that many bytes of text takes more: a word has a byte and a separator at least, and by word stand a hash,
        a span and a window (8 + 16 + 16 bytes); a bitmap of 1 MB for each of up to n lengths comes on top."""
        return 2 * text_bytes + (text_bytes // 2 + items) * 40 + (8 << 20)

    def scan(self, batch: W.Batch) -> list[tuple[np.ndarray, set[str]]]:
        """For each text of the batch: which words are hit, and the items whose windows occur."""
        found: list[tuple[np.ndarray, set[str]]] = [(np.zeros(b - a, bool), set()) for a, b in zip(batch.first, batch.last, strict=True)]
        own, known = batch.buf.tobytes() if len(batch.buf) < W.PIECE else None, self.batch
        for n, (hashes, maybe, places, owners) in self.by_length.items():
            all_windows = W.windows(batch.hashes, n)
            at = np.flatnonzero(maybe[(all_windows >> W.U(44)).astype(np.int64)])
            low = np.searchsorted(hashes, all_windows[at], "left")
            high = np.searchsorted(hashes, all_windows[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            docs = np.searchsorted(batch.first, at, "right") - 1
            for i, d, a, b in zip(at.tolist(), docs.tolist(), low.tolist(), high.tolist(), strict=True):
                if i + n > batch.last[d]:
                    continue
                words = b" ".join([(own[batch.starts[k] : batch.ends[k]] if own is not None else batch.buf[batch.starts[k] : batch.ends[k]].tobytes()) for k in range(i, i + n)])
                for k in range(a, b):
                    p = int(places[k])
                    if known.buf[known.starts[p] : known.ends[p + n - 1]].tobytes() == words:
                        found[d][0][i - batch.first[d] : i - batch.first[d] + n] = True
                        found[d][1].add(self.names[owners[k]])
        return found


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _rows(ids: list, batch: W.Batch, found: list) -> list[dict]:
    rows = []
    for k, (doc_id, (hit, items)) in enumerate(zip(ids, found, strict=True)):
        base, first = batch.at[k], batch.first[k]
        cuts = []
        if items:
            cuts = [{"start": int(batch.starts[first + a] - base), "stop": int(batch.ends[first + b] - base)} for a, b in zip(*_runs(hit), strict=True)]
        rows.append({"doc_id": doc_id, "n_words": len(hit), "n_hit": int(hit.sum()), "items": sorted(items), "spans": cuts})
    return rows


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _whole(docs: DataFrame, prefix: str) -> StructType:
    return StructType(docs.schema.fields + [StructField(f"{prefix}{f.name}", f.dataType) for f in StructType.fromDDL(SCHEMA).fields[1:]])


def _beside(part: pa.RecordBatch, rows: list[dict], width: int, prefix: str) -> pa.RecordBatch:
    """Results beside the first `width` columns of the rows they come from."""
    found = pa.RecordBatch.from_pylist(rows, _arrow(SCHEMA))
    names = part.schema.names[:width] + [f"{prefix}{c}" for c in found.schema.names[1:]]
    return pa.RecordBatch.from_arrays(part.columns[:width] + found.columns[1:], names=names)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 8, broadcast_bytes: int = 64 << 20, whole: str = "") -> DataFrame:
    """Returns doc_id, n_words, n_hit, items (sorted as strings) and spans (byte ranges of runs of hit words).

    With `whole`, a prefix of names, results stand beside all columns of their row (doc_id and text first), under names that begin with that prefix."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    text_bytes, items = bench.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0)), F.count("*")).first()
    size = WindowSet.bound(text_bytes, items)
    docs = docs.select("doc_id", "text", *([c for c in docs.columns if c not in ("doc_id", "text")] if whole else []))
    return (_scan_broadcast if size <= broadcast_bytes else _scan_joined)(docs, bench, n, whole)


def _scan_broadcast(docs: DataFrame, bench: DataFrame, n: int, whole: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([(item, text) for item, text in bench.collect()])  # the texts; each worker builds the arrays

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(shared.value, n)
        for part in parts:
            ids, texts = part.column(0).to_pylist(), [t.translate(FOLD) for t in W.utf8(part.column(1))]
            for i, j, batch in W.batches(texts, W.ALNUM):
                rows = _rows(ids[i:j], batch, known.scan(batch))
                yield _beside(part.slice(i, j - i), rows, width, whole) if whole else pa.RecordBatch.from_pylist(rows, _arrow(SCHEMA))

    width = len(docs.columns)
    return docs.mapInArrow(run, _whole(docs, whole) if whole else SCHEMA)


def _hashes(texts: list[bytes], lengths: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for _, _, batch in W.batches(texts, W.ALNUM):
        for a, b in zip(batch.first, batch.last, strict=True):
            out.append(np.unique(np.concatenate([W.windows(batch.hashes[a:b], n) for n in lengths])).view(np.int64).tolist() if lengths else [])
    return out


def _scan_joined(docs: DataFrame, bench: DataFrame, n: int, whole: str) -> DataFrame:
    """For a benchmark too large to broadcast: windows and documents meet by window hash; rows of a hot window are only (doc, hash)."""
    item_schema = "item string, length int, hash long, words binary"

    def items(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(item, w) for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for w in dict.fromkeys(item_windows(text, n))]
            hashes = []
            for _, w in rows:
                b = W.Batch([b" ".join(w)], W.ALNUM)
                hashes.append(int(W.windows(b.hashes, len(w)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array(hashes, pa.int64()), pa.array([b" ".join(r[1]) for r in rows], pa.binary())], names=["item", "length", "hash", "words"])

    known = bench.mapInArrow(items, item_schema)
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # n values at most

    def doc_hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t.translate(FOLD) for t in W.utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_hashes(texts, lengths), pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    keyed = docs.select("doc_id", "text").mapInArrow(doc_hashes, "doc_id long, hashes array<long>").select("doc_id", F.explode("hashes").alias("hash"))
    mine = store.free_prefix(docs.columns, "id", "candidates")
    per_doc = keyed.distinct().join(known, "hash").groupBy("doc_id").agg(F.collect_set(F.struct("item", "words")).alias(f"{mine}candidates")).withColumnRenamed("doc_id", f"{mine}id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc_id, text, candidates in zip(part.column(0).to_pylist(), W.utf8(part.column(1)), part.column(width).to_pylist(), strict=True):
                # each candidate window is an item of its own: no longer than n words, so one window
                known = WindowSet([(c["item"], c["words"].decode()) for c in candidates or []], n)
                batch = W.Batch([text.translate(FOLD)], W.ALNUM)
                rows += _rows([doc_id], batch, known.scan(batch))
            yield _beside(part, rows, width, whole) if whole else pa.RecordBatch.from_pylist(rows, _arrow(SCHEMA))

    width = len(docs.columns)
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col(f"{mine}id")), "left").select(*docs.columns, f"{mine}candidates")
    return joined.mapInArrow(run, _whole(docs, whole) if whole else SCHEMA)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2) -> DataFrame:
    """One row per document with counts, the digest of its items, and the decision."""
    return scan(docs, benchmark, n).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"), "spans",
    )


def cut(text: F.Column, spans: F.Column) -> F.Column:
    """The text without the given byte ranges."""
    raw = text.cast("binary")
    stops = F.concat(F.array(F.lit(0)), spans.getField("stop"))
    starts = F.concat(spans.getField("start"), F.array(F.octet_length(text)))
    parts = F.zip_with(stops, starts, lambda a, b: F.substring(raw, a + 1, b - a).cast("string"))
    return F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(text)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2) -> DataFrame:
    """Rows with windows of `min_items` or more items go; from others the runs of hit words are cut. Columns stay as they are.

    Each row is judged by its own text, whether its doc_id is null, repeated or neither. n_chars, if present, follows the cut text."""
    p = store.free_prefix(docs.columns, "n_words", "n_hit", "items", "spans", "text")
    kept = scan(docs, benchmark, n, whole=p).where(F.size(f"{p}items") < min_items)
    hit = F.size(f"{p}spans") > 0
    kept = kept.withColumn(f"{p}text", cut(F.col("text"), F.col(f"{p}spans")))
    changed = {"text": F.col(f"{p}text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(f"{p}text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
