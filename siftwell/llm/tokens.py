"""Token counts through a digest cache.

Each text (null: empty) is keyed by the SHA-256 of its content as the tokenizer normalises it, so that texts which differ only in
what the tokenizer doesn't see share a count; each tokenizer by the SHA-256 of its file, library version and options. Counts already
in the cache are joined; only distinct contents that miss are encoded, once each, and their counts are appended to the cache.
Writers only ever append whole Parquet commits, so a lost executor repeats tasks without harm; two writers that race append equal
rows, which reading removes.

Digests are made in one pass and only they are counted and joined. Texts move in a second pass, by digest and only where a digest
misses; each task sends a content once, so that a content with many copies gathers nowhere. Empty texts have the count of the empty
text, rows with a null or repeated doc_id each get a row, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import buckets, store
from siftwell.llm import words as W
from siftwell.sources import shared

CACHE = "digest binary, n_tokens long, tokenizer string"
#: Up to so many missing digests (32 bytes each) are broadcast to the second pass; more are shuffled.
FEW = 20_000
_loaded: dict[str, tuple[Callable, Callable]] = {}


def tokenizer_digest(path: str) -> str:
    """Of the file, the library's version and the options of `tokenizer`."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}|plain-v2".encode()).hexdigest()


def tokenizer(path: str) -> tuple[Callable[[list[str]], list[int]], Callable[[str], str]]:
    """(counts of texts, normal form of a text): sentencepiece for .model files, tokenizers for .json files.

    Texts of equal normal form have equal counts. A .json tokenizer may cut out special strings before it normalises, so there the
    text itself is the normal form."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], model.normalize)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = (lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)], lambda text: text)
    return _loaded[path]


class DigestCache:
    """Counts by tokenizer digest (a folder each) and content digest, kept as a Parquet table that is only appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, tokenizer_id: str) -> DataFrame:
        """digest, n_tokens; racing writers may have left a digest twice. The files are those of now."""
        path = f"{self.path}/tokenizer={tokenizer_id}"
        if not shared.exists(self.spark, path):
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        return self.spark.read.schema("digest binary, n_tokens long").parquet(path)

    def append(self, rows: DataFrame, tokenizer_id: str) -> None:
        rows.select("digest", "n_tokens").write.mode("append").parquet(f"{self.path}/tokenizer={tokenizer_id}")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, digest of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, normal = tokenizer(model_path)
        for part in parts:
            raw = W.utf8(part.column(1))
            keys = [hashlib.sha256(normal(t.decode()).encode()).digest() for t in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_bytes", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest binary")


def _texts(docs: DataFrame, model_path: str) -> DataFrame:
    """(digest, text), each digest once per task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, normal = tokenizer(model_path)
        seen: set[bytes] = set()
        for part in parts:
            keep, keys = [], []
            for text in W.utf8(part.column(0)):
                key = hashlib.sha256(normal(text.decode()).encode()).digest()
                keep.append(key not in seen)
                keys.append(key)
                seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0)], names=["digest", "text"]).filter(pa.array(keep, pa.bool_()))

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "digest binary, text string")


def _encoded(texts: DataFrame, model_path: str, batch_bytes: int) -> DataFrame:
    """texts dealt and sorted by digest: the count of each digest, encoded once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = tokenizer(model_path)
        last = None
        for part in parts:
            keys, rows = part.column(0).to_pylist(), []
            for k, key in enumerate(keys):
                if key != last:
                    rows.append(k)
                last = key
            raw, counts, i = W.utf8(part.column(1).take(pa.array(rows, pa.int64()))), [], 0
            while i < len(raw):
                j, size = i, 0
                while j < len(raw) and (j == i or size + len(raw[j]) <= batch_bytes):
                    size += len(raw[j])
                    j += 1
                counts += encode([t.decode() for t in raw[i:j]])
                i = j
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in rows], pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, model_path: str, cache: DigestCache, batch_bytes: int = 1 << 20) -> DataFrame:
    """Returns doc_id, n_bytes, n_tokens, cached (whether the count was already there)."""
    spark, own = docs.sparkSession, tokenizer_digest(model_path)
    keyed = store.Table(digests(docs, model_path), "token-digests")
    misses = store.Table(keyed.read().select("digest").distinct().join(cache.read(own).select("digest"), "digest", "left_anti"), "token-misses")
    n = misses.read().count()
    if n:
        wanted = misses.read()
        if n <= FEW:
            texts = _texts(docs, model_path).join(F.broadcast(wanted), "digest", "left_semi").repartition("digest")
        else:
            texts = _texts(docs, model_path).join(wanted.hint("merge"), "digest", "left_semi")
        cache.append(_encoded(texts.select("digest", "text").sortWithinPartitions("digest"), model_path, batch_bytes), own)
        store.release(spark)
    # of the cache only what this table holds
    counts = keyed.read().select("digest").distinct().join(cache.read(own).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "digest")
    counts = counts.join(misses.read().withColumn("cached", F.lit(False)), "digest", "left").withColumn("cached", F.coalesce("cached", F.lit(True)))
    counts = store.Table(counts, "token-distinct")
    out = buckets.join_spread(keyed.read(), counts.read(), "digest")
    done = store.Table(out.select("doc_id", "n_bytes", "n_tokens", "cached"), "token-counts")
    for t in (keyed, misses, counts):
        t.drop()
    return done.read()
