"""Steps shared by the operators on pairs: keys that more than one text holds, and connected components, without any driver collect."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import store
from siftwell.llm import words as W


def keyed_nodes(docs: DataFrame, describe: Callable[[np.ndarray], tuple[int, int | None, np.ndarray]], table: np.ndarray, fold: bytes | None) -> DataFrame:
    """(doc_id, n, sig, keys) by describe(word hashes). Keys are left out where the same task has already met the same sig."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in parts:
            texts = W.utf8(part.column(1))
            if fold:
                texts = [t.translate(fold) for t in texts]
            ids = part.column(0)
            for i, j, batch in W.batches(texts, table):
                n, sig, keys = [], [], []
                for a, b in zip(batch.first, batch.last, strict=True):
                    size, s, k = describe(batch.hashes[a:b])
                    n.append(size)
                    sig.append(s)
                    keys.append(k.view(np.int64) if s not in seen else None)
                    seen.add(s)
                offsets = np.cumsum([0] + [0 if k is None else len(k) for k in keys]).astype(np.int32)
                flat = np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n", "sig", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long, keys array<long>")


def join_spread(left: DataFrame, right: DataFrame, key: str, most: int = 1024, counts: DataFrame | None = None) -> DataFrame:
    """left join right on key, right holding each key at most once, without gathering a frequent key in one task.

    Keys that hold at least one in `most` of left's rows, of which there can't be more than `most`, meet a broadcast of their rows
    of right; rows of left with a null key meet nothing; the others are shuffled. The keys are told apart by a filter, so that no
    join but the one asked for passes left's rows on. Columns: left's, then right's without the key.
    counts (key, n), if the caller has them, spare a pass over left."""
    width = [c for c in right.columns if c != key]
    if counts is None:
        counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in counts.where(F.col("n") >= max(-(-total // most), 32)).select(key).collect()]  # at most `most` keys
    lone = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in width])
    rest = left.where(F.col(key).isNotNull())
    if not hot:
        return rest.join(right, key, "left").select(*left.columns, *width).unionByName(lone)
    frequent = F.col(key).isin([F.lit(k).cast(left.schema[key].dataType) for k in hot])
    cold = rest.where(~frequent).join(right, key, "left").select(*left.columns, *width)
    warm = rest.where(frequent).join(F.broadcast(right.where(frequent)), key, "left").select(*left.columns, *width)
    return cold.unionByName(warm).unionByName(lone)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared_keys(nodes: DataFrame) -> store.Table:
    """(key, sig, holders) for every key that at least two different sigs hold. Counting first drops the keys of one text only."""
    spark = nodes.sparkSession
    entries = nodes.where(F.size("keys") > 0).select("sig", F.explode("keys").alias("key"))
    several = entries.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("holders")).where("lo <> hi")
    several = store.Table(several.select("key", "holders"), "shared-keys")
    store.release(spark)
    known = several.read()
    met = join_spread(entries, known, "key", counts=known.select("key", F.col("holders").alias("n"))).where("holders is not null")
    held = store.Table(met.select("key", "sig", "holders").distinct(), "held-keys")
    several.drop()
    store.release(spark)
    return held


def _contract(edges: DataFrame) -> DataFrame:
    """Each task replaces its edges by stars around the smallest node of each of its components."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root.setdefault(up, up)
                x = root[x]
            return x

        for part in parts:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in list(root)]
        rows = [(x, r) for x, r in rows if x != r]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 50_000]], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> store.Table:
    """(u, v): every node of an edge but the smallest of its component, with that smallest node.

    Large-star and small-star steps alternate until nothing changes: O(log^2 n) rounds of joins, each cut by a written table."""
    spark = edges.sparkSession
    e = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = store.Table(_contract(_contract(e).repartition("v")).distinct(), "links")
    last = None
    for _ in range(100):
        e = now.read()
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return now
        last = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, store.Table(small, "links")
        old.drop()
        store.release(spark)
    raise RuntimeError("components did not settle")
