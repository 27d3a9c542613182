"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

A source's rows, in an order fixed by a hash of their values, are cut into blocks of `block_rows`. The mixture to be met is a fluid
one: all sources that have rows left flow at rates in the ratio of their exact weights, one block per slot together; when one runs
dry the others share its rate. A block is released in the slot in which its fluid begins and due when its fluid has ended; in every
slot the released block with the earliest deadline is placed. All windows are met, so at no slot is a source a whole block away
from its target, however long the table. No row is left out.

The windows and slots are computed on the driver, once per block, not per row. Blocks are as large as it takes to have at most
`max_blocks` of them and one more per source or class (a block is then rows / max_blocks rows, a millionth of the mixture), so plan and
broadcast have a bound that doesn't grow with the table: 24 bytes a block, 28 MB in all. Ranks inside a source come from counts by hash
bucket, so that a source with a third of all rows is spread over many tasks.

A null source is a source of its own. Beyond `max_sources` the sources with the fewest rows are planned by classes of equal number of
rows and equal weight. The m sources of a class flow alike and run dry together, so a class flows just as its sources do in sum; inside
it they take turns row by row. With b rows a block a source of a class is at most (b + m - 1) / m rows from its target, which is never more than a block. The driver
holds no source of a class, only the classes: with n rows in all no more than sqrt(2 n) for each weight given. Repeated rows are placed next to each other in any order; an empty table gives no rows. Columns of the table
keep their names and values: if one of ours is taken, all of ours get one more underscore in front. Sources without a weight get
weight 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NONE, OTHERS = "\x00none", "\x00others"
CHUNK = 1024


def windows(blocks: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Release and deadline slots of each source's blocks. At virtual time v a source has flowed min(weight * v, blocks)."""
    dry = blocks / weights
    order = np.argsort(dry, kind="stable")
    ended = np.concatenate([[0.0], np.cumsum(blocks[order], dtype=np.float64)])
    rate = np.concatenate([np.cumsum(weights[order][::-1])[::-1], [0.0]])
    dry = dry[order]
    for n, w in zip(blocks, weights, strict=True):
        v = np.arange(n + 1) / w
        k = np.searchsorted(dry, v)
        t = ended[k] + rate[k] * v
        t = np.where(np.abs(t - np.rint(t)) < 1e-6, np.rint(t), t)
        yield np.floor(t[:-1]).astype(np.int64), np.ceil(t[1:]).astype(np.int64)


def plan(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(source, slots, releases, deadlines of its blocks): earliest deadline first among the released."""
    names = sorted(blocks)
    n = np.array([blocks[s] for s in names], np.int64)
    if not names:
        return
    found = list(windows(n, np.array([weights[s] for s in names], np.float64)))
    slots = [np.empty(x, np.int64) for x in n]
    waiting = [(int(r[0]), int(d[0]), s) for s, (r, d) in enumerate(found)]  # release, deadline, source
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    place = [0] * len(names)
    for t in range(int(n.sum())):
        while waiting and waiting[0][0] <= t:
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s))
        due, s = heapq.heappop(ready)
        assert t < due
        i = place[s]
        slots[s][i] = t
        place[s] = i = i + 1
        if i < len(slots[s]):
            heapq.heappush(waiting, (int(found[s][0][i]), int(found[s][1][i]), s))
    for s, name in enumerate(names):
        yield name, slots[s], *found[s]


def alike(by_source: DataFrame, planned: Iterable[str], weights: dict[str, float], buckets: int) -> tuple[DataFrame, list[tuple[str, int, int, float]]]:
    """Classes of the sources not planned alone: (s, class, members, turn), and of each class its name, members, rows a member and weight.

    Without weights all have weight 1. Turns are ranked by hash bucket, as a class can have most of the sources."""
    spark = by_source.sparkSession
    name = OTHERS
    while by_source.where(F.col("s").startswith(name)).limit(1).count():
        name += "\x00"
    few = by_source.join(F.broadcast(spark.createDataFrame([(s,) for s in planned], "s string")), "s", "left_anti").withColumnRenamed("count", "n")
    given = spark.createDataFrame(list(weights.items()), "s string, w double")
    few = few.join(given, "s", "left").select("s", "n", F.coalesce("w", F.lit(1.0)).alias("w"), F.xxhash64("s").alias("h")).withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    found = [(f"{name}{r.n}:{r.w!r}", r.m, r.n, r.w) for r in few.groupBy("n", "w").agg(F.count("*").alias("m")).collect()]
    before = few.groupBy("n", "w", "b").count().withColumn("before", F.sum("count").over(Window.partitionBy("n", "w").orderBy("b")) - F.col("count")).drop("count")
    turn = F.col("before") + F.row_number().over(Window.partitionBy("n", "w", "b").orderBy("h", "s")) - 1
    classes = spark.createDataFrame(found, "class string, members long, n long, w double")
    return few.join(before, ["n", "w", "b"]).withColumn("turn", turn).join(F.broadcast(classes), ["n", "w"]).select("s", "class", "members", "turn"), found


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 16, temperature: float = 0.5, max_sources: int = 100_000, max_blocks: int = 1 << 20, prefix: str = "mix_") -> DataFrame:
    """Adds to each row: block (in its source), slot (in the whole mixture), release and deadline slots, place (in its block).

    Without weights, a source's weight is its number of rows to the power `temperature`. Blocks have `block_rows` rows or more."""
    spark = docs.sparkSession
    while any(f"{prefix}{c}" in docs.columns for c in ("block", "slot", "release", "deadline", "place")):
        prefix = f"_{prefix}"
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    by_source = docs.groupBy(source.alias("s")).count()
    counts = {r[0]: r[1] for r in by_source.orderBy(F.desc("count"), "s").limit(max_sources).collect()}
    every = by_source.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    given = {NONE if s is None else s: float(w) for s, w in (weights or {}).items()}
    if any(not w > 0 for w in given.values()):
        raise ValueError("weights must be above zero")
    target = {s: given.get(s, 1.0) if weights else n**temperature for s, n in counts.items()}
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = None
    if every[0] > len(counts):
        rest, classes = alike(by_source, list(counts), given, buckets)
        for s, m, n, w in classes:
            counts[s], target[s] = m * n, m * (w if weights else n**temperature)
    block_rows = max(block_rows, -(-every[1] // max_blocks))
    planned = plan({s: -(-n // block_rows) for s, n in counts.items()}, target)

    p = f"__{prefix}"
    key = F.xxhash64("doc_id", source)
    keyed = docs.withColumns({f"{p}s": source, f"{p}h": key}).withColumn(f"{p}b", F.pmod(F.shiftright(f"{p}h", 20), F.lit(buckets)))
    before = (
        docs.select(source.alias(f"{p}s"), F.pmod(F.shiftright(key, 20), F.lit(buckets)).alias(f"{p}b")).groupBy(f"{p}s", f"{p}b").count()
        .withColumn(f"{p}before", F.sum("count").over(Window.partitionBy(f"{p}s").orderBy(f"{p}b")) - F.col("count")).drop("count")
    )
    order = Window.partitionBy(f"{p}s", f"{p}b").orderBy(f"{p}h", "doc_id")
    if rest is not None:
        before = before.join(rest.toDF(*[f"{p}{c}" for c in ("s", "class", "members", "turn")]), f"{p}s", "left")
    ranked = keyed.withColumn(f"{p}n", F.row_number().over(order) - 1).join(before, [f"{p}s", f"{p}b"])
    rank = F.col(f"{p}before") + F.col(f"{p}n")
    if rest is not None:
        rank = F.when(F.col(f"{p}class").isNull(), rank).otherwise(rank * F.col(f"{p}members") + F.col(f"{p}turn"))
        ranked = ranked.withColumn(f"{p}s", F.coalesce(f"{p}class", f"{p}s"))
    block = F.floor(rank / block_rows)

    kind = pa.list_(pa.int64())
    chunks = [(s, i // CHUNK, *(x[i : i + CHUNK] for x in found)) for s, *found in planned for i in range(0, len(found[0]), CHUNK)]
    columns = list(zip(*chunks, strict=True)) or [()] * 5
    kinds = [pa.string(), pa.int64(), kind, kind, kind]
    pl = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f"{p}{c}" for c in ("s", "c", "slots", "releases", "deadlines")]))
    at = ranked.withColumns({f"{prefix}block": block, f"{prefix}place": rank % block_rows}).withColumn(f"{p}c", F.floor(F.col(f"{prefix}block") / CHUNK))
    at = at.join(F.broadcast(pl), [f"{p}s", f"{p}c"])
    i = (F.col(f"{prefix}block") % CHUNK + 1).cast("int")
    return at.select(
        *docs.columns, f"{prefix}block", *(F.element_at(f"{p}{c}s", i).cast("long").alias(f"{prefix}{c}") for c in ("slot", "release", "deadline")), f"{prefix}place",
    )
