"""Jaccard join of documents on word n-grams by vertical partitioning.

Every distinct set of n-grams is a node; copies share one. The global order of n-grams (by 64-bit hash) is cut into fragments, 2^L of
them, L by size, nested so that sets cut differently still meet. A fragment's digest is the exclusive or of its hashes.

Candidates. Two linked sets differ in at most d n-grams, fewer than there are fragments at the pair's level, so all but d of their
fragments overlap wholly: sets meet by (fragment, digest). In the order of frequency, rarest first, they must meet within the first
d + 1 digests of each; the more frequent digests of a set are dropped, and with them every set that has more than d digests of its
own. A bucket first gives a star of pairs around its smallest set, in a second round a star around
another; verified links are contracted after each round. Only buckets whose sets then still lie in several components are
searched for the rest, all of them, dealt into pairs of blocks, with a parity bitmap as a lower bound of the difference. So no
group is expanded into all its pairs, and no link between components is lost.

Verification. A pair whose parity bitmaps differ in more bits than the rule lets n-grams differ is refuted. Of the others, in a
coarser cut of some dozens of n-grams a fragment, fragments with equal digests overlap wholly. For each other fragment a row (pair, fragment) meets the n-grams that either set has there; partial overlaps are counted fragment
by fragment and then summed per pair. Frequent keys, sets and copies are joined without gathering in a task.

Words are split at ASCII white space after lower-casing A-Z. With fewer than n words the whole sequence is one n-gram; null,
empty and blank texts have no set and link with nothing; equal texts and repeated rows are one node; other columns are ignored.
Signatures and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import buckets, store
from siftwell.llm import words as W

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = W.U(0x9E3779B97F4A7C15), W.U(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Rule:
    """Sets link when den * |intersection| >= num * |union|."""

    n: int = 3
    num: int = 9
    den: int = 10
    block: int = 2048

    def difference(self, total: int) -> int:
        """No linked pair of sizes summing to total differs in more n-grams."""
        return total * (self.den - self.num) // (self.den + self.num)

    def level(self, total: int) -> int:
        return self.difference(total).bit_length()

    def links(self, a: int, b: int, overlap: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def range(self, n: int) -> tuple[int, int]:
        return -(-n * self.num // self.den), n * self.den // self.num


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a document."""
    return np.unique(W.windows(hashes, min(n, len(hashes)))) if len(hashes) else np.empty(0, W.U)


def signature(g: np.ndarray) -> int:
    return buckets.signed(int(W.mix(np.sum(W.mix(g ^ _A), dtype=W.U, keepdims=True) + np.array([len(g)], W.U) * _B)[0]))


def describe(rule: Rule, hashes: np.ndarray) -> tuple[int, int | None, np.ndarray]:
    """Size, signature, and a key for each fragment at each level at which a partner may look."""
    g = grams(hashes, rule.n)
    n = len(g)
    if not n:
        return 0, None, np.empty(0, W.U)
    total, sig = np.r_[W.U(0), np.cumsum(W.mix(g ^ _A), dtype=W.U)], signature(g)
    low, high = rule.range(n)
    out = []
    for level in range(max(1, rule.level(n + low)), rule.level(n + high) + 1):
        f = (g >> W.U(64 - level)).astype(np.int64)
        bounds = np.searchsorted(f, np.arange((1 << level) + 1))
        count = np.diff(bounds)
        place = np.arange(1 << level, dtype=W.U) | W.U(level) << W.U(40)
        keys = W.mix((total[bounds[1:]] - total[bounds[:-1]]) + count.astype(W.U) * _B + W.mix(place * _A))
        keys = (keys & ~W.U(127)) | W.U(level << 1) | (count == 0).astype(W.U)  # the last bits name the level and empty fragments
        empty = int((count == 0).sum())
        spare = (1 << level) - 1 - min((1 << level) - 1, rule.difference(n + high))
        out.append(keys if empty > spare else keys[count > 0])  # empty fragments count only if they may be all that agrees
    return n, sig, np.concatenate(out) if out else np.empty(0, W.U)


def bitmap(g: np.ndarray) -> np.ndarray:
    """Parity of the n-grams falling on each of 1024 to 32768 bits, over eight bits an n-gram up to there: few differences cancel."""
    bits = min(32768, max(1024, 8 << len(g).bit_length()))
    odd = np.bincount((g & W.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _fold(maps: list[list[int]]) -> list[int]:
    """Bitmaps as numbers, all folded to the shortest length."""
    least = min(map(len, maps)) * 64
    out = []
    for m in maps:
        x, bits = int.from_bytes(np.array(m, np.int64).tobytes(), "little"), len(m) * 64
        while bits > least:
            bits >>= 1
            x = (x >> bits) ^ (x & ((1 << bits) - 1))
        out.append(x)
    return out


def likely(rule: Rule, a: int, b: int, x: int, y: int) -> bool:
    return a * rule.den >= b * rule.num and b * rule.den >= a * rule.num and (x ^ y).bit_count() <= rule.difference(a + b)


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with equal first column."""
    held: list[tuple] = []
    for part in parts:
        for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _emit(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def cross_pairs(rule: Rule, members: DataFrame) -> DataFrame:
    """members (key, sig, n, bitmap, root, holders): every likely pair of different roots in a bucket."""
    blocks = F.ceil(F.col("holders") / rule.block).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = members.withColumns({"own": own}).withColumn("other", other)
    dealt = dealt.select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("k"), "sig", "n", "bitmap", "root", "own")
    dealt = dealt.select(F.xxhash64("k").alias("k"), "sig", "n", "bitmap", "root", "own", F.col("k.key").alias("key"), (F.col("k.i") == F.col("k.j")).alias("same")).repartition("k").sortWithinPartitions("k", "sig")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for rows in _groups(parts):
            maps = _fold([r[3] for r in rows])
            for u, x in enumerate(rows):
                for v in range(u):
                    y = rows[v]
                    if x[4] != y[4] and x[1] != y[1] and (x[7] or x[5] != y[5]) and likely(rule, x[2], y[2], maps[u], maps[v]):
                        out.add((min(x[1], y[1]), max(x[1], y[1])))
            if len(out) > 200_000:
                yield _emit(out)
                out = set()
        yield _emit(out)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def cut_level(n: int) -> int:
    """A set is stored in fragments of some 32 to 64 n-grams."""
    return (n // 64).bit_length()


def cut(g: np.ndarray) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Level, digests and n-grams of the fragments of a set."""
    level = cut_level(len(g))
    bounds = np.searchsorted(g >> W.U(64 - level), np.arange((1 << level) + 1, dtype=W.U)) if level else np.array([0, len(g)])
    folded = np.r_[W.U(0), np.bitwise_xor.accumulate(W.mix(g ^ _A))]
    return level, folded[bounds[1:]] ^ folded[bounds[:-1]], [g[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def selective(rule: Rule, nodes: DataFrame, held: DataFrame) -> store.Table:
    """(key, sig, lo, holders): of the shared keys of a set those among which a partner must be met, where several sets still are."""
    level, empty = F.shiftright("key", 1).bitwiseAND(F.lit(63)).cast("int"), F.col("key").bitwiseAND(F.lit(1)) == 1
    most = F.least(F.expr(f"(n + n * {rule.den} div {rule.num}) * {rule.den - rule.num} div {rule.den + rule.num}"), F.expr("shiftleft(1L, level) - 1"))
    full = F.transform(F.filter("keys", lambda k: k.bitwiseAND(F.lit(1)) == 0), lambda k: F.shiftright(k, 1).bitwiseAND(F.lit(63)).cast("int"))
    levels = F.transform(F.array_distinct(F.transform("keys", lambda k: F.shiftright(k, 1).bitwiseAND(F.lit(63)).cast("int"))), lambda x: F.struct(x.alias("level"), F.size(F.filter("full", lambda y: y == x)).alias("emitted")))
    about = nodes.where(F.size("keys") > 0).select("sig", "n", "keys", full.alias("full")).select("sig", "n", F.inline(levels)).groupBy("sig", "n", "level").agg(F.max("emitted").alias("emitted"))
    about = about.select("sig", "level", "emitted", most.alias("most"))
    lists = held.select("sig", level.alias("level"), F.struct("holders", "key").alias("x"), empty.alias("empty")).groupBy("sig", "level").agg(
        F.sort_array(F.collect_list(F.when(~F.col("empty"), F.col("x")))).alias("full"), F.collect_list(F.when(F.col("empty"), F.col("x"))).alias("none"))
    room = F.col("most") + 1 - (F.col("emitted") - F.size("full"))
    kept = F.concat(F.slice("full", 1, F.greatest(room, F.lit(0)).cast("int")), F.when(F.col("emitted") <= F.col("most"), F.col("none")).otherwise(F.slice("none", 1, 0)))
    kept = lists.join(about, ["sig", "level"]).select("sig", F.explode(kept).alias("x")).select("x.key", "sig")
    few = store.Table(kept, "ngram-prefixes")
    several = few.read().groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("holders")).where("lo <> hi").drop("hi")
    several = store.Table(several, "ngram-several")
    known = several.read()
    met = buckets.join_spread(few.read(), known, "key", counts=known.select("key", F.col("holders").alias("n"))).where("lo is not null")
    out = store.Table(met.select("key", "sig", "lo", "holders"), "ngram-held")
    for t in (few, several):
        t.drop()
    return out


def verify(rule: Rule, pairs: DataFrame, sets: DataFrame) -> store.Table:
    """The pairs (a, b) that link. sets: (sig, n, level, digests, fragments, bitmap)."""
    sides = pairs
    for x in ("a", "b"):
        shape = sets.select(F.col("sig").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "level", "digests", "bitmap")])
        sides = buckets.join_spread(sides, shape, x, counts=pairs.groupBy(x).agg(F.count("*").alias("n")))
    level, words = F.least("level_a", "level_b"), F.least(F.size("bitmap_a"), F.size("bitmap_b"))

    def parity(x: str) -> F.Column:
        """The bitmap folded to the shorter one's length."""
        return F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.sequence(i, F.size(f"bitmap_{x}") - 1, words), F.lit(0).cast("long"), lambda u, k: u.bitwiseXOR(F.get(f"bitmap_{x}", k))))

    differ = F.aggregate(F.zip_with(parity("a"), parity("b"), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)

    def folded(x: str) -> F.Column:
        step = F.pow(F.lit(2), F.col(f"level_{x}") - level).cast("int")
        return F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), level).cast("int") - 1), lambda f: F.aggregate(F.slice(f"digests_{x}", f * step + 1, step), F.lit(0).cast("long"), lambda u, v: u.bitwiseXOR(v)))

    unequal = F.filter(F.transform(F.arrays_zip(folded("a").alias("x"), folded("b").alias("y")), lambda d, f: F.when(d["x"] != d["y"], f)), lambda f: f.isNotNull())
    most = F.floor((F.col("n_a") + F.col("n_b")) * (rule.den - rule.num) / (rule.den + rule.num))
    fits = (F.col("n_a") * rule.den >= F.col("n_b") * rule.num) & (F.col("n_b") * rule.den >= F.col("n_a") * rule.num)
    open_ = store.Table(sides.where(fits).where(differ <= most).withColumn("unequal", unequal).where(F.size("unequal") <= most).select("a", "b", "n_a", "n_b", "level_a", "level_b", F.explode("unequal").alias("fragment")), "ngram-open")

    def side(x: str) -> DataFrame:
        finer = F.pow(F.lit(2), F.col(f"level_{x}") - level).cast("int")
        own = F.explode(F.sequence(F.col("fragment") * finer, (F.col("fragment") + 1) * finer - 1))
        return open_.read().withColumn("own", own).select("a", "b", "n_a", "n_b", "fragment", F.lit(x).alias("side"), F.concat_ws(":", x, "own").alias("at"))

    wanted = store.Table(side("a").unionByName(side("b")), "ngram-sides")
    grams = sets.select("sig", F.posexplode("fragments").alias("own", "grams")).where(F.size("grams") > 0).select(F.concat_ws(":", "sig", "own").alias("at"), "grams")
    met = buckets.join_spread(wanted.read(), grams, "at")
    here = met.groupBy("a", "b", "n_a", "n_b", "fragment").agg(*[F.flatten(F.collect_list(F.when(F.col("side") == x, F.coalesce("grams", F.array().cast("array<long>"))))).alias(x + "s") for x in ("a", "b")])
    partial = here.select("a", "b", "n_a", "n_b", F.size("as").alias("size"), F.size(F.array_intersect("as", "bs")).alias("common"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg((F.col("n_a") - F.sum("size") + F.sum("common")).alias("overlap"))
    links = store.Table(total.where(F.col("overlap") * rule.den >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * rule.num).select("a", "b"), "ngram-links")
    for t in (open_, wanted):
        t.drop()
    return links


def numbered(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """Rows with a null doc_id get numbers of their own, beyond every doc_id, from the returned one on (None: no such rows)."""
    nulls = docs.where("doc_id is null")
    if not nulls.limit(1).count():
        return docs, None
    first = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    if first >= 1 << 62:
        raise ValueError("null doc_ids beside doc_ids of 2^62 or more")
    first = max(first, 0)
    # written, so that the numbers don't change when the rows are read again
    own = store.Table(nulls.withColumn("doc_id", F.monotonically_increasing_id() + first), "ngram-null-ids")
    return docs.where("doc_id is not null").unionByName(own.read()), first


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Returns doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id (smallest doc_id reachable).

    Rows with a null doc_id are nodes like others; class_id and component_id are null where no row there has a doc_id."""
    docs, first = numbered(docs)
    found = _classes(docs, rule)
    if first is None:
        return found
    return found.select(*(c if c == "n_shingles" else F.when(F.col(c) < first, F.col(c)).alias(c) for c in found.columns))


def _classes(docs: DataFrame, rule: Rule) -> DataFrame:
    spark = docs.sparkSession
    nodes = store.Table(buckets.keyed_nodes(docs, lambda h: describe(rule, h), W.NON_SPACE, FOLD), "ngram-nodes")
    shared = buckets.shared_keys(nodes.read())
    held = selective(rule, nodes.read(), shared.read())
    shared.drop()
    light = store.Table(nodes.read().select("doc_id", "n", "sig"), "ngram-docs")
    nodes.drop()
    first = light.read().where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("class_id"))

    wanted = held.read().select("sig").distinct().join(first, "sig").select("sig", F.col("class_id").alias("doc_id"))

    def bits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for part in parts:
            raw, sigs = W.utf8(part.column(1)), part.column(0).to_pylist()
            for i, j, batch in W.batches([t.translate(FOLD) for t in raw], W.NON_SPACE):
                rows = []
                for k in range(j - i):
                    g = grams(batch.hashes[batch.first[k] : batch.last[k]], rule.n)
                    if len(g) and signature(g) == sigs[i + k]:  # a doc_id may repeat
                        level, digests, fragments = cut(g)
                        rows.append((sigs[i + k], len(g), level, digests.view(np.int64), [f.view(np.int64) for f in fragments], bitmap(g)))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), longs, pa.list_(longs), longs)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sig", "n", "level", "digests", "fragments", "bitmap"])

    sets = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(wanted.hint("shuffle_hash"), "doc_id").select("sig", "text").mapInArrow(bits, "sig long, n long, level int, digests array<long>, fragments array<array<long>>, bitmap array<long>")
    sets = store.Table(sets.dropDuplicates(["sig"]) if _repeats(docs) else sets, "ngram-sets")
    store.release(spark)

    def linked(pairs: DataFrame) -> store.Table:
        pairs = store.Table(pairs.distinct(), "ngram-pairs")
        store.release(spark)
        links = verify(rule, pairs.read(), sets.read())
        pairs.drop()
        store.release(spark)
        return links

    def across(roots: store.Table) -> store.Table:
        """Members of the buckets that hold more than one component, each with its root and one member of the bucket (rep, rep_root)."""
        rooted = store.Table(held.read().join(roots.read().toDF("sig", "root"), "sig", "left").select("key", "sig", "holders", F.coalesce("root", "sig").alias("root")), "ngram-rooted")
        order = F.xxhash64("sig")
        mixed = rooted.read().groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"), F.min_by(F.struct("sig", "root"), order).alias("rep")).where("lo <> hi")
        mixed = store.Table(mixed.select("key", "members", F.col("rep.sig").alias("rep"), F.col("rep.root").alias("rep_root")), "ngram-mixed")
        met = buckets.join_spread(rooted.read(), mixed.read(), "key", counts=mixed.read().select("key", F.col("members").alias("n"))).where("rep is not null")
        out = store.Table(met.select("key", "sig", "holders", "root", "rep", "rep_root"), "ngram-across")
        for t in (rooted, mixed):
            t.drop()
        return out

    def star(x: F.Column, y: F.Column, members: DataFrame) -> DataFrame:
        return members.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b")

    def rest(members: DataFrame) -> DataFrame:
        shape = sets.read().select("sig", "n", "bitmap")
        return cross_pairs(rule, members.select("key", "sig", "holders", "root").join(shape, "sig"))

    sig = F.col("sig")
    roots = None
    for find in (None, lambda m: star(F.col("rep"), sig, m.where("root <> rep_root")), rest):
        members = across(roots) if find else None
        links = linked(find(members.read()) if find else star(F.col("lo"), sig, held.read()))
        found = buckets.components(links.read().toDF("a", "b") if roots is None else roots.read().toDF("a", "b").union(links.read()))
        for t in (links, roots, members):
            if t is not None:
                t.drop()
        roots = found
    for t in (held, sets):
        t.drop()

    group = roots.read().toDF("sig", "root")
    group = group.union(group.select(F.col("root").alias("sig"), "root")).distinct()
    least = group.join(first, "sig").groupBy("root").agg(F.min("class_id").alias("component_id"))
    known = first.join(group.join(least, "root").select("sig", "component_id"), "sig", "left")
    known = store.Table(known.select("sig", "class_id", F.coalesce("component_id", "class_id").alias("component_id")), "ngram-components")
    roots.drop()
    out = buckets.join_spread(light.read(), known.read(), "sig")
    out = store.Table(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")), "ngram-classes")
    for t in (light, known):
        t.drop()
    store.release(spark)
    return out.read()


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id stands in more than one row."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 8, 10)) -> DataFrame:  # noqa: B008
    """The rows whose doc_id is the smallest of their component, columns as they are.

    Rows with a null doc_id come after all others: one stays of a component that has no doc_id. Rows that repeat a doc_id stay together."""
    rows, first = numbered(docs)
    kept = _classes(rows, rule).where("component_id = doc_id").select("doc_id").distinct()
    rows = rows.join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    if first is not None:
        rows = rows.withColumn("doc_id", F.when(F.col("doc_id") < first, F.col("doc_id")).cast(docs.schema["doc_id"].dataType))
    return rows.select(*docs.columns)
