"""A versioned index on any file system Spark writes to: every commit is one small row written last.

    path/docs/<segment>       rows, in the index's sort order if it has one
    path/postings/<segment>   dealt by ranges of (field, term, doc_id) and sorted by them: no term, however frequent, is one task or file,
                              and lookups, prefixes and ranges prune files and row groups; positions and offsets are packed as bytes
    path/terms/<segment>      term statistics        path/fields/<segment>   field statistics
    path/impacts/<segment>    best counts and lengths of each term by block of documents
    path/points/<segment>     point columns clustered along a space-filling curve, if asked for
    path/tombstones/<name>    (doc_id, segment): rows of older segments that are gone, or soft-deleted
    path/commits              generation, segments, tombstones, user data

Segment names are never used twice, so a commit that failed midway can be repeated; vacuum removes what no commit refers to.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources import shared
from siftwell.sources.index import FieldConfig, Index, Keyword, competitive, impacts_in_order, postings_of, problems, statistics, unpacked
from siftwell.sources.points import clustered

KINDS = ("docs", "raw", "postings", "terms", "fields", "impacts", "points", "tombstones")
COMMITS = "generation long, segments string, tombstones string, user_data string"
LOCK_SECONDS = 3600


@dataclass(frozen=True)
class MergePolicy:
    """Which segments to merge, given (name, rows) of each: once there are more than `most`, the smallest, so that `most` are left."""

    most: int = 10

    def choose(self, segments: list[tuple[str, int]]) -> list[str]:
        extra = len(segments) - self.most
        return [] if extra <= 0 else [s for s, _ in sorted(segments, key=lambda x: (x[1], x[0]))[: extra + 1]]


class NoMerges(MergePolicy):
    def choose(self, segments: list[tuple[str, int]]) -> list[str]:
        return []


class IndexStore:
    """Opens (append), creates (create) or does either (create_or_append) an index; closing commits what is pending.

    One writer at a time: the lock names its owner, each commit renews it, and one not renewed for `lock_seconds` is taken over."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, FieldConfig], mode: str = "create_or_append", sort_by: list[str] | None = None, points: list[str] | None = None,
                 merge_policy: MergePolicy = NoMerges(), lock_seconds: int = LOCK_SECONDS):  # noqa: B008
        if mode not in ("create", "append", "create_or_append"):
            raise ValueError(mode)
        self.spark, self.path, self.fields, self.sort_by, self.points, self.merge_policy, self.lock_seconds = spark, path.rstrip("/"), fields, sort_by, points, merge_policy, lock_seconds
        self.pending: list[Callable[[], None]] = []
        self.prepared: tuple[int, dict | None] | None = None
        self.owner = uuid.uuid4().hex
        if not self._lock():
            raise RuntimeError(f"{path} is locked by another writer")
        try:
            if mode == "create":
                for name in (*KINDS, "commits"):
                    shared.delete(spark, f"{self.path}/{name}")
            elif mode == "append" and not self.commits():
                raise FileNotFoundError(path)
        except BaseException:
            self._unlock()
            raise

    def __enter__(self) -> IndexStore:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self.commit()
        finally:
            self._unlock()

    # the lock

    def _lock(self) -> bool:
        fs, p = shared.file_system(self.spark, f"{self.path}/_lock")
        fs.mkdirs(p.getParent())
        if fs.exists(p) and time.time() * 1000 - fs.getFileStatus(p).getModificationTime() > self.lock_seconds * 1000:
            fs.delete(p, False)
        if not fs.createNewFile(p):
            return False
        self._renew()
        return True

    def _renew(self) -> None:
        fs, p = shared.file_system(self.spark, f"{self.path}/_lock")
        out = fs.create(p, True)
        out.writeBytes(self.owner)
        out.close()

    def _holds(self) -> bool:
        fs, p = shared.file_system(self.spark, f"{self.path}/_lock")
        if not fs.exists(p):
            return False
        stream = fs.open(p)
        try:
            return bool(stream.readLine() == self.owner)
        finally:
            stream.close()

    def _unlock(self) -> None:
        if self._holds():
            shared.delete(self.spark, f"{self.path}/_lock")

    # commits

    def commits(self) -> list[dict]:
        if not shared.exists(self.spark, f"{self.path}/commits"):
            return []
        return [r.asDict() for r in self.spark.read.json(f"{self.path}/commits", schema=COMMITS).orderBy("generation").collect()]

    def version(self) -> int:
        found = self.commits()
        return found[-1]["generation"] if found else 0

    def is_current(self, generation: int) -> bool:
        return generation == self.version()

    def add(self, docs: DataFrame) -> None:
        self.pending.append(lambda: self._write(docs))

    def delete(self, condition: Column) -> None:
        """Marks the rows of earlier commits and of earlier pending adds that meet the condition."""
        self.pending.append(lambda: self._bury(condition, False))

    def soft_delete(self, condition: Column) -> None:
        """As delete, but `open(include_soft=True)` still shows the rows."""
        self.pending.append(lambda: self._bury(condition, True))

    def update(self, condition: Column, docs: DataFrame) -> None:
        """Deletes by condition, then adds: readers see both or neither."""
        self.delete(condition)
        self.add(docs)

    def soft_update(self, condition: Column, docs: DataFrame) -> None:
        """Soft-deletes by condition, then adds."""
        self.soft_delete(condition)
        self.add(docs)

    def _write(self, docs: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows = docs.sortWithinPartitions(*self.sort_by) if self.sort_by else docs
        self._put(rows, f"docs/{name}")
        docs = self._get(f"docs/{name}")
        # a few large files make few tasks: deal their rows out; ranges are then taken of written postings, not of a second analysis
        cores = self.spark.sparkContext.defaultParallelism
        self._put(postings_of(docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs, self.fields, packed=True), f"raw/{name}")
        raw = self._get(f"raw/{name}")
        self._put(raw.drop("problem").repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id"), f"postings/{name}")
        postings = self._get(f"postings/{name}")
        if any(not isinstance(f, Keyword) and (f.positions or f.max_term_bytes is not None) for f in self.fields.values()):
            wrong = problems(raw, self.fields).groupBy("field", "problem").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).collect()  # a row per kind
            if wrong:
                raise ValueError(f"not indexed: {wrong}")
        # documents lie together in the raw postings and terms in the sorted ones: partial sums leave little to shuffle
        self._together(
            lambda: self._put(statistics(raw)[0].coalesce(1), f"fields/{name}"),
            lambda: self._put(statistics(postings)[1].repartitionByRange("field", "term").sortWithinPartitions("field", "term"), f"terms/{name}"),
            lambda: self._put(impacts_in_order(postings), f"raw/{name}-best"),
        )
        best = self._get(f"raw/{name}-best")
        self._put(best.where("not edge").drop("edge"), f"impacts/{name}")
        self._put(competitive(best.where("edge").drop("edge")).coalesce(1).sortWithinPartitions("field", "term", "block"), f"impacts/{name}", "append")
        for used in (name, f"{name}-best"):
            shared.delete(self.spark, f"{self.path}/raw/{used}")
        if self.points:
            clustered(docs.select("doc_id", *self.points), self.points).write.parquet(f"{self.path}/points/{name}")
        self._segments.append(name)

    def _together(self, *steps: Callable[[], None]) -> None:
        """Runs jobs that don't need one another at once: a small commit is made of short jobs, one after the other."""
        with ThreadPoolExecutor(len(steps)) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(step)) for step in steps]:
                done.result()

    def _put(self, rows: DataFrame, to: str, mode: str = "error") -> None:
        rows.write.mode(mode).option("compression", "zstd").parquet(f"{self.path}/{to}")

    def _get(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{path}")

    def _bury(self, condition: Column, soft: bool) -> None:
        found = [self.spark.read.parquet(f"{self.path}/docs/{s}").where(condition).select("doc_id", F.lit(s).alias("segment"), F.lit(soft).alias("soft")) for s in self._segments]
        if found:
            name = uuid.uuid4().hex
            reduce(DataFrame.unionByName, found).write.parquet(f"{self.path}/tombstones/{name}")
            self._tombstones.append(name)

    def prepare(self, user_data: dict | None = None) -> None:
        """First phase of a commit: writes all data, which no reader sees until `commit`; `rollback` forgets them."""
        if self.prepared is not None:
            raise RuntimeError("prepared already")
        past = self.commits()
        self._segments = json.loads(past[-1]["segments"]) if past else []
        self._tombstones = json.loads(past[-1]["tombstones"]) if past else []
        for step in self.pending:
            step()
        self.prepared = (past[-1]["generation"] if past else 0, user_data)

    def commit(self, user_data: dict | None = None) -> int:
        """First all data, then one row: a failure in between leaves the last commit as it was, and the commit can be tried again."""
        if self.prepared is None:
            if not self.pending and user_data is None and (now := self.version()):
                return now
            self.prepare(user_data)
        before, data = self.prepared
        self._record(before + 1, self._segments, self._tombstones, user_data or data)
        self.pending, self.prepared = [], None
        chosen = self.merge_policy.choose([(s, self.spark.read.parquet(f"{self.path}/docs/{s}").count()) for s in self._segments]) if not isinstance(self.merge_policy, NoMerges) else []
        return self.compact(chosen) if chosen else before + 1

    def _record(self, generation: int, segments: list[str], tombstones: list[str], user_data: dict | None) -> None:
        if not self._holds():
            raise RuntimeError(f"{self.path}: the lock was lost")
        self._renew()
        row = [(generation, json.dumps(segments), json.dumps(tombstones), json.dumps(user_data or {}))]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def rollback(self) -> None:
        self.pending, self.prepared = [], None

    def compact(self, segments: list[str] | None = None) -> int:
        """Rewrites the live rows of the given segments (all) as one; statistics forget deleted rows from then on."""
        if self.pending or self.prepared:
            self.commit()
        last = self.commits()[-1]
        chosen = json.loads(last["segments"]) if segments is None else segments
        live = self._rows("docs", chosen).join(self._graves(json.loads(last["tombstones"])), ["doc_id", "segment"], "left_anti").drop("segment")
        self._segments = [s for s in json.loads(last["segments"]) if s not in chosen]
        self._write(live)
        graves = json.loads(last["tombstones"]) if len(self._segments) > 1 else []
        self._record(last["generation"] + 1, self._segments, graves, None)
        return last["generation"] + 1

    def vacuum(self, keep_last: int = 1) -> None:
        """Keeps the last commits only, and drops what they don't refer to."""
        kept = self.commits()[-keep_last:]
        used = {s for c in kept for s in json.loads(c["segments"])} | {t for c in kept for t in json.loads(c["tombstones"])}
        for kind in KINDS:
            for name in shared.names(self.spark, f"{self.path}/{kind}"):
                if name not in used:
                    shared.delete(self.spark, f"{self.path}/{kind}/{name}")

    def add_index(self, other: Index, offset: int) -> None:
        """Takes in another index's live documents, their ids moved by offset; ids that then clash are an error."""
        moved = other.live.withColumn("doc_id", F.col("doc_id") + offset)
        if self.version() and moved.join(self.open().live.select("doc_id"), "doc_id", "left_semi").limit(1).count():
            raise ValueError("doc_ids clash")
        self.add(moved)

    # readers

    def _rows(self, kind: str, segments: list[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{kind}/{s}").withColumn("segment", F.lit(s)) for s in segments]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _graves(self, names: list[str], soft: bool = True) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], "doc_id long, segment string")
        found = self.spark.read.parquet(*[f"{self.path}/tombstones/{t}" for t in names])
        return (found if soft else found.where(~F.col("soft"))).select("doc_id", "segment").distinct()

    def open(self, generation: int | None = None, include_soft: bool = False) -> Index:
        """The last commit, or the given one."""
        found = [c for c in self.commits() if generation is None or c["generation"] == generation]
        if not found:
            raise FileNotFoundError(f"{self.path}: no commit {generation or ''}")
        return self._index(json.loads(found[-1]["segments"]), json.loads(found[-1]["tombstones"]), include_soft)

    def open_pending(self) -> Index:
        """A reader over the last commit and what this writer has pending, which is written but not committed."""
        if self.prepared is None:
            self.prepare()
        return self._index(self._segments, self._tombstones, False)

    def _index(self, segments: list[str], tombstones: list[str], include_soft: bool) -> Index:
        docs, postings = self._rows("docs", segments), self._rows("postings", segments)
        by_field, by_term = self._rows("fields", segments), self._rows("terms", segments)
        if len(segments) > 1:
            by_field = by_field.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("doc_count", "sum_ttf", "sum_df")])
            by_term = by_term.groupBy("field", "term").agg(*[F.sum(c).alias(c) for c in ("df", "ttf")])
        max_doc = docs.drop("segment")
        if tombstones:
            gone = self._graves(tombstones, not include_soft)
            docs, postings = docs.join(gone, ["doc_id", "segment"], "left_anti"), postings.join(gone, ["doc_id", "segment"], "left_anti")
        points = self._rows("points", segments).drop("segment") if self.points else None
        return Index(docs.drop("segment"), unpacked(postings.drop("segment")), by_field.drop("segment"), by_term.drop("segment"), None, self.fields, max_doc, points, False, self._rows("impacts", segments).drop("segment"))


def reader(spark: SparkSession, path: str, fields: dict[str, FieldConfig], points: list[str] | None = None) -> IndexStore:
    """The store without its lock: for reading only."""
    out = IndexStore.__new__(IndexStore)
    out.spark, out.path, out.fields, out.points, out.sort_by = spark, path.rstrip("/"), fields, points, None
    out.pending, out.prepared, out.owner = [], None, ""
    return out
