"""WARC archives: writing, normalising of monolithic gzip files, and reading through a sidecar index.

An archive whose whole file is one gzip stream can't be entered at a record. `normalise` inflates such a stream once, rewrites
every record as a gzip member of its own, and writes a sidecar index (a line `offset length record-id` for each member) beside it.
Archives are files, `*.warc.gz` and `*.warc.gz.idx`, in a folder that executors share. A task writes under a name of its own and
moves the finished file to its place, the index last; the rows it returns name what it wrote. A task that is lost and repeated
writes other files, and only those that the returned rows name count.

Null html is an empty payload; null urls leave out the target; rows with equal page_id each get a record; a null page_id gives a
record without a number. Of rows with equal payloads of at least `min_revisit` bytes those with the smallest page_id are responses.
Columns beyond page_id, url and html are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import buckets, store
from siftwell.llm import words as W
from siftwell.sources import shared

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, n_bytes: int, kind: str, refers_to) -> bytes:
    """A response with its payload, or a revisit whose block keeps only the HTTP header."""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record(headers, head + (payload if kind == "response" else b""))


class Inflated:
    """Reads a gzip file of one or many members as one stream, holding no more than a record."""

    def __init__(self, source, step: int = 1 << 16):
        self.source, self.step, self.buffer, self.z = source, step, bytearray(), zlib.decompressobj(31)

    def fill(self) -> bool:
        left = b""
        if self.z.eof:
            left, self.z = self.z.unused_data, zlib.decompressobj(31)
        part = left or self.source.read(self.step)
        if not part:
            return False
        self.buffer += self.z.decompress(part)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("archive ends within a record")
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise ValueError("archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, raw bytes) of every record of an archive, gzip-compressed as a whole or by record."""
    stream = Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:] if x)
        block = stream.take(int(headers["Content-Length"]))
        yield headers, block, head + block + stream.take(4)


def normalise(source, target, level: int = 6) -> list[tuple[int, int, str]]:
    """Copies an archive with one member a record; returns the sidecar index: offset, length and id of each."""
    index, at = [], 0
    for headers, _, raw in records(source):
        member = gzip.compress(raw, level, mtime=0)
        target.write(member)
        index.append((at, len(member), headers["WARC-Record-ID"]))
        at += len(member)
    return index


def index_lines(index: list[tuple[int, int, str]]) -> bytes:
    return "".join(f"{offset} {length} {record_id}\n" for offset, length, record_id in index).encode()


def read_index(data: bytes) -> list[tuple[int, int, str]]:
    return [(int(o), int(n), i) for o, n, i in (line.split(" ", 2) for line in data.decode().splitlines())]


@contextmanager
def placed(fs, path: str):
    """An output stream to a name of its own, moved to path when all is written."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


def _page_id(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_member(content: bytes) -> dict:
    """The record in a member; the payload of a response is checked against its digest."""
    headers, block, _ = next(records(io.BytesIO(content)))
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if headers["WARC-Type"] == "response" and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    return {"page_id": _page_id(headers["WARC-Record-ID"]), "payload_bytes": n_bytes, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": _page_id(headers.get("WARC-Refers-To")), "payload": payload}


def plan_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Pages with digest, size, record type and the page a revisit refers to. Payloads with very many copies gather nowhere."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = pages.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    repeats = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return buckets.join_spread(pages, first, "digest").select("page_id", "url", "html", "digest", "n_bytes", F.when(repeats, "revisit").otherwise("response").alias("kind"), F.when(repeats, F.col("first_id")).alias("refers_to"))


def write_monolithic(planned: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes files of one gzip stream each, about archive_bytes before compression or a single record; returns (archive, records)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store.files(folder)

        def rows() -> Iterator[bytes]:
            for part in parts:
                cols = [c.to_pylist() for c in part.columns]
                cols[2] = W.utf8(part.column(2))
                for row in zip(*cols, strict=True):
                    yield page_record(*row)

        source, pending = rows(), None
        while (pending := next(source, None) if pending is None else pending) is not None:
            path, held, n = f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
            with placed(fs, path) as out:
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                while pending is not None and held < archive_bytes:
                    out.write(z.compress(pending))
                    held, n, pending = held + len(pending), n + 1, next(source, None)
                out.write(z.flush())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["archive", "records"])

    return planned.mapInArrow(run, "archive string, records long")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Inflates each archive once and writes it anew with a member for each record, and its index; returns (archive, records)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store.files(folder)
        for part in parts:
            for path, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                done = f"{base}/{uuid.uuid4().hex}-{path.rsplit('/', 1)[1]}"
                with fs.open_input_stream(path, compression=None) as source, placed(fs, done) as out:
                    index = normalise(source, out)
                if len(index) != n:
                    raise ValueError(f"{path}: {len(index)} records of {n}")
                with placed(fs, f"{done}.idx") as out:
                    out.write(index_lines(index))
                yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([n], pa.int64())], names=["archive", "records"])

    return archives.select("archive", "records").mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of normalised archives, each entered at the offset that the sidecar index gives."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store.files(folder)
        for part in parts:
            for path in part.column(0).to_pylist():
                with fs.open_input_stream(f"{path}.idx", compression=None) as source:
                    index = read_index(source.read())
                with fs.open_input_file(path) as source:
                    for i in range(0, len(index), 256):
                        rows = [read_member(source.read_at(length, offset)) for offset, length, _ in index[i : i + 256]]
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in fields} for r in rows], pa.schema(fields))

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, min_revisit: int = 100, folder: str | None = None) -> DataFrame:
    """Writes pages to monolithic archives, normalises these, and reads every record back through the sidecar indexes.

    The normalised archives and indexes stay in `folder` if one is given."""
    spark = pages.sparkSession
    raw, final = store.new_folder(spark, "warc-monolithic"), folder or store.new_folder(spark, "warc")
    monolithic = store.Table(write_monolithic(plan_records(pages, min_revisit), raw), "warc-written")
    store.release(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda t: t.read().repartition(n, "archive")  # the names are few bytes, the archives aren't
    normal = store.Table(normalise_archives(spread(monolithic), final), "warc-normalised")
    shared.delete(spark, raw)
    found = store.Table(read_archives(spread(normal), final), "warc-records")
    for t in (monolithic, normal):
        t.drop()
    if folder is None:
        shared.delete(spark, final)
    return found.read()
