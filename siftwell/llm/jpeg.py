"""Progressive JPEG: a decoder from scans to RGB tensors, and an encoder that carries bytes losslessly in the coefficients.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays, dequantises, applies the
inverse transform in numpy, repeats chroma samples to full resolution and converts to RGB. Scans whose codes are all of one length
(as the encoder writes them) are read as arrays of bits; any other Huffman scan goes through the bit-by-bit reader.

The carrier's unit is the 8-bit quantised coefficient: Y, Cb and Cr planes at 4:2:0 hold the payload in zigzag order, an AC byte as
sign and 128 + seven bits, a DC byte minus 128. The payload's length stands in an APP9 segment.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm import words as W

ORDER = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
ZIGZAG = np.array(ORDER)
_U = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
UNIT = 576
MCU = 384


# ---------------------------------------------------------------- reading


@functools.lru_cache(64)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = i = 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                self.codes[n, code] = symbols[i]
                code, i = code + 1, i + 1
            code <<= 1
        self.only = next(iter(self.codes.items())) if len(self.codes) == 1 else None
        self.table: list[tuple[int, int]] | None = None

    def lookup(self) -> list[tuple[int, int]]:
        """(length, symbol) by the next 16 bits."""
        if self.table is None:
            self.table = [(0, 0)] * 65536
            for (n, code), s in self.codes.items():
                self.table[code << (16 - n) : (code + 1) << (16 - n)] = [(n, s)] * (1 << (16 - n))
        return self.table


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    @functools.cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.data, np.uint8))

    @functools.cached_property
    def window(self) -> list[int]:
        """32 bits from each byte on."""
        x = np.frombuffer(self.data + b"\xff" * 4, np.uint8).astype(np.uint32)
        return (x[:-4] << 24 | x[1:-3] << 16 | x[2:-2] << 8 | x[3:-1]).tolist() + [0xFFFFFFFF]

    def peek16(self) -> int:
        return self.window[self.at >> 3] >> (16 - (self.at & 7)) & 0xFFFF

    def symbol(self, h: Huffman) -> int:
        n, s = h.lookup()[self.peek16()]
        if not n:
            raise ValueError("bad Huffman code")
        self.at += n
        return s

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek16() >> (16 - n)
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("scan ends early")
        self.at += n
        return out


def extend(v: int, n: int) -> int:
    return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def _dc_first(parts: list[bytes], plan: list[tuple[np.ndarray, int, Huffman]], order: np.ndarray, al: int, restart: int) -> None:
    """plan: (flat DC array, component, table) by component; order: rows (component, block) in scan order."""
    comps, blocks = order[:, 0].tolist(), order[:, 1].tolist()
    values: list[int] = []
    step = restart or len(comps)
    for k, part in enumerate(parts):
        bits, last = Bits(part), [0] * len(plan)
        tables, window, at = [p[2].lookup() for p in plan], bits.window, 0
        for c in comps[k * step : (k + 1) * step]:
            n, s = tables[c][window[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
            if not n:
                raise ValueError("bad Huffman code")
            at += n
            if s:
                v = window[at >> 3] >> (16 - (at & 7)) & 0xFFFF
                v >>= 16 - s
                last[c] += v if v >> (s - 1) else v - (1 << s) + 1
                at += s
            values.append(last[c])
    got = np.array(values, np.int32) << al
    for c, (plane, _, _) in enumerate(plan):
        mine = order[:, 0] == c
        plane[order[mine, 1]] = got[mine]
    

def _ac_first(bits: Bits, rows: np.ndarray, ss: int, se: int, al: int, h: Huffman) -> None:
    width = se - ss + 1
    if h.only and h.only[1] >> 4 == 0 and h.only[1] & 15:
        (n, code), size = h.only[0], h.only[1] & 15
        if n + size == 8 and code == 0 and bits.at == 0:  # a byte for each coefficient
            raw = np.frombuffer(bits.data, np.uint8)[: len(rows) * width].astype(np.int32)
            if len(raw) < len(rows) * width or (raw >> size).any():
                raise ValueError("bad Huffman code")
            rows[:, ss : se + 1] = (np.where(raw >> (size - 1), raw, raw - (1 << size) + 1) << al).reshape(len(rows), width)
            return
        raw = bits.many(len(rows) * width * (n + size)).reshape(-1, n + size)
        if code == 0 and not raw[:, :n].any():  # the only code is zeros
            weights = 1 << np.arange(size - 1, -1, -1)
            v = raw[:, n:] @ weights.astype(np.int32)
            v = np.where(v >> (size - 1), v, v - (1 << size) + 1)
            rows[:, ss : se + 1] = (v << al).reshape(len(rows), width)
            return
        raise ValueError("bad Huffman code")
    run = 0
    for row in rows:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(bits.symbol(h), 16)
            if s:
                k += r
                row[k] = extend(bits.take(s), s) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(bits: Bits, rows: np.ndarray, ss: int, se: int, al: int, h: Huffman) -> None:
    one, i, n = 1 << al, 0, len(rows)

    def correct(part: np.ndarray) -> None:
        if not part.size:
            return
        if part.all():
            add = bits.many(part.size).reshape(part.shape)
            part += np.where(part > 0, one, -one) * add
            return
        at = np.nonzero(part)
        if len(at[0]):
            part[at] += np.sign(part[at]) * bits.many(len(at[0])).astype(np.int32) * one

    while i < n:
        row, k = rows[i], ss
        while k <= se:
            r, s = divmod(bits.symbol(h), 16)
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                if k == ss:
                    correct(rows[i : i + run, ss : se + 1])
                else:
                    correct(row[k : se + 1][None])
                    correct(rows[i + 1 : i + run, ss : se + 1])
                i += run - 1
                break
            value = (one if bits.take(1) else -one) if s else 0
            skip = r
            while k <= se:
                if row[k]:
                    if bits.take(1):
                        row[k] += one if row[k] > 0 else -one
                else:
                    if skip == 0:
                        break
                    skip -= 1
                k += 1
            if value and k <= se:
                row[k] = value
            k += 1
        i += 1


class Image:
    """Coefficients (zigzag order) of each component, and what is needed to turn them into pixels."""

    def __init__(self, data: bytes):
        self.app9, self.quant, self.huffman, self.restart = b"", {}, {}, 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at, ended = 2, False
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            at += 2
            if marker == 0xFF:
                at -= 1
                continue
            if marker == 0xD9:
                ended = True
                break
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xC2:
                self.frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("only progressive Huffman files are read")
            elif marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int32)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xE9:
                self.app9 = body
            elif marker == 0xDA:
                end = m.start() if (m := MARKER.search(data, at)) else len(data)
                raw = data[at:end]
                parts = re.split(rb"\xff[\xd0-\xd7]", raw) if self.restart else [raw]
                self.scan(body, [p.replace(b"\xff\x00", b"\xff") for p in parts])
                at = end
        if not ended:
            raise ValueError("the file ends early")

    def frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3):
            raise ValueError("8-bit grey or three-component files are read")
        self.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        self.mw, self.mh = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.planes = [np.zeros((self.mh * v, self.mw * h, 64), np.int32) for _, h, v, _ in self.comps]

    def scan(self, head: bytes, parts: list[bytes]) -> None:
        n = head[0]
        ids = [c[0] for c in self.comps]
        comps = [(ids.index(head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
        ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if ss == 0:
            order, per = self.dc_order([c for c, _ in comps])
            flat = [self.planes[c].reshape(-1, 64)[:, 0] for c, _ in comps]
            if ah == 0:
                _dc_first(parts, [(f, c, self.huffman[t >> 4]) for f, (c, t) in zip(flat, comps, strict=True)], order, al, self.restart * per)
            else:
                step = self.restart * per or len(order)
                got = np.concatenate([Bits(p).many(len(order[i * step : (i + 1) * step])) for i, p in enumerate(parts)]).astype(np.int32)
                for k, f in enumerate(flat):
                    mine = order[:, 0] == k
                    f[order[mine, 1]] |= got[mine] << al
            return
        c, t = comps[0]
        _, h, v, _ = self.comps[c]
        rows = self.planes[c][: -(-(self.height * v) // (8 * self.vmax)), : -(-(self.width * h) // (8 * self.hmax))]
        work = rows.reshape(-1, 64)
        step = self.restart or len(work)
        for i, p in enumerate(parts):
            (_ac_refine if ah else _ac_first)(Bits(p), work[i * step : (i + 1) * step], ss, se, al, self.huffman[16 | t & 15])
        if not np.shares_memory(work, rows):
            rows[...] = work.reshape(rows.shape)

    def dc_order(self, comps: list[int]) -> tuple[np.ndarray, int]:
        """Rows (place in comps, block) in scan order, and the blocks of a restart unit."""
        if len(comps) == 1:
            _, h, v, _ = self.comps[comps[0]]
            hh, ww = -(-(self.height * v) // (8 * self.vmax)), -(-(self.width * h) // (8 * self.hmax))
            blocks = (np.arange(hh)[:, None] * (self.mw * h) + np.arange(ww)).ravel()
            return np.stack([np.zeros_like(blocks), blocks], 1), 1
        parts = []
        for k, c in enumerate(comps):
            _, h, v, _ = self.comps[c]
            y, x = np.arange(self.mh)[:, None, None, None] * v + np.arange(v)[:, None], np.arange(self.mw)[:, None, None] * h + np.arange(h)
            blocks = (y * (self.mw * h) + x).reshape(self.mh * self.mw, h * v)
            parts.append(np.stack([np.full_like(blocks, k), blocks], 2))
        order = np.concatenate(parts, 1)
        return order.reshape(-1, 2), order.shape[1]

    def pixels(self) -> np.ndarray:
        """A full-resolution RGB tensor (height, width, 3) of bytes."""
        out = []
        for (_, h, v, q), plane in zip(self.comps, self.planes, strict=True):
            blocks = np.zeros(plane.shape, np.float64)
            blocks[..., ZIGZAG] = plane * self.quant[q]
            rows, cols, _ = plane.shape
            x = (blocks.reshape(-1, 8) @ _U).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _U  # columns, then rows
            x = x.reshape(rows, cols, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)
            x = np.clip(np.rint(x) + 128, 0, 255)
            x = x.repeat(self.vmax // v, 0).repeat(self.hmax // h, 1)
            out.append(x[: self.height, : self.width])
        if len(out) == 1:
            return np.repeat(out[0][..., None], 3, 2).astype(np.uint8)
        y, cb, cr = out[0], out[1] - 128, out[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        return np.clip(np.rint(rgb, out=rgb), 0, 255, out=rgb).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return Image(data).pixels()


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(len(lengths.get(n, ())) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in lengths.get(n, ())))


DC_SIZES = {4: list(range(9))}  # nine 4-bit codes
DC_CODES = [format(i, "04b") for i in range(9)]
REFINE = {4: [r << 4 for r in range(15)]}
_DC_BITS = {d: DC_CODES[s := abs(d).bit_length()] + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "") for d in range(-255, 256)}
_HEADER = (
    b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    + _table(0x00, DC_SIZES) + _table(0x10, {1: [0x07]}) + _table(0x11, REFINE)
)


def _pack(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(comps: list[int], tables: int, ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c, tables]) for c in comps) + bytes([ss, se, ah << 4 | al])) + data


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 file of eleven scans whose coefficients are the payload."""
    n = max(1, -(-len(payload) // MCU))
    mw = int(np.ceil(np.sqrt(n)))
    mh = -(-n // mw)
    raw = np.zeros(mw * mh * MCU, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    y, cb, cr = raw[: 256 * mw * mh].reshape(2 * mh, 2 * mw, 64), raw[256 * mw * mh : 320 * mw * mh].reshape(mh, mw, 64), raw[320 * mw * mh :].reshape(mh, mw, 64)
    frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * mh, 16 * mw, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out = [_HEADER, _segment(0xE9, b"payload\0" + struct.pack(">Q", len(payload))), frame]
    dc = np.concatenate([y[..., 0].reshape(mh, 2, mw, 2).transpose(0, 2, 1, 3).reshape(-1, 4), cb[..., 0].reshape(-1, 1), cr[..., 0].reshape(-1, 1)], 1).astype(np.int16) - 128
    high = dc >> 1
    diffs = np.empty_like(high)
    ys = high[:, :4].ravel()
    diffs[:, :4] = np.diff(ys, prepend=0).reshape(-1, 4)
    diffs[:, 4:] = np.diff(high[:, 4:], axis=0, prepend=0)
    text = "".join(map(_DC_BITS.__getitem__, diffs.ravel().tolist()))
    out.append(_scan([1, 2, 3], 0x00, 0, 0, 0, 1, _pack(np.frombuffer(text.encode(), np.uint8) - 48)))
    planes = [p.reshape(-1, 64) for p in (y, cb, cr)]
    for ss, se in ((1, 5), (6, 63)):
        for c, p in enumerate(planes, 1):
            v = p[:, ss : se + 1]
            size = (64 | (v & 127) >> 1).astype(np.uint8)  # 7 bits of magnitude 64..127
            out.append(_scan([c], 0x00, ss, se, 0, 1, np.where(v & 128, size, 127 - size).astype(np.uint8).tobytes()))
    for c, p in enumerate(planes, 1):
        bits, blocks, i = [], len(p), 0
        while i < blocks:
            r = min(14, (blocks - i).bit_length() - 1)
            run = min(blocks - i, (2 << r) - 1)
            code = f"{r:04b}" + (format(run - (1 << r), f"0{r}b") if r else "")
            bits += [np.frombuffer(code.encode(), np.uint8) - 48, (p[i : i + run, 1:] & 1).ravel()]
            i += run
        out.append(_scan([c], 0x01, 1, 63, 1, 0, _pack(np.concatenate(bits))))
    out.append(_scan([1, 2, 3], 0x00, 0, 0, 1, 0, _pack((dc & 1).astype(np.uint8).ravel())))
    return b"".join([*out, b"\xff\xd9"])


def decode_payload(image: Image) -> bytes:
    """The bytes that encode_payload stored, from decoded coefficients."""
    if not image.app9.startswith(b"payload\0"):
        raise ValueError("no payload")
    flat = np.concatenate([p.reshape(-1, 64) for p in image.planes])
    raw = (np.abs(flat) & 127 | (flat > 0) << 7).astype(np.uint8)
    raw[:, 0] = (flat[:, 0] + 128).astype(np.uint8)
    return raw.tobytes()[: struct.unpack(">Q", image.app9[8:16])[0]]


BATCH = 32 << 20


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def feature(rgb: np.ndarray) -> str:
    """Size, channel sums, and counts of the green channel in eight bins; whole numbers only."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    bins = np.bincount(rgb[..., 1].ravel() >> 5, minlength=8)
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ",".join(map(str, sums.tolist())) + ";" + ",".join(map(str, bins.tolist()))


def stored_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text (null: empty) as a progressive JPEG that holds its padded bytes, to be written to a table."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for part in parts:
            rows, held = [], 0
            for doc_id, text in zip(part.column(0).to_pylist(), W.utf8(part.column(1)), strict=True):
                rows.append([doc_id, len(text), encode_payload(pad(text))])
                held += len(rows[-1][2])
                if held > BATCH:
                    yield _record_batch(rows, schema)
                    rows, held = [], 0
            yield _record_batch(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_columns(media: DataFrame, with_tensor: bool = False) -> DataFrame:
    """Decodes stored files (doc_id, n_bytes, media) and describes payload, file and pixels.

    Equal files give equal values; repeated rows and null ids each get a row; other columns are ignored. With with_tensor height,
    width and the bytes of the full-resolution RGB tensor follow, for a table of tensors. An image is decoded whole: per byte of
    text it takes some 60 bytes of memory while it lasts."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())] * with_tensor
    schema = pa.schema(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, held = [], 0
            for doc_id, n_bytes, cell in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                file = cell.as_py()
                image = Image(file)
                payload, rgb = decode_payload(image), image.pixels()
                row = [doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(rgb)]
                rows.append(row + ([rgb.shape[0], rgb.shape[1], rgb.tobytes()] if with_tensor else []))
                held += rgb.size * with_tensor
                if held > BATCH:
                    yield _record_batch(rows, schema)
                    rows, held = [], 0
            yield _record_batch(rows, schema)

    kinds = {"int64": "long", "int32": "int", "string": "string", "binary": "binary"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{k} {kinds[str(t)]}" for k, t in fields))


def _record_batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
