"""Words of whole texts as 64-bit hashes, computed over Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of words [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, bool)
NON_SPACE[list(SPACES)] = False
#: Bytes of words of digits, lower-case ASCII letters and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
PIECE = 1 << 21
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, U)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[U(1), np.full(max(n, 256), _BASE)], dtype=U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of each word."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = table[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; works through pieces so that memory stays bounded by the text."""
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        s, n = starts[i:j], ends[i:j] - starts[i:j]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        values = (buf[place + np.repeat(s, n)].astype(U) + U(1)) * _powers_to(int(n.max()))[place]
        out[i:j] = mix(np.add.reduceat(values, first) + n.astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


class Batch:
    """Texts of one batch: byte buffer, word spans, word hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.cumsum(lengths) - lengths
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.starts, self.ends = spans(self.buf, table)
        self.hashes = hash_spans(self.buf, self.starts, self.ends)
        bounds = np.searchsorted(self.starts, np.append(self.at, len(self.buf)))
        self.first, self.last = bounds[:-1], bounds[1:]


def batches(texts: list[bytes], table: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, Batch]]:
    """Splits texts into runs of at most about `limit` bytes, one text at least."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j]) + 1
            j += 1
        yield i, j, Batch(texts[i:j], table)
        i = j


_MUL = U(0xC2B2AE3D27D4EB4F)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (len - n + 1 of them, none if there are fewer words)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U)
    acc = hashes[:m].copy()
    for k in range(1, n):
        acc *= _MUL
        acc += hashes[k : k + m]
    return mix(acc + U(n))


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole sequence."""
    n = len(hashes)
    if not n:
        return 0
    weights = _powers_to(n)[:n] if n <= 1 << 20 else np.cumprod(np.full(n, _BASE, U), dtype=U)
    return int(mix(np.array([np.sum(hashes * weights, dtype=U) + U(n)], U))[0])


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]
