"""Quality by regularised quadratic discriminant analysis.

Statistics of a document's whole text are transformed (logarithms of counts, logits of shares), standardised, and modelled by one
Gaussian per class. Class covariances are shrunk towards the pooled one and its diagonal; their Cholesky factors are computed once
and shipped, so that a score is a difference of two Mahalanobis log-densities plus the class priors, squashed into 0 to 1.

Labels are read only for rows outside the held-out fold, from at most `sample_rows` of them. Null and empty texts have statistics
too (all counts zero) and so a score; with fewer than two labelled rows of each class every score is the share of label 1 (0.5
without labels); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as W
from siftwell.llm.toxicity import held_out, sample

FOLDS, FOLD = 3, 1
LETTER, UPPER, DIGIT, SPACE, POINT, SYMBOL, PIPE, NEWLINE, HIGH = range(9)
CLASS = np.full(256, SYMBOL, np.int64)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A], CLASS[0x80:] = LETTER, UPPER, DIGIT, HIGH
CLASS[list(b" \t\r\x0b\x0c")], CLASS[list(b".,;:!?'\"()-")], CLASS[ord("|")], CLASS[ord("\n")] = SPACE, POINT, PIPE, NEWLINE
N = 16


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics for each text."""
    out = np.zeros((len(texts), N))
    for i, j, b in W.batches(texts, W.NON_SPACE):
        kinds, lengths = CLASS[b.buf], np.diff(np.append(b.at, len(b.buf)))
        owner = np.repeat(np.arange(j - i), lengths)
        counts = np.bincount(owner * 9 + kinds, minlength=9 * (j - i)).reshape(-1, 9).astype(float)
        counts[:, NEWLINE] -= 1  # the separator
        word_bytes = (b.ends - b.starts).astype(float)
        for k in range(j - i):
            a, z = b.first[k], b.last[k]
            n, size = z - a, float(lengths[k] - 1)
            wl, h = word_bytes[a:z], b.hashes[a:z]
            _, reps = np.unique(h, return_counts=True)
            share = lambda x, of=size: np.log((x + 0.5) / (max(of - x, 0) + 0.5))
            two = W.windows(h, 2)
            lines = counts[k, NEWLINE] + 1
            out[i + k] = [
                np.log1p(size), np.log1p(n), np.log1p(wl.mean() if n else 0), np.log1p(wl.std() if n else 0),
                share(counts[k, UPPER]), share(counts[k, DIGIT]), share(counts[k, POINT]), share(counts[k, SYMBOL]),
                share(counts[k, PIPE]), share(counts[k, HIGH]), share(lines - 1, max(n, 1)), np.log1p(n / lines),
                share(len(reps), n), np.log1p(reps.max() if n else 0) - np.log1p(n), share(len(np.unique(two)), max(len(two), 1)),
                share(float((wl <= 3).sum()), n),
            ]
    return out


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, feature
    factors: np.ndarray  # inverse Cholesky factors
    constants: np.ndarray  # log prior - half log determinant
    flat: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        x = np.clip((x - self.centre) / self.scale, -6, 6)
        logs = [self.constants[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))


def train(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, diagonal: float = 0.1) -> Model:
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(*[np.empty(0)] * 5, flat=float(y.mean()) if len(y) else 0.5)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - centre) / scale, -6, 6)
    parts = [z[y == c] for c in (0, 1)]
    pooled = sum(len(p) * np.cov(p, rowvar=False, bias=True) for p in parts) / len(z)
    means, factors, constants = [], [], []
    for p in parts:
        own = shrink + (1 - shrink) * N / (N + len(p))  # small classes lean on the pooled covariance
        cov = (1 - own) * np.cov(p, rowvar=False, bias=True) + own * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(pooled)) + 1e-3 * np.eye(N)
        low = np.linalg.cholesky(cov)
        means.append(p.mean(0))
        factors.append(np.linalg.inv(low))
        constants.append(np.log(len(p) / len(z)) - np.log(np.diag(low)).sum())
    return Model(centre, scale, np.array(means), np.array(factors), np.array(constants))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = statistics(W.utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    got = sample(docs, labels, "quality", ~held_out(folds=FOLDS, fold=FOLD), sample_rows).mapInArrow(run, "label int, x array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return train(np.array([r[1] for r in got]).reshape(-1, N), np.array([r[0] for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(statistics(W.utf8(part.column(1)))), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """Returns doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels, sample_rows)).select("doc_id", held_out(folds=FOLDS, fold=FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
