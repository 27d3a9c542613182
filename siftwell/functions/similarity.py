"""Similarities: factories of score Columns over tf, dl and the statistics of a term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte4(length: Column) -> Column:
    """Lengths as a byte that holds a float of four bits keeps them: exact below 24 + 16, then only the four highest bits of length - 24 count."""
    rest = length - 24
    shift = F.greatest(F.floor(F.log2(F.greatest(rest, F.lit(1)))).cast("int") - 3, F.lit(0))
    unit = F.pow(F.lit(2), shift).cast("long")
    return F.when(rest < 0, length).otherwise(24 + F.floor(rest / unit) * unit)


class Similarity:
    """Anything with idf(df, docs) and score(tf, dl, weight, avgdl), all Columns."""

    def smoothing(self, dl: Column, weight: Column, avgdl: Column) -> Column:
        """The score of a document that lacks the term."""
        return self.score(F.lit(0), dl, weight, avgdl)

    def idf_sum(self, pairs: list[tuple[Column, Column]]) -> Column:
        """The idf of several terms that count as one: the sum over (df, docs)."""
        return sum((self.idf(df, docs) for df, docs in pairs[1:]), self.idf(*pairs[0]))

    def idf(self, df: Column, docs: Column) -> Column:
        raise NotImplementedError

    def score(self, tf: Column, dl: Column, weight: Column, avgdl: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class BM25(Similarity):
    """weight - weight / (1 + tf * inv), inv = 1 / (k1 ((1 - b) + b dl / avgdl)), weight = boost * idf.

    norms: exact lengths; byte: lengths modulo 256, as an index of that width has them; byte4: lengths of four significant bits."""

    k1: float = 1.2
    b: float = 0.75
    norms: str = "exact"

    def __post_init__(self) -> None:
        if not (self.k1 >= 0 and self.k1 < float("inf")):
            raise ValueError("k1 must be a finite number of at least 0")
        if not 0 <= self.b <= 1:
            raise ValueError("b must be between 0 and 1")
        if self.norms not in ("exact", "byte", "byte4"):
            raise ValueError("norms are exact, byte or byte4")

    def idf(self, df: Column, docs: Column) -> Column:
        return F.log(1 + (docs - df + 0.5) / (df + 0.5))

    def inverse(self, dl: Column, avgdl: Column) -> Column:
        dl = dl.bitwiseAND(255) if self.norms == "byte" else byte4(dl) if self.norms == "byte4" else dl
        return 1 / (F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * dl / avgdl))

    def score(self, tf: Column, dl: Column, weight: Column, avgdl: Column) -> Column:
        return weight - weight / (1 + tf * self.inverse(dl, avgdl))
