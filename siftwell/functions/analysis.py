"""Analysis: text columns to arrays of tokens, as Column expressions that stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from siftwell.functions import batches

SPACE = r"(?U)\s"
cloudpickle.register_pickle_by_value(batches)  # so that workers need no copy of this package


def load_words(spark: SparkSession, path: str) -> frozenset[str]:
    """A word list, one word a line, trimmed; blank lines don't count."""
    return frozenset(w for (w,) in spark.read.text(path).select(F.trim("value")).collect() if w)


@dataclass(frozen=True)
class Analyzer:
    """Splits at every Unicode space, lower-cases, and drops stop words while keeping their positions.

    keep_empty keeps the empty tokens between consecutive spaces; separator is a regular expression for other tokenizers;
    char_filters are applied to the text first; filters map a token Column to a token Column; tokens longer than max_length go;
    synonyms (term, other terms) put further tokens on the position of a term."""

    lowercase: bool = True
    stop: frozenset[str] = frozenset()
    keep_empty: bool = False
    separator: str = SPACE
    max_length: int | None = None
    char_filters: tuple[Callable[[Column], Column], ...] = ()
    filters: tuple[Callable[[Column], Column], ...] = field(default=())
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def raw(self, text: Column) -> Column:
        for f in self.char_filters:
            text = f(text)
        return F.split(text, self.separator, -1)

    def terms(self, text: Column) -> Column:
        """array<string>, without positions: the cheap form when nothing asks for them."""
        terms = F.transform(self.raw(text), self.normal)
        if not self.keep_empty:
            terms = F.filter(terms, lambda t: t != "")
        terms = F.filter(terms, self.wanted) if self.stop or self.max_length else terms
        return F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), self.also(t)))) if self.synonyms else terms

    def also(self, term: Column) -> Column:
        """The terms that share a term's position."""
        other = F.array().cast("array<string>")
        for word, more in self.synonyms:
            other = F.when(term == word, F.array(*map(F.lit, more))).otherwise(other)
        return other

    def normal(self, term: Column) -> Column:
        term = F.lower(term) if self.lowercase else term
        for f in self.filters:
            term = f(term)
        return term

    def wanted(self, term: Column) -> Column:
        ok = F.lit(True)
        if self.stop:
            ok = ok & ~term.isin(*sorted(self.stop))
        if self.max_length:
            ok = ok & (F.length(term) <= self.max_length)
        return ok


STANDARD = Analyzer()
WHITESPACE = Analyzer(lowercase=False)


def stop_analyzer(words: Iterable[str]) -> Analyzer:
    return Analyzer(stop=frozenset(words))


#: A tokenizer of runs of ASCII letters, by the class of characters that part tokens.
LETTERS = Analyzer(separator="[^A-Za-z]+")


@F.pandas_udf(ArrayType(IntegerType()))
def _before(sizes: pd.Series) -> pd.Series:
    return sizes.map(lambda x: np.cumsum(x, dtype=np.int32) - x)


# declared so that the planner leaves the call in a projection of its own, and makes it once
_sums_before = _before.asNondeterministic()


def with_tokens(df: DataFrame, text_col: str, analyzer: Analyzer = STANDARD, gap: int = 0, offsets: bool = True, name: str = "__tokens") -> DataFrame:
    """Adds array<struct<term,pos,start,end>>, made inside each row: no shuffle.

    pos counts tokens before stop words go; start and end (null without offsets) are code points of the text. The values of an array
    column follow one another, gap positions and one code point apart. Only the running sum of piece lengths leaves the JVM."""
    values = F.col(text_col) if df.schema[text_col].dataType.typeName() == "array" else F.array(text_col)
    values = F.filter(values, lambda v: v.isNotNull()).cast("array<string>")
    pieces = F.flatten(F.transform(values, lambda v, k: F.transform(analyzer.raw(v), lambda t: F.struct(t.alias("raw"), k.alias("value")))))
    out = df.withColumn("__pieces", pieces)
    if offsets:
        out = out.withColumn("__starts", _sums_before(F.transform("__pieces", lambda p: F.length(p["raw"]) + 1)))
        placed = F.zip_with("__pieces", "__starts", lambda p, s: F.struct(p["raw"].alias("raw"), p["value"].alias("value"), s.alias("start")))
    else:
        placed = F.transform("__pieces", lambda p: F.struct(p["raw"].alias("raw"), p["value"].alias("value"), F.lit(None).cast("int").alias("start")))
    if not analyzer.keep_empty:
        placed = F.filter(placed, lambda p: p["raw"] != "")
    tokens = F.transform(placed, lambda p, i: F.struct(
        analyzer.normal(p["raw"]).alias("term"), (i + p["value"] * gap).cast("int").alias("pos"), p["start"].alias("start"), (p["start"] + F.length(p["raw"])).alias("end")))
    tokens = F.filter(tokens, lambda t: analyzer.wanted(t["term"])) if analyzer.stop or analyzer.max_length else tokens
    if analyzer.synonyms:
        tokens = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.transform(analyzer.also(t["term"]), lambda x: F.struct(x.alias("term"), t["pos"].alias("pos"), t["start"].alias("start"), t["end"].alias("end"))))))
    return out.withColumn(name, tokens).drop("__pieces", "__starts")


def quick(df: DataFrame, text_col: str, analyzer: Analyzer, gap: int = 0) -> bool:
    """Whether `batches` can do an analyzer's work: one that splits at spaces and has no filters of tokens."""
    gapped = gap and df.schema[text_col].dataType.typeName() == "array"
    return analyzer.separator == SPACE and not analyzer.keep_empty and not analyzer.filters and not gapped


def in_batches(df: DataFrame, id_col: str, text_col: str, analyzer: Analyzer, work: Callable, schema: str, **options) -> DataFrame:
    """id and the columns of schema, a row per token or posting, by whole batches of texts."""
    plan = batches.Plan(tuple(sorted(analyzer.stop)), analyzer.max_length, tuple((w, tuple(more)) for w, more in analyzer.synonyms), **options)
    values = F.col(text_col) if df.schema[text_col].dataType.typeName() == "array" else F.array(text_col)
    values = F.filter(values, lambda v: v.isNotNull()).cast("array<string>")

    def filtered(text: Column) -> Column:
        for f in analyzer.char_filters:
            text = f(text)
        return text

    values = F.transform(values, filtered) if analyzer.char_filters else values
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.array_join(values, " "), F.lit("")).alias("raw"))
    if not analyzer.lowercase:
        rows = rows.select("id", F.col("raw").alias("text"))
    elif plan.offsets:  # of the text as it was, which differs from its lower case in code points where a letter becomes two
        rows = rows.select("id", F.lower("raw").alias("text"), "raw")
        rows = rows.select("id", "text", F.when(F.length("text") != F.length("raw"), F.col("raw")).alias("raw"))
    else:
        rows = rows.select("id", F.lower("raw").alias("text"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(found, plan)

    types = StructType([df.select(F.col(id_col).alias("id")).schema["id"], *StructType.fromDDL(schema)])
    return rows.mapInArrow(run, types).withColumnRenamed("id", id_col)


TOKENS = "term string, pos int, start int, end int, pos_inc int"


def token_table(df: DataFrame, id_col: str, text_col: str, analyzer: Analyzer = STANDARD, gap: int = 0, offsets: bool = True) -> DataFrame:
    """One row per token: id, term, pos, start, end; see with_tokens."""
    if quick(df, text_col, analyzer, gap):
        return in_batches(df, id_col, text_col, analyzer, batches.token_batches, TOKENS, offsets=offsets).drop("pos_inc")
    return with_tokens(df.select(id_col, text_col), text_col, analyzer, gap, offsets).select(id_col, F.inline("__tokens"))


def attributes(df: DataFrame, id_col: str, text_col: str, analyzer: Analyzer = STANDARD, gap: int = 0) -> DataFrame:
    """token_table with the other attributes of a token: pos_inc (to the token before), pos_length, type, payload, term_freq."""
    if quick(df, text_col, analyzer, gap):
        rest = {"pos_length": F.lit(1), "type": F.lit("word"), "payload": F.lit(None).cast("binary"), "term_freq": F.lit(1)}
        return in_batches(df, id_col, text_col, analyzer, batches.token_batches, TOKENS, offsets=True).withColumns(rest)
    tokens = with_tokens(df.select(id_col, text_col), text_col, analyzer, gap).withColumn("__before", F.concat(F.array(F.lit(-1)), F.col("__tokens.pos")))
    rows = F.transform("__tokens", lambda t, i: F.struct(
        t["term"].alias("term"), t["pos"].alias("pos"), t["start"].alias("start"), t["end"].alias("end"), (t["pos"] - F.get("__before", i)).alias("pos_inc"), F.lit(1).alias("pos_length"),
        F.lit("word").alias("type"), F.lit(None).cast("binary").alias("payload"), F.lit(1).alias("term_freq")))
    return tokens.select(id_col, F.inline(rows))
