"""The inverted index as tables: docs, postings, field statistics, term statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from siftwell.functions import batches
from siftwell.functions.analysis import STANDARD, Analyzer, in_batches, quick, with_tokens


@dataclass(frozen=True)
class Text:
    """An analysed field. A column of arrays counts as repeated values, their tokens one after the other.

    Lengths count tokens, those that share a position once (discount_overlaps); with docs_only a term counts once and lengths
    count distinct terms. max_term_bytes bounds terms: `problems` names those beyond it and a store refuses them."""

    analyzer: Analyzer = STANDARD
    positions: bool = False
    offsets: bool = False
    gap: int = 0
    docs_only: bool = False
    discount_overlaps: bool = True
    max_term_bytes: int | None = None


@dataclass(frozen=True)
class Keyword:
    """One un-analysed term per value, without length norms."""


FieldConfig = Text | Keyword


@dataclass
class Index:
    """docs has doc_id and the stored columns; live is the docs that deletes have left (statistics ignore deletes).

    all_docs are the docs with deleted ones; points, if any, the point columns clustered for box queries. With repeated, several
    rows of docs may stand for one document, which still matches once."""

    docs: DataFrame
    postings: DataFrame  # field, term, doc_id, tf, dl[, positions, starts, ends]
    field_stats: DataFrame  # field, doc_count, sum_ttf, sum_df
    term_stats: DataFrame  # field, term, df, ttf
    tombstones: DataFrame | None = None
    fields: dict[str, FieldConfig] = field(default_factory=dict)
    all_docs: DataFrame | None = None
    points: DataFrame | None = None
    repeated: bool = False
    impacts: DataFrame | None = None

    @property
    def live(self) -> DataFrame:
        return self.docs if self.tombstones is None else self.docs.join(self.tombstones.select("doc_id").distinct(), "doc_id", "left_anti")


def _part(n: int):
    """A function of the columns places and spans."""

    def run(places: pa.Array, spans: pa.Array) -> pa.Array:
        return batches.lists(places, spans)[n]

    return F.arrow_udf(run, ArrayType(IntegerType()))


def unpacked(postings: DataFrame) -> DataFrame:
    """Packed postings with their lists, which are made of those rows only whose lists a query asks for."""
    if "places" not in postings.columns:
        return postings
    return postings.withColumns({c: _part(n)("places", "spans") for n, c in enumerate(LISTS)}).drop("places", "spans")


LISTS = ("positions", "starts", "ends")
PACKED = {"places": "binary", "spans": "binary", "problem": "string"}


def postings_of(docs: DataFrame, fields: dict[str, FieldConfig], packed: bool = False) -> DataFrame:
    """Inverts every field, counting inside each row: no shuffle where `batches` can do the analysis. Terms of any length are kept.

    packed: positions and offsets as bytes, beside the name of what is wrong with them; `unpacked` gives the lists."""
    out = None
    kinds = PACKED if packed else dict.fromkeys(LISTS, "array<int>")
    none = {c: F.lit(None).cast(kind) for c, kind in kinds.items()}
    for name, config in fields.items():
        kind = docs.schema[name].dataType.typeName()
        values = F.col(name) if kind == "array" else F.array(F.col(name))
        values = F.filter(values, lambda v: v.isNotNull())
        if isinstance(config, Keyword):
            part = docs.select(F.lit(name).alias("field"), F.explode(F.array_distinct(values).cast("array<string>")).alias("term"), "doc_id").withColumns({"tf": F.lit(1), "dl": F.lit(1)})
            part = part.withColumns(none)
        elif quick(docs, name, config.analyzer, config.gap):
            placed = bool(config.positions or config.offsets or config.analyzer.synonyms)
            lists = "".join(f", {c} {kind}" for c, kind in kinds.items()) if placed else ""
            part = in_batches(docs, "doc_id", name, config.analyzer, batches.posting_batches, f"term string, tf int, dl int{lists}",
                              positions=placed, packed=packed, offsets=config.offsets, docs_only=config.docs_only, discount_overlaps=config.discount_overlaps)
            part = (part if placed else part.withColumns(none)).select(F.lit(name).alias("field"), "term", "doc_id", "tf", "dl", *kinds)
        elif config.positions or config.offsets or config.analyzer.synonyms:
            rows = with_tokens(docs.select("doc_id", name), name, config.analyzer, config.gap, config.offsets)
            lengths = F.size(F.array_distinct("__tokens.term")) if config.docs_only else F.size(F.array_distinct("__tokens.pos")) if config.discount_overlaps else F.size("__tokens")
            # in two steps: beside the generator the length would be taken anew for every token
            rows = rows.select("doc_id", lengths.alias("dl"), "__tokens").select("doc_id", "dl", F.inline("__tokens"))
            part = rows.groupBy("doc_id", "term", "dl").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list(F.struct("pos", "start", "end"))).alias("p"))
            part = part.select(F.lit(name).alias("field"), "term", "doc_id", F.lit(1).alias("tf") if config.docs_only else "tf", "dl", F.col("p.pos").alias("positions"), F.col("p.start").alias("starts"), F.col("p.end").alias("ends"))
            if packed:
                rows = part
                part = rows.mapInArrow(batches.packed_batches, StructType([*(f for f in rows.schema if f.name not in LISTS), *StructType.fromDDL(", ".join(map(" ".join, PACKED.items())))]))
        else:
            terms = F.flatten(F.transform(values.cast("array<string>"), config.analyzer.terms))
            terms = F.array_distinct(terms) if config.docs_only else terms
            part = docs.select("doc_id", terms.alias("t")).select("doc_id", F.size("t").alias("dl"), "t").select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").cast("int").alias("tf"))
            part = part.select(F.lit(name).alias("field"), "term", "doc_id", "tf", "dl")
            part = part.withColumns(none)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fields")
    return out


def problems(postings: DataFrame, fields: dict[str, FieldConfig]) -> DataFrame:
    """(field, doc_id, problem): terms longer than their field allows, positions out of bounds or falling, offsets that end before they start."""
    term_bytes = F.lit(None).cast("int")
    for name, config in fields.items():
        if isinstance(config, Text) and config.max_term_bytes is not None:
            term_bytes = F.when(F.col("field") == name, F.lit(config.max_term_bytes)).otherwise(term_bytes)
    immense = postings.where(F.coalesce(F.octet_length("term") > term_bytes, F.lit(False))).select("field", "doc_id", F.lit("immense term").alias("problem"))
    if "problem" in postings.columns:  # packed ones carry it
        return immense.unionByName(postings.where(F.col("problem").isNotNull()).select("field", "doc_id", "problem"))
    fallen = F.exists(F.zip_with(F.slice("positions", 1, F.size("positions") - 1), F.slice("positions", 2, F.size("positions")), lambda a, b: b < a), lambda x: x)
    tests = {
        "position": (F.element_at("positions", 1) < 0) | (F.element_at("positions", -1) > batches.MAX_POSITION) | F.when(F.size("positions") > 1, fallen),
        "offset": F.exists(F.arrays_zip("starts", "ends"), lambda x: (x["ends"] < x["starts"]) | (x["starts"] < 0)),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))
    return immense.unionByName(postings.select("field", "doc_id", F.explode(found).alias("problem")))


BLOCK = 128


def impacts(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(field, term, block, tf, dl): per block of doc_ids the competitive pairs, those that no other pair of the block beats in both count and length."""
    return competitive(postings.select("field", "term", F.floor(F.col("doc_id") / block).alias("block"), "tf", "dl"))


def impacts_in_order(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """impacts of written postings that are sorted by (field, term, doc_id), without a shuffle: with edge, for rows of groups that
    another split of the files may share. `competitive` of the edges of all tasks gives what is missing."""
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("split")
    rows = postings.select("field", "term", F.floor(F.col("doc_id") / block).alias("block"), "tf", "dl", split)
    return rows.mapInArrow(batches.impact_batches, "field string, term string, block long, tf int, dl int, edge boolean")


def competitive(pairs: DataFrame) -> DataFrame:
    """Of rows (field, term, block, tf, dl) those that no other one of their group beats."""
    best = pairs.groupBy("field", "term", "block", "tf").agg(F.min("dl").alias("dl"))
    pairs = best.groupBy("field", "term", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("tf")).alias("minus"), F.col("dl")))).alias("pairs"))
    kept = F.filter("pairs", lambda p, i: F.coalesce(p["dl"] < F.array_min(F.transform(F.slice("pairs", F.lit(1), i), lambda q: q["dl"])), F.lit(True)))
    return pairs.select("field", "term", "block", F.explode(kept).alias("p")).select("field", "term", "block", (-F.col("p.minus")).alias("tf"), F.col("p.dl").alias("dl"))


def statistics(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of fields, of terms)."""
    terms = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
    fields = postings.groupBy("field", "doc_id").agg(F.sum("tf").alias("n"), F.count("*").alias("terms")).groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("n").alias("sum_ttf"), F.sum("terms").alias("sum_df"))
    return fields, terms


def build(docs: DataFrame, fields: dict[str, FieldConfig], id_col: str = "doc_id") -> Index:
    """An index over a DataFrame, lazily; nothing is written. Rows need distinct ids."""
    docs = docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs
    postings = postings_of(docs, fields)
    by_field, by_term = statistics(postings)
    return Index(docs, postings, by_field, by_term, None, dict(fields))
