"""JSON lines: one record a line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respanel.functions.coerce import build_records
from respanel.operators.store import stored
from respanel.schema import PASSTHROUGH, REQUIRED, RecordError
from respanel.sources.registry import Reader, register


#: Blocks whose counts are broadcast at once; beyond it lines meet them by a shuffle.
FEW_BLOCKS = 100_000


def numbered_lines(spark: SparkSession, path: str, blocks: bool = False, **options) -> DataFrame:
    """value, _source, _line (from 1, blank lines counted), _seq over all lines in file order; with ``blocks``, __at, where the line's block begins.

    Spark's readers cut files at line ends and number nothing. Lines of a
    block come in order from one task, so a line's place is its id less the
    least id of its block, plus the lines of the blocks before. Only the
    counts of the blocks are ever sorted, one row a block; the texts stay
    where they are read.
    """
    rows = spark.read.options(**options).text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("_source"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    counts = stored(rows.groupBy("_source", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")), "blocks")
    before = Window.partitionBy("_source").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__line", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    files = counts.groupBy("_source").agg(F.sum("__n").alias("__all"))
    ahead = Window.orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_source", F.coalesce(F.sum("__all").over(ahead), F.lit(0)).alias("__start"))
    placed = placed.join(starts, "_source").select("_source", "__at", "__first", "__line", "__start")
    if counts.count() <= FEW_BLOCKS:
        placed = F.broadcast(placed)
    line = F.col("__line") + F.col("__id") - F.col("__first")
    return rows.join(placed, ["_source", "__at"]).select("value", "_source", (line + 1).alias("_line"), (F.col("__start") + line).alias("_seq"), *(["__at"] if blocks else []))


def parsed_objects(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``v``, the variant of each non-blank line; a line that is no JSON object raises with its place."""
    rows = lines.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    if strict:
        bad = rows.filter(F.col("v").isNull() | ~kind.startswith("OBJECT")).orderBy("_source", "_line").select("_source", "_line").limit(1).collect()
        if bad:
            raise RecordError("no JSON object", *bad[0])
    return rows


def field(name: str, kind: str = "string"):
    return F.try_variant_get("v", f"$.{name}", kind)


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; keys beyond the known ones are kept as text in ``extra``."""
    rows = parsed_objects(numbered_lines(spark, path), strict)
    known = [*REQUIRED, *PASSTHROUGH]
    whole = F.from_json("value", "map<string,string>")
    extra = F.map_filter(whole, lambda k, v: ~k.isin(*known) & v.isNotNull())
    out = rows.select(
        *[field(n).alias(n) for n in ("model_id", "item_id", "correct", "subject", "split", "prompt_variant")],
        field("raw_score", "double").alias("raw_score"),
        extra.alias("extra"),
        "_source",
        "_line",
        "_seq",
    )
    return build_records(out, strict)


def sniff(path: str, head: bytes) -> bool:
    """A first non-blank line that is an object with model_id and item_id; a cut-off line passes."""
    for line in head.decode("utf-8", "replace").splitlines():
        if not line.strip():
            continue
        if not line.lstrip().startswith("{"):
            return False
        try:
            return {"model_id", "item_id"} <= set(json.loads(line))
        except ValueError:
            return '"item_id"' in line and '"model_id"' in line
    return False


register(Reader("jsonl", (".jsonl", ".ndjson"), sniff, read_jsonl, "one JSON record a line"))
