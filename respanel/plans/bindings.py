"""Response matrices made from the driver tables, exact in any engine.

natural: suppliers' nations as models, two line states as prompt variants,
brand and type of the part as items; pure noise. planted: all suppliers and
all parts, with known abilities, slopes and difficulties and arithmetic noise,
a cell for each pair that a line joins. events: users on (event type, hour) cells, repeated answers kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respanel.functions.irt import probability
from respanel.operators.matrix import ResponseMatrix
from respanel.operators.store import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def respondent_truth(j: Column) -> Column:
    return F.lit(-2.0) + F.lit(4.0) * ((j * 7919) % 1009) / 1008.0


def item_truth(i: Column) -> tuple[Column, Column]:
    """(a, b): a twentieth of the slopes points the wrong way, a seventh is almost flat."""
    slope = F.when(i % 20 == 0, F.lit(-1.2)).when(i % 7 == 0, F.lit(0.05)).otherwise(0.5 + 1.5 * ((i * 3571) % 997) / 996.0)
    return slope, F.lit(-2.0) + F.lit(4.0) * ((i * 6007) % 2003) / 2002.0


def planted_cells(spark: SparkSession, sf_dir: str, fresh: bool = False) -> DataFrame:
    """j, i, th, a, b, correct: every supplier answers the parts it delivered, so rows are as ragged as the table. ``fresh``: a second draw of the answers."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("j"), F.col("l_partkey").alias("i")).distinct()
    j, i = F.col("j"), F.col("i")
    a, b = item_truth(i)
    first, second, third = (7919, 611953, 32452843) if fresh else (104729, 1299709, 15485863)
    # the remainder is taken before the third factor too: the whole product leaves 64 bits at some 10^12 pairs of keys
    noise = ((j * first + i * second + ((j * i) % 10000019 * third) % 10000019) % 10007) / F.lit(10007.0)
    known = cells.select("j", "i", respondent_truth(j).alias("th"), a.alias("a"), b.alias("b"), noise.alias("u"))
    hit = F.col("u") < probability(F.col("a"), F.col("b"), F.col("th"))
    return known.select("j", "i", "th", "a", "b", hit.cast("int").alias("correct"))


def planted(spark: SparkSession, sf_dir: str) -> ResponseMatrix:
    """Indices are the keys themselves, r = supplier and c = part, so that encoding is order by id. The cells are written once."""
    cells = stored(planted_cells(spark, sf_dir).select(F.col("j").alias("r"), F.col("i").alias("c"), F.col("correct").alias("obs")), "planted")
    respondents = cells.select("r").distinct()
    respondents = respondents.select("r", F.concat(F.lit("m"), F.col("r").cast("string")).alias("respondent_id")).withColumn("model_id", F.col("respondent_id"))
    items = cells.select("c").distinct()
    subject = F.concat(F.lit("s"), (F.col("c") % 7).cast("string"))
    items = items.select("c", F.concat(F.lit("i"), F.col("c").cast("string")).alias("item_id"), subject.alias("subject"), F.lit(None).cast("string").alias("split"))
    return ResponseMatrix(respondents, items, cells)


def planted_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items c, a, b; respondents r, theta) that generated the responses."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = item_truth(F.col("c"))
    items = lines.select(F.col("l_partkey").alias("c")).distinct().select("c", a.alias("a"), b.alias("b"))
    return items, lines.select(F.col("l_suppkey").alias("r")).distinct().select("r", respondent_truth(F.col("r")).alias("theta"))


def natural_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, prompt_variant, item_id, subject, correct; the first line of each cell."""
    lines, part, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = joined.select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("model_id"),
        F.col("l_linestatus").alias("prompt_variant"),
        F.concat("p_brand", F.lit("_"), "p_type").alias("item_id"),
        F.col("p_brand").alias("subject"),
        (F.col("l_quantity") >= 25).cast("int").alias("correct"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"),
    )
    # the least line of a cell by aggregation: one row a cell and task is shuffled
    cells = rows.groupBy("model_id", "prompt_variant", "item_id", "subject").agg(F.min_by("correct", "at").alias("correct"))
    return cells


def natural(spark: SparkSession, sf_dir: str) -> ResponseMatrix:
    from respanel.operators.matrix import build_matrix

    return build_matrix(natural_records(spark, sf_dir), ("model_id", "prompt_variant"), order=None, check=False)


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """respondent_id (user), item_id (type and hour), event_id, correct."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("respondent_id"),
        F.concat("event_type", F.lit("_"), F.hour("ts").cast("string")).alias("item_id"),
        "event_id",
        (F.col("value") >= 10).cast("int").alias("correct"),
        "event_type",
        "props",
    )
