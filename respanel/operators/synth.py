"""Synthetic responses with known truth, as DataFrames drawn by hash: any size, same seed, same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respanel.operators.matrix import ResponseMatrix

# The generating distribution.
VARIANT_SPREAD, SLOPE_LOG_MEAN, SLOPE_LOG_SD = 0.15, math.log(1.05), 0.42
DEAD_SHARE, DEAD_RANGE, INVERTED_RANGE = 0.15, (0.02, 0.22), (0.8, 2.2)
B_SD, OFF_SHARE, OFF_CENTRE, OFF_SD = 1.05, 0.08, 4.2, 0.35


def uniform(seed: int, salt: str, *keys: str) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(k) for k in keys]), F.lit(2**40)).cast("double") + 0.5) / float(2**40)


def normal(seed: int, salt: str, *keys: str) -> Column:
    radius = F.sqrt(-2 * F.ln(uniform(seed, salt + "r", *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, salt + "a", *keys))


def truth(spark: SparkSession, models: int, items: int, variants: int = 1, seed: int = 0, inverted: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(items c, a, b; respondents r, respondent_id, model_id, theta)."""
    u = uniform(seed, "kind", "c")
    slope = (
        F.when(u < DEAD_SHARE, DEAD_RANGE[0] + (DEAD_RANGE[1] - DEAD_RANGE[0]) * uniform(seed, "dead", "c"))
        .when(u < DEAD_SHARE + inverted, -(INVERTED_RANGE[0] + (INVERTED_RANGE[1] - INVERTED_RANGE[0]) * uniform(seed, "inv", "c")))
        .otherwise(F.exp(SLOPE_LOG_MEAN + SLOPE_LOG_SD * normal(seed, "a", "c")))
    )
    side = F.when(uniform(seed, "side", "c") < 0.5, -1.0).otherwise(1.0)
    place = F.when(uniform(seed, "off", "c") < OFF_SHARE, side * OFF_CENTRE + OFF_SD * normal(seed, "offb", "c")).otherwise(B_SD * normal(seed, "b", "c"))
    own = spark.range(items).select(F.col("id").alias("c")).select("c", slope.alias("a"), place.alias("b"))
    people = spark.range(models * variants).select(F.col("id").alias("r"), F.floor(F.col("id") / variants).alias("m"), (F.col("id") % variants).alias("v"))
    jitter = F.when(F.col("v") > 0, VARIANT_SPREAD * normal(seed, "v", "r")).otherwise(0.0)
    name = F.concat(F.lit("model-"), F.col("m").cast("string"))
    people = people.select(
        "r", F.concat(name, F.lit("|v"), F.col("v").cast("string")).alias("respondent_id"), name.alias("model_id"), (normal(seed, "theta", "m") + jitter).alias("theta")
    )
    return own, people


def responses(items: DataFrame, people: DataFrame, seed: int = 0, missing: float = 0.0) -> DataFrame:
    """(r, c, obs): one draw of every cell, a share of the cells left out."""
    p = 1 / (1 + F.exp(-(F.col("a") * (F.col("theta") - F.col("b")))))
    cells = people.select("r", "theta").crossJoin(items.select("c", "a", "b")).filter(uniform(seed, "miss", "r", "c") >= missing)
    return cells.select("r", "c", (uniform(seed + 1, "hit", "r", "c") < p).cast("int").alias("obs"))


def synthetic_matrix(spark: SparkSession, models: int, items: int, variants: int = 1, seed: int = 0, missing: float = 0.0, inverted: float = 0.0) -> tuple[ResponseMatrix, DataFrame, DataFrame]:
    """(matrix, true items, true respondents); subjects are dealt modulo seven."""
    own, people = truth(spark, models, items, variants, seed, inverted)
    text = F.col("c").cast("string")
    named = own.select("c", F.concat(F.lit("item-"), text).alias("item_id"), F.concat(F.lit("subject-"), (F.col("c") % 7).cast("string")).alias("subject"), F.lit(None).cast("string").alias("split"))
    key = ("model_id", "prompt_variant") if variants > 1 else ("model_id",)
    return ResponseMatrix(people.select("r", "respondent_id", "model_id"), named, responses(own, people, seed, missing), key), own, people


def records_of(m: ResponseMatrix) -> DataFrame:
    """Records that assemble to the matrix."""
    rows = m.responses.join(m.respondents, "r").join(m.items, "c")
    return rows.select("model_id", "item_id", F.col("obs").alias("correct"), "subject", F.regexp_extract("respondent_id", r"\|(.*)$", 1).alias("prompt_variant"))


def fabricated_fit(items: DataFrame, people: DataFrame, n_per_item: int, precision: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Posteriors around a truth without fitting: widths shrink with answers and precision, means are off by one draw of it."""
    from respanel.functions.irt import probability
    from respanel.operators.fit import interval, item_flags

    width = lambda base: min(max(base / math.sqrt(n_per_item) / precision, 0.01), 5.0)
    sa, sb, st = width(0.95), width(1.3), min(max(0.9 / math.sqrt(max(items.count(), 1)), 0.01), 5.0)
    abilities = people.select("r", "respondent_id", "model_id", (F.col("theta") + st * normal(seed, "ft", "r")).alias("theta"))
    p = F.avg(probability(F.col("a"), F.col("b"), F.col("theta")))
    rates = items.crossJoin(people.select("theta")).groupBy("c").agg(p.alias("p_correct"))
    own = items.join(rates, "c").select("c", (F.col("a") + sa * normal(seed, "fa", "c")).alias("a"), (F.col("b") + sb * normal(seed, "fb", "c")).alias("b"), F.lit(n_per_item).cast("long").alias("n_resp"), "p_correct")
    own = own.select("*", *interval(F.col("a"), F.lit(sa), "a"), *interval(F.col("b"), F.lit(sb), "b"))
    return item_flags(own, abilities), abilities
