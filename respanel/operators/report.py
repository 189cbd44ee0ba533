"""Report aggregates: header, refusal, item rows, information curve, model positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respanel.functions.irt import information
from respanel.operators import fit, select, smooth
from respanel.schema import (
    ALIGNED,
    CAUTION_SHARE,
    GRID_PAD,
    GRID_POINTS,
    MAX_ABS_B,
    MIN_SPAN,
    PARTIAL,
    REFUSAL_SHARE,
    ReportError,
    THIN_MODELS,
)

SORTS = ("discrimination", "difficulty", "id")


def rows(items: DataFrame, sort: str = "discrimination", limit: int = 0) -> DataFrame:
    """Items in report order with ``position`` and the discrimination rank (null if not rankable); limit 0: all.

    The order takes one sort of the item table.
    """
    if sort not in SORTS:
        raise ReportError(f"unknown sort {sort!r}; choose one of {', '.join(SORTS)}")
    if limit < 0:
        raise ReportError("limit must not be negative")
    marked = items.withColumn("rankable", ~F.array_contains("flags", "insufficient-data")).withColumn("__a", F.round("a", 10)).withColumn("__b", F.round("b", 10))
    orders = {
        "id": ["item_id"],
        "difficulty": [F.asc_nulls_last("__b"), "item_id"],
        "discrimination": [F.desc("rankable"), F.desc("__a"), "item_id"],
    }
    position = F.row_number().over(Window.orderBy(*orders[sort])).cast("long")
    rank = F.row_number().over(Window.partitionBy("rankable").orderBy(F.desc("__a"), "item_id")).cast("long")
    if limit and sort == "discrimination":  # the head by a distributed top-n; ranks of the first rows don't need the others
        marked = marked.orderBy(*orders[sort]).limit(limit)
    out = marked.withColumn("position", position).withColumn("rank", F.when(F.col("rankable"), rank)).drop("__a", "__b")
    return out.filter(F.col("position") <= limit) if limit else out


def header(items: DataFrame, respondents: DataFrame, n_responses: DataFrame) -> DataFrame:
    """One row: counts of models (not respondents first), items, usable and flagged items, density."""
    people = respondents.agg(F.count_distinct("model_id").alias("n_real_models"), F.count("*").alias("n_respondents"))
    flagged = [F.sum(F.array_contains("flags", f).cast("long")).alias("n_" + f.replace("-", "_")) for f in fit.FLAGS]
    counts = items.agg(F.count("*").alias("n_items"), F.sum((~fit.has_flag("insufficient-data", "ceiling", "floor", "inverted")).cast("long")).alias("n_usable"), *flagged)
    out = people.crossJoin(counts).crossJoin(n_responses.agg(F.count("*").alias("n_responses")))
    share = F.coalesce(F.try_divide(F.col("n_insufficient_data").cast("double"), F.col("n_items")), F.lit(0.0))
    density = F.try_divide(F.col("n_responses").cast("double"), F.col("n_respondents") * F.col("n_items"))
    return out.withColumn("insufficient_share", share).withColumn("density", density)


def refusal(head: DataFrame) -> DataFrame:
    """Adds ``level``: refusal from half of the items undetermined, caution from a fifth or under five models."""
    share = F.col("insufficient_share")
    level = F.when(share >= REFUSAL_SHARE, "refusal").when((share >= CAUTION_SHARE) | (F.col("n_real_models") < THIN_MODELS), "caution").otherwise("none")
    return head.withColumn("level", level)


def plot_range(items: DataFrame, abilities: DataFrame) -> DataFrame:
    """(low, high) of the curve: all abilities and the middle 96 % of the pool's difficulties, padded."""
    pool = fit.usable(items).filter("n_resp > 0")
    b = pool.agg(F.percentile("b", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    ends = abilities.agg(F.min("theta").alias("t0"), F.max("theta").alias("t1")).crossJoin(b)
    padded_low = F.greatest(F.col("q")[0] - GRID_PAD, F.lit(-MAX_ABS_B))
    padded_high = F.least(F.col("q")[1] + GRID_PAD, F.lit(MAX_ABS_B))
    low, high = F.least(F.col("t0") - GRID_PAD, padded_low), F.greatest(F.col("t1") + GRID_PAD, padded_high)
    short = F.greatest(F.lit(MIN_SPAN) - (high - low), F.lit(0.0)) / 2
    return ends.select((low - short).alias("low"), (high + short).alias("high"))


def information_curve(items: DataFrame, abilities: DataFrame) -> DataFrame:
    """(g, theta, pool_info, all_info) on a grid of 241 points."""
    spark = items.sparkSession
    grid = spark.range(GRID_POINTS).select(F.col("id").alias("g")).crossJoin(F.broadcast(plot_range(items, abilities)))
    grid = grid.select("g", (F.col("low") + (F.col("high") - F.col("low")) * F.col("g") / float(GRID_POINTS - 1)).alias("theta"))
    in_pool = (~fit.has_flag("insufficient-data", "ceiling", "floor", "inverted") & (F.col("n_resp") > 0)).cast("double")
    both = items.filter("b is not null").select("a", "b", in_pool.alias("in_pool")).crossJoin(F.broadcast(grid))
    info = information(F.col("a"), F.col("b"), F.col("theta"))
    sums = both.groupBy("g").agg(F.sum(info * F.col("in_pool")).alias("pool_info"), F.sum(info).alias("all_info"))
    return grid.join(sums, "g", "left").select("g", "theta", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pool_info", "all_info")])


def model_positions(items: DataFrame, abilities: DataFrame, respondents: DataFrame) -> DataFrame:
    """(model_id, theta, info, se): mean ability of each model and the pool's information there."""
    models = abilities.join(respondents.select("r", "model_id"), "r").groupBy("model_id").agg(F.avg("theta").alias("theta"))
    pool = fit.usable(items).filter("n_resp > 0").select("a", "b")
    info = smooth.summed(pool, models, information).withColumnRenamed("total", "info")
    out = models.join(info, "theta", "left").select("model_id", "theta", F.coalesce("info", F.lit(0.0)).alias("info"))
    return out.withColumn("se", 1 / F.sqrt(1 + F.col("info")))


def rug(curve: DataFrame, points: DataFrame) -> DataFrame:
    """(g, theta, weight, n): respondents and their weight by the nearest place of the curve; those beyond an end count there.

    A drawing has no more marks than the curve has points, however many
    respondents there are. Null abilities have no place.
    """
    ends = curve.agg(F.min("theta").alias("low"), F.max("theta").alias("high"))
    share = F.coalesce(F.try_divide(F.col("theta") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    place = F.least(F.greatest(F.floor(share * (GRID_POINTS - 1) + 0.5), F.lit(0)), F.lit(GRID_POINTS - 1)).cast("long")
    placed = points.filter("theta is not null").select("theta", "weight").crossJoin(F.broadcast(ends)).groupBy(place.alias("g")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    return placed.join(curve.select("g", "theta"), "g").select("g", "theta", "weight", "n")


def spread(points: DataFrame) -> DataFrame:
    """(theta_lo, theta_hi, theta_mean): span and weighted mean of the respondents' abilities, in one row."""
    known = points.filter("theta is not null")
    mean = F.try_divide(F.sum(F.col("theta") * F.col("weight")), F.sum("weight"))
    return known.agg(F.min("theta").alias("theta_lo"), F.max("theta").alias("theta_hi"), mean.alias("theta_mean"))


def verdict(curve: DataFrame, items: DataFrame, points: DataFrame) -> DataFrame:
    """(peak_info, info_at_models, coverage, verdict): the pool's information where the models are, as a share of its peak."""
    peak = curve.agg(F.max("pool_info").alias("peak_info"))
    pool = fit.usable(items).filter("n_resp > 0").select("a", "b")
    at = select.at_nodes(pool, points).agg(F.sum(F.col("weight") * information(F.col("a"), F.col("b"), F.col("theta"))).alias("info_at_models"))
    coverage = F.when(F.col("peak_info") > 0, F.col("info_at_models") / F.col("peak_info")).otherwise(F.lit(0.0))
    unread = F.coalesce(F.col("peak_info"), F.lit(0.0)) <= 0
    name = F.when(unread, "unreadable").when(coverage >= ALIGNED, "aligned").when(coverage >= PARTIAL, "partial").otherwise("mismatch")
    return peak.crossJoin(at).select("peak_info", "info_at_models", coverage.alias("coverage"), name.alias("verdict"))


def subject_profile(items: DataFrame) -> DataFrame:
    """(subject, n_items, n_usable, n_insufficient, n_dead, mean_a over all items)."""
    has = lambda f: F.sum(F.array_contains("flags", f).cast("long"))
    return items.groupBy("subject").agg(
        F.count("*").alias("n_items"),
        F.sum((~fit.has_flag("insufficient-data", "ceiling", "floor", "inverted")).cast("long")).alias("n_usable"),
        has("insufficient-data").alias("n_insufficient"),
        has("dead").alias("n_dead"),
        F.avg("a").alias("mean_a"),
    )
