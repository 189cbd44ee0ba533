"""Ranks with ties, rank correlations and allocations, over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respanel.operators.store import stored


def average_rank(by: list[str], value: str, descending: bool = True) -> Column:
    """1 is best; ties share the mean of their places."""
    order = F.desc(value) if descending else F.asc(value)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null for a constant side."""
    n, sx, sy = F.count("*").cast("double"), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(y) * F.col(y)) - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def inversions(rows: DataFrame, keys: list[str], place: str, rank: str, levels: int) -> DataFrame:
    """(keys, inversions): pairs whose ``place`` rises while their ``rank`` falls, both whole numbers from 0.

    Two ranks part at one bit: the highest they differ in. So every row is
    taken once for each bit, with the ranks that agree above it, and a
    row with a 0 there counts the rows with a 1 that came before it. These
    are ``levels`` running sums, n log n in all, and no pair is made.
    """
    spread = rows.select(*keys, place, rank, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("__bit"))
    above, bit = F.expr(f"shiftright({rank}, __bit + 1)"), F.expr(f"shiftright({rank}, __bit) & 1")
    spread = spread.select(*keys, place, "__bit", above.alias("__above"), bit.alias("__one"))
    before = Window.partitionBy(*keys, "__bit", "__above").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    ahead = spread.withColumn("__ahead", F.coalesce(F.sum("__one").over(before), F.lit(0)))
    return ahead.groupBy(*keys).agg(F.sum(F.when(F.col("__one") == 0, F.col("__ahead")).otherwise(0)).alias("inversions"))


def tied_pairs(rows: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """(keys, name): pairs of rows equal in ``values``."""
    n = F.col("__n")
    return rows.groupBy(*keys, *values).agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.sum(n * (n - 1) / 2).alias(name))


def rank_correlations(pairs: DataFrame, by: list[str], ident: str, x: str, y: str) -> DataFrame:
    """(by, n, spearman, kendall) of the rows finite on both sides; null under three or for a constant side.

    Kendall's tau-b is had from counts of ties and of inversions.
    """
    rows = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    # adding 0 makes one zero of both
    rows = rows.select(*by, F.lit(0).alias("__g"), (F.col(x) + F.lit(0.0)).alias("x"), (F.col(y) + F.lit(0.0)).alias("y"))
    keys = [*by, "__g"]
    ranked = rows.select(*keys, average_rank(keys, "x").alias("rx"), average_rank(keys, "y").alias("ry"))
    spearman = ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("spearman"))
    order = Window.partitionBy(*keys)
    placed = rows.select(*keys, (F.row_number().over(order.orderBy("x", "y")) - 1).alias("__place"), (F.dense_rank().over(order.orderBy("y")) - 1).cast("long").alias("__rank"))
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    falls = inversions(placed, keys, "__place", "__rank", max(1, (most - 1).bit_length()))
    ties = [tied_pairs(rows, keys, values, name) for values, name in ((["x"], "tx"), (["y"], "ty"), (["x", "y"], "txy"))]
    out = spearman
    for part in (falls, *ties):
        out = out.join(part, keys, "left")
    every = F.col("n") * (F.col("n") - 1) / 2
    agree = every - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("inversions")
    kendall = F.try_divide(agree, F.nullif(F.sqrt((every - F.col("tx")) * (every - F.col("ty"))), F.lit(0.0)))
    enough = F.col("n") >= 3
    return out.select(*by, "n", F.when(enough, F.col("spearman")).alias("spearman"), F.when(enough, kendall).alias("kendall"))


def largest_remainder(groups: DataFrame, name: str, size: str, n: int) -> DataFrame:
    """(name, take): n places dealt in proportion to size; what is left goes to the largest fraction, then by name."""
    total = groups.agg(F.sum(size).alias("total"))
    share = groups.crossJoin(F.broadcast(total)).withColumn("share", F.col(size) * n / F.col("total").cast("double"))
    floors = share.withColumn("floor", F.floor("share"))
    left = floors.agg((F.lit(n) - F.sum("floor")).alias("left"))
    order = Window.orderBy(F.desc(F.round(F.col("share") - F.col("floor"), 10)), name)
    ranked = floors.withColumn("rank", F.row_number().over(order)).crossJoin(F.broadcast(left))
    return ranked.select(name, (F.col("floor") + (F.col("rank") <= F.col("left")).cast("int")).cast("long").alias("take"))


def narrowest_interval(samples: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, low, high): the narrowest window that holds ceil(share * n) of the sorted samples.

    Distinct values with their counts are sorted by ranges, whatever group
    they are in; a value's place among all of its group is that in its range
    and the counts of the ranges before it. No task holds a group.
    """
    counts = samples.groupBy(*by, value).agg(F.count("*").alias("m"))
    # written with its ranges: what is read back does not depend on sampling the ranges again
    cut = stored(counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()), "samples")
    inside = F.sum("m").over(Window.partitionBy("part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    sizes = cut.groupBy(*by, "part").agg(F.sum("m").alias("own"))
    before = F.sum("own").over(Window.partitionBy(*by).orderBy("part")) - F.col("own")
    starts = sizes.select(*by, "part", before.alias("before"), F.sum("own").over(Window.partitionBy(*by)).alias("n"))
    placed = cut.withColumn("inside", inside).join(F.broadcast(starts), [*by, "part"])
    placed = placed.select(*by, F.col(value).alias("v"), "m", (F.col("before") + F.col("inside")).alias("last"), F.ceil(F.col("n") * share).cast("long").alias("w"), "n")
    placed = stored(placed, "samples-placed")
    # a window from a value starts at its first copy: the later ones reach no less far
    lows = placed.select(*by, F.col("v").alias("low"), (F.col("last") - F.col("m") + F.col("w")).alias("at"), "n").filter("at <= n").withColumn("is_low", F.lit(1))
    # places in slices of ``SLICE``: the end of a window is the least value whose last copy lies there or later
    first, last = F.floor((F.col("last") - F.col("m")) / SLICE), F.floor((F.col("last") - 1) / SLICE)
    highs = placed.withColumn("slice", F.explode(F.sequence(first, last)))
    highs = highs.select(*by, "slice", F.col("last").alias("at"), F.lit(0).alias("is_low"), F.lit(None).cast(samples.schema[value].dataType).alias("low"), F.col("v").alias("high"))
    asked = lows.select(*by, F.floor((F.col("at") - 1) / SLICE).alias("slice"), "at", "is_low", "low", F.lit(None).cast(samples.schema[value].dataType).alias("high"))
    # from the far end, so that the frame runs and is not made anew for every row
    ahead = Window.partitionBy(*by, "slice").orderBy(F.desc("at"), "is_low").rowsBetween(Window.unboundedPreceding, 0)
    spans = highs.unionByName(asked).withColumn("high", F.last("high", ignorenulls=True).over(ahead)).filter("is_low = 1")
    best = F.min(F.struct((F.col("high") - F.col("low")).alias("span"), "low", "high"))
    return spans.groupBy(*by).agg(best.alias("best")).select(*by, "best.low", "best.high")


#: Places of a sorted group that one window of the search for its narrowest interval spans.
SLICE = 200_000
