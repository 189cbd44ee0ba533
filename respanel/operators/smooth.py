"""Sums over all pairs of items and abilities in time linear in both, by Chebyshev interpolation.

The curve of an item over ability (its probability or information) is analytic
within pi / |a| of the real line. On a cell of width w with |a| w <= 1 the
polynomial through ``ORDER`` Chebyshev nodes meets it to about 1e-15 of a^2. So
the points in a cell act on an item like weights at the cell's nodes, and a sum
over items is known in the whole cell from its values at the nodes. Items of
steeper slopes take narrower cells: ``level`` l has cells of width 2^-l.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 16
#: Places of the nodes inside a cell, on [-1, 1].
NODES = [math.cos((q + 0.5) * math.pi / ORDER) for q in range(ORDER)]
#: The widest cells are four units wide.
FLATTEST = -2


def level(a: Column) -> Column:
    """Least level whose cells suit the slope."""
    return F.greatest(F.ceil(F.log2(F.greatest(F.abs(a), F.lit(2.0**FLATTEST)))), F.lit(FLATTEST)).cast("int")


def _chebyshev(x: Column, j: int) -> Column:
    return F.cos(j * F.acos(x)) if j else F.lit(1.0)


def _placed(points: DataFrame, levels: DataFrame) -> DataFrame:
    """``points`` (theta, ...) once for every level, with their cell and their place x in it, on [-1, 1]."""
    at = points.crossJoin(F.broadcast(levels)).withColumn("__u", F.col("theta") * F.pow(F.lit(2.0), F.col("level")))
    at = at.withColumn("cell", F.floor("__u"))
    inside = 2 * (F.col("__u") - F.col("cell")) - 1
    return at.withColumn("x", F.least(F.greatest(inside, F.lit(-1.0)), F.lit(1.0))).drop("__u")


def _theta(x: Column) -> Column:
    return (F.col("cell") + (x + 1) / 2) * F.pow(F.lit(2.0), -F.col("level"))


def nodes(points: DataFrame, levels: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, level, theta, weight) that stands for ``points`` (by, theta, weight) in sums over curves of a level.

    A cell of ``ORDER`` distinct abilities or fewer keeps them, so that no
    more rows come out than go in; weights may be negative.
    """
    keys = [*by, "level", "cell"]
    spread = points.filter("theta is not null").groupBy(*by, "theta").agg(F.sum("weight").alias("weight"))
    at = _placed(spread, levels)
    moments = at.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("weight") * _chebyshev(F.col("x"), j)).alias(f"m{j}") for j in range(ORDER)])
    each = []
    for x in NODES:
        weight = reduce(lambda s, j: s + F.col(f"m{j}") * (2 * math.cos(j * math.acos(x))), range(1, ORDER), F.col("m0")) / ORDER  # noqa: B023
        each.append(F.struct(F.lit(x).alias("x"), weight.alias("weight")))
    dense = moments.filter(F.col("n") > ORDER).select(*keys, F.inline(F.array(*each))).select(*by, "level", _theta(F.col("x")).alias("theta"), "weight")
    few = at.join(moments.filter(F.col("n") <= ORDER).select(*keys), keys, "left_semi")
    return dense.unionByName(few.select(*by, "level", "theta", "weight"))


def summed(items: DataFrame, points: DataFrame, curve: Callable[[Column, Column, Column], Column], by: list[str] = ()) -> DataFrame:
    """(by, theta, total): for every distinct ability of ``points`` the sum of ``curve(a, b, theta)`` over ``items`` (by, a, b)."""
    rows = items.select(*by, "a", "b", level(F.col("a")).alias("level"))
    at = _placed(points.filter("theta is not null").select("theta").distinct(), rows.select("level").distinct())
    grid = at.select("level", "cell").distinct().withColumn("x", F.explode(F.array(*[F.lit(x) for x in NODES])))
    grid = grid.withColumn("t", _theta(F.col("x")))
    values = rows.join(F.broadcast(grid), "level").groupBy(*by, "level", "cell", "x").agg(F.sum(curve(F.col("a"), F.col("b"), F.col("t"))).alias("v"))
    terms = [(F.sum(F.col("v") * _chebyshev(F.col("x"), j)) * ((2.0 if j else 1.0) / ORDER)).alias(f"k{j}") for j in range(ORDER)]
    known = values.groupBy(*by, "level", "cell").agg(*terms)
    here = reduce(lambda s, j: s + F.col(f"k{j}") * _chebyshev(F.col("x"), j), range(1, ORDER), F.col("k0"))
    return at.join(F.broadcast(known), ["level", "cell"]).groupBy(*by, "theta").agg(F.sum(here).alias("total"))
