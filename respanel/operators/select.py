"""Anchor sets: information at the abilities at hand, tiers of confident and padding items, other selectors.

``items``: by, c, a, b, a_sd, flags, n_resp; ``points``: by, theta, weight.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respanel.functions.irt import information
from respanel.functions.ranks import largest_remainder
from respanel.operators import smooth
from respanel.operators.fit import padding, usable
from respanel.operators.store import stored
from respanel.schema import SelectError, THETA_PRECISION

OBJECTIVES = ("max-information", "min-variance")


def normal_quantiles(n: int) -> list[tuple[float, float]]:
    """(x, weight): the middles of ``n`` equal parts of a standard normal."""
    return [(NormalDist().inv_cdf((k + 0.5) / n), 1 / n) for k in range(n)]


def quantile_points(spark, n: int = 41):
    """(theta, weight) of ``normal_quantiles``, for choosing where models will be and not where they are."""
    return spark.createDataFrame(normal_quantiles(n), "theta double, weight double")


def ability_points(abilities: DataFrame, respondents: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, r, model_id, theta, weight): each model weighs the same, shared by its respondents, all adding up to 1."""
    rows = abilities.select(*by, "r", "theta").join(respondents.select("r", "model_id"), "r")
    share = 1.0 / F.count("*").over(Window.partitionBy(*by, "model_id"))
    out = rows.withColumn("share", share)
    models = rows.groupBy(*by).agg(F.count_distinct("model_id").alias("n_models"))
    out = out.join(models, list(by)) if by else out.crossJoin(F.broadcast(models))
    return out.select(*by, "r", "model_id", "theta", (F.col("share") / F.col("n_models")).alias("weight"))


def weighted_information(items: DataFrame, points: DataFrame, by: list[str] = (), a: Column | None = None, value: str = "score") -> DataFrame:
    """(by, c, score): sum over abilities of weight times information, rounded so that equal items tie."""
    rows = items.select(*by, "c", (a if a is not None else F.col("a")).alias("a"), "b")
    total = F.sum(F.col("weight") * information(F.col("a"), F.col("b"), F.col("theta")))
    return at_nodes(rows, points, by).groupBy(*by, "c").agg(F.round(total, 10).alias(value))


def at_nodes(items: DataFrame, points: DataFrame, by: list[str] = ()) -> DataFrame:
    """``items`` (by, a, b, ...) beside theta and weight of the nodes that stand for all points: some hundred rows an item, however many points there are."""
    rows = items.withColumn("level", smooth.level(F.col("a")))
    nodes = smooth.nodes(points, rows.select("level").distinct(), by)
    # nodes of many fits are no small table by nature: its size on disk decides how it is joined
    return rows.join(stored(nodes, "nodes") if by else F.broadcast(nodes), [*by, "level"])


def check(n: int, objective: str = "max-information") -> None:
    if n <= 0:
        raise SelectError(f"a set of {n} items cannot be chosen, ask for one at least")
    if objective not in OBJECTIVES:
        raise SelectError(f"{objective!r} is no objective; there are {' and '.join(OBJECTIVES)}")


def tiers(items: DataFrame) -> DataFrame:
    """Eligible items with tier 0 (confident) or 1 (padding); an unanswered item is in neither."""
    sure = usable(items).filter("n_resp > 0").withColumn("tier", F.lit(0))
    return sure.unionByName(padding(items).withColumn("tier", F.lit(1)))


def anchor_max_information(scored: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    """(by, rank, c, gain, padded) from (by, c, tier, score).

    The gain of an item doesn't depend on the set, so the greedy pass is a
    sort: confident items before padding, then by score, then by index.
    """
    check(n)
    order = Window.partitionBy(*by).orderBy("tier", F.desc("score"), "c")
    if not by:  # the head by a distributed top-n, so that the window holds n rows and not the pool
        scored = scored.orderBy("tier", F.desc("score"), "c").limit(n)
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)
    return ranked.select(*by, "rank", "c", F.col("score").alias("gain"), (F.col("tier") == 1).alias("padded"))


def select_anchor(items: DataFrame, points: DataFrame, n: int, by: list[str] = (), candidates: DataFrame | None = None) -> DataFrame:
    """Anchor set of every fit: confident items first, padding where they run out; named candidates are the whole pool."""
    pool = tiers(items) if candidates is None else items.join(candidates.select("c").distinct(), "c", "left_semi").filter("n_resp > 0").withColumn("tier", F.lit(0))
    scored = pool.join(weighted_information(pool, points, by), [*by, "c"])
    return anchor_max_information(scored.select(*by, "c", "tier", "score"), n, by)


#: Items that the sequential part of a minimum-variance set holds at once.
CANDIDATES = 1024


def anchor_min_variance(items: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """Greedy set that minimises the weighted mean posterior variance; (rank, c, gain, padded).

    The gain of an item depends on the set chosen so far, but never rises as
    the set grows. So a pass over all items gives their gains, which bound all
    later ones: the best ``CANDIDATES`` go on by themselves while the best of
    them is above the bound of all others, then comes another pass. Abilities
    are nodes: with slopes up to a the variance 1 / (1 + information) is
    analytic and at most 1 within pi / 2a of the real line, so cells of half
    the usual width do.
    """
    check(n, "min-variance")
    spark, schema = items.sparkSession, "rank long, c long, gain double, padded boolean"
    pool = stored(tiers(items).select(F.col("c").cast("long").alias("c"), "a", "b", "tier"), "pool")
    level = stored(pool.agg((F.max(smooth.level(F.col("a"))) + 1).alias("level")).filter("level is not null"), "level")
    nodes = smooth.nodes(points, level).orderBy("theta").collect()  # some hundred or thousand
    theta, weight = np.array([r["theta"] for r in nodes]), np.array([r["weight"] for r in nodes])

    def informations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-a[:, None] * (theta[None, :] - b[:, None])))
        return (a * a)[:, None] * p * (1 - p)

    def gains(info: np.ndarray, precision: np.ndarray) -> np.ndarray:
        return ((weight / precision)[None, :] - weight[None, :] / (precision[None, :] + info)).sum(axis=1)

    def best(tier: int, out: list, precision: np.ndarray) -> list:
        """(gain, c, a, b) of the items of a tier that gain most by themselves beside the set, one more than the candidates."""

        def each(batches):
            for batch in batches:
                a, b = (np.asarray(batch.column(x)) for x in ("a", "b"))
                parts = [gains(informations(a[k : k + 256], b[k : k + 256]), precision) for k in range(0, len(a), 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0)), *(batch.column(x) for x in ("c", "a", "b"))], names=["gain", "c", "a", "b"])

        left = pool.filter((F.col("tier") == tier) & ~F.col("c").isin([row[1] for row in out])) if out else pool.filter(F.col("tier") == tier)
        found = left.select("c", "a", "b").mapInArrow(each, "gain double, c long, a double, b double")
        return found.orderBy(F.desc("gain"), "c").limit(CANDIDATES + 1).collect()

    out, precision = [], np.full(len(theta), THETA_PRECISION)
    for tier in (0, 1):
        while len(out) < n and (rows := best(tier, out, precision)):
            bound = rows[CANDIDATES]["gain"] if len(rows) > CANDIDATES else -np.inf
            own = sorted(rows[:CANDIDATES], key=lambda r: r["c"])
            info = informations(np.array([r["a"] for r in own]), np.array([r["b"] for r in own]))
            left, fresh = np.ones(len(own), bool), True
            while len(out) < n and left.any():
                gain = np.where(left, gains(info, precision), -np.inf)
                k = int(gain.argmax())
                if not fresh and gain[k] <= bound + 1e-14:
                    break
                left[k], fresh, precision = False, False, precision + info[k]
                out.append((len(out) + 1, own[k]["c"], float(gain[k]), bool(tier)))
            if not left.any() and len(rows) <= CANDIDATES:
                break
    return spark.createDataFrame(out, schema)


def set_error(chosen: DataFrame, items: DataFrame, points: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, r, theta, weight, info, theta_se) of the abilities under a set of items."""
    own = chosen.select(*by, "c").join(items.select(*by, "c", "a", "b"), [*by, "c"])
    both = own.join(points, list(by)) if by else own.crossJoin(points)
    info = both.groupBy(*by, "r").agg(F.sum(information(F.col("a"), F.col("b"), F.col("theta"))).alias("info"))
    out = points.join(info, [*by, "r"], "left").withColumn("info", F.coalesce("info", F.lit(0.0)))
    return out.withColumn("theta_se", 1 / F.sqrt(THETA_PRECISION + F.col("info")))


def lower_bound_scores(items: DataFrame, points: DataFrame) -> DataFrame:
    """Information with a at the lower end of its interval, 0 at least."""
    return weighted_information(items, points, a=F.greatest(F.col("a") - 1.96 * F.col("a_sd"), F.lit(0.0)))


def gauss_hermite(n: int) -> list[tuple[float, float]]:
    """(x, w) with which sums of w f(x) give the mean of f under a standard normal."""
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return [(float(a), float(b / math.sqrt(2 * math.pi))) for a, b in zip(x, w, strict=True)]


def expected_scores(items: DataFrame, points: DataFrame, nodes: int = 9) -> DataFrame:
    """Information averaged over the normal posterior of a by quadrature."""
    spark = items.sparkSession
    grid = F.broadcast(spark.createDataFrame(gauss_hermite(nodes), "x double, w double"))
    rows = items.crossJoin(grid).select("c", (F.col("a") + F.col("x") * F.col("a_sd")).alias("a"), "b", "w")
    total = F.sum(F.col("w") * F.col("weight") * information(F.col("a"), F.col("b"), F.col("theta")))
    return at_nodes(rows, points).groupBy("c").agg(F.round(total, 10).alias("score"))


def scored_selector(items: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    return anchor_max_information(tiers(items).join(scores, "c").select("c", "tier", "score"), n)


def per_scenario(items: DataFrame, points: DataFrame, scenario: DataFrame, n: int) -> DataFrame:
    """(scenario, rank, c, gain, padded): places dealt to scenarios by largest remainder, filled inside each."""
    check(n)
    take = largest_remainder(scenario.groupBy("scenario").agg(F.count("*").alias("size")), "scenario", "size", n)
    pool = tiers(items).join(scenario, "c")
    scored = pool.join(weighted_information(pool, points), "c").select("scenario", "c", "tier", "score")
    order = Window.partitionBy("scenario").orderBy("tier", F.desc("score"), "c")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).join(take, "scenario").filter("rank <= take")
    return ranked.select("scenario", "rank", "c", F.col("score").alias("gain"), (F.col("tier") == 1).alias("padded"))


def item_rest(responses: DataFrame, respondents: DataFrame) -> DataFrame:
    """(c, n_models, item_rest): correlation over models of an item's score with the mean of the model's other items.

    Null under three models or for a constant side.
    """
    scores = responses.join(respondents.select("r", "model_id"), "r").groupBy("model_id", "c").agg(F.avg("obs").alias("x"))
    total = scores.groupBy("model_id").agg(F.sum("x").alias("sum"), F.count("*").alias("n"))
    rest = scores.join(total, "model_id").filter("n > 1").withColumn("rest", (F.col("sum") - F.col("x")) / (F.col("n") - 1))
    from respanel.functions.ranks import correlation

    out = rest.groupBy("c").agg(F.count("*").alias("n_models"), correlation("x", "rest").alias("item_rest"))
    return out.withColumn("item_rest", F.when(F.col("n_models") >= 3, F.col("item_rest")))


def item_rest_filled(responses: DataFrame, respondents: DataFrame, items: DataFrame) -> DataFrame:
    """(c, item_rest): as ``item_rest`` on the full models x items table, gaps filled by the item's mean; constant: 0.

    The table is never made. With the deviations e of the observed cells
    from their items' means, a gap has e = 0 and a model's row total is a
    constant plus the sum E of its deviations. So an item's sums over all
    models are those over its observed cells: of e, e^2 and e E, and of E^2
    over the models.
    """
    scores = responses.join(respondents.select("r", "model_id"), "r").groupBy("model_id", "c").agg(F.avg("obs").alias("x"))
    means = scores.groupBy("c").agg(F.avg("x").alias("mean"))
    cells = scores.join(means, "c").select("model_id", "c", (F.col("x") - F.col("mean")).alias("e"))
    totals = cells.groupBy("model_id").agg(F.sum("e").alias("t"))
    every = respondents.select("model_id").distinct().agg(F.count("*").alias("n"))
    whole = every.crossJoin(totals.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("st"), F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0)).alias("stt")))
    e, t = F.col("e"), F.col("t")
    sums = cells.join(totals, "model_id").groupBy("c").agg(F.sum(e).alias("se"), F.sum(e * e).alias("see"), F.sum(e * t).alias("set"))
    both = items.select("c").join(sums, "c").crossJoin(F.broadcast(whole))
    # the rest of a model is t - e, up to a constant
    n, se, see = (F.col(x) for x in ("n", "se", "see"))
    sr, srr, ser = F.col("st") - se, F.col("stt") - 2 * F.col("set") + see, F.col("set") - see
    vx, vr, cov = see - se * se / n, srr - sr * sr / n, ser - se * sr / n
    return both.select("c", F.when((vx > 1e-12) & (vr > 1e-12), cov / F.sqrt(vx * vr)).otherwise(0.0).alias("item_rest"))


def top_by(scores: DataFrame, value: str, n: int) -> DataFrame:
    """(rank, c, value): the n greatest, nulls out, ties to the lower index."""
    order = Window.orderBy(F.desc("__v"), "c")
    rows = scores.filter(F.col(value).isNotNull()).withColumn("__v", F.round(value, 10)).orderBy(F.desc("__v"), "c").limit(n)
    return rows.select(F.row_number().over(order).cast("long").alias("rank"), "c", value)


def random_sets(items: DataFrame, size: int, draws: int, seed: int, keys: DataFrame | None = None) -> DataFrame:
    """(keys, draw, c): for every draw the ``size`` items of least hash of (seed, key, draw, item).

    Arithmetic modulo primes, so that any engine draws the same sets.
    """
    spark = items.sparkSession
    grid = spark.range(draws).select(F.col("id").alias("draw"))
    rows = items.select("c").crossJoin(grid) if keys is None else items.crossJoin(grid)
    key = F.lit(0) if keys is None else F.col("k")
    h = (F.col("c") * 7919 + F.col("draw") * 104729 + key * 1299709 + seed * 15485863) % 1000003
    h = (h * h + F.col("c") * 31 + F.col("draw") * 17) % 999983
    by = ["draw"] if keys is None else ["k", "draw"]
    ranked = rows.withColumn("h", h).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h", "c")))
    return ranked.filter(F.col("rank") <= size).select(*by, "c")
