"""Fitting by aggregation: classical start, conditional Newton steps, information intervals, flags.

Every function takes ``by``, columns that tell fits apart, so that all fits
of a holdout run as one query. ``rows`` are responses with theta: by, r, c,
obs, theta.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respanel.functions.irt import clamped_logit, difficulty, information, probability, start_difficulty
from respanel.operators.store import stored
from respanel.schema import CEILING, DEAD_THRESHOLD, FLAGS, FLOOR, HDI_PROB, Z95

NEWTON_STEPS = 4
#: A state of items (by, c, ...) -> its columns beside obs and theta of every answer.
Meet = Callable[[DataFrame], DataFrame]


def classical_items(responses: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, c, n_resp, p_correct, a = 1, b) from item rates."""
    rates = responses.groupBy(*by, "c").agg(F.count("*").alias("n_resp"), F.avg("obs").alias("p_correct"))
    return rates.withColumn("a", F.lit(1.0)).withColumn("b", start_difficulty(F.col("p_correct")))


def classical_abilities(responses: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, r, n_resp, theta): standardised logit accuracy, population deviation of at least 1e-6."""
    logits = responses.groupBy(*by, "r").agg(F.count("*").alias("n_resp"), F.avg("obs").alias("rate")).withColumn("logit", clamped_logit(F.col("rate")))
    moments = logits.groupBy(*by).agg(F.avg("logit").alias("mean"), F.greatest(F.stddev_pop("logit"), F.lit(1e-6)).alias("sd"))
    joined = logits.join(moments, list(by)) if by else logits.crossJoin(F.broadcast(moments))
    return joined.select(*by, "r", "n_resp", ((F.col("logit") - F.col("mean")) / F.col("sd")).alias("theta"))


def with_theta(responses: DataFrame, abilities: DataFrame, by: list[str] = ()) -> DataFrame:
    return responses.join(abilities.select(*by, "r", "theta"), [*by, "r"])


def newton_items(
    rows: DataFrame | None, by: list[str] = (), steps: int = NEWTON_STEPS, precision_a: float = 1.0, precision_d: float = 1.0, meet: Meet | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """(by, c, n_resp, p_correct, a, d, b, gradient): ridge logistic regression of each item on fixed abilities.

    Slope-intercept form, from a = 0 and d = logit of the rate; the ridge
    pulls d to its start. ``gradient`` is the norm of the score after the
    last step. All steps share one partitioning by item: each is a join and
    an aggregation without a new shuffle. Instead of ``rows``, ``meet`` may
    give the answers beside a state of the items, and ``counts`` the columns
    n_resp and p_correct.
    """
    keys = [*by, "c"]
    if meet is None:
        rows = rows.select(*keys, "obs", "theta")
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n_resp"), F.avg("obs").alias("p_correct"))
        meet = lambda state: rows.join(state, keys)
    now = counts.withColumn("d0", clamped_logit(F.col("p_correct"))).withColumn("a", F.lit(0.0)).withColumn("d", F.col("d0"))
    state = ["n_resp", "p_correct", "d0", "a", "d"]
    for step in range(steps + 1):
        p = 1 / (1 + F.exp(-(F.col("a") * F.col("theta") + F.col("d"))))
        w = p * (1 - p)
        # the state rides along as grouping columns: each step reads the last one once
        both = (
            meet(now)
            .groupBy(*keys, *state)
            .agg(
                F.sum((F.col("obs") - p) * F.col("theta")).alias("sa"),
                F.sum(F.col("obs") - p).alias("sd"),
                F.sum(w * F.col("theta") * F.col("theta")).alias("haa"),
                F.sum(w * F.col("theta")).alias("had"),
                F.sum(w).alias("hdd"),
            )
        )
        ga = F.col("sa") - F.col("a") * precision_a
        gd = F.col("sd") - (F.col("d") - F.col("d0")) * precision_d
        if step == steps:
            return both.select(*keys, "n_resp", "p_correct", "a", "d", difficulty(F.col("a"), F.col("d")).alias("b"), F.sqrt(ga * ga + gd * gd).alias("gradient"))
        haa, hdd = F.col("haa") + precision_a, F.col("hdd") + precision_d
        det = haa * hdd - F.col("had") * F.col("had")
        now = both.select(
            *keys,
            "n_resp",
            "p_correct",
            "d0",
            (F.col("a") + (hdd * ga - F.col("had") * gd) / det).alias("a"),
            (F.col("d") + (haa * gd - F.col("had") * ga) / det).alias("d"),
        )
    raise AssertionError


def interval(mean: Column, sd: Column, name: str) -> list[Column]:
    return [sd.alias(f"{name}_sd"), (mean - Z95 * sd).alias(f"{name}_lo"), (mean + Z95 * sd).alias(f"{name}_hi")]


def sampled_posterior(samples: DataFrame, by: list[str], value: str, prob: float = HDI_PROB) -> DataFrame:
    """(by, mean, sd, low, high) of posterior draws: sample deviation and the narrowest interval that holds ``prob`` of them."""
    from respanel.functions.ranks import narrowest_interval

    moments = samples.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return moments.join(narrowest_interval(samples, by, value, prob), by)


def item_intervals(items: DataFrame, rows: DataFrame, by: list[str] = (), precision_a: float | Column = 1.0, precision_b: float | Column = 1.0) -> DataFrame:
    """Adds a and b intervals from the joint information of (a, b): for bounded b only.

    An item without a response keeps the prior's width. Precisions of the
    prior are numbers or columns of ``items``.
    """
    keys = [*by, "c"]
    at = rows.select(*keys, "theta").join(items.select(*keys, "a", "b"), keys)
    p = probability(F.col("a"), F.col("b"), F.col("theta"))
    w, gap = p * (1 - p), F.col("theta") - F.col("b")
    info = at.groupBy(*keys).agg(
        F.sum(w * gap * gap).alias("iaa"), F.sum(-F.col("a") * w * gap).alias("iab"), F.sum(F.col("a") * F.col("a") * w).alias("ibb")
    )
    joined = items.join(info, keys, "left")
    iaa, iab, ibb = (F.coalesce(c, F.lit(0.0)) for c in ("iaa", "iab", "ibb"))
    iaa, ibb = iaa + precision_a, ibb + precision_b
    det = F.greatest(iaa * ibb - iab * iab, F.lit(2.2250738585072014e-308))
    return joined.select(*items.columns, *interval(F.col("a"), F.sqrt(ibb / det), "a"), *interval(F.col("b"), F.sqrt(iaa / det), "b"))


def newton_intervals(items: DataFrame, rows: DataFrame | None, by: list[str] = (), precision_a: float = 1.0, precision_d: float = 1.0, meet: Meet | None = None) -> DataFrame:
    """Adds intervals from the information of (a, d), that of b by the delta method.

    With b = -d / a an item near a = 0 would look certain in the (a, b) form.
    An item without a response keeps the prior's width.
    """
    keys = [*by, "c"]
    at = meet(items.select(*keys, "a", "d")) if meet else rows.select(*keys, "theta").join(items.select(*keys, "a", "d"), keys)
    p = 1 / (1 + F.exp(-(F.col("a") * F.col("theta") + F.col("d"))))
    w = p * (1 - p)
    info = at.groupBy(*keys).agg(F.sum(w * F.col("theta") * F.col("theta")).alias("iaa"), F.sum(w * F.col("theta")).alias("iad"), F.sum(w).alias("idd"))
    iaa, idd, iad = (F.coalesce(c, F.lit(0.0)) for c in ("iaa", "idd", "iad"))
    iaa, idd = iaa + precision_a, idd + precision_d
    det = iaa * idd - iad * iad
    va, vd, cov = idd / det, iaa / det, -iad / det
    b = F.col("b")
    vb = (vd + 2 * b * cov + b * b * va) / (F.col("a") * F.col("a"))
    sd_b = F.when(F.abs("a") > 1e-9, F.sqrt(F.greatest(vb, F.lit(0.0))))
    return items.join(info, keys, "left").select(*items.columns, *interval(F.col("a"), F.sqrt(va), "a"), *interval(b, sd_b, "b"))


def ability_intervals(abilities: DataFrame, items: DataFrame, responses: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds theta_sd, theta_lo, theta_hi: curvature at the items answered plus the error of the metric itself."""
    keys = [*by, "r"]
    at = responses.select(*keys, "c").join(items.select(*by, "c", "a", "b"), [*by, "c"]).join(abilities.select(*keys, "theta"), keys)
    info = at.groupBy(*keys).agg(F.sum(information(F.col("a"), F.col("b"), F.col("theta"))).alias("info"))
    n = F.count("*").over(Window.partitionBy(*by)) if by else None
    joined = abilities.join(info, keys, "left")
    if n is None:
        joined = joined.crossJoin(F.broadcast(abilities.agg(F.count("*").alias("n_all"))))
    else:
        joined = joined.withColumn("n_all", n)
    metric = F.col("theta") / F.sqrt(2.0 * F.greatest(F.col("n_all") - 1, F.lit(1)))
    sd = F.sqrt(1 / (1 + F.coalesce("info", F.lit(0.0))) + metric * metric)
    return joined.select(*abilities.columns, *interval(F.col("theta"), sd, "theta"))


def canonical_sign(items: DataFrame, abilities: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Every fit reflected so that its slopes sum to no less than 0: a, b and theta change sign, interval ends swap."""
    sign = F.broadcast(items.groupBy(*by).agg(F.when(F.sum("a") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign")))

    def turned(df: DataFrame, names: list[str]) -> DataFrame:
        both = df.join(sign, list(by)) if by else df.crossJoin(sign)
        out = []
        for c in df.columns:
            stem, _, end = c.rpartition("_")
            if c in names or c == "d":
                out.append((F.col(c) * (F.col("sign") if c != "d" else F.lit(1.0))).alias(c))
            elif stem in names and end in ("lo", "hi"):
                other = f"{stem}_{'hi' if end == 'lo' else 'lo'}"
                out.append(F.when(F.col("sign") < 0, -F.col(other)).otherwise(F.col(c)).alias(c))
            else:
                out.append(F.col(c))
        return both.select(*out)

    return turned(items, ["a", "b"]), turned(abilities, ["theta"])


def flag_columns(low: Column, high: Column, rate: Column, b: Column, theta_min: Column, theta_max: Column, dead: float = DEAD_THRESHOLD) -> Column:
    """Flags of an item in the fixed order, from its interval, rate and place. A null rate is neither ceiling nor floor."""
    unsure = (low <= 0) & (high >= 0)
    flat, upside_down = ~unsure & (low > -dead) & (high < dead), ~unsure & (high < 0)
    span = F.greatest(theta_max - theta_min, F.lit(1e-6))
    off = ~unsure & ((b < theta_min - span) | (b > theta_max + span))
    tests = [flat, upside_down & ~flat, unsure, rate >= CEILING, rate <= FLOOR, off]
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, FLAGS, strict=True)]))


def item_flags(items: DataFrame, abilities: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds ``flags``."""
    ends = abilities.groupBy(*by).agg(F.min("theta").alias("theta_min"), F.max("theta").alias("theta_max"))
    joined = items.join(ends, list(by)) if by else items.crossJoin(F.broadcast(ends))
    flags = flag_columns(*(F.col(c) for c in ("a_lo", "a_hi", "p_correct", "b", "theta_min", "theta_max")))
    return joined.select(*items.columns, flags.alias("flags"))


def has_flag(*names: str) -> Column:
    return F.arrays_overlap("flags", F.array(*[F.lit(n) for n in names]))


def usable(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~has_flag("insufficient-data", "ceiling", "floor", "inverted"))


def padding(flagged: DataFrame) -> DataFrame:
    """Items that may fill up a set: answered, a > 0, discriminating the right way, not certain enough to be usable."""
    return flagged.filter((F.col("n_resp") > 0) & (F.col("a") > 0) & ~has_flag("ceiling", "floor", "inverted") & has_flag("insufficient-data"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    """(flag, n, rate) for every flag, zeros included."""
    spark = flagged.sparkSession
    names = spark.createDataFrame(list(enumerate(FLAGS)), "place long, flag string")
    counts = flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    total = flagged.agg(F.count("*").alias("total"))
    out = names.join(counts, "flag", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("place", "flag", n.alias("n"), F.coalesce(F.try_divide(n.cast("double"), F.col("total")), F.lit(0.0)).alias("rate"))


def newton_fit(responses: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(items with intervals and flags, abilities) of every fit in ``responses``."""
    abilities = stored(classical_abilities(responses, by), "abilities")
    rows = stored(with_theta(responses, abilities, by), "fit-rows")
    items = stored(newton_items(rows, by), "fit-items")
    items, abilities = canonical_sign(newton_intervals(items, rows, by), abilities, by)
    abilities = stored(abilities, "abilities")
    return stored(item_flags(items, abilities, by), "fit"), abilities
