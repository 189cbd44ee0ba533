"""Leave-one-model-out validation: all holdouts in one query, the held-out model is a column.

``holdouts``: k (long), holdout (model id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respanel.functions.irt import clamped_logit
from respanel.operators import fit, score, select
from respanel.operators.matrix import ResponseMatrix, full_suite_accuracy
from respanel.operators.store import stored
from respanel.schema import DEFAULT_SIZES, MIN_MODELS, ValidateError


#: Hashes of random sets lie under it.
HASHES = 999983


def parse_sizes(spec: str) -> list[int]:
    """Sorted, distinct, positive sizes of ``"25,50"``."""
    try:
        sizes = sorted({int(x) for x in spec.split(",")})
    except ValueError:
        raise ValidateError(f"sizes must be whole numbers, got {spec!r}") from None
    if not sizes or sizes[0] <= 0:
        raise ValidateError(f"sizes must be positive, got {spec!r}")
    return sizes


def all_holdouts(m: ResponseMatrix, only: list[str] | None = None) -> DataFrame:
    """(k, holdout) of every model, or of the named ones; raises for under three models or unknown names."""
    models = m.respondents.select(F.col("model_id").alias("holdout")).distinct()
    n = models.count()
    if n < MIN_MODELS:
        raise ValidateError(f"holding a model out needs {MIN_MODELS} models, there are {n}")
    ranked = models.select((F.row_number().over(Window.orderBy("holdout")) - 1).cast("long").alias("k"), "holdout")
    if only is None:
        return ranked
    found = ranked.filter(F.col("holdout").isin(only))
    if found.count() < len(set(only)):
        raise ValidateError("unknown model among the holdouts")
    return found


def without_own(rows: DataFrame, holdouts: DataFrame) -> DataFrame:
    """``rows`` (with model_id) once for every holdout but that of their own model: k beside the columns of ``rows``.

    The keys of the holdouts, one a model, are a literal; nothing is joined on an inequality.
    """
    named = holdouts.select(F.col("holdout").alias("model_id"), F.array("k").alias("own"))
    every = F.lit([r["k"] for r in holdouts.select("k").distinct().orderBy("k").collect()]).cast("array<bigint>")
    met = rows.join(F.broadcast(named), "model_id", "left")
    others = F.when(F.col("own").isNull(), every).otherwise(F.array_except(every, F.col("own")))
    return met.select(F.explode(others).alias("k"), *rows.columns)


def held_out_responses(m: ResponseMatrix, holdouts: DataFrame) -> DataFrame:
    """(k, r, c, obs) of every fit: all respondents of the other models. For fits that need the answers of each holdout in one place."""
    return without_own(m.responses.join(m.respondents.select("r", "model_id"), "r"), holdouts).select("k", "r", "c", "obs")


def held_out_counts(m: ResponseMatrix, holdouts: DataFrame) -> DataFrame:
    """(k, c, n_resp, n_right) of the items that a fit has answers of: counts of all models less those of the held-out one.

    Answers are counted once by item and once by item and held-out model,
    however many holdouts there are.
    """
    whole = m.responses.groupBy("c").agg(F.count("*").alias("n"), F.sum("obs").alias("right"))
    people = m.respondents.join(F.broadcast(holdouts.withColumnRenamed("holdout", "model_id")), "model_id").select("r", "k")
    own = m.responses.join(people, "r").groupBy("k", "c").agg(F.count("*").alias("own_n"), F.sum("obs").alias("own_right"))
    grid = whole.crossJoin(F.broadcast(holdouts.select("k"))).join(own, ["k", "c"], "left")
    less = lambda x: (F.col(x) - F.coalesce(f"own_{x}", F.lit(0))).cast("long")
    return grid.select("k", "c", less("n").alias("n_resp"), less("right").alias("n_right")).filter("n_resp > 0")


def held_out_moments(logits: DataFrame, holdouts: DataFrame) -> DataFrame:
    """(k, holdout, mean, sd) of ``logits`` (model_id, logit) without the held-out model: sums of all less its own, about the common mean."""
    whole = logits.agg(F.avg("logit").alias("middle"))
    centred = logits.crossJoin(F.broadcast(whole)).select("model_id", "middle", (F.col("logit") - F.col("middle")).alias("x"))
    sums = [F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")]
    own = centred.groupBy("model_id").agg(*[x.alias(f"own_{name}") for x, name in zip(sums, ("n", "s", "ss"), strict=True)])
    total = centred.agg(F.first("middle").alias("middle"), *sums)
    both = holdouts.join(own, holdouts.holdout == own.model_id, "left").crossJoin(F.broadcast(total))
    n, s, ss = (F.col(x) - F.coalesce(f"own_{x}", F.lit(0.0)) for x in ("n", "s", "ss"))
    spread = F.sqrt(F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0)))
    return both.select("k", "holdout", (F.col("middle") + s / n).alias("mean"), F.greatest(spread, F.lit(1e-6)).alias("sd"))


def newton_holdouts(m: ResponseMatrix, holdouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``fit.newton_fit`` gives for the answers of every holdout, without copies of the matrix.

    A respondent's logit accuracy is the same in all fits; what differs is
    the mean and deviation it is standardised by. So the answers are stored
    once with their logits and meet the state of an item in all its holdouts
    by an equi-join on the item, in which the held-out model's are passed over.
    """
    rates = m.responses.groupBy("r").agg(F.count("*").alias("n_resp"), F.avg("obs").alias("rate"))
    logits = stored(rates.join(m.respondents.select("r", "model_id"), "r").select("r", "model_id", "n_resp", clamped_logit(F.col("rate")).alias("logit")), "holdout-logits")
    moments = stored(held_out_moments(logits, holdouts), "holdout-moments")
    spread = without_own(logits, holdouts).join(F.broadcast(moments), "k")
    abilities = stored(spread.select("k", "r", "n_resp", ((F.col("logit") - F.col("mean")) / F.col("sd")).alias("theta")), "abilities")
    answers = stored(m.responses.join(logits.select("r", "model_id", "logit"), "r").select("c", "obs", "model_id", "logit"), "holdout-answers")

    def meet(state: DataFrame) -> DataFrame:
        kept = answers.join(state.join(F.broadcast(moments), "k"), "c").filter(F.col("model_id") != F.col("holdout"))
        return kept.withColumn("theta", (F.col("logit") - F.col("mean")) / F.col("sd"))

    counts = held_out_counts(m, holdouts).select("k", "c", "n_resp", (F.col("n_right") / F.col("n_resp")).alias("p_correct"))
    items = stored(fit.newton_items(None, ["k"], meet=meet, counts=stored(counts, "holdout-counts")), "fit-items")
    items, abilities = fit.canonical_sign(fit.newton_intervals(items, None, ["k"], meet=meet), abilities, ["k"])
    abilities = stored(abilities, "abilities")
    return stored(fit.item_flags(items, abilities, ["k"]), "fit"), abilities


def joint_holdouts(m: ResponseMatrix, holdouts: DataFrame, priors: str, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Variational fits of all holdouts, side by side."""
    from respanel.operators import variational

    return variational.joint_fit(stored(held_out_responses(m, holdouts), "held-out"), ["k"], priors, epochs, seed)[:2]


def chosen_sets(items: DataFrame, points: DataFrame, sizes: list[int], by: list[str]) -> DataFrame:
    """(by, size, c): anchor sets of all sizes from one ranking, of which smaller sets are the head."""
    ranked = select.select_anchor(items, points, max(sizes), by)
    grid = items.sparkSession.createDataFrame([(s,) for s in sizes], "size long")
    return ranked.join(F.broadcast(grid), F.col("rank") <= F.col("size")).select(*by, "size", "c")


def errors(sets: DataFrame, m: ResponseMatrix, holdouts: DataFrame, by: list[str]) -> DataFrame:
    """(by, holdout, place, true_place, error) of the held-out model under every set."""
    scores = score.set_accuracy(sets, m.responses, m.respondents, by)
    placed = score.placements(scores, full_suite_accuracy(m), by)
    own = placed.join(holdouts, "k").filter(F.col("model_id") == F.col("holdout"))
    return own.select(*by, "holdout", "place", "true_place", F.abs(F.col("place") - F.col("true_place")).alias("error"))


def ability_errors(sets: DataFrame, items: DataFrame, reference: DataFrame, m: ResponseMatrix, holdouts: DataFrame, by: list[str], item_by: list[str] = ()) -> DataFrame:
    """(by, theta, place, error) by the held-out model's ability among the reference models; the true place is by accuracy on the set's models."""
    own = m.responses.join(m.respondents, "r").join(holdouts, F.col("model_id") == F.col("holdout")).select("k", "r", "c", "obs", "model_id")
    members = sets.join(own, ["k", "c"]) if "k" in by else sets.join(own, "c")
    params = items.select(*item_by, "c", "a", "b")
    answer = F.struct(F.col("c").alias("c"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("obs").cast("double").alias("y"))
    gathered = members.join(params, [*item_by, "c"]).groupBy(*by, "r").agg(F.sort_array(F.collect_list(answer)).alias("answers"))
    theta = gathered.select(*by, score.map_theta(F.col("answers")).alias("theta")).groupBy(*by).agg(F.avg("theta").alias("theta"))
    places = score.ability_places(theta, reference, by, ["k"])
    truth = errors(sets, m, holdouts, by).select(*by, "true_place")
    return theta.join(places, by).join(truth, by).withColumn("error", F.abs(F.col("place") - F.col("true_place")))


def random_sets(answered: DataFrame, sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    """(k, size, draw, c): as many items as the chosen set of (k, size) really has, from those the fit answered.

    ``answered``: k, c. ``sizes``: k, size, n_selected. One ranking of a
    (k, draw) gives the sets of all sizes. Only items whose hash is under a
    bound are ranked: it is passed by four times the items asked for, on the
    average, so that the rows ranked depend on the sets and not on the items.
    A draw in which fewer pass is ranked whole.
    """
    answered, sizes = stored(answered.select("k", "c"), "answered"), stored(sizes, "sizes-asked")
    grid = answered.sparkSession.range(draws).select(F.col("id").alias("draw"))
    asked = sizes.groupBy("k").agg(F.max("n_selected").alias("most"))
    asked = answered.groupBy("k").agg(F.count("*").alias("n")).join(asked, "k")
    asked = asked.select("k", F.least("most", "n").alias("need"), F.ceil((4 * F.col("most") + 64) * (HASHES / F.col("n"))).alias("under"))
    h = (F.col("c") * 7919 + F.col("draw") * 104729 + F.col("k") * 1299709 + seed * 15485863) % 1000003
    h = (h * h + F.col("c") * 31 + F.col("draw") * 17) % HASHES
    every = answered.join(F.broadcast(asked), "k").crossJoin(F.broadcast(grid)).withColumn("h", h)
    low = stored(every.filter("h < under").select("k", "draw", "c", "h"), "low-hashes")
    met = asked.crossJoin(F.broadcast(grid)).join(low.groupBy("k", "draw").agg(F.count("*").alias("met")), ["k", "draw"], "left")
    met = met.select("k", "draw", (F.coalesce("met", F.lit(0)) >= F.col("need")).alias("enough"))
    short = stored(met.filter("not enough").select("k", "draw"), "short-draws")
    rows = low.join(F.broadcast(short), ["k", "draw"], "left_anti")
    if not short.isEmpty():
        rows = rows.unionByName(every.join(F.broadcast(short), ["k", "draw"], "left_semi").select("k", "draw", "c", "h"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k", "draw").orderBy("h", "c")))
    return ranked.join(F.broadcast(sizes), "k").filter(F.col("rank") <= F.col("n_selected")).select("k", "size", "draw", "c")


def summary(chosen: DataFrame, random: DataFrame) -> DataFrame:
    """(size, mean_error, random_error, beats_random): means over holdouts, and the share of draws with a larger mean error."""
    own = chosen.groupBy("size").agg(F.count("*").alias("n_holdouts"), F.avg("error").alias("mean_error"))
    draws = random.groupBy("size", "draw").agg(F.avg("error").alias("draw_error"))
    both = draws.join(own, "size").withColumn("m", F.round("mean_error", 10)).withColumn("d", F.round("draw_error", 10))
    return both.groupBy("size").agg(
        F.first("n_holdouts").alias("n_holdouts"),
        F.first("mean_error").alias("mean_error"),
        F.avg("draw_error").alias("random_error"),
        score.beats(F.col("m"), F.col("d")).alias("beats_random"),
    )


def validation(m: ResponseMatrix, fit_fn, sizes=DEFAULT_SIZES, draws: int = 200, seed: int = 0, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary by size, rows by size and held-out model), places by accuracy and by ability.

    ``fit_fn(m, holdouts)`` gives (items with flags, abilities) of every k,
    fitted to the answers of the other models: ``newton_holdouts``, or
    ``joint_holdouts`` with its priors, steps and seed. The summary adds to ``summary`` the same three figures by ability, the
    fewest items that a set of the size really holds and the sets that fall
    short of it.
    """
    holdouts = stored(all_holdouts(m, only), "holdouts")
    m = ResponseMatrix(m.respondents, m.items, stored(m.responses, "responses"), m.respondent_key)
    items, abilities = fit_fn(m, holdouts)
    points = select.ability_points(abilities, m.respondents, ["k"])
    sets = stored(chosen_sets(items, points, list(sizes), ["k"]), "sets")
    realised = stored(sets.groupBy("k", "size").agg(F.count("*").alias("n_selected")), "realised")
    drawn = stored(random_sets(items.filter("n_resp > 0"), realised, draws, seed), "drawn")
    reference = stored(score.model_abilities(abilities, m.respondents, ["k"]), "reference")
    params = items.select("k", "c", "a", "b").filter("b is not null")

    def both(chosen: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
        return stored(errors(chosen, m, holdouts, by), "errors"), stored(ability_errors(chosen, params, reference, m, holdouts, by, ["k"]), "ability-errors")

    own, own_ability = both(sets, ["k", "size"])
    random, random_ability = both(drawn, ["k", "size", "draw"])
    by_ability = summary(own_ability, random_ability).select("size", *[F.col(c).alias(c.replace("error", "ability_error") if "error" in c else f"{c}_ability") for c in ("mean_error", "random_error", "beats_random")])
    filled = realised.groupBy("size").agg(F.min("n_selected").alias("min_selected"), F.sum((F.col("n_selected") < F.col("size")).cast("long")).alias("n_short"))
    rows = own.join(realised, ["k", "size"]).join(
        own_ability.select("k", "size", "theta", F.col("place").alias("ability_place"), F.col("error").alias("ability_error")), ["k", "size"], "left"
    )
    return summary(own, random).join(by_ability, "size", "left").join(filled, "size", "left"), rows
