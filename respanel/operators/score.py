"""Scoring sets of items: accuracy, places with ties, MAP abilities, ability places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respanel.functions.ranks import average_rank
from respanel.schema import THETA_BOUND, THETA_STEPS


def set_accuracy(members: DataFrame, responses: DataFrame, respondents: DataFrame, by: list[str]) -> DataFrame:
    """(by, model_id, accuracy): mean inside each respondent over the set, then over the model's answering respondents."""
    own = members.select(*by, "c").join(responses, "c")
    inner = own.groupBy(*by, "r").agg(F.avg("obs").alias("x")).join(respondents.select("r", "model_id"), "r")
    return inner.groupBy(*by, "model_id").agg(F.avg("x").alias("accuracy"))


def placements(scores: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(by, model_id, place, true_place) among the models known on both sides; average ranks, 1 is best.

    Values are rounded before ranking, so that the order of summation never
    breaks a tie.
    """
    both = scores.join(truth.select("model_id", F.col("accuracy").alias("truth")), "model_id").filter("accuracy is not null and truth is not null")
    both = both.withColumn("accuracy", F.round("accuracy", 10)).withColumn("truth", F.round("truth", 10))
    return both.select(*by, "model_id", average_rank(by, "accuracy").alias("place"), average_rank(by, "truth").alias("true_place"))


def map_theta(answers: Column, bound: float = THETA_BOUND, steps: int = THETA_STEPS) -> Column:
    """Ability of greatest posterior from an array of struct<a, b, y>: root of -theta + sum a (y - P) between the bounds.

    The score falls in theta, so Newton steps are kept between the ends that
    its sign has closed in on, and halve them where they would leave. All
    arrays of a batch are solved side by side, in pieces of bounded size.
    """

    def solve(a: np.ndarray, b: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        whose = np.repeat(np.arange(len(sizes)), sizes)
        low, high, at = np.full(len(sizes), -float(bound)), np.full(len(sizes), float(bound)), np.zeros(len(sizes))
        for _ in range(steps):
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-a * (at[whose] - b)))
            score = np.bincount(whose, a * (y - p), len(sizes)) - at
            fall = np.bincount(whose, a * a * p * (1 - p), len(sizes)) + 1
            low, high = np.where(score > 0, at, low), np.where(score > 0, high, at)
            new = at + score / fall
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            moved = float(np.abs(new - at).max(initial=0.0))
            at = new
            if moved < 1e-14 * bound:
                break
        return at

    def each(lists: pa.Array) -> pa.Array:
        out = []
        for first in range(0, len(lists), 512):
            part = lists.slice(first, 512)
            flat = part.flatten()
            a, b, y = (np.asarray(flat.field(x).cast(pa.float64()), dtype=float) for x in ("a", "b", "y"))
            out.append(solve(a, b, y, np.asarray(pc.list_value_length(part), dtype=np.int64)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(each, "double")(answers)


def estimate_abilities(
    members: DataFrame, items: DataFrame, responses: DataFrame, by: list[str], item_by: list[str] = (), bound: float = THETA_BOUND, steps: int = THETA_STEPS
) -> DataFrame:
    """(by, r, theta) of every respondent that answered something in the set. A set bounds the answers gathered for a respondent."""
    own = members.select(*by, "c").join(items.select(*item_by, "c", "a", "b"), [*item_by, "c"]).join(responses, "c")
    answer = F.struct(F.col("c").alias("c"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("obs").cast("double").alias("y"))
    gathered = own.groupBy(*by, "r").agg(F.sort_array(F.collect_list(answer)).alias("answers"))
    return gathered.select(*by, "r", map_theta(F.col("answers"), bound, steps).alias("theta"))


def model_abilities(abilities: DataFrame, respondents: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, model_id, theta): mean over the model's respondents."""
    return abilities.join(respondents.select("r", "model_id"), "r").groupBy(*by, "model_id").agg(F.avg("theta").alias("theta"))


def ability_places(own: DataFrame, reference: DataFrame, by: list[str], ref_by: list[str] = ()) -> DataFrame:
    """(by, place): 1 + how many reference models are above + half of those level. ``own``: by, theta."""
    ref = reference.select(*ref_by, F.round("theta", 10).alias("ref"))
    mine = own.withColumn("theta", F.round("theta", 10))
    both = mine.join(ref, list(ref_by)) if ref_by else mine.crossJoin(ref)
    above = F.sum(F.when(F.col("ref") > F.col("theta"), 1.0).when(F.col("ref") == F.col("theta"), 0.5).otherwise(0.0))
    return both.groupBy(*by).agg((1.0 + above).alias("place"))


def beats(error: Column, other: Column) -> Column:
    """Aggregate: share of draws with a larger error, ties counting half."""
    return F.avg(F.when(other > error, 1.0).when(other == error, 0.5).otherwise(0.0))
