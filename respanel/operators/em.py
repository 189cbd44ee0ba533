"""Marginal maximum likelihood by EM (Bock and Aitkin 1981), one pass over packed answers a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respanel.functions.irt import clamped_logit, difficulty
from respanel.operators import marginal
from respanel.operators.store import drop, stored


#: Estimates of separable items would run away beyond it.
BOUND = 100.0


def em_fit(responses: DataFrame, rounds: int = 100, nodes: int = 31, precision_a: float = 0.25, precision_d: float = 0.05, tol: float = 1e-5) -> tuple[DataFrame, list[float]]:
    """(items c, a, d, b; log likelihood before each round).

    E-step: posterior of every respondent over the nodes, expected answers by
    item and node, in one pass over the packed answers of ``marginal.objective``.
    M-step: three Newton steps on those counts, an item a row. Every round is
    written to the shared folder, so the plan of a round never holds the rounds before it. It ends when a round gains
    less than ``tol`` of the log likelihood, or after ``rounds``. Slopes and
    intercepts are held to 100 either way.
    """
    rates = responses.groupBy("c").agg(F.avg("obs").alias("p"))
    items = stored(rates.select(F.col("c").cast("long").alias("c"), F.lit(1.0).alias("a"), clamped_logit(F.col("p")).alias("d")), "em-items")
    target, history = marginal.objective(responses, nodes), []
    node, bound = target.node, BOUND

    def maximised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = (np.stack([np.asarray(batch.column(f"{x}{q}")) for q in range(len(node))], axis=1) for x in "nk")
            a, d = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "d"))
            value = pa.array(np.where(np.isnan(a), n[:, 0], 0.0))
            for _ in range(3):
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(a[:, None] * node + d[:, None])))
                w, miss = n * p * (1 - p), k - n * p
                ga, gd = miss @ node - precision_a * (a - 1), miss.sum(axis=1) - precision_d * d
                haa, had, hdd = w @ (node * node) + precision_a, w @ node, w.sum(axis=1) + precision_d
                det = haa * hdd - had * had
                a, d = np.clip(a + (hdd * ga - had * gd) / det, -bound, bound), np.clip(d + (haa * gd - had * ga) / det, -bound, bound)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(a), pa.array(d), value], names=["c", "a", "d", "value"])

    for _ in range(rounds):
        counts = target.expected(items).join(items.select("c", "a", "d"), "c", "left")
        fresh = stored(counts.mapInArrow(maximised, "c long, a double, d double, value double"), "em-items")
        whole = fresh.filter("c is null").first()
        history.append(whole["value"] if whole else None)
        if not whole or (len(history) > 1 and history[-1] - history[-2] < tol * abs(history[-1])):
            break
        drop(items)
        items = fresh.filter("c is not null").drop("value")
    return items.withColumn("b", difficulty(F.col("a"), F.col("d"))), history
