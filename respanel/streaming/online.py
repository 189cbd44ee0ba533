"""Running rates of graded answers, in batch and as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_rates(answers: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, hour, n, p_correct): counts and share of correct answers up to each hour. ``answers`` has obs."""
    hourly = answers.groupBy(by, F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"), F.sum("obs").alias("k"))
    upto = Window.partitionBy(by).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("n").over(upto)
    return hourly.select(by, "hour", n.alias("n"), (F.sum("k").over(upto) / n).alias("p_correct"))


def windowed_rates(answers: DataFrame, by: str, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming or batch: (by, window, n, n_correct) of tumbling windows; answers later than ``late`` are left out."""
    return (
        answers.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("window"), F.col(by))
        .agg(F.count("*").alias("n"), F.sum("obs").alias("n_correct"))
        .select(by, "window", "n", "n_correct")
    )
