"""Benchmark run names and prediction rows of a run directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metrics taken as the grade, in order of preference.
METRICS = ("exact_match", "quasi_exact_match", "math_equiv_chain_of_thought")


def parse_runs(runs: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Adds version, spec, model, params of ``.../runs/<version>/<spec>,model=<model>[,<params>]/``; null where the name is another."""
    path = F.regexp_replace(prefix, "/+$", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ok = name.rlike(r"model=")
    part = lambda pattern: F.when(ok, F.regexp_extract(name, pattern, 1))
    return runs.select(
        "*",
        F.when(ok, F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)).alias("version"),
        part(r"^(.*?)[,:]model=").alias("spec"),
        part(r"[,:]model=([^,]*)").alias("model"),
        part(r"[,:]model=[^,]*,(.*)$").alias("params"),
    )


def latest_runs(parsed: DataFrame, prefix: str = "prefix") -> DataFrame:
    """One run for each spec and model: the greatest version by numbers, then the shortest params, then the greatest name."""
    numbers = F.transform(F.split(F.regexp_replace("version", "^v", ""), r"\."), lambda x: x.try_cast("int"))
    order = Window.partitionBy("spec", "model").orderBy(F.desc(numbers), F.length(F.coalesce("params", F.lit(""))), F.desc(prefix))
    return parsed.filter("model is not null").withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def records(predictions: DataFrame, model: str, scenario: str) -> DataFrame:
    """Records of prediction rows (instance_id, stats map): the first preferred metric that any row has; rows without it go, other than 0 and 1 raises."""
    has = [F.max(F.col("stats")[m].isNotNull()).alias(m) for m in METRICS]
    found = predictions.agg(*has).first()
    chosen = next((m for m in METRICS if found[m]), None)
    rows = predictions.filter(F.lit(chosen is not None))
    value = F.col("stats")[chosen or METRICS[0]].cast("double")
    grade = F.when(value.isin(0.0, 1.0), value.cast("int")).otherwise(F.raise_error(F.concat(F.lit("grade must be 0 or 1, got "), value.cast("string"))).cast("int"))
    return rows.filter(value.isNotNull()).select(
        F.lit(model).alias("model_id"), F.concat(F.lit(scenario + "_"), "instance_id").alias("item_id"), grade.alias("correct"), F.lit(scenario).alias("subject")
    )


def scenario_of(item_id):
    """Item id without its instance number."""
    return F.regexp_replace(item_id, r"_id\d+$", "")
