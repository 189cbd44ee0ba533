"""Ragged respondent x item matrices: assembly with integrity checks, holdout, restriction, rates.

Matrices are long: ``responses`` (r, c, obs), ``respondents`` (r,
respondent_id, model_id), ``items`` (c, item_id, subject, split).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respanel.functions.coerce import respondent_id
from respanel.operators.store import stored
from respanel.schema import MatrixError


@dataclass(frozen=True)
class ResponseMatrix:
    respondents: DataFrame
    items: DataFrame
    responses: DataFrame
    respondent_key: tuple[str, ...] = ("model_id",)


def keyed(records: DataFrame, key: list[str]) -> DataFrame:
    """Adds respondent_id; a field of the key may be a column or a key of ``extra``."""
    rows = records
    for field in key:
        if field not in rows.columns and "extra" in rows.columns:
            rows = rows.withColumn(field, F.col("extra")[field])
    return rows.withColumn("respondent_id", respondent_id(key, rows.columns))


def duplicates(rows: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """The most repeated cells with their counts."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return counted.orderBy(F.desc("n"), *keys).limit(top)


def ownership_conflicts(rows: DataFrame) -> DataFrame:
    """Respondents that several models compose to."""
    return rows.groupBy("respondent_id").agg(F.count_distinct("model_id").alias("n_models")).filter("n_models > 1")


def encode(rows: DataFrame, name: str, index: str, order: str | None) -> DataFrame:
    """(index, name): positions from 0, by first appearance if ``order`` names a sequence, else by name.

    The window runs over the distinct names only.
    """
    if order:
        seen = rows.groupBy(name).agg(F.min(order).alias("__first"))
        return seen.select((F.row_number().over(Window.orderBy("__first", name)) - 1).cast("long").alias(index), name)
    return rows.select(name).distinct().select((F.row_number().over(Window.orderBy(name)) - 1).cast("long").alias(index), name)


def first_seen(rows: DataFrame, by: str, field: str, order: Column) -> DataFrame:
    """(by, field): the first value of ``field`` that isn't null, null if there is none."""
    known = rows.filter(F.col(field).isNotNull()).groupBy(by).agg(F.min_by(field, order).alias(field))
    return rows.select(by).distinct().join(known, by, "left")


def build_matrix(records: DataFrame, key: tuple[str, ...] = ("model_id",), order: str | None = "_seq", check: bool = True) -> ResponseMatrix:
    """Assemble records; raises ``MatrixError`` for empty input, repeated cells, and respondents of two models."""
    rows = keyed(records, list(key))
    order = order if order in rows.columns else None
    used = ["respondent_id", "model_id", "item_id", "correct", *[c for c in ("subject", "split", order) if c in rows.columns]]
    rows = stored(rows.select(*used), "records")  # read many times below, written once
    if check:
        if rows.isEmpty():
            raise MatrixError("no responses")
        if not rows.filter("respondent_id is null").isEmpty():
            raise MatrixError(f"a field of the respondent key {', '.join(key)} is missing in some row")
        if owners := ownership_conflicts(rows).limit(3).collect():
            raise MatrixError("one respondent, several models: " + ", ".join(f"{r['respondent_id']} ({r['n_models']})" for r in owners))
        if worst := duplicates(rows, ["respondent_id", "item_id"]).collect():
            raise MatrixError("repeated answers: " + ", ".join(f"{r['respondent_id']} x {r['item_id']} ({r['n']} times)" for r in worst))
    respondents = encode(rows, "respondent_id", "r", order).join(rows.groupBy("respondent_id").agg(F.min("model_id").alias("model_id")), "respondent_id")
    items = encode(rows, "item_id", "c", order)
    at = F.col(order) if order else F.struct("respondent_id")
    for field in ("subject", "split"):
        if field in rows.columns:
            items = items.join(first_seen(rows, "item_id", field, at), "item_id")
        else:
            items = items.withColumn(field, F.lit(None).cast("string"))
    responses = rows.join(respondents.select("respondent_id", "r"), "respondent_id").join(items.select("item_id", "c"), "item_id")
    return ResponseMatrix(
        respondents.select("r", "respondent_id", "model_id"),
        items.select("c", "item_id", "subject", "split"),
        responses.select("r", "c", F.col("correct").cast("int").alias("obs")),
        tuple(key),
    )


def item_rates(m: ResponseMatrix) -> DataFrame:
    """(c, item_id, n_resp, p_correct) of all items; unanswered: 0 and null."""
    counted = m.responses.groupBy("c").agg(F.count("*").alias("n_resp"), F.avg("obs").alias("p_correct"))
    return m.items.join(counted, "c", "left").select("c", "item_id", F.coalesce("n_resp", F.lit(0)).alias("n_resp"), "p_correct")


def respondent_accuracy(m: ResponseMatrix) -> DataFrame:
    counted = m.responses.groupBy("r").agg(F.count("*").alias("n_resp"), F.avg("obs").alias("accuracy"))
    return m.respondents.join(counted, "r", "left").select("r", "respondent_id", "model_id", F.coalesce("n_resp", F.lit(0)).alias("n_resp"), "accuracy")


def full_suite_accuracy(m: ResponseMatrix) -> DataFrame:
    """Per model the mean over its respondents of their accuracy, not pooled."""
    return respondent_accuracy(m).groupBy("model_id").agg(F.count("*").alias("n_respondents"), F.avg("accuracy").alias("accuracy"))


def shape(m: ResponseMatrix) -> DataFrame:
    """One row: n_respondents, n_real_models, n_items, n_responses, density."""
    people = m.respondents.agg(F.count("*").alias("n_respondents"), F.count_distinct("model_id").alias("n_real_models"))
    items, cells = m.items.agg(F.count("*").alias("n_items")), m.responses.agg(F.count("*").alias("n_responses"))
    whole = people.crossJoin(items).crossJoin(cells)
    return whole.withColumn("density", F.try_divide(F.col("n_responses").cast("double"), F.col("n_respondents") * F.col("n_items")))


def drop_model(m: ResponseMatrix, model_id: str) -> ResponseMatrix:
    """Without every respondent of a model; items stay. The only way to hold a model out."""
    left = m.respondents.filter(F.col("model_id") != model_id)
    return ResponseMatrix(left, m.items, m.responses.join(left.select("r"), "r", "left_semi"), m.respondent_key)


def select_items(m: ResponseMatrix, item_ids: list[str], check: bool = True) -> ResponseMatrix:
    """Restricted to the named items, renumbered in the order of the request (repeats once)."""
    spark = m.items.sparkSession
    wanted = spark.createDataFrame(list(enumerate(dict.fromkeys(item_ids))), "c_new long, item_id string")
    if check and (lost := wanted.join(m.items, "item_id", "left_anti").limit(3).collect()):
        raise MatrixError("unknown items: " + ", ".join(r["item_id"] for r in lost))
    kept = m.items.join(wanted, "item_id")
    responses = m.responses.join(kept.select("c", "c_new"), "c").select("r", F.col("c_new").alias("c"), "obs")
    return ResponseMatrix(m.respondents, kept.select(F.col("c_new").alias("c"), "item_id", "subject", "split"), responses, m.respondent_key)


def answered_by_all(m: ResponseMatrix, models: DataFrame) -> DataFrame:
    """Items that every listed model answered (relational division): c, item_id."""
    own = m.responses.join(m.respondents.select("r", "model_id"), "r").join(models, "model_id", "left_semi")
    held = own.groupBy("c").agg(F.count_distinct("model_id").alias("k"))
    need = models.agg(F.count_distinct("model_id").alias("need"))
    full = held.join(F.broadcast(need), F.col("k") == F.col("need"))
    return m.items.join(full.select("c"), "c", "left_semi").select("c", "item_id")


def single_category_items(m: ResponseMatrix) -> DataFrame:
    """Items answered all alike or not at all."""
    mixed = m.responses.groupBy("c").agg(F.min("obs").alias("low"), F.max("obs").alias("high")).filter("low <> high")
    return m.items.join(mixed, "c", "left_anti").select("c", "item_id")
