"""Grades and records: total coercion to 0 or 1, or a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respanel.schema import FALSE_SPELLINGS, REQUIRED, TRUE_SPELLINGS, RecordError


def coerce_correct(value: Column) -> Column:
    """0 or 1 from a boolean, an exact 0/1 number or an accepted spelling; null refuses.

    Values arrive as text. A number must equal 0 or 1, so 0.5 and 2 are
    refused rather than thresholded.
    """
    text = F.lower(F.trim(value.cast("string")))
    number = F.when(text.rlike(r"^[+-]?[0-9]*\.?[0-9]+(e[+-]?[0-9]+)?$"), text.try_cast("double"))
    return (
        F.when(text.isin(*TRUE_SPELLINGS) | (number == 1), F.lit(1)).when(text.isin(*FALSE_SPELLINGS) | (number == 0), F.lit(0)).cast("int")
    )


def missing_fields(columns: dict[str, Column]) -> Column:
    """Names of the required fields that are null or empty, in order."""
    absent = [F.when(columns[n].isNull() | (F.trim(columns[n].cast("string")) == ""), F.lit(n)) for n in REQUIRED if n in columns]
    return F.array_compact(F.array(*absent))


def build_records(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Records of text rows with model_id, item_id, correct and optional fields.

    Adds ``_error`` (null if sound). ``strict`` runs one pass that finds the
    first bad row and raises ``RecordError`` with its source and line, then
    leaves the column out.
    """
    fields = {n: F.col(n) if n in rows.columns else F.lit(None).cast("string") for n in REQUIRED}
    missing, value = missing_fields(fields), coerce_correct(fields["correct"])
    error = F.when(F.size(missing) > 0, F.concat(F.lit("missing field "), F.array_join(missing, ", "))).when(
        value.isNull(), F.concat(F.lit("correct must be 0 or 1, got "), fields["correct"].cast("string"))
    )
    rest = [c for c in rows.columns if c not in REQUIRED]
    out = rows.select(
        fields["model_id"].cast("string").alias("model_id"), fields["item_id"].cast("string").alias("item_id"), value.alias("correct"), *rest, error.alias("_error")
    )
    if not strict:
        return out
    place = [c for c in ("_source", "_line") if c in rows.columns]
    bad = out.filter("_error is not null").orderBy(*place).select("_error", *place).limit(1).collect()
    if bad:
        raise RecordError(bad[0]["_error"], *(bad[0][c] for c in place))
    return out.drop("_error")


def respondent_id(key: list[str], available: list[str]) -> Column:
    """Identity of a respondent: the key's fields joined by ``|``; null where one is null, so that it is never skipped."""
    absent = [k for k in key if k not in available]
    if absent:
        raise RecordError(f"no column {', '.join(absent)} for the respondent key; {', '.join(sorted(available))} are available")
    whole = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    sound = F.lit(True)
    for k in key:
        sound = sound & F.col(k).isNotNull()
    return F.when(sound, whole)


def parse_key(spec: str) -> list[str]:
    """``"a,b"`` as field names: non-empty, with model_id, without repeats."""
    fields = [x.strip() for x in spec.split(",")]
    if not spec.strip() or "" in fields:
        raise ValueError(f"empty field in respondent key {spec!r}")
    if "model_id" not in fields:
        raise ValueError("a respondent key must contain model_id")
    if len(set(fields)) < len(fields):
        raise ValueError(f"a field repeats in respondent key {spec!r}")
    return fields
