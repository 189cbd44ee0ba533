"""Per-sample logs of an evaluation harness: samples_<task>_<time>.jsonl beside results_<time>.json."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respanel.functions.coerce import build_records
from respanel.schema import FormatError, RecordError
from respanel.sources.jsonl import field, numbered_lines, parsed_objects
from respanel.sources.registry import Reader, register

# Metrics in order of preference; fields of a sample; keys of model arguments that name the model, in order.
METRICS = ("acc", "exact_match", "em", "acc_norm")
FIELDS = ("doc_id", "doc", "target", "arguments", "resps", "filtered_resps", "filter", "metrics", "doc_hash", "prompt_hash", "target_hash")
MODEL_KEYS = ("peft", "delta", "pretrained", "model", "path", "engine")


def task_of(name):
    """Task of a file name: between ``samples_`` and the last underscore; any other name keeps its stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    inner = F.regexp_extract(stem, r"^samples_(.*)_[^_]*$", 1)
    rest = F.regexp_extract(stem, r"^samples_(.+)$", 1)
    return F.when(stem.rlike(r"^samples_.*_[^_]*$"), inner).when(rest != "", rest).otherwise(stem)


def model_of(text: str) -> str | None:
    """Model named in a results file."""
    try:
        data = json.loads(text)
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    if isinstance(data.get("model_name"), str) and data["model_name"]:
        return data["model_name"]
    arguments = (data.get("config") or {}).get("model_args") if isinstance(data.get("config"), dict) else None
    if isinstance(arguments, str):
        arguments = dict(x.split("=", 1) for x in arguments.split(",") if "=" in x)
    if isinstance(arguments, dict):
        return next((str(arguments[k]) for k in MODEL_KEYS if isinstance(arguments.get(k), str) and arguments[k]), None)
    return None


def results_models(spark: SparkSession, path: str) -> DataFrame:
    """(folder, model): one row a folder with a results file that names its model."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "results_*.json", "wholetext": "true"}

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"file": frame["file"], "value": [model_of(x) for x in frame["value"]]})

    try:
        texts = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
        files = texts.mapInPandas(named, "file string, value string").filter("value is not null").orderBy("file").collect()  # names, not files
    except Exception as error:  # a folder without such files
        if "PATH_NOT_FOUND" in str(error):
            files = []
        else:
            raise
    found: dict[str, str] = {}
    for row in files:
        folder = row["file"].rsplit("/", 1)[0]
        found.setdefault(folder, row["value"])
    return spark.createDataFrame(list(found.items()), "folder string, model string")


def read_lmeval(spark: SparkSession, path: str, model_id: str | None = None, metric: str | None = None, filter: str | None = None, strict: bool = True) -> DataFrame:
    """Records of sample logs below ``path``: item <task>_<doc_id>, model from the results file or the folder.

    Of several filters the first named one of each file counts, or the given
    one; of several metrics the first preferred one, or the given one.
    """
    lines = numbered_lines(spark, path, recursiveFileLookup="true", **({} if path.endswith(".jsonl") else {"pathGlobFilter": "samples_*.jsonl"}))
    rows = parsed_objects(lines, strict).withColumn("filter", field("filter")).withColumn("doc_id", field("doc_id"))
    if rows.isEmpty():
        raise FormatError(f"no samples below {path}; log them with --log_samples")
    rows = rows.withColumn("folder", F.regexp_replace("_source", "/[^/]*$", "")).withColumn("task", task_of(F.regexp_extract("_source", "([^/]*)$", 1)))
    if filter is None:
        # one row a file is all that is gathered; the lines stay where they are read
        named = rows.filter("filter is not null").groupBy("_source").agg(F.min_by("filter", "_line").alias("wanted"))
        rows = rows.join(F.broadcast(named), "_source", "left")
    else:
        rows = rows.withColumn("wanted", F.lit(filter))
        if rows.filter(F.col("filter") == filter).isEmpty():
            raise RecordError(f"no sample has the filter {filter!r}")
    wanted = F.col("filter").isNull() | (F.col("filter") == F.col("wanted"))
    if dropped := rows.filter(~wanted).count():
        warnings.warn(f"{dropped} samples of other filters are left out", stacklevel=2)
    rows = rows.filter(wanted)
    names = F.from_json(field("metrics"), "array<string>")
    rows = rows.withColumn("metrics", names)
    if metric is not None:
        chosen = F.lit(metric)
    else:
        chosen = F.when(F.size("metrics") == 1, F.col("metrics")[0])
        for m in METRICS:
            chosen = chosen.when(F.array_contains("metrics", m) | (F.col("metrics").isNull() & field(m).isNotNull()), F.lit(m))
        # without a list of metrics, a single number beside the fixed fields is the metric
        numbers = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(*FIELDS) & v.try_cast("double").isNotNull())
        chosen = chosen.when(F.col("metrics").isNull() & (F.size(numbers) == 1), F.map_keys(numbers)[0])
    value = F.lit(None).cast("string")
    whole = F.from_json("value", "map<string,string>")
    rows = rows.withColumn("metric", chosen).withColumn("grade", F.coalesce(whole[F.col("metric")], value))
    if strict:
        bad = rows.filter("doc_id is null or metric is null or grade is null").orderBy("_source", "_line").select("_source", "_line", "doc_id", "metric").limit(1).collect()
        if bad:
            what = "no doc_id" if bad[0]["doc_id"] is None else "no known metric; name one" if bad[0]["metric"] is None else f"no metric {bad[0]['metric']!r}"
            raise RecordError(what, bad[0]["_source"], bad[0]["_line"])
    if model_id is not None:
        rows = rows.withColumn("model_id", F.lit(model_id))
    else:
        rows = rows.join(results_models(spark, path), "folder", "left")
        rows = rows.withColumn("model_id", F.coalesce("model", F.nullif(F.regexp_extract("folder", "([^/]*)$", 1), F.lit(""))))
    out = rows.select(
        "model_id",
        F.concat_ws("_", "task", "doc_id").alias("item_id"),
        F.col("grade").alias("correct"),
        F.coalesce(field("doc.subject"), "task").alias("subject"),
        F.map_filter(F.create_map(F.lit("task"), "task", F.lit("doc_id"), "doc_id", F.lit("metric"), "metric", F.lit("filter"), "filter"), lambda k, v: v.isNotNull()).alias("extra"),
        "_source",
        "_line",
        "_seq",
    )
    return build_records(out, strict)


def sniff(path: str, head: bytes) -> bool:
    for line in head.decode("utf-8", "replace").splitlines():
        if line.strip():
            try:
                keys = set(json.loads(line))
            except ValueError:
                keys = {k for k in ("doc_id", "item_id", "model_id") if f'"{k}"' in line}
            return line.lstrip().startswith("{") and "doc_id" in keys and not keys & {"item_id", "model_id"}
    return False


register(Reader("lmeval", (".jsonl",), sniff, read_lmeval, "per-sample logs of an evaluation harness"))
