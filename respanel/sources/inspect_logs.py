"""Evaluation logs: one JSON object a file, or a ZIP of header.json and samples/*.json."""

from __future__ import annotations

import bz2
import json
import lzma
import re
import struct
import warnings
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respanel.functions.coerce import build_records
from respanel.operators.store import stored
from respanel.schema import RecordError
from respanel.sources.registry import SNIFF_BYTES, Reader, register

MEMBERS = "_source string, model string, task string, place long, header long, packed long, method int, sample string"
LOGS = "_source string, model string, task string, sample string, place long"
METHODS = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
#: Bytes of samples that a task fetches, about, and bytes it hands on at once.
FETCHED, HANDED = 64 << 20, 4 << 20


def file_of(path: str):
    """A seekable file that reads what it is asked for; ``path`` as Spark's file listing has it, not escaped."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    store, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(place)


def described(name: str, header: dict) -> tuple[str, str]:
    """(model, task) of a log."""
    spec = header.get("eval") or {}
    if not spec.get("model"):
        raise RecordError("a log that names no model", name, 1)
    return spec["model"], spec.get("task") or name.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def members(name: str, file) -> list[tuple]:
    """Samples of an archive by the order of their names: only its directory and its header are read."""
    with zipfile.ZipFile(file) as archive:
        for member in archive.infolist():
            if member.compress_type not in METHODS:
                raise RecordError(f"{member.filename} uses ZIP method {member.compress_type}; convert the log to JSON first", name, 1)
        model, task = described(name, json.loads(archive.read("header.json")))
        own = sorted((x for x in archive.infolist() if x.filename.startswith("samples/") and x.filename.endswith(".json")), key=lambda x: x.filename)
        return [(name, model, task, k, x.header_offset, x.compress_size, x.compress_type, None) for k, x in enumerate(own)]


def fetched(file, header: int, packed: int, method: int) -> bytes:
    """A member by its range: the local header tells where its bytes begin."""
    file.seek(header)
    fixed = file.read(30)
    if len(fixed) < 30 or fixed[:4] != b"PK\3\4":
        raise ValueError("no member begins there")
    names, extra = struct.unpack("<HH", fixed[26:30])
    file.seek(header + 30 + names + extra)
    raw = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -15)
    if method == zipfile.ZIP_BZIP2:
        return bz2.decompress(raw)
    if method == zipfile.ZIP_LZMA:
        size = struct.unpack("<H", raw[2:4])[0]
        kind = lzma._decode_filter_properties(lzma.FILTER_LZMA1, raw[4 : 4 + size])
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[kind]).decompress(raw[4 + size :])
    return raw


def samples(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample, as JSON text.

    Of an archive first the directory is read, a row a member; members are
    then dealt over tasks by their bytes and read by range, so that a large
    archive is the work of many tasks and never lies in one. A log that is
    one JSON object is read by the task that finds it.
    """
    skipping = not path.endswith((".json", ".eval"))  # a named file must be a log, files of a folder need not
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,eval}").load(path).select("path")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in MEMBERS.split(", ")]
        for name in (x for frame in frames for x in frame["path"]):
            with file_of(name) as file:
                head = file.read(SNIFF_BYTES)
                file.seek(0)
                if head[:2] == b"PK":
                    rows = members(name, file)
                elif skipping and not sniff(name, head):
                    continue
                else:
                    log = json.loads(file.read())
                    if not isinstance(log, dict) or not isinstance(log.get("samples"), list):
                        raise RecordError("a log without samples", name, 1)
                    model, task = described(name, log)
                    rows = [(name, model, task, k, None, None, None, json.dumps(s)) for k, s in enumerate(log["samples"])]
            for k in range(0, len(rows), 1000):
                yield pd.DataFrame(rows[k : k + 1000], columns=columns).astype({"header": "Int64", "packed": "Int64", "method": "Int32"})

    found = stored(files.mapInPandas(look, MEMBERS), "log-members")
    held = found.filter("sample is not null").select(*[x.split()[0] for x in LOGS.split(", ")])
    packed = found.filter("sample is null").drop("sample")
    size = packed.agg(F.coalesce(F.sum("packed"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if not size["n"]:
        return held
    tasks = min(size["n"], max(spark.sparkContext.defaultParallelism, size["bytes"] // FETCHED + 1))

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, file, rows, waiting = None, None, [], 0
        try:
            for x in (x for frame in frames for x in frame.itertuples(index=False)):
                if x[0] != at:
                    if file is not None:
                        file.close()
                    at, file = x[0], file_of(x[0])
                text = json.dumps(json.loads(fetched(file, int(x.header), int(x.packed), int(x.method))))
                rows.append((x[0], x.model, x.task, text, x.place))
                waiting += len(text)
                if waiting > HANDED:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOGS.split(", ")])
                    rows, waiting = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOGS.split(", ")])
        finally:
            if file is not None:
                file.close()

    dealt = packed.repartitionByRange(tasks, "_source", "header").sortWithinPartitions("_source", "header")
    return held.unionByName(dealt.mapInPandas(fetch, LOGS))


def grade_of(value):
    """C is right, I and N are wrong, P and lists are refused, the rest is coerced like any grade."""
    text = F.upper(F.trim(value))
    return F.when(text == "C", F.lit("1")).when(text.isin("I", "N"), F.lit("0")).when(text == "P", F.lit("partial")).otherwise(value)


def read_inspect(spark: SparkSession, path: str, scorer: str | None = None, strict: bool = True) -> DataFrame:
    """Records of logs below ``path``; unscored samples are left out, several scorers need one named."""
    rows = samples(spark, path).withColumn("scores", F.from_json(F.get_json_object("sample", "$.scores"), "map<string,string>"))
    scored = F.col("scores").isNotNull() & (F.size("scores") > 0)
    if lost := rows.filter(~F.coalesce(scored, F.lit(False))).count():
        warnings.warn(f"{lost} samples without a score are left out: missing, not wrong", stacklevel=2)
    rows = rows.filter(scored).withColumn("_line", F.col("place") + 1)
    files = rows.groupBy("_source").agg((F.max("place") + 1).alias("__n"))
    before = Window.orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_source", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rows = rows.join(F.broadcast(starts), "_source").withColumn("_seq", F.col("__start") + F.col("place"))
    if scorer is None:
        many = rows.filter("size(scores) > 1").select(F.array_join(F.map_keys("scores"), ", ").alias("names"), "_source", "_line").limit(1).collect()
        if many:
            raise RecordError(f"several scorers ({many[0]['names']}); name one", many[0]["_source"], many[0]["_line"])
        own = F.map_values("scores")[0]
    else:
        if missing := rows.filter(F.col("scores")[scorer].isNull()).select("_source", "_line").limit(1).collect():
            raise RecordError(f"no scorer {scorer!r}", *missing[0])
        own = F.col("scores")[scorer]
    out = rows.select(
        F.col("model").alias("model_id"),
        F.concat_ws("_", "task", F.get_json_object("sample", "$.id")).alias("item_id"),
        grade_of(F.get_json_object(own, "$.value")).alias("correct"),
        F.coalesce(F.get_json_object("sample", "$.metadata.subject"), "task").alias("subject"),
        F.map_filter(F.create_map(F.lit("task"), "task", F.lit("epoch"), F.get_json_object("sample", "$.epoch")), lambda k, v: v.isNotNull()).alias("extra"),
        "_source",
        "_line",
        "_seq",
    )
    return build_records(out, strict)


def sniff(path: str, head: bytes) -> bool:
    if head[:2] == b"PK":
        return path.endswith(".eval")
    text = head.decode("utf-8", "replace").lstrip()
    return text.startswith("{") and '"eval"' in text and '"item_id"' not in text


register(Reader("inspect", (".json", ".eval"), sniff, read_inspect, "evaluation logs with samples and scores"))
