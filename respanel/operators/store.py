"""Stored fits and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Unset, it is a temporary one on one machine, as in tests, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder for intermediate tables")
        root = "file://" + tempfile.mkdtemp(prefix="respanel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever reads it and however often."""
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by ``stored``; what is read from it afterwards fails."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SCHEMA_VERSION = 2
TABLES = ("respondents", "items", "responses", "meta")


def save_fit(path: str, respondents: DataFrame, items: DataFrame, responses: DataFrame | None, meta: dict) -> None:
    """A fit as a folder of Parquet tables; ``meta`` is one row of JSON with the schema version."""
    import json

    spark = items.sparkSession
    respondents.write.mode("overwrite").parquet(f"{path}/respondents")
    items.write.mode("overwrite").parquet(f"{path}/items")
    if responses is not None:
        responses.write.mode("overwrite").parquet(f"{path}/responses")
    row = json.dumps({"schema_version": SCHEMA_VERSION, "embedded": responses is not None} | meta, sort_keys=True)
    spark.createDataFrame([(row,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


#: Columns that order the rows of a table in a file.
ORDER = {"respondents": ["r"], "items": ["c"], "responses": ["c", "r", "obs"]}


def export_fit(fit: dict, path: str) -> None:
    """A loaded fit as one gzip file of JSON lines, for other programmes: a head, then the rows of each table in order.

    Equal fits give equal bytes, wherever they are written: the gzip header
    holds no time and no name. Rows are streamed through the file system that
    Spark uses for ``path``, a partition at a time; none is held longer.
    The name must end in .gz, which tells readers how to open it.
    """
    import gzip
    import io
    import json

    from pyspark.sql import functions as F

    from respanel.schema import ArtifactError

    if not path.endswith(".gz"):
        raise ArtifactError(f"the file of a fit ends in .gz, not {path}")
    spark = fit["items"].sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)

    class Sink(io.RawIOBase):
        def writable(self) -> bool:
            return True

        def write(self, data) -> int:
            stream.write(bytearray(data))
            return len(data)

    schemas = {k: json.loads(fit[k].schema.json()) if fit[k] is not None else None for k in TABLES[:3]}
    head = {"schema_version": SCHEMA_VERSION, "meta": fit["meta"], "schemas": schemas}
    try:
        with io.BufferedWriter(Sink(), 1 << 20) as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as file:
            file.write(json.dumps(head).encode() + b"\n")
            for name in TABLES[:3]:
                if fit[name] is None:
                    continue
                order = [c for c in ORDER[name] if c in fit[name].columns]
                line = F.to_json(F.struct(F.lit(name).alias("table"), F.struct(*fit[name].columns).alias("row")))
                for row in fit[name].orderBy(*order).select(line.alias("line")).toLocalIterator():
                    file.write(row["line"].encode() + b"\n")
    finally:
        stream.close()


def import_fit(spark: SparkSession, path: str) -> dict:
    """Inverse of ``export_fit``, with all checks of ``load_fit``; a file of another shape or version raises ``ArtifactError``.

    The lines are read and parsed by a task and written to the shared folder
    once, since a gzip file has no parts.
    """
    import json

    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType, StructField, StructType

    from respanel.schema import ArtifactError

    try:
        lines = spark.read.text(path)
        head = json.loads(lines.filter(F.col("value").startswith('{"schema_version"')).first()["value"])
        if head["schema_version"] != SCHEMA_VERSION:
            raise ArtifactError(f"schema version {head['schema_version']!r}, this reads {SCHEMA_VERSION}")
        lines = stored(lines, "fit-lines")
        frames = {}
        for name in TABLES[:3]:
            if head["schemas"][name] is None:
                frames[name] = None
                continue
            own = StructType.fromJson(head["schemas"][name])
            parsed = F.from_json("value", StructType([StructField("table", StringType()), StructField("row", own)]), {"mode": "FAILFAST"})
            rows = lines.filter(F.col("value").startswith(f'{{"table":"{name}",')).select(parsed.alias("x"))
            frames[name] = stored(rows.select("x.row.*"), f"fit-{name}")
    except (PySparkException, Py4JError, ValueError, KeyError, TypeError) as error:
        if isinstance(error, ArtifactError):
            raise
        raise ArtifactError(f"{path} holds no fit: {str(error).splitlines()[0]}") from error
    verify(frames["items"])
    return frames | {"meta": head["meta"]}


def verify(items: DataFrame) -> None:
    """Raises for an item with contradictory or unknown flags, or an interval whose ends are the wrong way round."""
    from pyspark.sql import functions as F

    from respanel.schema import FLAGS, ArtifactError

    readings = F.size(F.array_intersect("flags", F.array(*[F.lit(f) for f in FLAGS[:3]])))
    unknown = F.size(F.array_except("flags", F.array(*[F.lit(f) for f in FLAGS])))
    crossed = [F.col(f"{x}_lo") > F.col(f"{x}_hi") for x in ("a", "b") if f"{x}_lo" in items.columns]
    wrong = (readings > 1) | (unknown > 0)
    for x in crossed:
        wrong = wrong | F.coalesce(x, F.lit(False))
    if bad := items.filter(wrong).limit(1).collect():
        raise ArtifactError(f"item {bad[0]['item_id']} has contradictory flags or an inverted interval")


def load_fit(spark: SparkSession, path: str, check: bool = True) -> dict:
    """respondents, items, responses (None if not embedded) and meta of a stored fit, a folder or one .gz file; only this version is read."""
    import json

    from pyspark.errors import AnalysisException

    from respanel.schema import ArtifactError

    if path.endswith(".gz"):
        return import_fit(spark, path)
    try:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        people, items = spark.read.parquet(f"{path}/respondents"), spark.read.parquet(f"{path}/items")
    except AnalysisException as error:
        raise ArtifactError(f"no fit at {path}: {str(error).splitlines()[0]}") from error
    if meta.get("schema_version") != SCHEMA_VERSION:
        raise ArtifactError(f"schema version {meta.get('schema_version')!r}, this reads {SCHEMA_VERSION}")
    if check:
        verify(items)
    responses = spark.read.parquet(f"{path}/responses") if meta["embedded"] else None
    return {"respondents": people, "items": items, "responses": responses, "meta": meta}
