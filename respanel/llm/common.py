"""What the operators of this subpackage share: scratch tables, Arrow helpers, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that carries texts. Batches are bounded in rows, so
#: a worker's memory follows the longest texts of one batch and not the table.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings the Arrow operators rely on; all are runtime settings.

    Vectored reads of a local file leave a direct buffer as long as a column
    chunk with every thread of a growing pool, outside the heap; whole texts
    make long chunks. Tables on other stores are read in order as well.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


#: Scratch paths this process made and has not deleted, in order.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place on one machine
    (tests); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder for intermediate tables")
        root = "file://" + tempfile.mkdtemp(prefix="respanel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def scratch_mark() -> int:
    """A place in the list of scratch paths, for ``drop_scratch``."""
    return len(_MADE)


def drop_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the scratch folders made after ``since``, but not those ``keep`` reads directly.

    For callers that have read or written their results: frames made from
    those folders cannot be read any more.
    """
    held = {name.rsplit("/", 2)[-2] for name in keep.inputFiles()} if keep is not None else set()
    own = _MADE[since:]
    _MADE[since:] = [x for x in own if x.rsplit("/", 1)[-1] in held]
    for path in own:
        if path.rsplit("/", 1)[-1] not in held:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by ``stored``."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def arrow_map(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1 ..., so that no name can clash with one of ours."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is the one column of ``gone``; rows without an id stay."""
    own = plain_names(docs)
    at = own[f"c{docs.columns.index(id_col)}"]
    lost = gone.toDF("gone_id").distinct()
    return own.join(lost, at == lost.gone_id, "left_anti").toDF(*docs.columns)


#: Repeated keys that are broadcast at once, at most: about 10 MB. A key held more often than this is dealt over all tasks.
FEW_KEYS, HOT = 100_000, 100_000


def holders(held: DataFrame, first: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``held`` whose ``on`` columns ``first`` has, with its ``owner``.

    ``first``: on, owner, n, the number of rows of every key. Few keys are
    broadcast. Else only the commonest are, at most ``FEW_KEYS`` since each
    has over sum(n) / ``FEW_KEYS`` rows, and the others meet by a shuffle, in
    which no key brings more rows than that to a task.
    """
    first = stored(first, "first-holders")
    size = first.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if size["keys"] <= FEW_KEYS:
        return held.join(F.broadcast(first.drop("n")), on)
    hot = F.col("n") > max(HOT, size["rows"] // FEW_KEYS)
    common, rare = first.filter(hot).drop("n"), first.filter(~hot).drop("n")
    near = held.join(F.broadcast(common), on)
    far = held.join(F.broadcast(common.select(*on)), on, "left_anti").join(rare, on)
    return near.unionByName(far)


def first_holders(held: DataFrame, on: list[str]) -> DataFrame:
    """(on, owner, n) of the keys of (doc_id, on) that several documents hold: the smallest holder and the number of rows."""
    seen = held.groupBy(*on).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), F.count("*").alias("n"))
    return seen.filter("top > owner").select(*on, "owner", "n")


def shared_keys(held: DataFrame) -> DataFrame:
    """(doc_id, key, owner): the rows of a stored table (doc_id, h1, h2) whose 128-bit key several doc_ids hold; owner is the smallest.

    Most keys are there once. They are told by their first half alone, so
    that the shuffles of all rows are narrow, and only the rest is compared
    in full. ``key``: the 16 bytes of the two halves, greatest byte first.
    """
    rest = stored(holders(held, first_holders(held, ["h1"]), ["h1"]).select("doc_id", "h1", "h2"), "repeated")
    on = ["h1", "h2"]
    found = holders(rest, first_holders(rest, on), on)
    return found.select("doc_id", F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in on])).alias("key"), "owner")


def later_holders(held: DataFrame) -> DataFrame:
    """(doc_id, key): the rows of ``shared_keys`` whose key some smaller doc_id holds too."""
    return shared_keys(held).filter("doc_id > owner").select("doc_id", "key")


def halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """16-byte keys as two columns of whole numbers."""
    pairs = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())


def beside_keys(rows: DataFrame, keyed: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` of their ``key`` in ``keyed`` (key, value, n rows), null where it has none.

    Few keys are broadcast and the rows stay where they are. Else only the
    commonest are, bounded as in ``holders``; the other rows meet
    theirs by a shuffle, those of common keys under a key of their own.
    """
    keyed = stored(keyed, "keyed")
    size = keyed.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    few = keyed.select(F.col("key").alias("__key"), F.col(value).alias("__value"))
    if size["keys"] <= FEW_KEYS:
        return rows.join(F.broadcast(few), F.col(key) == F.col("__key"), "left").drop("__key").withColumnRenamed("__value", value)
    hot = F.col("n") > max(HOT, size["rows"] // FEW_KEYS)
    common = keyed.filter(hot).select(F.col("key").alias("__common"), F.col(value).alias("__hot"))
    rare = keyed.filter(~hot).select(F.col("key").alias("__key"), F.col(value).alias("__value"))
    met = rows.join(F.broadcast(common), F.col(key) == F.col("__common"), "left")
    # a digest of another length than any key: dealt evenly, equal to none
    own = F.concat(F.unhex(F.md5(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c != key]))), F.lit(b"-"))
    met = met.withColumn("__at", F.when(F.col("__common").isNull(), F.col(key)).otherwise(own))
    joined = met.join(rare, F.col("__at") == F.col("__key"), "left").withColumn(value, F.coalesce("__hot", "__value"))
    return joined.drop("__key", "__value", "__common", "__hot", "__at")


def text_bytes(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def xor(col: str | Column, const: int) -> Column:
    return (F.col(col) if isinstance(col, str) else col).bitwiseXOR(F.lit(const))


def components(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 7) -> DataFrame:
    """Connected components of undirected ``edges`` between long ids: (node, label).

    Every node that some edge names comes back once; two nodes are connected
    exactly if their labels are equal. Rounds of contraction: each node moves
    to the least neighbour in an order that changes from round to round (ids
    XOR a constant of the round), so paths shrink by a constant factor and
    stars in one step. All steps are aggregations and equi-joins; nothing is
    collected but the number of remaining edges. Each round is written to the
    shared folder.
    """
    rng = np.random.default_rng(seed)
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "cc-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        c = int(rng.integers(-(2**62), 2**62))
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.least(xor(F.min(xor("b", c)), 0), xor(F.first("a"), c)).alias("m"))
        step = stored(step.select(F.col("a").alias("n"), xor("m", c).alias("m")), "cc-step")
        fresh = (
            edges.join(step, edges.a == step.n)
            .select(F.col("m").alias("a"), "b")
            .join(step, F.col("b") == step.n)
            .select("a", F.col("m").alias("b"))
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        fresh = stored(fresh, "cc-edges")
        labels = stored(
            labels.join(step, labels.label == step.n, "left").select("node", F.coalesce("m", "label").alias("label")), "cc-labels"
        )
        drop_stored(edges)
        edges = fresh
    return labels
