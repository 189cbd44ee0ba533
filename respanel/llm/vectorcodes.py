"""Vector code compression: product codebooks by Lloyd's rounds with Hamerly's bounds, in whole numbers.

Every part of a vector keeps one upper bound on the distance to its entry and
one lower bound on the distance to the second nearest. Entries move between
rounds, and the bounds with them; only where they do not show strictly that
the entry stays nearest are all entries scanned. Distances are whole numbers
and bounds are rounded outwards, so results equal those of full scans,
ties to the lower index included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from respanel.llm.common import beside_keys, drop_stored, prepare, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components in steps lie below this, so that squared distances and their sums fit 64 bits.
MOST = 1 << 29


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, steps) of the rows without null or non-finite components: floor(4096 x) of each component."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & ~bad)
    # a float times 4096 is exact in doubles; what is too large is told apart by the caller
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(F.least(F.greatest(x, F.lit(-1e12)), F.lit(1e12)) * SCALE).cast("long")).alias("steps"))


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, second smallest squared distance) by a full scan; ties go to the lower index."""
    gaps = points[:, None, :] - book[None, :, :]
    squares = np.einsum("nkd,nkd->nk", gaps, gaps)
    entry = squares.argmin(axis=1)
    best = squares[np.arange(len(points)), entry]
    squares[np.arange(len(points)), entry] = np.iinfo(np.int64).max
    return entry, best, squares.min(axis=1)


def up(squares: np.ndarray) -> np.ndarray:
    """Roots of whole numbers, rounded to floats that are no smaller."""
    return np.nextafter(np.sqrt(squares.astype(np.float64) * (1 + 1e-15)), np.inf)


def down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64) * (1 - 1e-15)), -np.inf), 0.0)


class Codebooks:
    """Entries of every part, how far they moved since the last round, and half the distance to each entry's neighbour."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        parts, size, _ = entries.shape
        gaps = entries[:, :, None, :] - entries[:, None, :, :]
        apart = np.einsum("pabd,pabd->pab", gaps, gaps)
        apart[:, np.arange(size), np.arange(size)] = np.iinfo(np.int64).max
        self.half = down(apart.min(axis=2)) / 2
        self.fresh = before is None
        moved = up(np.einsum("pkd,pkd->pk", entries - before, entries - before)) if before is not None else np.zeros((parts, size))
        self.moved = np.where((entries == before).all(axis=2), 0.0, moved) if before is not None else moved
        # the farthest that any other entry moved
        order = np.sort(self.moved, axis=1)
        top, second = order[:, -1:], order[:, -2:-1] if size > 1 else order[:, -1:]
        alone = (self.moved == top).sum(axis=1, keepdims=True) == 1
        self.others = np.where((self.moved == top) & alone, second, top)

    def assign(self, points: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """New codes and bounds, in place, of points (n, parts, d); the number of full scans."""
        scans = 0
        for p in range(self.entries.shape[0]):
            own, book = points[:, p], self.entries[p]
            if self.fresh:
                open_ = np.arange(len(own))
            else:
                at = code[:, p]
                upper[:, p] = np.nextafter(upper[:, p] + self.moved[p][at], np.inf)
                lower[:, p] = np.maximum(np.nextafter(lower[:, p] - self.others[p][at], -np.inf), 0.0)
                limit = np.maximum(lower[:, p], self.half[p][at])
                open_ = np.flatnonzero(~(upper[:, p] < limit))
                gaps = own[open_] - book[at[open_]]
                upper[open_, p] = up(np.einsum("nd,nd->n", gaps, gaps))
                open_ = open_[~(upper[open_, p] < limit[open_])]
            if len(open_):
                entry, best, second = nearest(own[open_], book)
                code[open_, p], upper[open_, p], lower[open_, p] = entry, up(best), down(second)
                scans += len(open_)
        return scans


def _state_type(vectors: StructType) -> StructType:
    state = ("points", "code", "upper", "lower")
    own = [vectors["vec_id"], vectors["label"], *(StructField(c, BinaryType()) for c in state)]
    return StructType([StructField(f.name, f.dataType, True) for f in own] + [StructField("sums", ArrayType(LongType())), StructField("scans", LongType())])


def _assigned(state: DataFrame, schema: StructType, books: Codebooks, sums: bool) -> DataFrame:
    """One round: states with new codes and bounds and, as a last row of each task, its sums and counts of every entry."""
    parts, size, d = books.entries.shape
    sent = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, schema_ = sent.value, None
        total, scans = np.zeros((parts * size, d + 1), np.int64), 0
        for batch in batches:
            schema_ = batch.schema
            n = batch.num_rows
            column = lambda name, kind, wide=1: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, parts, wide)
            points = column("points", "<i4", d).astype(np.int64)
            if books.fresh:
                code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
            else:
                code = column("code", "u1")[:, :, 0].astype(np.int64)
                upper, lower = (column(x, "<f8")[:, :, 0].copy() for x in ("upper", "lower"))
            scans += books.assign(points, code, upper, lower)
            if sums:
                at = (code + size * np.arange(parts)).ravel()
                np.add.at(total, at, np.concatenate([points, np.ones((n, parts, 1), np.int64)], axis=2).reshape(n * parts, d + 1))
            rows = [[x.tobytes() for x in own] for own in (code.astype("u1"), upper.astype("<f8"), lower.astype("<f8"))]
            columns = [batch.column(c) for c in ("vec_id", "label", "points")] + [pa.array(x, pa.binary()) for x in rows]
            columns += [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if schema_ is not None:
            kinds = [schema_.field(c).type for c in ("vec_id", "label")] + [pa.binary()] * 4
            last = [pa.array([total.ravel().tolist() if sums else []], pa.list_(pa.int64())), pa.array([scans], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in kinds] + last, names=schema.names)

    return state.mapInArrow(run, schema)


def _moved(entries: np.ndarray, state: DataFrame) -> np.ndarray:
    """Entries as the floors of their points' means; the sums of all tasks have as many rows as numbers in the codebooks."""
    parts, size, d = entries.shape
    flat = state.filter("scans IS NOT NULL").select(F.posexplode("sums").alias("k", "x"))
    total = {r["k"]: int(r["x"]) for r in flat.groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    out = entries.copy()
    for p in range(parts):
        for e in range(size):
            base = (p * size + e) * (d + 1)
            if count := total.get(base + d, 0):
                out[p, e] = [total[base + j] // count for j in range(d)]
    return out


def _first_entries(kept: DataFrame) -> np.ndarray | None:
    first = kept.filter("vec_id IS NOT NULL").orderBy("vec_id", "steps").limit(ENTRIES).select("steps").collect()
    if not first:  # no ids at all
        first = kept.orderBy("steps").limit(ENTRIES).select("steps").collect()
    if not first:
        return None
    return np.array([r["steps"] for r in first], np.int64).reshape(len(first), PARTS, len(first[0]["steps"]) // PARTS).transpose(1, 0, 2).copy()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label) of every kept row.

    A round is one pass: states (points, codes, bounds) are read from the
    last round's table and written to the next, and the sums of the entries
    come as one row of each task. The codebooks alone reach the driver.

    Rows whose vector is null or holds null or non-finite components are
    dropped. All other vectors must be of one length that 8 divides, with
    components below 2 ** 17, for their squared distances to fit 64 bits;
    otherwise ``ValueError``. Empty vectors have the code 0 and no error.
    Rows without an id are coded but never begin a codebook (unless no row
    has one); repeated rows count and come back each by itself, and begin
    an entry each. Under 16 rows make as many entries. Null labels are one
    label. Other columns are ignored whatever their names. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    shape = kept.agg(
        F.min(F.size("steps")).alias("least"), F.max(F.size("steps")).alias("most"), F.max(F.greatest(F.lit(0), F.array_max(F.transform("steps", F.abs)))).alias("far")
    ).first()
    kinds = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label")).schema
    schema = _state_type(kinds)
    if shape["least"] is None:
        return spark.createDataFrame([], StructType([kinds["vec_id"]])).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256").withColumn("label", F.lit(None).cast(kinds["label"].dataType)).filter("false")
    if shape["least"] != shape["most"] or shape["least"] % PARTS:
        raise ValueError(f"vectors must have one length that {PARTS} divides, not {shape['least']} to {shape['most']}")
    if (shape["far"] or 0) >= MOST:
        raise ValueError(f"components of {MOST // SCALE} and more have squared distances over 64 bits")
    entries, before = _first_entries(kept), None

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x, "<i4").tobytes() for x in batch.column("steps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["vec_id", "label", "points"])

    start = StructType([StructField(f.name, f.dataType, True) for f in list(schema)[:3]])
    state, last = kept.mapInArrow(packed, start), None
    for k in range(rounds + 1):
        fresh = stored(_assigned(state, schema, Codebooks(entries, before), k < rounds), "vector-states")
        if k < rounds:
            entries, before = _moved(entries, fresh), entries
        if last is not None:
            drop_stored(last)
        last, state = fresh, fresh.filter("scans IS NULL")
    return _result(state, entries)


def _result(state: DataFrame, entries: np.ndarray) -> DataFrame:
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    parts, sent = entries.shape[0], state.sparkSession.sparkContext.broadcast(entries)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value
        for batch in batches:
            n = batch.num_rows
            points = np.frombuffer(b"".join(batch.column("points").to_pylist()), "<i4").reshape(n, parts, entries.shape[2]).astype(np.int64)
            raw = batch.column("code").to_pylist()
            code = np.frombuffer(b"".join(raw), "u1").reshape(n, parts)
            gaps = points - entries[np.arange(parts), code]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([x.hex() for x in raw]), pa.array((gaps * gaps).sum(axis=(1, 2)))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    names = [state.schema["vec_id"], state.schema["label"]]
    kinds = StructType([*names, *StructType().add("code", "string").add("error", "long")])
    rows = stored(state.select("vec_id", "label", "points", "code").mapInArrow(errors, kinds), "vector-codes")
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).cast("binary"))
    by_label = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = beside_keys(rows, by_label, "key", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """``compress`` over the table embeddings in DuckDB SQL: full scans, one step of the text a round."""
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "pt AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM k, range(8) t(p))",
        "b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 16) JOIN pt USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS (SELECT vec_id, label, pt.p, pt.x, e, list_sum([(pt.x[i] - b.x[i]) * (pt.x[i] - b.x[i]) FOR i IN range(1, len(pt.x) + 1)]) AS dist FROM pt JOIN b{r} b ON b.p = pt.p),"
            f" a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, arg_min(e, dist * 16 + e) AS e, min(dist) AS dist FROM d{r} GROUP BY vec_id, p)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT p, e, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL),"
                f" f{r} AS (SELECT p, e, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY p, e),"
                f" b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(f.x, b.x) AS x FROM b{r} b LEFT JOIN f{r} f ON f.p = b.p AND f.e = b.e)"
            )
    last = f"a{rounds}"
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS sha FROM b{rounds})")
    steps.append(f"c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM {last} GROUP BY vec_id)")
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM c, h"
    )
