"""Removal of line runs that repeat across documents.

Chunks are cut at content-defined places: a rolling hash over the last lines
is compared with its neighbours, and its local minima are cuts, so that an
insertion moves only the cuts next to it. A 128-bit hash proposes the chunks
that several documents hold; they are grouped by their bytes. A repeated
passage keeps the lines between its ends and the nearest cuts, so ``whole``
adds the runs of the rolling window itself, which are proposed and compared
alike wherever they reach out of a repeated chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from respanel.llm.common import arrow_map, first_holders, halves, holders, plain_names, prepare, shared_keys, stored, text_bytes

#: Lines in the rolling window, and so the least lines of a chunk.
WINDOW = 2
FACTOR = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def rolling(lines: list[bytes]) -> list[int]:
    """Hash of the ``WINDOW`` lines that end at each line: the newest line comes in, the oldest goes out."""
    out, at, oldest = [], 0, pow(FACTOR, WINDOW, 1 << 64)
    hashed = [xxhash.xxh64_intdigest(x) for x in lines]
    for i, h in enumerate(hashed):
        at = (at * FACTOR + h) & MASK
        if i >= WINDOW:
            at = (at - hashed[i - WINDOW] * oldest) & MASK
        out.append(at ^ (at >> 32))
    return out


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """[start, end) line ranges: a cut follows a line whose rolling hash lies below its neighbours'.

    No two cuts are adjacent, so every chunk but the first and the last has
    two lines or more. A cut depends on the ``WINDOW`` + 2 lines around it and
    on no cut before, whatever comes earlier in the text.
    """
    rolled = rolling(lines)
    cuts = [i + 1 for i in range(1, len(lines) - 1) if rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1]]
    edges = [0, *cuts, len(lines)]
    return [(s, e) for s, e in zip(edges[:-1], edges[1:], strict=True) if e > s]


def chunk_ranges(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks with two or more lines that hold words, without blank lines at their ends."""
    if len(lines) < 2:
        return []
    out = []
    for s, e in chunks(lines):
        held = [k for k in range(s, e) if lines[k].strip()]
        if len(held) > 1:
            out.append((held[0], held[-1] + 1))
    return out


def candidates(raw: bytes) -> list[tuple[int, bytes]]:
    """(first line, bytes) of the chunks that may be removed."""
    lines = raw.split(b"\n")
    return [(s, b"\n".join(lines[s:e])) for s, e in chunk_ranges(lines)]


def run_ranges(lines: list[bytes]) -> list[tuple[int, int]]:
    """[start, end) of each run of ``WINDOW`` lines with words; blank lines between them belong to it."""
    worded = [k for k, x in enumerate(lines) if x.strip()]
    return [(s, e + 1) for s, e in zip(worded, worded[WINDOW - 1 :], strict=False)]


def all_ranges(lines: list[bytes], whole: bool) -> list[tuple[int, int]]:
    """Chunks, with ``whole`` runs too, in order of their first line; a chunk of two lines is also a run and stands once."""
    return sorted({*chunk_ranges(lines), *(run_ranges(lines) if whole else ())})


def part_key(part: bytes) -> bytes:
    return xxhash.xxh3_128_digest(part)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw")).filter("doc_id is not null")


def _keys(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(doc_id, h1, h2): 128-bit keys of the chunks and runs of every row, each key once a row."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, keys = [], []
        for raw in batch.column(1).to_pylist():
            lines = raw.split(b"\n")
            own = dict.fromkeys(part_key(b"\n".join(lines[s:e])) for s, e in all_ranges(lines, whole))
            counts.append(len(own))
            keys += own
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        return pa.RecordBatch.from_arrays([ids, *halves(keys)], names=["doc_id", "h1", "h2"])

    return arrow_map(_lines(docs, id_col, text_col), "doc_id long, h1 long, h2 long", cut)


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, first, later): by key, what a document shares with others: as smallest id of the key or as a later one."""
    held = stored(_keys(docs, id_col, text_col, whole), "line-keys")
    shared = shared_keys(held)
    key = F.when(F.col("doc_id") > F.col("owner"), F.col("key"))
    own = F.when(F.col("doc_id") <= F.col("owner"), F.col("key"))
    return shared.groupBy("doc_id").agg(F.collect_list(own).alias("first"), F.collect_list(key).alias("later"))


def to_compare(raw: bytes, first: set[bytes], later: set[bytes], whole: bool) -> list[bytes]:
    """The parts of a text whose bytes have to be compared: proposed chunks, and proposed runs that reach out of the chunks that may go.

    A run inside a chunk that may go needs no look: its bytes are part of the
    chunk's, whose smallest holder has the run too.
    """
    lines = raw.split(b"\n")
    out, covered = {}, [0] * len(lines)
    for s, e in chunk_ranges(lines):
        part = b"\n".join(lines[s:e])
        if (key := part_key(part)) in later:
            covered[s:e] = [s + 1] * (e - s)
        if key in later or key in first:
            out[part] = None
    for s, e in run_ranges(lines) if whole else ():
        if not (covered[s] and covered[s] == covered[e - 1]):
            part = b"\n".join(lines[s:e])
            if (key := part_key(part)) in later or key in first:
                out[part] = None
    return list(out)


def chunk_key(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, key): the chunks, with ``whole`` runs, that a document of smaller id also holds.

    Hash keys only propose; what they propose is grouped by its bytes. Parts
    that one document alone holds never leave their task.
    """
    rows = _lines(docs, id_col, text_col).join(proposals(docs, id_col, text_col, whole), "doc_id")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, parts = [], []
        for raw, first, later in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            own = to_compare(raw, set(first), set(later), whole)
            counts.append(len(own))
            parts += own
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        return pa.RecordBatch.from_arrays([ids, pa.array(map(chunk_key, parts), pa.binary()), pa.array(parts, pa.binary())], names=["doc_id", "key", "part"])

    said = stored(arrow_map(rows, "doc_id long, key binary, part binary", cut), "line-parts")
    first = first_holders(said, ["part"]).select(F.substring(F.unhex(F.sha2("part", 256)), 1, 16).alias("key"), "owner", "n")
    return holders(said.select("doc_id", "key"), first, ["key"]).filter("doc_id > owner").select("doc_id", "key")


def without(raw: bytes, gone: set[bytes], whole: bool = False) -> tuple[bytes, int]:
    """(text without the lines of chunks, with ``whole`` of runs, that ``gone`` names or that repeat inside the text, lines removed)."""
    lines = raw.split(b"\n")
    lost, seen = [False] * len(lines), {}
    for s, e in all_ranges(lines, whole):
        key = chunk_key(b"\n".join(lines[s:e]))
        if key in gone or s >= seen.setdefault(key, e):
            lost[s:e] = [True] * (e - s)
    return b"\n".join(x for x, out in zip(lines, lost, strict=True) if not out), sum(lost)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` with every column, ``text_col`` without its repeated lines, plus ``__removed``, the lines removed.

    A chunk of two or more lines with words stays in the document of smallest
    id that holds it and goes from all others; inside one document its first
    place stays. With ``whole`` so does every run of two lines with words
    (and the blank lines between), so that a repeated passage goes from its
    first line to its last wherever chunks are cut.

    Texts of one line and lines that repeat alone never change. Kept lines
    stay in order, joined by a line feed, byte for byte. A null text stays
    null (0 lines removed); a row without an id is held against no other and
    loses only its own repetitions. Rows that share an id count as one
    document: both keep what either holds first. Very long texts are cut as
    a whole. Columns may have any names. Empty table: empty result.
    """
    prepare(docs.sparkSession)
    own, names, at = plain_names(docs), docs.columns, docs.columns.index(text_col)
    inner = own.columns
    gone = removals(docs, id_col, text_col, whole)
    gone = gone.groupBy("doc_id").agg(F.collect_list("key").alias("gone"))
    joined = own.join(gone, F.col(f"c{names.index(id_col)}") == F.col("doc_id"), "left").drop("doc_id")

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
            kept, n = (None, 0) if text is None else without(text.encode(), set(gone or ()), whole)
            texts.append(kept if kept is None else kept.decode())
            counts.append(n)
        cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*inner, "removed"])

    return arrow_map(joined, StructType([*own.schema.fields, StructField("removed", LongType())]), rebuilt).toDF(*names, "__removed")
