"""SimHash near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respanel.llm.common import arrow_map, components, holders, prepare, stored, text_bytes, without_ids

BITS = 64
#: Runs up to this length are compared by shifts over a whole batch.
SMALL_RUN = 16
#: Longer runs than this are split by blocks of their free bits before comparing.
LARGE_RUN = 4096
#: Rows of a comparison block; bounds memory at BLOCK * BLOCK bytes.
BLOCK = 1024


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, A-Z lower-cased, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    return np.array([hashed(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(raw: bytes, width: int) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half of the shingle hashes; no words: 0."""
    hashes = shingle_hashes(raw, width)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, whole texts."""
    prepare(docs.sparkSession)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(raw, width) for raw in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    return arrow_map(rows, "doc_id long, fp long", hashed)


def covering_masks(radius: int, seed: int = 11) -> np.ndarray:
    """2^(radius+1) - 1 masks of 64 bits (CoveringLSH, Pagh 2016).

    Each bit position gets a vector of radius+1 bits; mask v holds the
    positions whose vector has odd inner product with v. The vectors of at
    most ``radius`` differing positions span less than the whole space, so
    some v is orthogonal to all of them: under that mask the two
    fingerprints agree. Vectors are dealt evenly, so masks have equal weight.
    """
    span = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(np.arange(BITS) % span)
    masks = []
    for v in range(1, span):
        odd = [i for i in range(BITS) if bin(int(vectors[i]) & v).count("1") % 2]
        masks.append(sum(1 << i for i in odd))
    return np.array(masks, np.uint64)


def _block_edges(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one run: every fingerprint is tied to the first one near it, block by block."""
    out, n = [], len(fps)
    for i in range(0, n, BLOCK):
        rows = fps[i : i + BLOCK]
        for j in range(i, n, BLOCK):
            cols = fps[j : j + BLOCK]
            near = np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius
            if i == j:
                near = np.triu(near, 1)
            if near.any():
                out.append(forest(near, rows, cols, i == j))
    return out


def forest(near: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of ``near``, at most one per node."""
    x, y = np.nonzero(near)
    shift = 0 if same else len(rows)
    parent = np.arange(len(rows) if same else len(rows) + len(cols))
    keep = []
    for k, (p, q) in enumerate(zip(x.tolist(), (y + shift).tolist(), strict=True)):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        while parent[q] != q:
            parent[q] = parent[parent[q]]
            q = parent[q]
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep.append(k)
    return rows[x[keep]], cols[y[keep]]


def _run_edges(fps: np.ndarray, mask: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside one long run of distinct fingerprints that agree under ``mask``.

    A very long run is first split by the free bits: dealt over radius+1
    blocks, at most ``radius`` differing bits leave one block untouched, so
    comparing only inside equal blocks loses no link.
    """
    if len(fps) <= LARGE_RUN:
        return _block_edges(fps, radius)
    free = [i for i in range(BITS) if not mask >> i & 1]
    out = []
    for g in range(radius + 1):
        block = np.uint64(sum(1 << i for i in free[g :: radius + 1]))
        order = np.argsort(fps & block, kind="stable")
        sub = fps[order]
        cuts = np.flatnonzero(np.diff(sub & block)) + 1
        for part in np.split(sub, cuts):
            if len(part) > 1:
                out += _block_edges(part, radius)
    return out


def bucket_links(table: np.ndarray, key: np.ndarray, fps: np.ndarray, masks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, one, other) of links within runs of equal (table, key); the three arrays are sorted by them."""
    change = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
    starts = np.concatenate(([0], change))
    lengths = np.diff(np.concatenate((starts, [len(fps)])))
    left, right, own = [], [], []
    run = np.repeat(np.arange(len(starts)), lengths)
    small = np.repeat(lengths <= SMALL_RUN, lengths)
    for shift in range(1, min(SMALL_RUN, int(lengths.max(initial=1)))):
        at = np.flatnonzero(small[:-shift] & (run[:-shift] == run[shift:]))
        if not len(at):
            break
        differ = fps[at] ^ fps[at + shift]
        ok = np.bitwise_count(differ) <= radius
        at, differ = at[ok], differ[ok]
        if len(at):  # the pair comes from the first table in which it meets
            first = np.argmax((differ[:, None] & masks[None, :]) == 0, axis=1)
            at = at[first == table[at] % len(masks)]
            left.append(fps[at])
            right.append(fps[at + shift])
            own.append(table[at])
    for r in np.flatnonzero(lengths > SMALL_RUN):
        s, n = starts[r], lengths[r]
        for x, y in _run_edges(fps[s : s + n], int(masks[table[s] % len(masks)]), radius):
            left.append(x)
            right.append(y)
            own.append(np.full(len(x), table[s]))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none.astype(np.int64), *own]), np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (family, a, b) of distinct fingerprints whose closure joins every pair within ``radius`` bits.

    ``fps``: family (0 where there is only one kind of fingerprint) and fp,
    without repeats; only members of a family are held against each other.
    Each fingerprint goes to every covering table under its masked bits; a
    task sees whole buckets in sorted order, as a stream, and holds one
    bucket at a time: 8 bytes for each distinct fingerprint.
    """
    masks = covering_masks(radius)
    signed = masks.view(np.int64).tolist()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    dealt = fps.select("family", "fp", F.inline(tables)).select((F.col("family") * len(signed) + F.col("t")).cast("int").alias("table"), "key", "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] = []

        def emit(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            own, x, y = bucket_links(table, key, fp.view(np.uint64), masks, radius)
            family = pa.array((own // len(masks)).astype(np.int32))
            return pa.RecordBatch.from_arrays([family, pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["family", "a", "b"])

        pending: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            last = (cols[0][-1], cols[1][-1])
            cut = int(np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1])).max(initial=-1)) + 1
            if cut:
                whole = [np.concatenate([*(p[i] for p in pending), cols[i][:cut]]) for i in range(3)]
                pending = []
                yield emit(*whole)
            pending.append([c[cut:] for c in cols])
        if pending:
            tail = [np.concatenate([p[i] for p in pending]) for i in range(3)]
            yield emit(*tail)

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.select("table", "key", "fp").repartition(parts, "table", "key").sortWithinPartitions("table", "key", "fp")
    return sorted_.mapInArrow(linked, "family int, a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: groups of documents joined by near fingerprints.

    Two documents link if their fingerprints differ in at most ``radius``
    bits; ``component_id`` is the smallest id that links reach, the document
    itself included. Equal fingerprints are one node, so exact copies cost
    one row each however many there are, and a common fingerprint (zero: all
    texts without words) meets its component by a broadcast, not in one task.

    Null or wordless text: fingerprint zero, linked like any other. A null id
    keeps its row and never becomes a component_id unless no other id is
    there (then null). Repeated rows come back repeated. Empty table: empty
    result. Other columns of ``docs`` are ignored.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    labels = components(links(nodes.select(F.lit(0).alias("family"), "fp"), radius))
    member = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    member = stored(member, "simhash-member")
    root = member.groupBy("label").agg(F.min("least").alias("component_id"))
    named = member.join(root, "label").select("fp", F.col("component_id").alias("owner"), "n")
    return holders(rows, named, ["fp"]).select("doc_id", "fp", F.col("owner").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 3) -> DataFrame:
    """``docs`` without the documents that have a near duplicate of smaller id.

    Rows without an id stay. Rows that share an id count as one document.
    """
    groups = near_groups(docs, id_col, text_col, width, radius)
    return without_ids(docs, groups.filter("doc_id > component_id").select("doc_id"), id_col)
