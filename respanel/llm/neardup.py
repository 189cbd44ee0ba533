"""Near-duplicate documents on five-word shingles, each link verified exactly.

Covering SimHash tables propose links between fingerprints within 3 bits.
They miss pairs whose change moves more bits, so a prefix filter proposes the
rest: two shingle sets of Jaccard similarity ``SIMILARITY`` or more share a
shingle among the rarest fifth of each (Chaudhuri et al. 2006), whatever
changed between them. Texts that do fall into one cluster of candidates.
Texts of a large cluster are compared with a few of its texts first; then
every pair of a cluster is compared that verified links don't join yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respanel.llm.common import arrow_map, components, prepare, stored, text_bytes, without_ids
from respanel.llm.simhash import fingerprint, forest, links

SIMILARITY, WIDTH, RADIUS = 0.8, 5, 3
#: A node with many links is joined in so many parts.
SALT = 32
#: In a cluster of more texts than this, every text is first compared with so many of its texts.
HUB_FROM, HUBS = 128, 8
#: Shingles that a task of the prefix filter holds at once, about.
PART = 250_000
#: Texts of a block; a cluster of more is compared block against block, so a task holds two blocks.
BLOCK = 1024
#: Shingles that so many texts of a comparison share, or fewer, are counted pair by pair; commoner ones by matrix products.
RARE = 16


def shingle_keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the different five-word shingles (fewer words: the whole)."""
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - WIDTH + 1
    out = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted 32-bit hashes of the different five-word shingles (fewer words: the whole)."""
    if not words:
        return np.zeros(0, np.int32)
    runs = zip(*(words[k:] for k in range(WIDTH)), strict=False) if len(words) >= WIDTH else [words]
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(b" ".join(r)) for r in runs), np.uint32)).view(np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, n, fp): hash of the words, number of words, SimHash of the five-word shingles."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, 4), np.int64)
        for i, raw in enumerate(batch.column(1).to_pylist()):
            words = raw.lower().split()
            out[i, :2] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
            out[i, 2:] = len(words), fingerprint(raw, WIDTH)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k].copy()) for k in range(4))], names=["doc_id", "h1", "h2", "n", "fp"])

    return arrow_map(rows, "doc_id long, h1 long, h2 long, n long, fp long", signed)


#: A shingle of a text: the text by the first hash of its words, its number of shingles, the shingle, how many texts hold it.
ENTRY = np.dtype([("text", "<i8"), ("size", "<i4"), ("held", "<i4"), ("key", "<u8")])


def packed(entries: np.ndarray, by: str, parts: int) -> pa.RecordBatch:
    """(part, entries): the entries as bytes, dealt over ``parts`` by a field."""
    part = (entries[by].view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, entries = part[order], entries[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*starts[1:].tolist(), len(part)]
    blobs = [entries[x:y].tobytes() for x, y in zip(starts.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(blobs, pa.binary())], names=["part", "entries"])


def by_part(rows: DataFrame, schema: str, fn: Callable[[np.ndarray], pa.RecordBatch]) -> DataFrame:
    """``fn`` of all entries of each part of (part, entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != part and held:
                    yield fn(np.frombuffer(b"".join(held), ENTRY))
                    held = []
                part = own
                held.append(blob)
        if held:
            yield fn(np.frombuffer(b"".join(held), ENTRY))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def shared(entries: np.ndarray) -> np.ndarray:
    """The entries whose shingle two texts or more hold, with their number, in the order of texts."""
    entries = entries[np.lexsort((entries["text"], entries["key"]))]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["text"][1:] != entries["text"][:-1])
    entries = entries[new]  # equal texts count once
    starts = np.flatnonzero(np.concatenate(([True], entries["key"][1:] != entries["key"][:-1])))
    counts = np.diff(np.append(starts, len(entries)))
    entries["held"] = np.repeat(counts, counts)
    entries = entries[entries["held"] > 1]
    return entries[np.argsort(entries["text"], kind="stable")]


def prefixes(entries: np.ndarray) -> np.ndarray:
    """Of the shared shingles of whole texts those among the rarest of a text, by (texts that hold it, shingle).

    A partner of similarity ``SIMILARITY`` shares at least that part of the
    shingles, so all but one fewer of them are enough to meet it in one.
    Shingles of the text that are not here are its own and come first.
    """
    entries = entries[np.lexsort((entries["key"], entries["held"], entries["text"]))]
    starts = np.flatnonzero(np.concatenate(([True], entries["text"][1:] != entries["text"][:-1])))
    counts = np.diff(np.append(starts, len(entries)))
    size = entries["size"].astype(np.int64)
    rank = np.arange(len(entries)) - np.repeat(starts, counts) + size - np.repeat(counts, counts)
    needed = np.ceil(SIMILARITY * size - 1e-6).astype(np.int64)
    return entries[rank <= size - needed]


def met(entries: np.ndarray) -> np.ndarray:
    """(text, other) rows that join the texts of each shingle."""
    entries = entries[np.lexsort((entries["text"], entries["key"]))]
    starts = np.flatnonzero(np.concatenate(([True], entries["key"][1:] != entries["key"][:-1])))
    first = np.repeat(entries["text"][starts], np.diff(np.append(starts, len(entries))))
    pairs = np.stack([first, entries["text"]], axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def candidate_clusters(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, cluster) of the texts with a candidate: closure of a shared shingle among the rarest.

    Shingles travel as bytes, dealt first by shingle, to count the texts that
    hold each, then by text, to find the rarest, and by shingle again. No
    pair of texts is ever a row: all texts of a shingle join its first.
    """
    parts = max(1, math.ceil((nodes.agg(F.sum("n")).first()[0] or 0) / PART))
    rows = docs.select(text_bytes(text_col).alias("raw"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keys = [], []
        for raw in dict.fromkeys(batch.column(0).to_pylist()):
            words = raw.lower().split()
            texts.append(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)[0])
            keys.append(shingle_keys(words))
        sizes = np.array([len(k) for k in keys])
        out = np.zeros(sizes.sum(), ENTRY)
        out["text"], out["size"], out["key"] = np.repeat(np.array(texts), sizes), np.repeat(sizes, sizes), np.concatenate(keys)
        return packed(out, "key", parts)

    held = "part int, entries binary"
    counted = by_part(arrow_map(rows, held, cut), held, lambda e: packed(shared(e), "text", parts))
    rarest = by_part(counted, held, lambda e: packed(prefixes(e), "key", parts))

    def joined(entries: np.ndarray) -> pa.RecordBatch:
        pairs = met(entries)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    labels = components(by_part(rarest, "a long, b long", joined))
    return nodes.join(labels.withColumnRenamed("node", "text"), F.col("h1") == F.col("text")).select("node", F.col("label").alias("cluster"))


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every two sets of Jaccard similarity ``SIMILARITY`` or more, at most one fewer than sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(flat)) + 1))
    counts = np.diff(np.concatenate((starts, [len(flat)])))
    common = np.zeros((n, n), np.float32)
    for f in range(2, RARE + 1):
        own = owner[starts[counts == f][:, None] + np.arange(f)] if (counts == f).any() else np.zeros((0, f), np.int64)
        for x in range(f if len(own) else 0):
            for y in range(x + 1, f):
                np.add.at(common, (own[:, x], own[:, y]), 1)
    columns = np.flatnonzero(counts > RARE)
    for k in range(0, len(columns), 1024):
        table = np.zeros((n, min(1024, len(columns) - k)), np.float32)
        for j, c in enumerate(columns[k : k + 1024]):
            table[owner[starts[c] : starts[c] + counts[c]], j] = 1
        common += np.triu(table @ table.T, 1)
    total = sizes[:, None] + sizes[None, :]
    near = np.triu(common >= SIMILARITY * (total - common) - 1e-3, 1) & (common > 0)
    x, y = forest(near, np.arange(n), np.arange(n), True)
    return x, y


def proposed(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints the covering tables bring within ``RADIUS`` bits; equal ones join the first.

    Of each node the link to the smallest partner is kept, a row a node. The
    comparison inside clusters makes up for the others.
    """
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("held")), "nd-fingerprints")
    equal = nodes.join(first.filter("held > 1"), "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select(F.lit(0).alias("family"), "fp"), RADIUS)
    at = first.select("fp", "first")
    near = near.join(at.toDF("a", "one"), "a").join(at.toDF("b", "other"), "b").select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
    return equal.unionByName(near).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def to_hubs(clusters: DataFrame) -> DataFrame:
    """(a, b): every node of a large cluster beside ``HUBS`` of its nodes, one of each part of the hash range."""
    large = clusters.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > HUB_FROM).select("cluster")
    member = clusters.join(large, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(HUBS)))
    hubs = member.groupBy("cluster", "part").agg(F.min("node").alias("a"))
    return member.select("cluster", F.col("node").alias("b")).join(hubs.select("cluster", "a"), "cluster").filter("a <> b").select("a", "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the documents whose id is a node of ``wanted``."""
    rows = docs.select(F.col(id_col).cast("long").alias("node"), text_bytes(text_col).alias("raw"))

    def to_set(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(raw.lower().split()) for raw in batch.column(1).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *sets]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["node", "shingles"])

    return arrow_map(rows.join(wanted.select("node").distinct(), "node", "left_semi"), "node long, shingles array<int>", to_set)


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) between sets of Jaccard similarity ``SIMILARITY`` or more. A node with very many edges is dealt over ``SALT`` parts."""
    one = sets.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    one = one.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    other = edges.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    both = other.join(one, ["a", "salt"]).select("a", "b", "x", "y")

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [(batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy()) for k in (2, 3)]
        keep = []
        for i in range(batch.num_rows):
            x, y = (flat[at[i] : at[i + 1]] for at, flat in lists)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared > 0 and shared >= SIMILARITY * (len(x) + len(y) - shared) - 1e-3)
        kept = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in (0, 1)], names=["a", "b"])

    return arrow_map(both, "a long, b long", near)


def links_in_clusters(sets: DataFrame, clusters: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): verified links inside the clusters (node, cluster), enough to connect what is connected.

    ``known``: (node, label) of what verified links join already. A cluster
    of one label needs nothing more; one of at most ``BLOCK`` texts is
    compared at once; in a larger one the texts of its commonest label are
    joined already, so only the others are held against all, block by block.
    """
    labelled = clusters.join(known, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("label"))
    labelled = stored(labelled, "nd-labelled")
    parts = labelled.groupBy("cluster", "label").agg(F.count("*").alias("held"))
    sizes = parts.groupBy("cluster").agg(F.sum("held").alias("n"), F.count("*").alias("labels"), F.max(F.struct("held", "label")).alias("most"))
    sizes = stored(sizes.filter("labels > 1").select("cluster", "n", F.col("most.label").alias("main"), F.col("most.held").alias("joined")), "nd-sizes")
    own, rest = F.ceil(F.col("joined") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("joined")) / BLOCK).cast("int")
    small = F.col("n") <= BLOCK
    member = labelled.join(sizes, "cluster").select(
        "node", "cluster", F.when(small, 0).otherwise(own).alias("own"), F.when(small, 1).otherwise(rest).alias("rest"), (~small & (F.col("label") == F.col("main"))).alias("inner")
    )
    # blocks 0 to own - 1 hold the commonest label, the rest follow; a pair of blocks always has one of the rest
    at = F.xxhash64("node")
    block = F.when(F.col("inner"), F.pmod(at, F.greatest("own", F.lit(1)))).otherwise(F.col("own") + F.pmod(at, F.greatest("rest", F.lit(1)))).cast("int")
    member = member.withColumn("block", block)
    low = F.when(F.col("inner"), F.col("own")).otherwise(F.lit(0))
    other = F.explode(F.sequence(low, F.col("own") + F.col("rest") - 1)).alias("other")
    paired = member.select("node", "cluster", "block", other)
    paired = paired.select("node", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    paired = paired.join(sets, "node").select("cluster", "i", "j", "node", "shingles")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def closed() -> pa.RecordBatch | None:
            _, at = np.unique(ids, return_index=True)  # a repeated row counts once
            if len(at) < 2:
                return None
            nodes = np.array(ids)[at]
            x, y = similar([sets[k] for k in at])
            return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], names=["a", "b"])

        for batch in batches:
            lists = batch.column(4)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            for row, (cluster, i, j, node) in enumerate(keys):
                if (cluster, i, j) != key:
                    if key is not None and (out := closed()) is not None:
                        yield out
                    key, ids, sets = (cluster, i, j), [], []
                ids.append(node)
                sets.append(flat[offsets[row] : offsets[row + 1]].copy())
        if key is not None and (out := closed()) is not None:
            yield out

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = paired.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keeper) of every document with an id: the smallest id of its group, its own if it is alone.

    Documents with the same words (A-Z in lower case) are one text; texts
    link at a five-word Jaccard similarity of 0.8 or more; groups are the
    components. Wordless and null texts form one group. Rows that share an id
    must share a text to be told apart from others; they come back repeated.
    """
    prepare(docs.sparkSession)
    known = docs.filter(F.col(id_col).isNotNull())
    rows = stored(signatures(known, id_col, text_col), "nd-signatures")
    nodes = stored(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp")), "nd-nodes")
    edges = stored(proposed(nodes.filter("n > 0")), "nd-edges")
    clusters = stored(candidate_clusters(known, nodes, text_col), "nd-clusters")
    wanted = clusters.select("node").unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")))
    sets = stored(shingle_sets(known, wanted, id_col, text_col), "nd-sets")
    links_ = stored(verified(edges.unionByName(to_hubs(clusters)), sets), "nd-verified")
    more = links_in_clusters(sets, clusters, components(links_))
    labels = components(links_.unionByName(more))
    group = nodes.select("h1", "h2", "node").join(labels, "node", "left").select("h1", "h2", "node", F.coalesce("label", "node").alias("label"))
    group = stored(group, "nd-group")
    keeper = group.groupBy("label").agg(F.min("node").alias("keeper"))
    return rows.select("doc_id", "h1", "h2").join(group.join(keeper, "label").select("h1", "h2", "keeper"), ["h1", "h2"]).select("doc_id", "keeper")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one of smallest id; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col).filter("doc_id <> keeper").select("doc_id")
    return without_ids(docs, gone, id_col)
