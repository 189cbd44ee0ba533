"""Ranked lexical search over a two-level quantised index.

Level one holds a byte for each term of a document: its impact on a score in
steps of the term, rounded up. Sums of bytes bound every score from above and,
a step lower for each term, from below. Level two holds the exact whole
numbers. Documents whose upper bound reaches the k-th lower bound of an item
are scored from level two; all others are ruled out by the first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respanel.llm.common import FEW_KEYS, prepare, stored, text_bytes

TOP = 10
#: UTF-8 bytes and rows of test items that are looked up in one pass over the documents; more items take more passes.
BLOCK_BYTES, BLOCK_ITEMS = 8_000_000, 20_000
#: Cells of the table of bounds, documents by items, that a task fills at once, and bounds that it holds back.
CELLS, HELD = 2_000_000, 200_000
#: Greatest quotient that the weight of a term is multiplied with.
MOST = 1_000_000

#: ASCII letters and digits in lower case, other ASCII to space, bytes of longer characters kept.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)).lower() + bytes(range(128, 256))

INDEX = "row long, doc_id {id}, n long, terms array<int>, tfs array<long>"
BOUND = "item long, row long, doc_id {id}, lower long, upper long"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def exact_index(docs: DataFrame, terms: dict[bytes, int], id_type: str) -> DataFrame:
    """Level two: (row, doc_id, n, terms, tfs) of every row of (row, doc_id, raw); only terms that ``terms`` numbers are kept, ``n`` counts all."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n, own, tfs = [], [], []
            for raw in batch.column("raw"):
                words = terms_of(raw.as_py())
                held = sorted((known[w], tf) for w, tf in Counter(words).items() if w in known)
                n.append(len(words))
                own.append([t for t, _ in held])
                tfs.append([tf for _, tf in held])
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, INDEX.format(id=id_type))


def weights(index: DataFrame, total: int, size: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of every numbered term."""
    df = np.zeros(size, np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[row["term"]] = row["count"]
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def quantised(index: DataFrame, weight: np.ndarray, total: int, words: int, id_type: str) -> DataFrame:
    """Level one: (row, doc_id, terms, impacts), one byte a term. A term's step is the 255th part of what it could add to a score."""
    step = steps(weight)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            cuts, flat = np.asarray(terms.offsets), np.asarray(terms.flatten())
            cuts = cuts - cuts[0]
            tf = np.asarray(batch.column("tfs").flatten())
            n = np.repeat(np.asarray(batch.column("n")), np.diff(cuts))
            m = 100 - 90 + (90 * n * total) // max(words, 1)
            impact = weight[flat] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            bytes_ = (-(-impact // step[flat])).astype(np.uint8).tobytes()
            own = [bytes_[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), terms, pa.array(own, pa.binary())], names=["row", "doc_id", "terms", "impacts"])

    rows = index.filter(F.size("terms") > 0)
    return rows.mapInArrow(level, f"row long, doc_id {id_type}, terms array<int>, impacts binary")


def steps(weight: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-weight * MOST // 255))


def bounded(level: DataFrame, items: list[list[int]], weight: np.ndarray, id_type: str, top: int = TOP) -> DataFrame:
    """(item, row, doc_id, lower, upper): for every item the rows of level one whose upper bound may reach the ``top``-th lower bound.

    A task keeps the ``top`` greatest lower bounds it has met and lets go of
    what cannot reach them any more. Rows with the same terms and bytes
    are bounded once.
    """
    step, width = steps(weight), len(items)
    pairs = sorted((t, k) for k, own in enumerate(items) for t in own)
    holders = np.array([k for _, k in pairs], np.int64)
    first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(weight) + 1))
    sent = level.sparkSession.sparkContext.broadcast((step, holders, first))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, holders, first = sent.value
        best, held, waiting = np.zeros((top, width), np.int64), [], 0

        def reached() -> Iterator[pa.RecordBatch]:
            kth = best.min(axis=0)
            for item, row, doc, low, high in held:
                ok = high >= kth[item]
                if ok.any():
                    columns = [pa.array(x[ok]) for x in (item, row)] + [doc.filter(pa.array(ok))] + [pa.array(x[ok]) for x in (low, high)]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "row", "doc_id", "lower", "upper"])

        for batch in batches:
            rows, doc_ids = np.asarray(batch.column("row")), batch.column("doc_id")
            classes: dict[tuple, list[int]] = {}
            for k, (own, raw) in enumerate(zip(batch.column("terms").to_pylist(), batch.column("impacts").to_pylist(), strict=True)):
                classes.setdefault((tuple(own), raw), []).append(k)
            names, members = list(classes), list(classes.values())
            at, span = 0, max(1, CELLS // width)
            while at < len(names):
                end, own = at + 1, len(holders)
                while end < len(names) and end - at < span and (end - at + 1) * own <= 50 * CELLS:
                    end += 1
                terms = np.concatenate([np.array(t, np.int64) for t, _ in names[at:end]])
                level_of = np.frombuffer(b"".join(raw for _, raw in names[at:end]), np.uint8).astype(np.int64)
                where = np.repeat(np.arange(end - at), [len(t) for t, _ in names[at:end]])
                many = first[terms + 1] - first[terms]
                flat = np.repeat(first[terms] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                cell = np.repeat(where * width, many) + holders[flat]
                # sums stay below 2 ** 53
                shape = (end - at, width)
                high = np.bincount(cell, np.repeat(level_of * step[terms], many), shape[0] * width).astype(np.int64).reshape(shape)
                low = np.bincount(cell, np.repeat(np.maximum(level_of - 1, 0) * step[terms], many), shape[0] * width).astype(np.int64).reshape(shape)
                copies = np.array([min(len(x), top) for x in members[at:end]])
                known = np.concatenate([best, np.repeat(low, copies, axis=0)])
                best = np.partition(known, len(known) - top, axis=0)[len(known) - top :]
                who, item = np.nonzero((high > 0) & (high >= best.min(axis=0)))
                if len(who):
                    sizes = np.array([len(members[at + k]) for k in range(end - at)])[who]
                    k = np.concatenate([np.array(members[at + w], np.int64) for w in who.tolist()])
                    rep = lambda x: np.repeat(x, sizes)
                    held.append((rep(item), rows[k], doc_ids.take(pa.array(k)), rep(low[who, item]), rep(high[who, item])))
                    waiting += len(k)
                    if waiting > HELD:
                        yield from reached()
                        held, waiting = [], 0
                at = end
        yield from reached()

    return level.mapInArrow(bound, BOUND.format(id=id_type))


def rescored(reached: DataFrame, index: DataFrame, wanted: DataFrame, total: int, words: int) -> DataFrame:
    """(item, row, doc_id, score): exact scores of (item, row) from level two, in 64-bit whole numbers."""
    rows = reached.select("item", "row")
    few = rows.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    met = index.join(F.broadcast(rows), "row") if few else index.join(rows, "row")
    flat = met.select("item", "row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("own")).select("item", "row", "doc_id", "n", F.col("own.terms").alias("term"), F.col("own.tfs").alias("tf"))
    m = F.lit(100 - 90).cast("long") + F.expr(f"(90L * n * {total}L) div {max(words, 1)}L")
    scored = flat.join(F.broadcast(wanted), ["item", "term"]).withColumn("m", m)
    return scored.groupBy("item", "row", "doc_id").agg(F.sum(F.expr("weight * ((1000000000L * tf) div (1000L * tf + 8L * m))")).alias("score"))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items as (item_id, distinct terms), in blocks of bounded size; an item whose text is longer than a block is one alone."""
    block, size = [], 0
    for row in items.toLocalIterator():
        raw = bytes(row["raw"])
        if block and (size + len(raw) > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], list(dict.fromkeys(terms_of(raw)))))
        size += len(raw)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for every item the ``top`` documents of highest score above 0, equal scores by ascending doc_id.

    Items are taken in blocks, each of which passes over the documents once;
    blocks, not documents, reach the driver, and their terms are sent to all
    workers (8 MB of text a block).

    A null text has no terms: such documents do not count for the statistics
    and are never found, such items find nothing. Every row is a document
    and every row of ``items`` an item, so repeated rows are found and
    answered each by itself; a null doc_id sorts last. Very long texts are
    taken whole. Other columns are ignored whatever their names. Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("raw")).withColumn("row", F.monotonically_increasing_id())
    wanted = items.select(F.col(item_col).alias("item_id"), text_bytes(item_text_col).alias("raw"))
    kinds = wanted.schema["item_id"].dataType.simpleString(), own.schema["doc_id"].dataType.simpleString()
    found = [_searched(spark, own, block, top, *kinds) for block in item_blocks(wanted)]
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    for part in found:
        out = out.unionByName(part)
    return out


def _searched(spark: SparkSession, own: DataFrame, block: list[tuple[object, list[bytes]]], top: int, item_type: str, id_type: str) -> DataFrame:
    number = {t: k for k, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
    asked = [[number[t] for t in terms] for _, terms in block]
    index = stored(exact_index(own, number, id_type), "search-exact")
    size = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    total, words = size["total"], size["words"]
    weight = weights(index, total, len(number))
    level = stored(quantised(index, weight, total, words, id_type), "search-bytes")
    met = stored(bounded(level, asked, weight, id_type, top), "search-bounds")
    # the greatest lower bounds of an item: those of each task hold those of all
    order = Window.partitionBy("item").orderBy(F.desc("lower"), "row")
    kth = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") == top).select("item", F.col("lower").alias("kth"))
    reached = stored(met.join(F.broadcast(kth), "item", "left").filter("kth IS NULL OR upper >= kth").select("item", "row"), "search-reached")
    pairs = [(k, t, int(weight[t])) for k, terms in enumerate(asked) for t in terms]
    terms = spark.createDataFrame(pairs, "item long, term int, weight long")
    scores = rescored(reached, index, terms, total, words).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item long, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


#: ``search`` over the tables documents and benchmark, in DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
sc AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id
), k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
