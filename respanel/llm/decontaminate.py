"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a window of tokens; positions with 0 are ignored, so a
window still hits after a substitution there. Seed hashes of the test items
and of the training texts are joined on equality, and around every hit the
overlap on its diagonal is verified token by token, substitutions allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respanel.llm.common import arrow_map, prepare, stored, text_bytes, without_ids

#: Fixed masks, none longer than ``SPAN``, the least item that may have changes.
#: Found by greedy search over all patterns of changes: whatever fifth of the
#: tokens of an overlap of ``SPAN`` tokens or more is changed, one mask hits.
MASKS = ("1111011", "11010111", "111111", "11100111", "1110111", "10110111", "1111101")
SPAN = 8
MIN_WORDS, IDENTITY = 13, 0.8
#: Words of test items that are broadcast as an index: 8 bytes for a word and
#: 20 for each of its seeds, about 150 MB at this bound.
BLOCK_WORDS = 1_000_000
#: Test items of an index, at most: the bits that number an item in a hit.
ITEM_BITS = 20
FILTER_BITS = 22
#: Pairs of equal seeds that a task holds at once, about.
MEETINGS = 1_000_000
#: Bits of the tables that keep seeds out of the join, parts of a hot key.
TABLE_BITS, SALT = 27, 16

#: ASCII letters and digits in lower case, other ASCII to space, bytes of longer characters kept.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)).lower() + bytes(range(128, 256))

RESULT = "doc_id long, item_id long, start_word long, n_words long, n_matched long, identity double"


def token_hashes(raw: bytes) -> np.ndarray:
    words = raw.translate(FOLD).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _weights(mask: str) -> list[tuple[int, np.uint64]]:
    draw = np.random.default_rng(int(mask, 2) + 1000 * len(mask))
    return [(j, np.uint64(int(draw.integers(1, 2**62)) * 2 + 1)) for j, bit in enumerate(mask) if bit == "1"]


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window's positions that ``mask`` keeps."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, weight in _weights(mask):
        out += tokens[j : j + n] * weight
    return out ^ (out >> np.uint64(29))


class SeedIndex:
    """Seed hashes of one block of test items, sorted, with a bit filter before the search."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.tokens = [], []
        for item, raw in items:
            tokens = token_hashes(raw)
            if len(tokens):
                self.ids.append(item)
                self.tokens.append(tokens)
        short = {"1" * len(t) for t in self.tokens if len(t) < SPAN}
        self.masks = list(dict.fromkeys([*MASKS, *sorted(short)]))
        self.tables = []
        for mask in self.masks:
            own = [(k, t) for k, t in enumerate(self.tokens) if len(t) >= SPAN or mask == "1" * len(t)]
            seeds = [seed_hashes(t, mask) for _, t in own]
            key = np.concatenate([np.zeros(0, np.uint64), *seeds])
            item = np.repeat(np.array([k for k, _ in own], np.int64), [len(s) for s in seeds])
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s)) for s in seeds)])
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[key >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((key[order], item[order], at[order], bits))

    def hits(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (document, item, diagonal) rows; ``bounds`` cuts ``tokens`` into documents.

        Seeds that meet are taken ``MEETINGS`` at a time and at once reduced
        to diagonals, of which a document and an item have no more than
        words together.
        """
        found, pending = np.zeros(0, np.int64), []
        for mask, (key, item, at, bits) in zip(self.masks, self.tables, strict=True):
            seeds = seed_hashes(tokens, mask)
            where = np.flatnonzero(bits[seeds >> np.uint64(64 - FILTER_BITS)])
            low = np.searchsorted(key, seeds[where], "left")
            count = np.searchsorted(key, seeds[where], "right") - low
            where, low, count = where[count > 0], low[count > 0], count[count > 0]
            doc = np.searchsorted(bounds, where, "right") - 1
            inside = where + len(mask) <= bounds[doc + 1]
            where, low, count, doc = where[inside], low[inside], count[inside], doc[inside]
            total, k = np.cumsum(count), 0
            while k < len(where):
                end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + MEETINGS, "right")))
                own = count[k:end]
                flat = np.repeat(low[k:end] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())
                start = np.repeat(where[k:end] - bounds[doc[k:end]], own)
                # 11 bits for a document of the batch, ITEM_BITS for an item of the index, 32 for the diagonal
                pending.append(np.unique(((np.repeat(doc[k:end], own) << ITEM_BITS | item[flat]) << 32) + (start - at[flat] + (1 << 31))))
                if sum(map(len, pending)) > MEETINGS:
                    found, pending = np.unique(np.concatenate([found, *pending])), []
                k = end
        found = np.unique(np.concatenate([found, *pending]))
        return np.stack([found >> 32 + ITEM_BITS, found >> 32 & (1 << ITEM_BITS) - 1, (found & (1 << 32) - 1) - (1 << 31)], axis=1)


def verify(own: np.ndarray, tokens: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start word, words, matched) of the longest overlap of item ``own`` on the diagonal that is near enough."""
    first, last = max(0, -diagonal), min(len(own), len(tokens) - diagonal)
    same = own[first:last] == tokens[first + diagonal : last + diagonal]
    least = min(MIN_WORDS, len(own))
    if 100 * int(same.sum()) < round(100 * IDENTITY) * least:
        return None
    # a run has enough identity exactly if its matches, each worth 1 - IDENTITY, pay for its changes
    worth = np.concatenate(([0], np.cumsum(np.where(same, 100 - round(100 * IDENTITY), -round(100 * IDENTITY)))))
    after = np.maximum.accumulate(worth[::-1])[::-1]
    # the farthest end from each start: ``after`` falls, so it is the last place where it is no less
    ends = len(after) - 1 - np.searchsorted(after[::-1], worth, "left")
    lengths = ends - np.arange(len(worth))
    start = int(lengths.argmax())
    length = int(lengths[start])
    if length < least:
        return None
    return first + diagonal + start, length, int(same[start : start + length].sum())


def longest(own: np.ndarray, tokens: np.ndarray, diagonals: list[int]) -> tuple[int, int, int] | None:
    """The longest overlap on any of the diagonals, the first of equal ones."""
    best = None
    for diagonal in sorted(diagonals):
        got = verify(own, tokens, diagonal)
        if got and (best is None or (got[1], -got[0]) > (best[1], -best[0])):
            best = got
            if best[1] == min(len(own), len(tokens)):  # later diagonals start later
                break
    return best


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True))
    types = [pa.int64()] * 5 + [pa.float64()]
    names = ["doc_id", "item_id", "start_word", "n_words", "n_matched", "identity"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _searched(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Overlaps by an index of all test items that every task holds, 2 ** ``ITEM_BITS`` at most."""
    index = SeedIndex([(r["item_id"], bytes(r["raw"])) for r in tests.collect()])
    held = rows.sparkSession.sparkContext.broadcast(vars(index))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = SeedIndex.__new__(SeedIndex)
        vars(seeds).update(held.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            each = [token_hashes(raw) for raw in texts]
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in each])))
            hits = seeds.hits(np.concatenate(each), bounds)
            cuts = np.flatnonzero((hits[1:, :2] != hits[:-1, :2]).any(axis=1)) + 1
            out = []
            for group in np.split(hits, cuts) if len(hits) else []:
                doc, k = int(group[0, 0]), int(group[0, 1])
                if got := longest(seeds.tokens[k], each[doc], group[:, 2].tolist()):
                    out.append((ids[doc], seeds.ids[k], *got, got[2] / got[1]))
            if out:
                yield _rows(out)

    return rows.mapInArrow(found, RESULT)


def _filter_of(seeds: DataFrame) -> list[np.ndarray]:
    """Two bit tables of ``TABLE_BITS`` bits over the seed hashes, from their upper and their lower bits: 32 MB however many there are."""
    out = []
    for shift in (64 - TABLE_BITS, 0):
        place = F.shiftrightunsigned("h", shift).bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        words = seeds.select(place.alias("place")).select(F.shiftrightunsigned("place", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
        got = words.toArrow()
        table[got.column(0).to_numpy()] = got.column(1).to_numpy()
        out.append(table.view(np.uint64))
    return out


def _joined(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Overlaps by a join of the seed hashes of documents and test items, for test sets of any size.

    Documents are hashed once. Bit tables of the items' seeds keep most of
    theirs out of the shuffle; what meets is reduced to diagonals of a text
    and an item, and only texts and items that meet are joined again, to be
    verified. Both joins deal a hot seed or text over ``SALT`` parts.
    """
    spark = rows.sparkSession
    tests = stored(tests.withColumn("item_key", F.unhex(F.md5("raw"))), "leak-items")

    def lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = {len(raw.translate(FOLD).split()) for raw in batch.column(0).to_pylist()}
        return pa.RecordBatch.from_arrays([pa.array([x for x in n if 0 < x < SPAN], pa.int32())], names=["n"])

    short = sorted(r["n"] for r in arrow_map(tests.select("raw"), "n int", lengths).distinct().collect())
    masks = list(dict.fromkeys([*MASKS, *("1" * n for n in short)]))

    def seeded(tables: list | None):
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, parts = [], []
            for key, raw in dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items():
                tokens = token_hashes(raw)
                for m, mask in enumerate(masks):
                    if tables is None and len(tokens) < SPAN and mask != "1" * len(tokens):
                        continue
                    seeds = seed_hashes(tokens, mask)
                    at = np.arange(len(seeds))
                    for table, shift in zip(tables.value if tables else (), (64 - TABLE_BITS, 0), strict=False):
                        place = (seeds[at] >> np.uint64(shift)) & np.uint64((1 << TABLE_BITS) - 1)
                        at = at[(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) == 1]
                    if len(at):
                        keys += [key] * len(at)
                        parts.append(np.stack([np.full(len(at), m), seeds[at].view(np.int64), at]))
            flat = np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(x) for x in flat)], names=["key", "mask", "h", "at"])

        return cut

    schema = "key binary, mask long, h long, at long"
    items = stored(arrow_map(tests.select("item_key", "raw"), schema, seeded(None)).distinct(), "leak-seeds")
    tables = spark.sparkContext.broadcast(_filter_of(items))
    docs = rows.withColumn("key", F.unhex(F.md5("raw")))
    theirs = arrow_map(docs.select("key", "raw"), schema, seeded(tables)).withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALT)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    ours = items.select(F.col("key").alias("item_key"), "mask", "h", F.col("at").alias("item_at"), salts)
    met = theirs.join(ours, ["mask", "h", "salt"]).select("key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    met = stored(met.groupBy("key", "item_key").agg(F.collect_list("diagonal").alias("diagonals")), "leak-diagonals")
    hit = docs.join(met.select("key").distinct(), "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    facing = met.join(tests.select("item_key", "item_id", F.col("raw").alias("item")), "item_key").select("*", salts)
    pairs = hit.join(facing, ["key", "salt"]).select("doc_id", "raw", "item_id", "item", "diagonals")

    def checked(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, held = [], {}
        for doc, raw, item_id, item, diagonals in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            tokens = held.get(raw)
            if tokens is None:
                held = {raw: (tokens := token_hashes(raw))}
            if got := longest(token_hashes(item), tokens, diagonals):
                out.append((doc, item_id, *got, got[2] / got[1]))
        return _rows(out) if out else None

    return arrow_map(pairs, RESULT, checked)


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each document and test item that overlap: where, how long, how many tokens agree.

    Reported is the longest overlap with at least ``IDENTITY`` of its tokens
    equal and at least ``MIN_WORDS`` tokens (all of a shorter item). Items
    under ``SPAN`` tokens must occur whole and unchanged. A test set of at
    most ``block_words`` words and 2 ** ``ITEM_BITS`` items is broadcast as an
    index and met in one pass without a shuffle; a larger one is joined by
    seed hash. The results are the same.

    Null, empty and wordless texts or items overlap nothing. Equal items all
    report; a repeated document reports for each of its rows. Null ids are
    carried. Very long texts are hashed whole. Empty tables give an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.lower(text_col)).alias("raw"))
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), text_bytes(F.lower(item_text)).alias("raw")).filter("raw <> X''")
    size = tests.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("bytes"), F.count("*").alias("items")).first()
    few = size["bytes"] / 4 <= block_words and size["items"] <= 1 << ITEM_BITS
    return _searched(rows, tests) if few else _joined(rows, tests)


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap some test item; rows without an id stay."""
    return without_ids(docs, overlaps(docs, items, id_col, text_col).select("doc_id"), id_col)
