"""Removal of sentences covered by a run of sentences that occurred before.

Sentences end at stops and line ends. One of over ``WINDOW`` words is cut at
content-defined words (winnowing: the word of least hash in every window of
``WINDOW`` words), so that a passage is cut alike wherever it stands in a
sentence. A span is the shortest run of at least ``SPAN`` such pieces that
has ``LEAST`` words: stock phrases are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from respanel.llm.common import arrow_map, halves, later_holders, plain_names, prepare, stored, text_bytes

#: Least pieces and words of a span; words of a window that holds a cut. A
#: passage of n words has its cuts in common from word WINDOW to word
#: n - WINDOW at the latest, and a span ends within LEAST + WINDOW - 1 words
#: of its start (or 3 * WINDOW), so any 51 words hold a span.
SPAN, LEAST, WINDOW = 3, 20, 10

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

# Unicode sentence ends, by their UTF-8 bytes.
STOPS = (".", "!", "?", "。", "！", "？", "｡", "؟", "۔", "।", "॥", "።", "។", "։", "။", "…")
LONG_STOPS = tuple(x.encode() for x in STOPS if not x.isascii())
SHORT_STOP, LONG_STOP = np.zeros(256, bool), np.zeros(256, bool)
SHORT_STOP[[ord(x) for x in STOPS if x.isascii()]] = True
LONG_STOP[[x[-1] for x in LONG_STOPS]] = True

#: UTF-8 first bytes of U+3000 to U+9FFF: kana and Han, written without spaces. Each such character is a word.
LEADS = (0xE3, 0xE9)


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(starts, ends, words in lower case) of the words of a text, white space between or characters of scripts without spaces."""
    data = np.frombuffer(raw, np.uint8)
    blank = BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    lead = (data >= LEADS[0]) & (data <= LEADS[1])
    spaced = not lead.any()
    if not spaced:
        first |= lead
        first[3:] |= lead[:-3] & ~blank[3:]
    starts = np.flatnonzero(first)
    last = ~blank
    last[:-1] &= blank[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    low = raw.lower()
    return starts, ends, low.split() if spaced else [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def piece_starts(raw: bytes, starts: np.ndarray, ends: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Numbers of the words that begin a piece: the first of a sentence, and the least of a window inside one."""
    n = len(words)
    data = np.frombuffer(raw, np.uint8)
    begins = np.zeros(n, bool)
    begins[0] = True
    last = data[ends - 1]
    stop = SHORT_STOP[last]
    for k in np.flatnonzero(LONG_STOP[last]).tolist():
        stop[k] = raw[max(starts[k], ends[k] - 3) : ends[k]].endswith(LONG_STOPS)
    begins[1:] = stop[:-1]
    feeds = np.flatnonzero(data == 10)
    if len(feeds):
        after = np.searchsorted(starts, feeds)
        begins[after[after < n]] = True
    if n >= WINDOW:
        sentence = np.cumsum(begins)
        hashed = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, n)
        inside = np.flatnonzero(sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :])
        if len(inside):
            least, place = hashed[inside], inside.copy()
            for k in range(1, WINDOW):
                other = hashed[inside + k]
                less = other < least
                least, place = np.where(less, other, least), np.where(less, inside + k, place)
            begins[place] = True
    return np.flatnonzero(begins)


def sentences(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges that tile the text: pieces with the white space after them."""
    return pieces_and_spans(raw)[0]


def pieces_and_spans(raw: bytes) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """(piece ranges, for each span its last piece, 128-bit key of its words); span k begins at piece k. White space and case of A-Z don't count."""
    if not raw:
        return [], [], []
    starts, ends, words = words_of(raw)
    if not words:
        return [(0, len(raw))], [], []
    first = piece_starts(raw, starts, ends, words)
    cuts = [0, *starts[first[1:]].tolist(), len(raw)]
    after = np.append(first, len(words))
    stop = np.maximum(np.searchsorted(after, first + LEAST), np.arange(len(first)) + SPAN)
    stop = stop[stop < len(after)]
    begin, end = first[: len(stop)].tolist(), after[stop].tolist()
    keys = [xxhash.xxh3_128_digest(b" ".join(words[s:e])) for s, e in zip(begin, end, strict=True)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)), (stop - 1).tolist(), keys


def span_keys(raw: bytes) -> tuple[list[tuple[int, int]], list[bytes]]:
    """(piece ranges, key of each span)."""
    ranges, _, keys = pieces_and_spans(raw)
    return ranges, keys


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2), the halves of the key, of every different span of every row with an id."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw")).filter("doc_id is not null")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, keys = [], []
        for raw in batch.column(1).to_pylist():
            own = dict.fromkeys(span_keys(raw)[1])
            counts.append(len(own))
            keys += own
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        return pa.RecordBatch.from_arrays([ids, *halves(keys)], names=["doc_id", "h1", "h2"])

    return arrow_map(rows, "doc_id long, h1 long, h2 long", cut)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key): spans of a document that a document of smaller id also holds."""
    return later_holders(stored(spans(docs, id_col, text_col), "sentence-spans"))


def without(raw: bytes, gone: set[bytes]) -> tuple[bytes, int, int]:
    """(text without pieces that a span in ``gone`` or a later equal span covers, pieces, removed)."""
    ranges, last, keys = pieces_and_spans(raw)
    if not gone and len(set(keys)) == len(keys):
        return raw, len(ranges), 0
    change, seen = np.zeros(len(ranges) + 1, np.int64), set()
    for i, (key, j) in enumerate(zip(keys, last, strict=True)):
        if key in gone or key in seen:
            change[i] += 1
            change[j + 1] -= 1
        seen.add(key)
    covered = np.cumsum(change)[:-1] > 0
    if not covered.any():
        return raw, len(ranges), 0
    kept, at = [], 0
    for (s, e), out in zip(ranges, covered.tolist(), strict=True):
        if out:
            kept.append(raw[at:s])
            at = e
    kept.append(raw[at:])
    return b"".join(kept).strip(), len(ranges), int(covered.sum())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every column, ``text_col`` without repeated sentences, plus __sentences and __removed (pieces).

    A span is a run of at least ``SPAN`` consecutive pieces and ``LEAST``
    words. Its first occurrence (the smallest doc_id, inside a document the
    first place) stays; sentences that any other occurrence covers go. Any
    passage of 51 words that repeats holds a span, wherever it stands; what
    is left of it at each end is shorter than a window. White space between
    kept sentences stays as it was; a text that lost sentences is trimmed.

    Null text stays null. Texts without a span never change. Rows without an
    id are held against no other and lose only their own repetitions. Rows
    that share an id count as one document. Very long texts are cut as a
    whole. Columns may have any names. Empty table: empty result.
    """
    own, names, at = plain_names(docs), docs.columns, docs.columns.index(text_col)
    inner = own.columns
    gone = removals(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_list("key").alias("gone"))
    joined = own.join(gone, F.col(f"c{names.index(id_col)}") == F.col("doc_id"), "left").drop("doc_id")

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, lost = [], [], []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
            new, n, m = (None, 0, 0) if text is None else without(text.encode(), set(gone or ()))
            texts.append(new if new is None else new.decode())
            total.append(n)
            lost.append(m)
        cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*inner, "sentences", "removed"])

    out = StructType([*own.schema.fields, StructField("sentences", LongType()), StructField("removed", LongType())])
    return arrow_map(joined, out, rebuilt).toDF(*names, "__sentences", "__removed")
