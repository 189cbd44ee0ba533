"""Sequence packing as a cutting-stock problem, solved by column generation."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respanel.llm.common import arrow_map, prepare, stored

CAPACITY = 2048
#: Tokens of a length class: lengths are rounded up to it in the programme.
#: Fewer make less padding and a larger programme (CAPACITY / UNIT rows).
UNIT = 8
END_ID = 1
#: The programme stops once its proven distance from the optimum is below this share, or where no column improves it.
GAP = 1e-3

_ENCODERS: dict[str, object] = {}
_ADDED: dict[str, tuple[re.Pattern | None, dict[str, int]]] = {}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def encoder(vocabulary: str, pattern: str):
    """Byte-level BPE of a ``tokenizers`` JSON file, for text between added tokens.

    Merges in such a file are ranked by the id of what they make, so the ids
    serve as the ranks of the faster encoder, with equal results.
    """
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            whole = json.load(file)
        special = {x["content"] for x in whole.get("added_tokens", ())}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def added(vocabulary: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """(pattern, ids) of the added tokens of a ``tokenizers`` file: strings that stand for one id wherever they occur, the longest first."""
    if vocabulary not in _ADDED:
        with open(vocabulary, encoding="utf-8") as file:
            own = json.load(file).get("added_tokens", ())
        if odd := [x["content"] for x in own if x.get("lstrip") or x.get("rstrip") or x.get("single_word")]:
            raise ValueError(f"added tokens that take white space or whole words only are not supported: {odd}")
        ids = {x["content"]: x["id"] for x in own if x["content"]}
        parts = "|".join(re.escape(x) for x in sorted(ids, key=len, reverse=True))
        _ADDED[vocabulary] = (re.compile(f"({parts})") if parts else None, ids)
    return _ADDED[vocabulary]


def token_ids(text: str, vocabulary: str, pattern: str) -> list[int]:
    """Ids of a text as the ``tokenizers`` library gives them, without the special tokens that it would add around."""
    encode = encoder(vocabulary, pattern).encode_ordinary
    split, known = added(vocabulary)
    if split is None or not split.search(text):
        return encode(text)
    return [i for k, part in enumerate(split.split(text)) for i in ([known[part]] if k % 2 else encode(part) if part else [])]


def pieces(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32): whole texts as ids with ``END_ID`` after them, cut every ``capacity`` ids."""
    import public_tokenizers

    prepare(docs.sparkSession)
    vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([*token_ids(text, vocabulary, pattern), END_ID], "<u4")
            for start in range(0, len(ids), capacity):
                own = ids[start : start + capacity]
                for col, x in zip(out, (doc, len(ids), start, len(own), zlib.crc32(own.tobytes())), strict=True):
                    col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "doc_tokens", "start", "length", "ids_crc32"])

    return arrow_map(rows, "doc_id long, doc_tokens long, start long, length long, ids_crc32 long", cut)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value that fits: unbounded knapsack by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, "right"))
        best[room] = best[room - 1]
        if n:
            with_last = best[room - sizes[:n]] + values[:n]
            k = int(with_last.argmax())
            if with_last[k] > best[room] + 1e-12:
                best[room], choice[room] = with_last[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if (k := choice[room]) < 0:
            room -= 1
            continue
        pattern[k] += 1
        room -= sizes[k]
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots: element-wise only, so no thread pool of a linear algebra library starts in the driver."""
    m = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(m)], axis=1)
    for k in range(m):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        column = work[:, k].copy()
        column[k] = 0
        work -= column[:, None] * work[k][None, :]
    return work[:, m:].copy()


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of first-fit decreasing over the sizes with demand left, each used until a size runs out.

    A later pattern never holds a size that ran out, so the patterns are
    independent, and their amounts meet the demand exactly.
    """
    m, left = len(sizes), demand.astype(float).copy()
    open_, basis, amounts = np.ones(m, bool), np.zeros((m, m)), np.zeros(m)
    for step in range(m):
        room, pattern = capacity, np.zeros(m)
        for i in range(m - 1, -1, -1):
            if open_[i] and sizes[i] <= room:
                pattern[i], room = room // sizes[i], room % sizes[i]
        used = np.flatnonzero(pattern)
        lasts = left[used] / pattern[used]
        out = used[lasts.argmin()]
        amounts[step] = lasts.min()
        left -= amounts[step] * pattern
        left[out], open_[out], basis[:, step] = 0.0, False, pattern
    return basis, amounts


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns, amounts, gap reached) of the linear programme: least total amount whose patterns meet the demand.

    Revised simplex; the columns are the patterns, priced by the knapsack. It
    runs until the amount is proven to lie within ``gap`` of the optimum or
    no pattern improves it. Demands are raised by unlike trifles, so that no
    step stands still and no basis comes back.
    """
    m = len(sizes)
    demand = demand + 1e-7 * (1 + np.arange(m) / m)
    basis, amounts = first_basis(sizes, demand, capacity)
    inverse = inverted(basis)
    bound = float((sizes * demand).sum()) / capacity
    step = 0
    while amounts.sum() > bound * (1 + gap):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        bound = max(bound, amounts.sum() / max(value, 1.0))
        direction = times(inverse, pattern)
        ok = direction > 1e-9
        if value <= 1 + 1e-9 or not ok.any():
            break
        ratios = np.full(m, np.inf)
        ratios[ok] = amounts[ok] / direction[ok]
        leave = int(ratios.argmin())
        amounts = np.maximum(amounts - ratios[leave] * direction, 0)
        amounts[leave] = ratios[leave]
        basis[:, leave] = pattern
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        step += 1
        if step % 100 == 0:
            inverse = inverted(basis)
            amounts = np.maximum(times(inverse, demand), 0)
    return basis.T.round().astype(np.int64), amounts, float(max(0.0, amounts.sum() / bound - 1))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {size: how many})] that hold exactly ``counts`` items."""
    return plan_with_gap(counts, capacity)[0]


def plan_with_gap(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """(plan, proven distance of its programme from the optimum): amounts rounded down, the rest first-fit decreasing."""
    sizes = np.array(sorted(s for s, n in counts.items() if n > 0), np.int64)
    if not len(sizes):
        return [], 0.0
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    patterns, amounts, gap = relaxed(sizes, left.astype(float), capacity)
    out = []
    for k in np.argsort(-amounts, kind="stable"):
        used = patterns[k] > 0
        times = int(min(np.floor(amounts[k] + 1e-6), (left[used] // patterns[k][used]).min())) if used.any() else 0
        if times:
            left -= times * patterns[k]
            out.append((times, {int(sizes[i]): int(patterns[k][i]) for i in np.flatnonzero(used)}))
    rest: dict[tuple, int] = {}
    while left.any():
        room, own = capacity, {}
        for i in range(len(sizes) - 1, -1, -1):
            take = int(min(left[i], room // sizes[i]))
            if take:
                own[int(sizes[i])] = take
                room -= take * int(sizes[i])
        times = min(int(left[i]) // own[s] for i, s in enumerate(sizes.tolist()) if s in own)
        for i, s in enumerate(sizes.tolist()):
            left[i] -= times * own.get(s, 0)
        key = tuple(sorted(own.items()))
        rest[key] = rest.get(key, 0) + times
    return out + [(n, dict(key)) for key, n in rest.items()], gap


def assign(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id, offset, sequence_tokens (padded length) and lp_gap (of the whole plan) to stored ``pieces``.

    The driver gets one count for each length class, capacity / unit at most.
    Pieces are ranked inside their class without gathering it: counts by
    class and hash block give each block its first rank.
    """
    spark = cut.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("class", F.ceil(F.col("length") / unit).cast("long")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks))
    )
    sizes = stored(dealt.groupBy("class", "block").count(), "packing-counts")
    totals = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    slots, filled, base = [], {}, 0
    made, gap = plan_with_gap(totals, capacity // unit)
    for times, own in made:
        for size, many in own.items():
            low = filled.get(size, 0)
            slots.append((size, low, low + times * many, many, base))
            filled[size] = low + times * many
        base += times
    slots = spark.createDataFrame(slots, "slot_class long, low long, high long, many long, base long")
    before = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("class", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        dealt.withColumn("own", F.row_number().over(inside) - 1)
        .join(firsts, ["class", "block"])
        .withColumn("rank", F.col("first") + F.col("own"))
    )
    placed = ranked.join(
        F.broadcast(slots), (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ).withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("many")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "rank")
    used = F.sum("length").over(Window.partitionBy("sequence_id"))
    power = F.bin(used).rlike("^10*$")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        F.when(power, used).otherwise(F.lit(capacity).cast("long")).alias("sequence_tokens"),
        F.lit(gap).alias("lp_gap"),
    )


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as pieces in sequences of at most ``CAPACITY`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, lp_gap.

    Texts are cut only every ``CAPACITY`` ids, so all but a text's last piece
    fill a sequence alone; last pieces are combined by patterns. Sequences
    are padded to ``CAPACITY`` unless their ids number a power of two.

    A null or empty text is the end id alone. Null ids and repeated rows are
    packed like others, equal pieces in any order; other columns are ignored
    whatever their names. Very long texts are encoded whole, one at a time.
    ``lp_gap`` is how far the linear programme may lie above its optimum. An
    empty table gives an empty result.
    """
    return assign(stored(pieces(docs, vocabulary, id_col, text_col), "packing"))
