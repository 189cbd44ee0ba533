"""Quality rules as weak supervision: votes, estimated accuracies, posterior probability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from respanel.llm.common import arrow_map, plain_names, prepare, stored, text_bytes

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\r\v\f"
WINDOW = 5
TRAIL = bytes(range(0x80, 0xC0))
NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
NOT_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0))

#: Pseudo-votes (bad, good) of a rule: in good texts, in bad texts of its own kind, in bad texts of another kind.
IN_GOOD, IN_OWN, IN_OTHER = (0.5, 9.5), (4.0, 1.0), (0.5, 4.5)
ROUNDS = 1000

#: Statistics that every text gets; the first five are fixed by contract.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs", "n_wordlike", "n_unique", "n_adjacent")


def repeat_words(words: list[bytes]) -> int:
    """Words inside a run of ``WINDOW`` words that the text holds twice or more, first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    runs = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(runs)) == n:
        return 0
    counts: dict = {}
    for x in runs:
        counts[x] = counts.get(x, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, x in enumerate(runs) if counts[x] > 1])
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[: len(words)] > 0).sum())


def statistics(raw: bytes) -> tuple[int, ...]:
    """``STATS`` of one text."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.translate(None, BLANK)]
    plain = [w for w in words if not w.translate(None, NOT_LETTER) == b""]
    return (
        len(words),
        len(raw.translate(None, BLANK + TRAIL)),
        sum(raw.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS))),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(raw.translate(None, NOT_LETTER)),
        len(raw.translate(None, NOT_UPPER)),
        raw.count(b"!"),
        len(plain),
        len(set(words)),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def share(part: str, whole: str) -> Column:
    """part / whole of two statistics, 0 where there is nothing."""
    return F.coalesce(F.try_divide(F.col(f"__{part}").cast("double"), F.col(f"__{whole}").cast("double")), F.lit(0.0))


def rules() -> list[tuple[str, str, Column, Column]]:
    """(name, kind of bad text it sees, votes bad, votes good) on the columns ``__<statistic>``; neither: abstains.

    Thresholds are sensitive: a lone bad vote may well be wrong, and how far
    to trust it is estimated. Each kind has two rules or more, so that they
    can confirm each other.
    """
    mean = share("word_chars", "n_words")
    each = [
        ("symbols", "markup", share("n_symbols", "n_words"), 0.1, 0.02),
        ("repetition", "repetition", share("n_repeat_words", "n_words"), 0.2, 0.05),
        ("adjacent", "repetition", share("n_adjacent", "n_words"), 0.1, 0.02),
        ("lines", "repetition", share("n_dup_lines", "n_lines"), 0.2, 0.05),
        ("capitals", "shouting", share("n_upper", "n_letters"), 0.3, 0.15),
        ("exclamations", "shouting", share("n_bangs", "n_words"), 0.1, 0.02),
    ]
    out = [(name, kind, value > bad, value < good) for name, kind, value, bad, good in each]
    low = [
        ("letters", "markup", share("n_letters", "word_chars"), 0.8, 0.9),
        ("words", "markup", share("n_wordlike", "n_words"), 0.8, 0.95),
        ("variety", "repetition", share("n_unique", "n_words"), 0.3, 0.45),
        ("length", "fragment", F.col("__n_words"), 10, 50),
    ]
    out += [(name, kind, value < bad, value > good) for name, kind, value, bad, good in low]
    return [*out, ("word_length", "fragment", (mean < 3) | (mean > 12), (mean > 3.5) & (mean < 9))]


KINDS = ("markup", "repetition", "repetition", "repetition", "shouting", "shouting", "markup", "markup", "repetition", "fragment", "fragment")


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``__<statistic>`` of its whole texts."""
    prepare(docs.sparkSession)
    kept = docs.select(*[F.col(c) for c in keep], text_bytes(text_col).alias("__raw"))
    schema = StructType([*kept.schema.fields[:-1], *[StructField(f"__{s}", LongType()) for s in STATS]])

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(raw) for raw in batch.column(len(keep)).to_pylist()]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=schema.names)

    return arrow_map(kept, schema, measured)


def votes(measured: DataFrame) -> DataFrame:
    """Adds ``__votes``: a letter for each rule, b bad, g good, - abstains."""
    each = [F.when(bad, "b").when(good, "g").otherwise("-") for _, _, bad, good in rules()]
    return measured.withColumn("__votes", F.concat(*each))


def estimate(counts: dict[str, int], kinds: tuple[str, ...] | None = None, rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior probability of good for every vote pattern, by expectation maximisation.

    A text is good or bad of one of the kinds that the rules see (``kinds``:
    each rule's; without, one kind of all rules). A rule that does not
    abstain votes bad with a probability of its own in every class,
    independent of the other rules given the class; an abstention says
    nothing. All these rates and the shares of the classes are estimated.
    Weak pseudo-counts tell the classes apart: a rule seldom votes bad on
    good texts and mostly does on its own kind. Starts from: a pattern
    belongs to the kinds of its bad votes, one without any to good.
    """
    if not counts:
        return {}
    patterns = list(counts)
    kinds = kinds or ("bad",) * len(patterns[0])
    names = list(dict.fromkeys(kinds))
    own = np.array([[k == name for k in kinds] for name in names], float)
    n = np.array([counts[p] for p in patterns], float)
    bad = np.array([[c == "b" for c in p] for p in patterns], float)
    good = np.array([[c == "g" for c in p] for p in patterns], float)
    pseudo = [np.concatenate([np.full((1, len(kinds)), IN_GOOD[v]), own * IN_OWN[v] + (1 - own) * IN_OTHER[v]]) for v in (0, 1)]
    hits = (bad[:, None, :] * own[None, :, :]).sum(axis=2)
    part = np.concatenate([np.where(hits.any(axis=1), 0.05, 1.0)[:, None], hits], axis=1) + 0.01
    part /= part.sum(axis=1, keepdims=True)
    sums = lambda a, b: (a[:, :, None] * b[:, None, :]).sum(axis=0)  # noqa: E731  a product without the linear algebra thread pool
    for _ in range(rounds):
        weight = part * n[:, None]
        shares = (weight.sum(axis=0) + 1) / (n.sum() + len(names) + 1)
        x, y = sums(weight, bad) + pseudo[0], sums(weight, good) + pseudo[1]
        rate = x / (x + y)
        logs = np.log(shares)[None, :] + sums(bad.T, np.log(rate).T) + sums(good.T, np.log1p(-rate).T)
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done, part = np.abs(new - part).max() < 1e-10, new
        if done:
            break
    return {p: float(q) for p, q in zip(patterns, part[:, 0], strict=True)}


def _posteriors(voted: DataFrame) -> DataFrame:
    """(__votes, __good) of all patterns: at most 3 to the number of rules, whatever the input."""
    rows = voted.groupBy("__votes").count().collect()
    table = estimate({r["__votes"]: r["count"] for r in sorted(rows, key=lambda r: r["__votes"])}, KINDS)
    schema = StructType([StructField("__votes", StringType()), StructField("__good", DoubleType())])
    return voted.sparkSession.createDataFrame(list(table.items()), schema)


def _verdict(voted: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Adds __good, __base_failed and __kept."""
    failed = (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))
    return (
        voted.join(F.broadcast(posteriors), "__votes")
        .withColumn("__base_failed", failed)
        .withColumn("__kept", ~failed & (F.col("__good") >= 0.5))
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, votes, posterior probability of good, base_failed and kept, a row a document.

    Votes are counted over all documents. A null text has no words; under 10
    words, or over a fifth of the words in repeated five-word runs, fails
    outright. Null ids and repeated rows are carried as they are, very long
    texts are read as a whole. An empty table gives an empty result. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    voted = stored(votes(with_statistics(rows, "text", ["doc_id"])), "quality")
    out = _verdict(voted, _posteriors(voted))
    return out.select("doc_id", *[F.col(f"__{s}").alias(s) for s in STATS], *[F.col(f"__{c}").alias(c) for c in ("votes", "good", "base_failed", "kept")])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged. Statistics are taken twice rather than moved."""
    own = plain_names(docs)
    text = f"c{docs.columns.index(text_col)}"
    posteriors = _posteriors(votes(with_statistics(own, text, [])))
    voted = votes(with_statistics(own, text, own.columns))
    return _verdict(voted, posteriors).filter("__kept").select(*own.columns).toDF(*docs.columns)
