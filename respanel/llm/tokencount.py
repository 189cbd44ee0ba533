"""Token counts: pieces are counted once for each distinct pre-token and joined to the frequencies of every document.

The pre-tokens of a byte-level vocabulary are merged independently of each
other, so a document's count is the sum over its distinct pre-tokens of how
often it holds them times the pieces they fall into. No ids are made for
documents: the library sees every distinct pre-token of the corpus once.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respanel.llm.common import prepare, stored, text_bytes

LIMIT = 1024
#: Commonest pre-tokens that every worker holds, at most. All others meet their counts in a shuffle.
FEW = 200_000
#: Characters of a pre-token that stands for itself in joins; a longer one is told by its SHA-256.
SHORT = 64
#: Distinct pre-tokens, and characters of texts, that a task gathers before it passes them on.
GATHERED, GATHERED_CHARS = 200_000, 50_000_000
#: Pre-tokens and characters handed to the library at once.
LIBRARY_ROWS, LIBRARY_CHARS = 4096, 1_000_000

_CUTTERS: dict[str, Callable[[str], list[str]]] = {}


def unassigned(text: str) -> bool:
    """Does the text hold code points that the interpreter's Unicode tables leave open? Libraries of other versions may class them as they like."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


def cutter(vocabulary: str) -> Callable[[str], list[str]]:
    """Cuts a text into the pre-tokens of a ``tokenizers`` file, added tokens apart, as the library does.

    Only files that split by the byte-level pattern alone are taken: there
    every pre-token is merged by itself. Texts with code points that this
    interpreter does not know are cut by the library itself.
    """
    if vocabulary not in _CUTTERS:
        import public_tokenizers

        with open(vocabulary, encoding="utf-8") as file:
            own = json.load(file)
        kind = own.get("pre_tokenizer") or {}
        if own.get("normalizer") or own.get("truncation") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{vocabulary}: only plain byte-level vocabularies have independent pre-tokens")
        if odd := [x["content"] for x in own["added_tokens"] if x.get("lstrip") or x.get("rstrip") or x.get("single_word")]:
            raise ValueError(f"added tokens that take white space or whole words only are not supported: {odd}")
        named = sorted((x["content"] for x in own["added_tokens"] if x["content"]), key=len, reverse=True)
        apart = regex.compile("(" + "|".join(map(regex.escape, named)) + ")") if named else None
        plain, whole = regex.compile(public_tokenizers.PATTERN), library(vocabulary).pre_tokenizer

        def parts(text: str) -> list[str]:
            if unassigned(text):
                return [text[a:b] for _, (a, b) in whole.pre_tokenize_str(text)]
            return plain.findall(text)

        def cut(text: str) -> list[str]:
            if apart is None or not any(x in text for x in named):
                return parts(text)
            return [x for k, part in enumerate(apart.split(text)) for x in ([part] if k % 2 else parts(part))]

        _CUTTERS[vocabulary] = cut
    return _CUTTERS[vocabulary]


def library(vocabulary: str):
    """The library's tokenizer on one thread, without what it could cut off or pad."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def key(piece: str) -> str:
    """What a pre-token is joined by: itself, or a digest that is longer than any such."""
    return piece if len(piece) <= SHORT else "\0" + hashlib.sha256(piece.encode()).hexdigest()


def frequencies(texts: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, n): the distinct pre-tokens of all ``texts`` (one column) and how often they occur. A task's own are summed before the shuffle."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held, chars = cutter(vocabulary), Counter(), 0

        def out() -> Iterator[pa.RecordBatch]:
            names, n = list(held), list(held.values())
            for k in range(0, len(names), LIBRARY_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + LIBRARY_ROWS], pa.string()), pa.array(n[k : k + LIBRARY_ROWS], pa.int64())], names=["piece", "n"])
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                own = text.as_py()
                held.update(cut(own))
                chars += len(own)
                if len(held) > GATHERED or chars > GATHERED_CHARS:
                    yield from out()
                    chars = 0
        yield from out()

    return texts.mapInArrow(gather, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def counted(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """(key, n, tokens): every distinct pre-token goes through the library once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(vocabulary)
        for batch in batches:
            names, lengths, at = batch.column("piece").to_pylist(), [], 0
            while at < len(names):
                end, chars = at + 1, len(names[at])
                while end < len(names) and chars + len(names[end]) <= LIBRARY_CHARS:
                    chars += len(names[end])
                    end += 1
                lengths += [len(x) for x in tokenizer.encode_batch_fast(names[at:end], add_special_tokens=False)]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(map(key, names), pa.string()), batch.column("n"), pa.array(lengths, pa.int64())], names=["key", "n", "tokens"])

    return pieces.select("piece", "n").mapInArrow(encode, "key string, n long, tokens long")


def commonest(known: DataFrame) -> tuple[dict[str, int], int]:
    """({key: tokens}, bound): the pre-tokens that occur ``bound`` times and more, ``FEW`` at most.

    The bound is read off the counts of counts; pre-tokens are never ordered.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = known.groupBy(level.alias("level")).agg(F.count("*").alias("keys"), F.min("n").alias("least"), F.max("n").alias("most")).collect()
    bound, room = max((r["most"] for r in sizes), default=0) + 1, FEW
    for row in sorted(sizes, reverse=True):
        room -= row["keys"]
        if room < 0:
            break
        bound = row["least"]
    rows = known.filter(F.col("n") >= bound).select("key", "tokens").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), bound


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes, tokens as the library gives them, whether these exceed ``limit``.

    The commonest pre-tokens, ``FEW`` at most, are sent to all workers; a
    document's others are joined to their counts by a shuffle, in which every
    pre-token is rarer than all those sent. Strings of added tokens inside
    texts are one token, as is the library's default; nothing is added.

    A null or empty text has no bytes and no tokens. Null ids and repeated
    rows come back as they are, one result a row; other columns are ignored
    whatever their names. A very long text is cut whole, and a very long
    pre-token is encoded whole. An empty table gives an empty result.
    """
    import public_tokenizers

    spark = docs.sparkSession
    prepare(spark)
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = stored(counted(stored(frequencies(texts.select("text"), vocabulary), "pre-tokens"), vocabulary), "piece-counts")
    common, bound = commonest(known)
    sent = spark.sparkContext.broadcast(common)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, tokens = cutter(vocabulary), sent.value
        kind = pa.list_(pa.struct([("key", pa.string()), ("times", pa.int64())]))
        for batch in batches:
            met, rest = [], []
            for text in batch.column("text"):
                n, own = 0, []
                for piece, times in Counter(cut(text.as_py())).items():
                    if (each := tokens.get(name := key(piece))) is None:
                        own.append({"key": name, "times": times})
                    else:
                        n += each * times
                met.append(n)
                rest.append(own)
            columns = [batch.column(c) for c in ("row", "doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(met, pa.int64()), pa.array(rest, kind)], names=["row", "doc_id", "n_bytes", "met", "rest"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length(text_bytes("text")).cast("long").alias("n_bytes"), "text")
    per_doc = stored(rows.mapInArrow(sums, f"row long, doc_id {id_type}, n_bytes long, met long, rest array<struct<key: string, times: long>>"), "token-sums")
    rare = per_doc.select("row", F.inline("rest")).join(known.filter(F.col("n") < bound).select("key", "tokens"), "key")
    others = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("others"))
    n_tokens = F.col("met") + F.coalesce("others", F.lit(0))
    whole = per_doc.select("row", "doc_id", "n_bytes", "met").join(others, "row", "left")
    return whole.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
