"""Reply trees: root-to-leaf paths, branch ranking, and chat formatting with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respanel.llm.common import prepare, stored

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """No ``<|`` is left: ``<`` and ``|`` with n backslashes between get one more. Reversible."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(conversation, [start, end) of the assistant texts in code points)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{_role(role)}\n", escape(text), f"{END}\n"
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; inverse of ``format_turns``."""
    out = []
    for block in formatted.split(START)[1:]:
        head, _, rest = block.partition("\n")
        out.append((_unrole(head), unescape(rest[: -len(END) - 1])))
    return out


def tree(rows: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """Rows of linear conversations as reply trees: adds node and parent, each turn the reply to the one before."""
    turn = F.row_number().over(Window.partitionBy(conv).orderBy(*order)).cast("long")
    return rows.withColumn("node", turn).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(conv, leaf, node, depth, score) of the nodes on the ``top`` best root-to-leaf paths of every tree.

    ``nodes``: conv, node, parent (null at a root), score. Of rows that share
    conv and node the least (parent, score) counts, nulls first.
    A path scores the mean of its nodes' scores (null: 0); ties go to the
    smaller leaf. Paths grow by self-joins that double the reach, so a tree
    of depth d takes log2(d) rounds. A node whose parent is not there counts
    as a root; nodes on a cycle have no root and no path.
    """
    nodes = nodes.groupBy("conv", "node").agg(F.min(F.struct("parent", "score")).alias("x")).select("conv", "node", "x.parent", "x.score")
    known = nodes.select("conv", F.col("node").alias("parent"))
    rows = nodes.select("conv", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.join(known.withColumn("known", F.lit(True)), ["conv", "parent"], "left")
    jump = stored(rows.select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("depth")), "tree")
    leaves = jump.select("conv", "node").join(jump.select("conv", F.col("up").alias("node")).filter("node is not null").distinct(), ["conv", "node"], "left_anti")
    jumps, total = [], jump.count()
    ended = jump.filter("up is null")  # their path to the root is summed; only the others are joined again
    open_ = jump.filter("up is not null")
    while not open_.isEmpty() and 1 << len(jumps) <= total:
        jumps.append(open_.select("conv", "node", "up"))
        above = ended.unionByName(open_).select(
            "conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2")
        )
        grown = open_.join(above, ["conv", "up"]).select(
            "conv", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth")
        )
        grown = stored(grown, "tree")
        ended, open_ = ended.unionByName(grown.filter("up is null")), grown.filter("up is not null")
    jump = ended
    ranked = leaves.join(jump, ["conv", "node"]).select("conv", F.col("node").alias("leaf"), (F.col("score") / F.col("depth")).alias("score"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
    chosen = ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    on = stored(chosen.select("conv", "leaf", "score", F.col("leaf").alias("node")), "branch")
    for up in jumps:  # after k rounds the last 2^k nodes of each path are there
        more = on.join(up, ["conv", "node"]).select("conv", "leaf", "score", F.col("up").alias("node"))
        on = stored(on.unionByName(more), "branch")
    depth = jump.select("conv", "node", "depth")
    return on.join(depth, ["conv", "node"]).select("conv", "leaf", "node", "depth", "score")


FORMATTED = "conv long, leaf long, score double, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """One formatted conversation for each chosen path of ``nodes`` (conv, node, parent, score, role, text).

    Columns: conv, leaf, score, n_turns, formatted, loss (code point spans of
    the assistant texts, as escaped). A null role or text is empty. Control
    strings inside roles and texts are escaped reversibly. Trees with a null
    conv form one tree of their own. Rows that share conv and node are one
    node, the least of them. One conversation is formatted by one task, which
    holds its text. Other columns are ignored. An empty table gives an empty
    result.
    """
    prepare(nodes.sparkSession)
    keyed = nodes.withColumn("conv", F.coalesce(F.col("conv").cast("long"), F.lit(NO_CONV)))
    paths = branches(keyed.select("conv", "node", "parent", "score"), top)
    least = keyed.groupBy("conv", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("x"))
    texts = least.select("conv", "node", F.coalesce("x.role", F.lit("")).alias("role"), F.coalesce("x.text", F.lit("")).alias("text"))
    rows = paths.join(texts, ["conv", "node"]).select("conv", "leaf", "score", "depth", "role", "text")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv", "leaf").sortWithinPartitions("conv", "leaf", "depth")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns = None, []

        def closed() -> pa.RecordBatch:
            formatted, spans = format_turns(turns)
            row = {"conv": None if key[0] == NO_CONV else key[0], "leaf": key[1], "score": key[2], "n_turns": len(turns), "formatted": formatted}
            schema = pa.schema(
                [("conv", pa.int64()), ("leaf", pa.int64()), ("score", pa.float64()), ("n_turns", pa.int64()), ("formatted", pa.string())]
                + [("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            )
            return pa.RecordBatch.from_pylist([row | {"loss": [{"start": s, "end": e} for s, e in spans]}], schema=schema)

        done = []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            for conv, leaf, score, role, text in zip(*cols, strict=True):
                if key is not None and key[:2] != (conv, leaf):
                    done.append(closed())
                    turns = []
                key = (conv, leaf, score)
                turns.append((role, text))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if key is not None:
            yield closed()

    return rows.mapInArrow(told, FORMATTED)


#: Stands for a null conversation id, which equi-joins would drop.
NO_CONV = -(2**63)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of formatted conversations, taken from the formatted text and its loss mask alone."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            text = row["formatted"]
            turns = parse_turns(text)
            said = "".join(unescape(text[x["start"] : x["end"]]) for x in row["loss"])
            told = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append(
                {
                    "conv_id": row["conv"],
                    "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256(told.encode()).hexdigest(),
                    "loss_chars": len(said),
                    "loss_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    "formatted_chars": len(text),
                }
            )
        kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (read(b) for b in batches if b.num_rows)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv", "formatted", "loss").mapInArrow(run, schema)
