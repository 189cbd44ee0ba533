"""CSV and TSV with a header."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respanel.functions.coerce import build_records
from respanel.schema import PASSTHROUGH, REQUIRED, FormatError, RecordError
from respanel.operators.store import stored
from respanel.sources.jsonl import numbered_lines
from respanel.sources.registry import Reader, head_of, register

DELIMITERS = (",", "\t", ";", "|")
#: Lines that one quoted cell may run over.
LONGEST = 100_000


def header_of(head: bytes) -> str:
    text = head.decode("utf-8-sig", "replace")
    return next((x for x in text.splitlines() if x.strip()), "")


def delimiter(path: str, header: str) -> str:
    """Tab for .tsv, else what cuts the header into most fields, the comma on a tie."""
    if path.lower().endswith(".tsv"):
        return "\t"
    return max(DELIMITERS, key=lambda d: (header.count(d), d == ","))


def columns_of(header: str, sep: str) -> list[str]:
    return [c.strip().strip('"') for c in header.split(sep)]


def leaves_open(line: Column, sep: str) -> Column:
    """Does a line that begins a record end inside a quoted cell? A quote opens a cell only at its start and is doubled inside."""
    cell, s = r'"[^"]*+(?:""[^"]*+)*+', re.escape(sep)
    return line.rlike(rf'^(?s)(?:(?:{cell}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+{cell}$')


def whole_records(lines: DataFrame, sep: str) -> DataFrame:
    """``lines`` (value, _source, _line, _seq, __at) with the lines of a record that a quoted cell runs over joined, under the place of its first line.

    A line maps the state before it (inside a quoted cell or not) to the state
    behind it, and so does a block of lines. The maps of the blocks, one row a
    block, are composed in order of the file; inside a block lines follow
    from its entry. So a record is found wherever blocks cut it, and no task
    takes a file. Only lines of such records are moved; a file without any
    is passed on as it is.
    """
    a = leaves_open(F.col("value"), sep).cast("int")
    b = F.when(F.instr("value", '"') == 0, F.lit(1)).otherwise(leaves_open(F.concat(F.lit('"'), "value"), sep).cast("int"))
    if lines.filter(a == 1).isEmpty():
        return lines.drop("__at")
    # a map is constant (both states lead to one), or it keeps or swaps them
    kinds = lines.withColumns({"a": a, "b": b}).withColumn("swap", ((F.col("a") == 1) & (F.col("b") == 0)).cast("long"))
    block = Window.partitionBy("_source", "__at").orderBy("_line")
    upto, before = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("swaps", F.sum("swap").over(upto))
    fixed = F.when(F.col("a") == F.col("b"), F.struct("a", "swaps"))
    kinds = kinds.withColumns({"set_by": F.last(fixed, ignorenulls=True).over(before), "earlier": F.col("swaps") - F.col("swap")})
    kinds = stored(kinds.withColumn("fixed", fixed).drop("b"), "csv-lines")
    ends = kinds.groupBy("_source", "__at").agg(F.max("_line").alias("end"), F.sum("swap").alias("swaps"), F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.col("_line"))).alias("fixed"))
    # of a block: where it sets the state, the state it leaves; else whether it swaps
    order = Window.partitionBy("_source").orderBy("__at")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("total", F.sum("swaps").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.when(F.col("fixed").isNotNull(), F.struct(((F.col("fixed.a") + F.col("swaps") - F.col("fixed.swaps")) % 2).alias("state"), F.col("total").alias("total")))
    ends = ends.withColumn("last", F.last(left, ignorenulls=True).over(past))
    entry = (F.coalesce("last.state", F.lit(0)) + F.col("total") - F.col("swaps") - F.coalesce("last.total", F.lit(0))) % 2
    entered = ends.select("_source", "__at", entry.alias("entry"))
    state = F.when(F.col("set_by").isNull(), (F.col("entry") + F.col("earlier")) % 2).otherwise((F.col("set_by.a") + F.col("earlier") - F.col("set_by.swaps")) % 2)
    known = kinds.join(F.broadcast(entered), ["_source", "__at"]).withColumn("inside", state == 1)
    known = stored(known.select("value", "_source", "_line", "_seq", "__at", "inside", ((state == 0) & (F.col("a") == 1)).alias("opens")), "csv-states")
    single = known.filter(~F.col("inside") & ~F.col("opens")).select("value", "_source", "_line", "_seq")
    # lines of records that run on: a record's first line is the last one that opened, in this block or before it
    parts = known.filter(F.col("inside") | F.col("opens"))
    heads = parts.filter("opens").groupBy("_source", "__at").agg(F.max(F.struct("_line", "_seq")).alias("head"))
    blocks = parts.select("_source", "__at").distinct().join(heads, ["_source", "__at"], "left")
    blocks = blocks.select("_source", "__at", F.last("head", ignorenulls=True).over(past).alias("carried"))
    own = F.last(F.when(F.col("opens"), F.struct("_line", "_seq")), ignorenulls=True).over(upto)
    parts = parts.join(F.broadcast(blocks), ["_source", "__at"]).withColumn("head", F.coalesce(own, "carried"))
    parts = stored(parts.select("_source", "head", "_line", "value"), "csv-parts")
    records = parts.groupBy("_source", "head")
    if endless := records.count().filter(F.col("count") > LONGEST).select("_source", "head._line").limit(1).collect():
        raise RecordError(f"a quoted cell runs over {LONGEST} lines and more", *endless[0])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_line", "value"))), lambda x: x["value"]), "\n")
    return single.unionByName(records.agg(text.alias("value")).select("value", "_source", "head._line", "head._seq"))


def read_delimited(spark: SparkSession, path: str, strict: bool = True, sep: str | None = None) -> DataFrame:
    """Records of a table: every cell text, an empty cell absent, a row with more cells than the header raises.

    Cells are cut by the CSV parser over single records, so a record keeps
    the number of its first line. A quoted cell may hold line ends and
    doubled quotes; the header may not.
    """
    header = header_of(head_of(spark, path))
    sep = sep or delimiter(path, header)
    names = columns_of(header, sep)
    absent = [c for c in REQUIRED if c not in names]
    if absent:
        raise FormatError(f"{path} lacks the column {', '.join(absent)}")
    schema = ", ".join([*(f"c{k} string" for k in range(len(names))), "more string"])
    place = {c: f"c{k}" for k, c in reversed(list(enumerate(names)))}
    lines = numbered_lines(spark, path, blocks=True).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    lines = whole_records(lines, sep)
    first = lines.filter(F.trim("value") != "").groupBy("_source").agg(F.min("_line").alias("__first"))
    body = lines.join(first, "_source").filter((F.col("_line") > F.col("__first")) & (F.trim("value") != ""))
    rows = body.withColumn("x", F.from_csv("value", schema, {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}))
    if strict:
        long = rows.filter(F.col("x.more").isNotNull()).orderBy("_source", "_line").select("_source", "_line").limit(1).collect()
        if long:
            raise RecordError("more cells than the header", *long[0])
    value = lambda c: F.nullif(F.btrim(F.col("x")[place[c]], F.lit(" \t\r\n")), F.lit(""))
    known = [c for c in names if c in REQUIRED + PASSTHROUGH]
    rest = [c for c in names if c not in known]
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(c), value(c)) for c in rest])) if rest else F.create_map().cast("map<string,string>")
    out = rows.select(
        *[(value(c).try_cast("double") if c == "raw_score" else value(c)).alias(c) for c in known],
        F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("extra"),
        "_source",
        "_line",
        "_seq",
    )
    return build_records(out, strict)


def sniff(path: str, head: bytes) -> bool:
    header = header_of(head)
    return set(REQUIRED) <= set(columns_of(header, delimiter(path, header)))


register(Reader("csv", (".csv", ".tsv"), sniff, read_delimited, "a table with model_id, item_id and correct"))
