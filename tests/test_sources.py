"""Readers: every format gives the same records, refusals name their place."""

import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from respanel.schema import FormatError, RecordError
from respanel.sources import delimited, helm, inspect_logs
from respanel.sources.registry import read_any

ROWS = [("m1", "0042", 1), ("m1", "q2", 0), ("m2", "0042", 0), ("m2", "q2", 1)]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def triples(df):
    return sorted((r.model_id, r.item_id, r.correct) for r in df.collect())


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"model_id": m, "item_id": i, "correct": bool(c), "subject": "s", "seed": 3}) for m, i, c in ROWS]
    path = write(tmp_path / "a.jsonl", "\n" + lines[0] + "\n\n" + "\n".join(lines[1:]) + "\n")
    rows = read_any(spark, path).orderBy("_seq").collect()
    assert [(r.model_id, r.item_id, r.correct) for r in rows] == ROWS and [r._line for r in rows] == [2, 4, 5, 6]
    assert rows[0].extra == {"seed": "3"} and rows[0].subject == "s"
    for bad, place in (("[1]", ":2"), ("{x", ":2"), ('{"model_id": "a", "item_id": "b", "correct": 0.5}', ":2"), ('{"model_id": "a", "correct": 1}', ":2")):
        with pytest.raises(RecordError, match=place):
            read_any(spark, write(tmp_path / "b.jsonl", lines[0] + "\n" + bad), fmt="jsonl")
    with pytest.raises(FormatError, match="no such file"):
        read_any(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(FormatError, match="unknown format"):
        read_any(spark, path, fmt="xml")


@pytest.mark.parametrize(("name", "sep"), [("a.csv", ","), ("a.tsv", "\t"), ("b.csv", ";")])
def test_delimited(spark, tmp_path, name, sep):
    head = sep.join(["model_id", "item_id", "correct", "subject", "raw_score", "note"])
    body = [sep.join([m, i, str(c), "", "0.5", "n"]) for m, i, c in ROWS]
    path = write(tmp_path / name, "﻿" + head + "\n" + body[0] + "\n\n" + "\n".join(body[1:]) + "\n")
    rows = read_any(spark, path)
    assert triples(rows) == sorted(ROWS)
    one = rows.first()
    assert one.subject is None and one.raw_score == 0.5 and one.extra == {"note": "n"}
    with pytest.raises(RecordError, match="more cells"):
        read_any(spark, write(tmp_path / f"x{name}", head + "\n" + body[0] + sep + "z\n"))
    with pytest.raises(RecordError, match="0.87"):
        read_any(spark, write(tmp_path / f"y{name}", head + "\n" + sep.join(["m", "i", "0.87", "", "", ""]) + "\n"))
    with pytest.raises(FormatError):
        read_any(spark, write(tmp_path / f"z{name}", sep.join(["model_id", "item_id"]) + "\n"), fmt="csv")


def many_blocks(spark, size):
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{name}", str(size))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


@pytest.mark.parametrize("block", [97, 1 << 20])
def test_quoted_line_ends_over_many_blocks(spark, tmp_path, block):
    """Cells with line ends, doubled quotes and lone quotes, cut by blocks anywhere, against the standard library."""
    draw = random.Random(4)
    cells = ["plain", 'two\nlines', 'a "quoted" word', '""', "x,y", "\n\n", 'end"', "5\" disk", "", "é\n" * 40, 'a\n"b"\n,c']
    rows = [[f"m{k % 7}", f"q{k}", str(k % 2), draw.choice(cells), draw.choice(cells)] for k in range(150)]
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(["model_id", "item_id", "correct", "note", "other"])
    for k, row in enumerate(rows):
        writer.writerow(row) if k % 11 else text.write(f'{row[0]},{row[1]},{row[2]},un"quoted,5" disk\n')
    path = write(tmp_path / "a.csv", text.getvalue())
    text.seek(0)
    reader = csv.DictReader(text)
    want, line = [], 1
    for r in reader:
        want.append((r["item_id"], {k: v.strip() for k, v in (("note", r["note"]), ("other", r["other"])) if v.strip()}, line + 1))
        line = reader.line_num
    try:
        many_blocks(spark, block)
        got = read_any(spark, path)
        assert block > 1000 or got.rdd.getNumPartitions() > 5
        assert [(r.item_id, r.extra, r._line) for r in got.orderBy("_seq").collect()] == want
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")


def test_an_endless_quote_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "LONGEST", 5)
    path = write(tmp_path / "a.csv", 'model_id,item_id,correct\nm,a,1\nm,"b,0\n' + "m,c,1\n" * 9)
    with pytest.raises(RecordError, match="runs over"):
        read_any(spark, path)


def sample(doc, **more):
    return json.dumps({"doc_id": doc, "doc": {"subject": "alg"} if doc else {}, "metrics": ["acc", "acc_norm"], "acc": 1.0, "acc_norm": 0.0} | more)


def test_lmeval(spark, tmp_path):
    write(tmp_path / "dir_a" / "samples_my_task_2024-01-01.jsonl", sample(0) + "\n" + sample(1, acc=0.0) + "\n")
    write(tmp_path / "dir_a" / "results_2024.json", json.dumps({"config": {"model_args": "pretrained=org/a,dtype=x"}}))
    write(tmp_path / "dir_b" / "samples_my_task_2024-01-01.jsonl", sample(0, filter="none") + "\n" + sample(0, filter="strict", acc=0.0) + "\n")
    rows = read_any(spark, str(tmp_path), fmt="lmeval")
    assert triples(rows) == [("dir_b", "my_task_0", 1), ("org/a", "my_task_0", 1), ("org/a", "my_task_1", 0)]
    assert {r.item_id: r.subject for r in rows.collect() if r.model_id == "org/a"} == {"my_task_0": "my_task", "my_task_1": "alg"}
    b = str(tmp_path / "dir_b")
    assert triples(read_any(spark, b, fmt="lmeval", filter="strict", model_id="me")) == [("me", "my_task_0", 0)]
    assert triples(read_any(spark, b, fmt="lmeval", metric="acc_norm")) == [("dir_b", "my_task_0", 0)]
    with pytest.raises(RecordError, match="filter"):
        read_any(spark, b, fmt="lmeval", filter="other")
    with pytest.raises(RecordError, match="metric"):
        read_any(spark, b, fmt="lmeval", metric="f1")


def log(samples):
    return {"version": 2, "status": "success", "eval": {"model": "org/m", "task": "t"}, "samples": samples}


def test_inspect(spark, tmp_path):
    values = ["C", "I", True, 0, "N"]
    samples = [{"id": k, "epoch": 1, "scores": {"match": {"value": v}}} for k, v in enumerate(values)] + [{"id": 9, "epoch": 1, "scores": None, "error": "x"}]
    path = write(tmp_path / "one" / "a.json", json.dumps(log(samples)))
    want = [("org/m", f"t_{k}", c) for k, c in enumerate([1, 0, 1, 0, 0])]
    assert triples(read_any(spark, path)) == want
    packed = tmp_path / "two" / "a.eval"
    packed.parent.mkdir()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("header.json", json.dumps({"eval": {"model": "org/m", "task": "t"}}))
        for k, s in enumerate(samples):
            z.writestr(f"samples/{k}_epoch_1.json", json.dumps(s))
    assert triples(read_any(spark, str(packed))) == want
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
        with zipfile.ZipFile(packed, "w", method) as z:
            z.writestr("header.json", json.dumps({"eval": {"model": "org/m", "task": "t"}}))
            for k, s in enumerate(samples):
                z.writestr(f"samples/{k}_epoch_1.json", json.dumps(s))
        assert triples(read_any(spark, str(packed))) == want
    two = [{"id": 1, "epoch": 1, "scores": {"a": {"value": 1}, "b": {"value": 0}}}]
    path = write(tmp_path / "three" / "a.json", json.dumps(log(two)))
    assert triples(read_any(spark, path, fmt="inspect", scorer="b")) == [("org/m", "t_1", 0)]
    with pytest.raises(RecordError, match="several scorers"):
        read_any(spark, path, fmt="inspect")
    with pytest.raises(RecordError):
        read_any(spark, write(tmp_path / "four" / "a.json", json.dumps(log([{"id": 1, "scores": {"a": {"value": "P"}}}]))), fmt="inspect")


def test_a_large_archive_is_read_by_many_tasks(spark, tmp_path):
    packed = tmp_path / "big log.eval"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("header.json", json.dumps({"eval": {"model": "org/m", "task": "t"}}))
        for k in range(10_000):
            z.writestr(f"samples/{k:05d}.json", json.dumps({"id": k, "epoch": 1, "scores": {"m": {"value": "CI"[k % 2]}}}))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = inspect_logs.samples(spark, str(packed))
    by_task = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) >= 4 and sum(r["count"] for r in by_task) == 10_000 and max(r["count"] for r in by_task) < 5_000
    got = read_any(spark, str(packed))
    assert got.count() == 10_000 and got.filter("correct = 1").count() == 5_000
    assert {r._line: r.item_id for r in got.filter("_line < 4").collect()} == {1: "t_0", 2: "t_1", 3: "t_2"}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_run_names(spark):
    names = ["r/runs/v1.9.0/math:level=1,model=a_b,k=1/", "r/runs/v1.10.0/math:level=1,model=a_b,k=1/", "r/runs/v1.10.0/math:level=1,model=a_b/", "r/runs/v1.2.0/other/"]
    parsed = helm.parse_runs(spark.createDataFrame([(n,) for n in names], "prefix string"))
    best = helm.latest_runs(parsed).collect()
    assert [(r.spec, r.model, r.version, r.params) for r in best] == [("math:level=1", "a_b", "v1.10.0", "")]
    stats = spark.createDataFrame([("id1", {"exact_match": 1.0}), ("id2", {"other": 0.5})], "instance_id string, stats map<string,double>")
    assert triples(helm.records(stats, "m", "s")) == [("m", "s_id1", 1)]
