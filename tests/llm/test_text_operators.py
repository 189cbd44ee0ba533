"""Decontamination, line and sentence dedup, quality rules and the classifier against plain Python."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from respanel.llm import decontaminate, linededup, quality, rulefit, sentences

DOCS = "doc_id long, text string, fp string, __raw string, key long"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], DOCS)


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(n))


EDGE = [(None, None), (None, "one two"), (1, None), (2, ""), (3, "   \n\n "), (4, "word"), (5, words(40_000, 1)), (4, "word")]


def test_leaks_exact_changed_and_partial(spark):
    item = words(40, 2)
    changed = " ".join(w if k % 6 else "zzz" for k, w in enumerate(item.split()))
    far = " ".join(w if k % 2 else "zzz" for k, w in enumerate(item.split()))
    docs = table(spark, [(10, f"{words(50, 3)} {item.upper()}! {words(9, 4)}"), (11, words(30, 5) + " " + changed), (12, far), (13, words(80, 6)), (14, " ".join(item.split()[5:25])), *EDGE])
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "only three words"), (4, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, items).collect()}
    assert set(got) == {(d, i) for d in (10, 11, 14) for i in (0, 4)}
    assert got[10, 0].start_word == 50 and got[10, 0].n_words == 40 and got[10, 0].identity == 1.0
    assert got[11, 0].identity >= 0.8 and got[14, 0].n_words == 20
    small = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items, block_words=10).collect()}
    assert small == set(got)
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_more_items_than_an_index_numbers(spark, monkeypatch):
    """Items past the last number of an index are joined, whatever their words; up to it no hit is mistaken for another's."""
    items = [(k, f"w{k} x{k} y{k} z{k}") for k in range(40)]
    docs = table(spark, [(100 + k, f"before w{k} x{k} y{k} z{k} after") for k in (0, 7, 8, 9, 38, 39)])
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = {(100 + k, k) for k in (0, 7, 8, 9, 38, 39)}
    for bits in (20, 6, 5, 3):
        monkeypatch.setattr(decontaminate, "ITEM_BITS", bits)
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, tests).collect()} == want


def test_the_last_item_of_a_full_index_is_told_from_the_first():
    index = decontaminate.SeedIndex([(k, b"a%07d" % k) for k in range(1 << decontaminate.ITEM_BITS)])
    tokens = decontaminate.token_hashes(b"a%07d b a%07d" % ((1 << decontaminate.ITEM_BITS) - 1, 0))
    hits = index.hits(tokens, np.array([0, len(tokens)]))
    assert {(int(d), int(k)) for d, k, _ in hits} == {(0, (1 << decontaminate.ITEM_BITS) - 1), (0, 0)}


def test_leaks_match_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    fold = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).split()
    own = {r.doc_id: " ".join(fold(r.text)) for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in own.items() if f" {' '.join(fold(r.text))} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()}
    assert want and want <= got


def test_every_pattern_of_a_fifth_of_changes_hits():
    # an overlap of 26 words or more holds one of 13 to 20 with as few changes; 21 to 24 words with 4 changes hold one of 20
    for n in [*range(decontaminate.SPAN, 21), 25]:
        patterns = np.array([sum(1 << k for k in p) for p in itertools.combinations(range(n), n // 5)])
        open_ = np.ones(len(patterns), bool)
        for mask in decontaminate.MASKS:
            assert len(mask) <= decontaminate.SPAN
            for at in range(n - len(mask) + 1):
                open_ &= (patterns & (int(mask[::-1], 2) << at)) != 0
        assert not open_.any(), n


def test_short_changed_items_are_found(spark):
    item = words(13, 21).split()
    rows, cut = [], list(itertools.combinations(range(13), 2))
    for k, (a, b) in enumerate(cut):
        rows.append((1000 + k, " ".join(["before", *(f"new{k}" if j in (a, b) else w for j, w in enumerate(item)), "after"])))
    items = spark.createDataFrame([(0, " ".join(item)), (1, words(7, 22)), (2, words(6, 23))], "item_id long, text string")
    seven, six = words(7, 22).split(), words(6, 23).split()
    rows += [(1, " ".join([*seven[:3], "zzz", *seven[4:]])), (2, f"x {words(7, 22)} y"), (3, " ".join([*six[:3], "zzz", *six[4:]])), (4, f"x {words(6, 23)} y")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table(spark, rows), items).collect()}
    assert got == {(1000 + k, 0) for k, (a, b) in enumerate(cut)} | {(2, 1), (4, 2)}


def test_leaks_empty_tables(spark):
    docs, items = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, items).count() == 0
    assert decontaminate.overlaps(table(spark, EDGE), items).count() == 0


def brute_lines(rows):
    first = {}
    for i, t in rows:
        for _, chunk in linededup.candidates((t or "").encode()):
            if i is not None:
                first[chunk] = min(i, first.get(chunk, i))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        lines, kept, seen = t.encode().split(b"\n"), [], set()
        for s, e in linededup.chunks(lines) if len(lines) > 1 else [(0, len(lines))]:
            piece = lines[s:e]
            whole = b"\n".join(piece)
            if e - s > 1 and sum(bool(x.strip()) for x in piece) > 1:
                if whole in seen or (i is not None and first.get(whole, i) < i):
                    continue
                seen.add(whole)
            kept += piece
        out.append((i, b"\n".join(kept).decode()))
    return out


def test_line_dedup_matches_brute_force(spark):
    block = "\n".join(words(8, 100 + k) for k in range(12))
    rows = [(20 + d, "\n".join(words(5, 200 + d * 10 + k) for k in range(d % 5 + 1)) + "\n" + block + "\n" + words(6, 300 + d)) for d in range(12)]
    rows += [(40, block + "\n" + block), *EDGE, (41, block), (41, block)]
    out = linededup.dedup(table(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "__raw", "key", "__removed"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(brute_lines(rows), key=key)
    assert out.filter("doc_id = 31").first()["__removed"] >= 4
    assert linededup.dedup(table(spark, [])).count() == 0


def test_whole_line_runs_go_at_any_length(spark):
    lines = lambda n, seed: [words(6, seed * 100 + k) for k in range(n)]
    rows, want = [], {}
    for k in range(60):
        n = 2 + k % 11
        passage = lines(n, 7000 + k)
        if k % 3 == 0:
            passage.insert(1, " ")
        for d in range(2):
            before, after = lines(k % 4, 8000 + 2 * k + d), lines(1 + k % 3, 9000 + 2 * k + d)
            rows.append((1000 * d + 100 + k, "\n".join(before + passage + after)))
            want[1000 * d + 100 + k] = "\n".join(before + (passage if d == 0 else []) + after)
    one = words(6, 1)
    rows += [(3000, "\n".join([one] * 3)), (3001, "a b\nc d\ne f\na b\nc d"), (3002, one + "\nx"), (None, "a b\nc d"), *EDGE]
    want |= {3000: "\n".join([one] * 3), 3001: "a b\nc d\ne f", 3002: one + "\nx", None: None}
    out = linededup.dedup(table(spark, rows), whole=True)
    got = {r.doc_id: r for r in out.collect()}
    assert {i: got[i].text for i in want if i is not None} == {i: t for i, t in want.items() if i is not None}
    assert got[1100]["__removed"] == 3 and out.count() == len(rows)
    assert {r.text for r in out.filter("doc_id is null").collect()} == {None, "one two", "a b\nc d"}
    assert linededup.dedup(table(spark, []), whole=True).count() == 0


def test_chunks_resist_shifts():
    lines = [words(5, k).encode() for k in range(60)]
    cuts = {lines[e - 1] for _, e in linededup.chunks(lines)}
    moved = {x for _, e in linededup.chunks([b"new"] + lines) for x in [([b"new"] + lines)[e - 1]]}
    assert len(cuts & moved) >= len(cuts) - 3


def brute_sentences(rows):
    first = {}
    for i, t in rows:
        for key in sentences.span_keys((t or "").encode())[1]:
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        gone = {k for k in sentences.span_keys((t or "").encode())[1] if i is not None and first[k] < i}
        out.append((i, None if t is None else sentences.without(t.encode(), gone)[0].decode()))
    return out


def test_sentence_spans_match_brute_force(spark):
    passage = ". ".join(words(9, 400 + k).capitalize() for k in range(7)) + "."
    rows = [(60 + d, f"{words(12, 500 + d)}. {passage} {words(7, 600 + d)}.") for d in range(6)]
    rows += [(70, words(70, 700) + "."), (71, "Start here. " + words(70, 700) + "."), (72, passage + " " + passage), *EDGE]
    out = sentences.dedup(table(spark, rows))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=key)
    assert got == sorted(brute_sentences(rows), key=key)
    text = dict(got)
    assert passage in text[60] and all(passage not in text[d] for d in range(61, 66))
    assert text[61].startswith(words(12, 501)) and text[61].endswith(words(7, 601) + ".")
    assert words(70, 700) in text[70] and words(70, 700) not in text[71]
    assert sentences.dedup(table(spark, [])).count() == 0


def test_sentences_tile_the_text():
    for t in ["", "A b. C d!\n\nE?  F", words(99, 1), "x" * 500, ". . .", "é. à b.\r\nç"]:
        ranges = sentences.sentences(t.encode())
        assert b"".join(t.encode()[s:e] for s, e in ranges) == t.encode()


def brute_stats(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    runs = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    covered = {p for k, r in enumerate(runs) if runs.count(r) > 1 for p in range(k, k + 5)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_quality_statistics_match_brute_force():
    for t in ["", " \n", "é à b c d e", "a b c d e f a b c d e", "x y\nx y\n\n\nx y", "# | <a> b\x0bc", words(60, 8) + " " + words(60, 8), "a a a a a a a"]:
        assert quality.statistics(t.encode())[:5] == brute_stats(t)


def test_quality_verdicts(spark, sf):
    rows = [(100 + k, words(120, 800 + k)) for k in range(60)] + [(200 + k, " ".join(w + "***" for w in words(80, 900 + k).split())) for k in range(6)]
    rows += [(300 + k, words(12, 950 + k) + " " + " ".join([words(10, 980 + k)] * 6)) for k in range(4)] + EDGE
    out = {(r.doc_id, r.n_words): r for r in quality.judge(table(spark, rows)).collect()}
    assert all(r.kept for (i, _), r in out.items() if i is not None and 100 <= i < 200)
    assert not any(r.kept for (i, _), r in out.items() if i is not None and i >= 200)
    assert out[1, 0].base_failed and out[4, 1].base_failed and not out[4, 1].kept
    kept = quality.keep_good(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert kept.count() == sum(r.kept for r in quality.judge(table(spark, rows)).collect())
    assert quality.judge(table(spark, [])).count() == 0


def test_votes_find_planted_accuracies():
    draw, counts = np.random.default_rng(3), {}
    for _ in range(4000):
        bad = draw.random() < 0.2
        p = "".join("-" if draw.random() < 0.2 else "b" if draw.random() < (0.7 if bad else 0.003) else "g" for _ in range(6))
        counts[p] = counts.get(p, 0) + 1
    post = quality.estimate(counts)
    assert post["gggggg"] > 0.98 and min(post[p] for p in post if p.count("b") > 1) < 0.05 and max(post[p] for p in post if p.count("b") > 2) < 0.05 and post["------"] > 0.5
    assert quality.estimate({}) == {}


def test_classifier_on_held_out_labels(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = rulefit.train(docs, labels)
    scored = rulefit.score(docs, model)
    test = scored.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(test) > 50 and (test.predicted == test.quality).mean() > 0.95
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0
    assert scored.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)).count() == 0


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = rulefit.train(table(spark, EDGE), none)
    rows = rulefit.score(table(spark, EDGE), model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert rulefit.score(table(spark, []), model).count() == 0


def test_rules_compile_to_the_same_scores():
    draw = np.random.default_rng(1)
    x = draw.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.6)).astype(float)
    intercept, kept = rulefit.fit(x, y, list("abcd"))
    z = np.full(600, intercept)
    for rule, weight in kept:
        z += weight * np.all([(x[:, "abcd".index(f)] <= c) if low else (x[:, "abcd".index(f)] > c) for f, low, c in rule], axis=0)
    assert ((z > 0) == (y > 0)).mean() > 0.98 and 0 < len(kept) < 40


@pytest.mark.parametrize("text", ["", "no terminal", "a b c d e f g h " * 400])
def test_long_and_short_texts_never_fail(text):
    sentences.without(text.encode(), set())
    linededup.without(text.encode(), set())
    quality.statistics(text.encode())
