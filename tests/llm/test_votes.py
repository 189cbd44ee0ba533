"""The estimate behind the quality rules against plain loops, planted rates and labels."""

import math
import random

import numpy as np
import pytest

from respanel.llm import quality


def plain_em(counts, kinds):
    """The same model, row by row and rule by rule."""
    names = list(dict.fromkeys(kinds))
    part = {}
    for p in counts:
        hits = [sum(1 for c, k in zip(p, kinds, strict=True) if c == "b" and k == name) for name in names]
        raw = [(0.05 if any(hits) else 1.0) + 0.01] + [h + 0.01 for h in hits]
        part[p] = [x / sum(raw) for x in raw]
    total = sum(counts.values())
    for _ in range(2000):
        logs = {p: [] for p in counts}
        for k in range(len(names) + 1):
            mass = sum(part[p][k] * n for p, n in counts.items())
            rates = []
            for r, kind in enumerate(kinds):
                x, y = (0.5, 9.5) if k == 0 else (4, 1) if kind == names[k - 1] else (0.5, 4.5)
                for p, n in counts.items():
                    x += part[p][k] * n * (p[r] == "b")
                    y += part[p][k] * n * (p[r] == "g")
                rates.append(x / (x + y))
            for p in counts:
                logs[p].append(math.log((mass + 1) / (total + len(names) + 1)) + sum(math.log(q if c == "b" else 1 - q) for c, q in zip(p, rates, strict=True) if c != "-"))
        new = {}
        for p, own in logs.items():
            top = max(own)
            raw = [math.exp(x - top) for x in own]
            new[p] = [x / sum(raw) for x in raw]
        change = max(abs(a - b) for p in counts for a, b in zip(new[p], part[p], strict=True))
        part = new
        if change < 1e-10:
            break
    return {p: own[0] for p, own in part.items()}


def drawn(seed, n, good, own, kinds, abstain=0.1, other=0.02):
    draw, counts, truth = random.Random(seed), {}, []
    names = list(dict.fromkeys(kinds))
    for _ in range(n):
        kind = draw.choice(names) if draw.random() < 0.2 else None
        rates = [own if k == kind else other if kind else good for k in kinds]
        p = "".join("-" if draw.random() < abstain else "b" if draw.random() < q else "g" for q in rates)
        counts[p] = counts.get(p, 0) + 1
        truth.append((p, kind is None))
    return counts, truth


@pytest.mark.parametrize("seed", range(4))
def test_estimate_matches_plain_loops(seed):
    kinds = ("a", "a", "b", "c", "b")
    counts, _ = drawn(seed, 700, 0.05, 0.8, kinds)
    got, want = quality.estimate(counts, kinds), plain_em(counts, kinds)
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in want) < 1e-6


@pytest.mark.parametrize("good", [0.003, 0.03, 0.08])
def test_noisy_rules_are_outvoted_and_trusted_by_their_rates(good):
    kinds = ("a", "a", "a", "b", "b", "b")
    counts, truth = drawn(7, 8000, good, 0.85, kinds)
    post = quality.estimate(counts, kinds)
    right = np.mean([(post[p] >= 0.5) == t for p, t in truth])
    strict = np.mean([("b" not in p) == t for p, t in truth])
    like = lambda p, rates: math.prod(1 if c == "-" else q if c == "b" else 1 - q for c, q in zip(p, rates, strict=True))
    bad = [[0.85 if k == kind else 0.02 for k in kinds] for kind in "ab"]
    known = {p: 0.8 * like(p, [good] * 6) >= 0.1 * sum(like(p, x) for x in bad) for p in post}  # the true rates' verdict
    assert right > np.mean([known[p] == t for p, t in truth]) - 0.005 and right >= strict and post["gggggg"] > 0.99
    if good == 0.08:
        assert right > strict + 0.1


def test_kinds_go_with_the_rules(spark):
    assert tuple(k for _, k, _, _ in quality.rules()) == quality.KINDS
    assert all(quality.KINDS.count(k) > 1 for k in quality.KINDS)


def test_verdict_beats_all_must_pass_on_labels(spark, sf):
    d = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id", "left").collect()
    strict = {r.doc_id: not r.base_failed and "b" not in r.votes for r in rows}
    assert sum(r.kept != strict[r.doc_id] for r in rows) > 20
    known = [r for r in rows if r.quality is not None]
    right = np.mean([r.kept == bool(r.quality) for r in known])
    assert right >= 0.978 and right > np.mean([strict[r.doc_id] == bool(r.quality) for r in known])
