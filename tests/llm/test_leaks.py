"""Decontamination in both directions against a search of all diagonals."""

import random
import re
import time

import numpy as np
import pytest

from respanel.llm import decontaminate


def fold(t):
    return re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()


def brute(doc, item):
    """(words, -start, matched) of the longest near enough overlap, by trying every window of every diagonal."""
    best, least = None, min(13, len(item))
    if not item:
        return None
    for d in range(-len(item) + 1, len(doc)):
        first, last = max(0, -d), min(len(item), len(doc) - d)
        same = [item[k] == doc[k + d] for k in range(first, last)]
        if len(item) < 8 and (len(same) < len(item) or not all(same)):
            continue
        for i in range(len(same)):
            for j in range(i + least, len(same) + 1):
                if 5 * sum(same[i:j]) >= 4 * (j - i):
                    best = max(best or (0, 0, 0), (j - i, -(first + d + i), sum(same[i:j])))
    return best


def sample(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [[draw.choice(vocabulary) for _ in range(n)] for n in (5, 7, 8, 10, 13, 14, 17, 20, 24, 30)]
    docs = []
    for k in range(150):
        item = draw.choice(items)
        part = item[draw.randint(0, len(item) // 3) :]
        part = [w if draw.random() > draw.choice([0, 0.1, 0.2, 0.3]) else draw.choice(vocabulary) for w in part]
        head, tail = ([draw.choice(vocabulary) for _ in range(draw.randint(0, 12))] for _ in range(2))
        docs.append(head + part + tail)
    return [" ".join(d) for d in docs], [" ".join(i) for i in items]


@pytest.mark.parametrize("block_words", [10**6, 0])
def test_overlaps_match_brute_force_both_ways(spark, block_words):
    docs, items = sample(block_words + 3)
    rows = list(enumerate(docs)) + [(1, docs[1]), (None, docs[2]), (900, None), (901, "")]
    tests = list(enumerate(items)) + [(50, items[4]), (51, None), (52, "!")]
    want = set()
    for i, t in rows:
        for k, x in tests:
            if got := brute(fold(t), fold(x)):
                want.add((i, k, -got[1], got[0], got[2]))
    out = decontaminate.overlaps(
        spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, key string"),
        spark.createDataFrame(tests, "item_id long, text string"),
        block_words=block_words,
    ).collect()
    assert {(r.doc_id, r.item_id, r.start_word, r.n_words, r.n_matched) for r in out} == want
    assert len(want) > 60 and all(abs(r.identity - r.n_matched / r.n_words) < 1e-12 for r in out)
    assert sum(r.doc_id == 1 for r in out) == 2 * len([w for w in want if w[0] == 1])


def test_repeated_words_are_bounded():
    index = decontaminate.SeedIndex([(0, b"ha " * 500), (1, b"one two " * 100)])
    tokens = decontaminate.token_hashes(b"ha " * 20_000)
    start = time.time()
    hits = index.hits(tokens, np.array([0, len(tokens)]))
    assert len(hits) <= 20_500 and set(hits[:, 1].tolist()) == {0}
    assert decontaminate.longest(index.tokens[0], tokens, hits[:, 2].tolist()) == (0, 500, 500)
    assert time.time() - start < 60


@pytest.mark.parametrize("block_words", [10**6, 0])
def test_given_tables_have_no_false_leaks(spark, sf, block_words):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    own, tests = {r.doc_id: fold(r.text) for r in docs.collect()}, {r.item_id: fold(r.text) for r in items.collect()}
    for r in decontaminate.overlaps(docs, items, block_words=block_words).collect():
        at = tests[r.item_id]
        near = [sum(a == b for a, b in zip(own[r.doc_id][r.start_word : r.start_word + r.n_words], at[k : k + r.n_words], strict=False)) for k in range(len(at) - r.n_words + 1)]
        assert max(near) == r.n_matched and 5 * r.n_matched >= 4 * r.n_words
