"""Token counts, ranked search and vector codes against the library, plain Python and full scans."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from respanel.llm import ranked, tokencount, vectorcodes

DOCS = "doc_id long, text string, row string, n string, key long, terms string, raw string"
BASE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 7, "z", "w") for i, t in rows], DOCS)


ODD = "it's  we'll\n\n  <|endoftext|>x <|endoftext|><|endoftext|> é日本語 ՘\U0001ffff 12٣   ʼn 'S 's ''' \x1c\x85 end  "
EDGE = [(None, None), (None, "one two"), (1, None), (2, ""), (3, "   \n\n "), (4, "word"), (4, "word"), (5, "-" * 50_000 + " x" * 3000), (6, ODD), (7, ("q" * 90 + " ") * 40), (8, ODD)]


@pytest.mark.parametrize("few", [200_000, 3, 0])
def test_token_counts_equal_the_library(spark, monkeypatch, few):
    monkeypatch.setattr(tokencount, "FEW", few)
    monkeypatch.setattr(tokencount, "GATHERED", 5)
    whole = Tokenizer.from_file(BASE)
    sized = lambda t: len(whole.encode(t or "", add_special_tokens=False))
    got = tokencount.count_tokens(table(spark, EDGE), limit=10)
    want = [(i, len((t or "").encode()), sized(t), sized(t) > 10) for i, t in EDGE]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_token_counts_of_the_given_documents(spark, sf):
    whole, docs = Tokenizer.from_file(BASE), spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs).collect()}
    assert got == {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False)) for r in docs.collect()}
    assert tokencount.count_tokens(docs.filter("false")).collect() == []


def test_every_code_point_is_cut_as_the_library_cuts_it():
    whole, cut = Tokenizer.from_file(BASE).pre_tokenizer, tokencount.cutter(BASE)
    points = [c for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF] + random.Random(3).sample(range(0xE000, 0x110000), 3000)
    for k in range(0, len(points), 500):
        text = "".join(f"x{chr(c)}1{chr(c)}! {chr(c)} y" for c in points[k : k + 500])
        assert cut(text) == [text[a:b] for _, (a, b) in whole.pre_tokenize_str(text)]


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.cutter(public_tokenizers.path("word_bpe_49k.json"))


def best_documents(docs, items, top=10):
    """The contract in plain Python."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    own = [(i, Counter(terms(t))) for i, t in docs]
    total, words = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in items:
        scores = []
        for at, (doc, held) in enumerate(own):
            score = 0
            for t in set(terms(text)):
                if held[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in c for _, c in own) + 1)))
                    m = 100 - 90 + 90 * sum(held.values()) * total // words
                    score += w * (1_000_000_000 * held[t] // (1000 * held[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, at))
        for rank, (score, none, doc, _) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if none else doc, -score))
    return out


ITEMS = "item_id long, text string, item string, kth long, weight long"


def test_search_equals_plain_python(spark, monkeypatch):
    draw = random.Random(5)
    bag = [w for w in "alpha Beta gamma delta éa éA zeta 12 eta".split() for _ in range(draw.randint(1, 9))]
    docs = [(k, draw.choice(" ,.\x00").join(draw.choices(bag, k=draw.randint(0, 40)))) for k in range(120)] + EDGE + [(k, "omega beta") for k in range(500, 530)]
    items = [(0, "alpha beta, BETA"), (1, None), (2, ""), (3, "éA éa"), (4, "omega"), (4, "omega"), (5, "nothing here is known"), (None, "gamma word")]
    asked = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], ITEMS)
    want = sorted(map(repr, best_documents(docs, items)))
    given = table(spark, docs).repartition(7)
    assert sorted(repr(tuple(r)) for r in ranked.search(given, asked).collect()) == want
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(ranked, "CELLS", 3)
    monkeypatch.setattr(ranked, "HELD", 2)
    monkeypatch.setattr(ranked, "FEW_KEYS", 1)
    assert sorted(repr(tuple(r)) for r in ranked.search(given, asked).collect()) == want


def test_search_of_empty_tables(spark):
    asked = spark.createDataFrame([(1, "word", "x", 1, 2)], ITEMS)
    assert ranked.search(table(spark, EDGE), asked.filter("false")).collect() == []
    assert ranked.search(table(spark, EDGE).filter("false"), asked).collect() == []


def test_bounds_hold_and_rule_out_most_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"), F.col("doc_id").alias("row"))
    asked = [list(dict.fromkeys(ranked.terms_of(r.text.encode()))) for r in items.collect()]
    number = {t: k for k, t in enumerate(dict.fromkeys(t for own in asked for t in own))}
    index = ranked.exact_index(rows, number, "bigint").cache()
    n = index.filter("n > 0").count()
    words = index.agg(F.sum("n")).first()[0]
    weight = ranked.weights(index, n, len(number))
    met = ranked.bounded(ranked.quantised(index, weight, n, words, "bigint"), [[number[t] for t in own] for own in asked], weight, "bigint").collect()
    pairs = spark.createDataFrame([(k, number[t], int(weight[number[t]])) for k, own in enumerate(asked) for t in own], "item long, term int, weight long")
    reached = spark.createDataFrame([(r.item, r.row) for r in met], "item long, row long")
    exact = {(r.item, r.row): r.score for r in ranked.rescored(reached, index, pairs, n, words).collect()}
    assert len(met) < n * len(asked) / 3
    assert all(r.lower < exact[r.item, r.row] <= r.upper for r in met)


VECTORS = "vec_id long, embedding array<float>, label int, code string, points long, key string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], VECTORS)


def full_scans(rows, rounds=6):
    """The contract in plain whole numbers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(float(np.float32(x))) * 4096) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 8
    part = lambda v, p: v[p * d : p * d + d]
    books = [[part(v, p) for i, v, _ in kept if i is not None][:16] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min((far(part(v, p), e), j) for j, e in enumerate(books[p]))[::-1] for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for j in range(len(books[p])) if k < rounds else ():
                own = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p][0] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(x for _, x in c) for c in codes]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    return sorted(repr((i, "".join(f"{j:02x}" for j, _ in c), e, labels[label], sha)) for (i, _, label), c, e in zip(kept, codes, errors, strict=True))


def coded(df):
    return sorted(repr(tuple(r)[:5]) for r in vectorcodes.compress(df).collect())


def test_codes_equal_full_scans(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 16))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] + 0.2 * draw.normal(size=16)], [None, 1, 2][k % 3]) for k in range(40, 240)]
    rows += [(k, [float(np.float32(x)) for x in draw.integers(-2, 3, 16) / 4096], 1) for k in range(300, 340)]  # ties between few whole numbers
    rows += [(7, None, 1), (8, [1.0] * 15 + [None], 1), (9, [1.0] * 15 + [float("nan")], 1), (10, [float("-inf")] * 16, None), (None, [0.5] * 16, 2)]
    rows += [rows[0], rows[0], rows[3]]
    assert coded(vectors(spark, rows).repartition(5)) == full_scans(rows)


def test_codes_of_few_equal_and_empty_vectors(spark):
    few = [(3, [0.1] * 8, None), (2, [0.1] * 8, None), (1, [-0.3] * 8, 5)]
    assert coded(vectors(spark, few)) == full_scans(few)
    assert coded(vectors(spark, [(3, [0.1] * 8, None)])) == full_scans([(3, [0.1] * 8, None)])
    assert vectorcodes.compress(vectors(spark, few).filter("false")).collect() == []
    (row,) = vectorcodes.compress(vectors(spark, [(3, [], None)])).collect()
    assert (row.code, row.error, row.label_error) == ("00" * 8, 0, 0)
    with pytest.raises(ValueError, match="one length"):
        vectorcodes.compress(vectors(spark, [(1, [0.1] * 8, 1), (2, [0.1] * 16, 1)]))
    with pytest.raises(ValueError, match="64 bits"):
        vectorcodes.compress(vectors(spark, [(1, [3e38] * 8, 1)]))


def test_bounds_spare_most_scans():
    draw = np.random.default_rng(1)
    centres = draw.integers(-40_000, 40_000, (8, 16, 4))
    points = (centres[np.arange(8), draw.integers(0, 16, (500, 8))] + draw.integers(-400, 400, (500, 8, 4))).astype(np.int64)
    entries, before = centres + 90, None
    code, upper, lower, scans = np.zeros((500, 8), np.int64), np.zeros((500, 8)), np.zeros((500, 8)), []
    for _ in range(5):
        scans.append(vectorcodes.Codebooks(entries, before).assign(points, code, upper, lower))
        for p in range(8):
            assert (vectorcodes.nearest(points[:, p], entries[p])[0] == code[:, p]).all()
        before, entries = entries, entries + draw.integers(-60, 60, entries.shape)
    assert scans[0] == 4000 and sum(scans[1:]) < 400
