"""Line and sentence dedup against plain Python that shares no code with them."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from respanel.llm import common, linededup, sentences

DOCS = "doc_id long, text string, key string, owner long, gone string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "g") for i, t in rows], DOCS)


def word(draw):
    return "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8)))


def prose(n, seed):
    draw = random.Random(seed)
    return [word(draw) for _ in range(n)]


def brute_line_runs(rows):
    """Two worded lines (blank ones between) that a smaller id holds, or that ended before in the text, go."""

    def found(text):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if re.search(r"[^ \t\r\f\v]", x)]
        return lines, [(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(full, full[1:], strict=False)]

    least = {}
    for i, t in rows:
        for _, _, x in found(t or "")[1] if i is not None else ():
            least[x] = min(i, least.get(x, i))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        lines, runs = found(t)
        gone, ended = set(), {}
        for a, b, x in runs:
            if (i is not None and least[x] < i) or a > ended.setdefault(x, b):
                gone.update(range(a, b + 1))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


@pytest.mark.parametrize("few", [10**6, 3])
def test_line_runs_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_KEYS", few)
    monkeypatch.setattr(common, "HOT", 4)
    draw = random.Random(4)
    rows = [(k, "\n".join(draw.choice(["a b", "c d", "e f", "g", "h i j", "", " "] + [f"own {k} {n}" for n in range(4)]) for _ in range(draw.randint(0, 14)))) for k in range(120)]
    rows += [(None, "a b\nc d\ne f"), (7, rows[7][1]), (500, None), (501, ""), (502, "\n\n"), (503, "é\r\nü\r\né\r\nü\r\n")]
    out = linededup.dedup(table(spark, rows), whole=True)
    assert out.columns == ["doc_id", "text", "key", "owner", "gone", "__removed"]
    assert in_order((r.doc_id, r.text) for r in out.collect()) == in_order(brute_line_runs(rows))


def test_chunks_are_local_and_have_two_lines():
    lines = [" ".join(prose(4, k)).encode() for k in range(400)]
    ends = {lines[e - 1] for _, e in linededup.chunks(lines)}
    parts = linededup.chunks(lines)
    assert [x for s, e in parts for x in lines[s:e]] == lines and all(e - s >= 2 for s, e in parts[1:-1])
    assert np.mean([e - s for s, e in parts]) < 4 and 2 < len(parts)
    moved = [b"new one", *lines[:200], b"another", *lines[200:]]
    assert len(ends ^ {moved[e - 1] for _, e in linededup.chunks(moved)}) <= 8
    assert linededup.chunks([]) == [] and linededup.chunks([b"x"]) == [(0, 1)] and linededup.chunks([b"x"] * 50) == [(0, 50)]


def test_rolling_hash_is_the_hash_of_the_window():
    lines = [" ".join(prose(3, k)).encode() for k in range(30)]
    assert linededup.rolling(lines)[10:] == linededup.rolling(lines[5:])[5:]


def test_passages_without_a_cut_in_common_still_go(spark):
    rows, want = [], {}
    for k in range(80):
        passage = [" ".join(prose(30, 100 * k + j)) for j in range(2 + k % 3)]
        for d in range(3):
            head, tail = [" ".join(prose(6, 9000 + 10 * k + d))], [" ".join(prose(6, 19000 + 10 * k + d))]
            rows.append((1000 * d + k, "\n".join(head + passage + tail)))
            want[1000 * d + k] = "\n".join(head + (passage if d == 0 else []) + tail)
    out = {r.doc_id: r.text for r in linededup.dedup(table(spark, rows), whole=True).collect()}
    assert out == want


def test_runs_are_compared_only_where_chunks_do_not_decide():
    lines = [" ".join(prose(4, k)).encode() for k in range(60)]
    joined = lambda ranges: [b"\n".join(lines[s:e]) for s, e in ranges]
    parts, runs = linededup.chunk_ranges(lines), linededup.run_ranges(lines)
    keys = {linededup.part_key(x) for x in joined(parts) + joined(runs)}
    ends = {e for _, e in parts}
    over = [(s, e) for s, e in runs if s + 1 in ends]  # from one chunk into the next
    raw = b"\n".join(lines)
    assert 5 < len(over) < len(runs) / 2
    assert sorted(linededup.to_compare(raw, set(), keys, True)) == sorted(joined(parts) + joined(over))
    assert sorted(linededup.to_compare(raw, keys, set(), True)) == sorted({*joined(parts), *joined(runs)})
    assert sorted(linededup.to_compare(raw, set(), keys, False)) == sorted(joined(parts))
    assert linededup.to_compare(raw, set(), set(), True) == []


def plain_pieces(text):
    """Word lists of pieces, found by regular expressions and plain loops."""
    pieces = []
    for line in text.split("\n"):
        own = re.findall(r"[^ \t\r\f\v]+", line)
        sentence = []
        for k, w in enumerate(own):
            sentence.append(w)
            if w[-1] in ".!?…" or k + 1 == len(own):
                pieces.append(sentence)
                sentence = []
    return pieces


def brute_removed(rows):
    """(id, words left) with spans over all pieces, windows taken one by one."""
    import xxhash

    def cut(text):
        out = []
        for words in plain_pieces(text):
            low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
            hashed = [xxhash.xxh32_intdigest(w.encode()) for w in low]
            at = {0}
            for i in range(len(low) - 9):
                window = hashed[i : i + 10]
                at.add(i + window.index(min(window)))
            edges = [*sorted(at), len(low)]
            out += [(words[a:b], low[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def spans(pieces):
        for i in range(len(pieces)):
            for j in range(i + 3, len(pieces) + 1):
                flat = [w for _, low in pieces[i:j] for w in low]
                if len(flat) >= 20:
                    yield i, j, " ".join(flat)
                    break

    least = {}
    for i, t in rows:
        for _, _, x in spans(cut(t or "")) if i is not None else ():
            least[x] = min(i, least.get(x, i))
    out = []
    for i, t in rows:
        pieces, gone, seen = cut(t or ""), set(), set()
        for a, b, x in spans(pieces):
            if (i is not None and least[x] < i) or x in seen:
                gone.update(range(a, b))
            seen.add(x)
        out.append((i, " ".join(w for k, (own, _) in enumerate(pieces) if k not in gone for w in own)))
    return out


@pytest.mark.parametrize("few", [10**6, 3])
def test_spans_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_KEYS", few)
    monkeypatch.setattr(common, "HOT", 4)
    draw, stock = random.Random(6), [" ".join(prose(draw_n, 70 + draw_n)) + "." for draw_n in (2, 5, 9, 14, 31)]
    rows = []
    for k in range(60):
        own = [" ".join(prose(draw.randint(1, 25), 1000 + 10 * k + j)) + draw.choice([". ", "! ", "\n", " ", "? "]) for j in range(4)]
        rows.append((k, "".join(x + (" ".join(draw.sample(stock, 4)).upper() if draw.random() < 0.2 else " ".join(stock)) + draw.choice([" ", "\n"]) for x in own)))
    rows += [(None, rows[3][1]), (3, rows[3][1]), (700, None), (701, ""), (702, " \n "), (703, "For " * 90), (704, "É a. " * 30), (705, "x " * 4000)]
    got = [(r.doc_id, " ".join(re.findall(r"[^ \t\r\f\v\n]+", r.text or ""))) for r in sentences.dedup(table(spark, rows)).collect()]
    assert in_order(got) == in_order(brute_removed(rows))


def test_any_51_words_that_repeat_are_found():
    lost = 0
    for seed in range(400):
        draw = random.Random(seed)
        passage = [w + ("." if draw.random() < seed % 5 / 20 else "") for w in prose(51, 50_000 + seed)]
        texts = []
        for d in range(2):
            head, tail = prose(draw.randint(0, 30), 60_000 + 2 * seed + d), prose(draw.randint(0, 30), 70_000 + 2 * seed + d)
            texts.append(" ".join(head + passage + tail).encode())
        one, other = (set(sentences.span_keys(t)[1]) for t in texts)
        kept = sentences.without(texts[1], one)[0].split()
        lost += not one & other
        assert len(kept) <= len(texts[1].split()) - 51 + 2 * sentences.WINDOW + 11
    assert lost == 0


def test_stock_phrases_and_other_scripts():
    phrase = "Read this first. Then this. All rights reserved."
    a, b = (f"{phrase} {' '.join(prose(40, s))}." for s in (1, 2))
    assert not set(sentences.span_keys(a.encode())[1]) & set(sentences.span_keys(b.encode())[1])
    draw = random.Random(9)
    han = "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(60))
    x, y = f"前{han}後".encode(), f"別の文{han}".encode()
    assert set(sentences.span_keys(x)[1]) & set(sentences.span_keys(y)[1])
    for t in ["", " ", "漢字。かな！x y", "a漢b", "。", "𝒳 漢 é"]:
        assert b"".join(t.encode()[s:e] for s, e in sentences.sentences(t.encode())) == t.encode()


def test_empty_tables(spark):
    assert linededup.dedup(table(spark, []), whole=True).count() == 0 and sentences.dedup(table(spark, [])).filter(F.col("__removed") > 0).count() == 0
