"""Exact round trips: archives, chat formatting, packing; main text against a plain reading."""

import base64
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from respanel.llm import chat, common, htmltext, packing, warc

# --- archives


def test_zip_directories_agree_with_the_standard_library():
    raw = io.BytesIO()
    z = warc.ZipWriter(raw)
    for name, parts in (("archive/data.warc.gz", [b"abc", b"", b"defg"]), ("indexes/index.cdxj", [b"x" * 70_000])):
        z.begin(name)
        for p in parts:
            z.put(p)
        z.end()
    z.close()
    with zipfile.ZipFile(io.BytesIO(raw.getvalue())) as other:
        assert other.testzip() is None and other.read("archive/data.warc.gz") == b"abcdefg"
    found = warc.directory(io.BytesIO(raw.getvalue()), len(raw.getvalue()))
    method, at, size = found["archive/data.warc.gz"]
    assert method == 0 and raw.getvalue()[at : at + size] == b"abcdefg"


def test_reader_takes_plain_zips_and_refuses_others():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/b.txt", b"hello")
        z.comment = b"a comment PK\x05\x06 inside"
    data = raw.getvalue()
    method, at, size = warc.directory(io.BytesIO(data), len(data))["a/b.txt"]
    assert data[at : at + size] == b"hello"
    for bad in (b"", b"PK" * 40, data[:-40]):
        with pytest.raises(warc.PackageError):
            warc.directory(io.BytesIO(bad), len(bad))


PAGES = "page_id long, url string, html string, digest string, size int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], PAGES)


def test_round_trip(spark):
    rows = [(5, "http://a.b/ü?x=1\r\n", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (7, "u", ""), (None, "n", "<p>é</p>"), (11, "l", "x" * 3_000_000), (3, "again", "<p>é</p>")]
    rows += [(100 + k, f"http://h/{k}", f"body {k % 4}") for k in range(40)]
    got = [tuple(r)[:6] for r in warc.round_trip(pages(spark, rows)).collect()]
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        back = i is not None and i > least[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if back else "response", least[h or ""] if back else None, u))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hot_payloads_and_many_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_KEYS", 3)
    monkeypatch.setattr(common, "HOT", 5)
    rows = [(k, f"u{k}", "" if k % 3 == 0 else None if k % 3 == 1 else f"page {k // 9}") for k in range(120)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect()}
    least = {}
    for i, _, h in rows:
        least.setdefault(h or "", i)
    assert got == {i: ("response", None) if least[h or ""] == i else ("revisit", least[h or ""]) for i, _, h in rows}


def test_small_payloads_may_all_be_responses(spark):
    path = warc.scratch_path(spark, "small")
    assert warc.write_packages(pages(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "y" * 50), (4, "d", "y" * 50)]), path, min_bytes=10).count() > 0
    rows = warc.read_packages(spark, path).collect()
    assert {(r.page_id, r.record_type) for r in rows} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}
    assert {r.page_id: r.payload for r in rows} == {1: b"x", 2: b"x", 3: b"y" * 50, 4: None}


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


# --- chat


def test_format_is_reversible():
    draw = random.Random(5)
    pieces = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "assistant", "<\\|", "é", " "]
    for _ in range(300):
        turns = [("".join(draw.choices(pieces, k=draw.randint(0, 4))), "".join(draw.choices(pieces, k=draw.randint(0, 9)))) for _ in range(4)] + [("assistant", "<|im_end|>ok")]
        formatted, spans = chat.format_turns(turns)
        assert chat.parse_turns(formatted) == turns
        assert [chat.unescape(formatted[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]


def test_branches_match_brute_force(spark):
    draw, rows = random.Random(2), []
    for conv in range(8):
        for k in range(draw.choice([1, 2, 5, 40])):
            rows.append((conv, k * 3, None if k == 0 or draw.random() < 0.05 else draw.randrange(max(0, k - 3), k) * 3, draw.random()))
    rows += [(99, k, k - 1 if k else None, 1.0) for k in range(70)] + [(100, 1, 2, 1.0), (100, 2, 1, 1.0), (101, 1, 77, None)]
    got = {(r.conv, r.leaf, r.node, r.depth) for r in chat.branches(spark.createDataFrame(rows, "conv long, node long, parent long, score double"), top=2).collect()}
    want, trees = set(), {}
    for conv, n, p, s in rows:
        trees.setdefault(conv, {})[n] = (p, s or 0.0)
    for conv, tree in trees.items():
        parents, paths = {p for p, _ in tree.values()}, []
        for n in tree:
            if n not in parents:
                path, x = [], n
                while x is not None and x in tree:
                    path.append(x)
                    x = tree[x][0]
                paths.append((-round(sum(tree[y][1] for y in path) / len(path), 12), n, path))
        for _, leaf, path in sorted(paths)[:2]:
            want |= {(conv, leaf, y, d + 1) for d, y in enumerate(reversed(path))}
    assert got == want


def test_repeated_nodes_are_one(spark):
    rows = [(1, 0, None, 1.0, "user", "a"), (1, 1, 0, 1.0, "assistant", "b"), (1, 1, 0, 1.0, "assistant", "b"), (1, 1, 0, 2.0, "assistant", "z"), (1, 2, 1, 1.0, "user", "c"), (1, 0, None, 1.0, "user", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv long, node long, parent long, score double, role string, text string, depth string")
    got = chat.format_trees(df).collect()
    assert len(got) == 1 and chat.parse_turns(got[0].formatted) == [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert sorted((r.node, r.depth) for r in chat.branches(df.select("conv", "node", "parent", "score")).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "b<|x"), (1, 0, "user", None), (2, 0, None, "only"), (None, 0, "user", "lost"), (1, 1, "assistant", "b<|x"), (3, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, score string, leaf int")
    nodes = chat.tree(df.select("conv_id", "turn", "role", "text"), "conv_id", ["turn", "role", "text"]).selectExpr("conv_id as conv", "node", "parent", "0.0 as score", "role", "text")
    got = {r.conv_id: r for r in chat.read_back(chat.format_trees(nodes)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb<|x\nassistant\nb<|x\n")
    assert got[1].loss_chars == 8 and got[1].loss_sha256 == sha("b<|xb<|x") and got[2].turns_sha256 == sha("\nonly\n")
    assert got[None].n_turns == 1 and got[3].loss_chars == 100_000 and got[2].loss_sha256 == sha("")
    assert chat.format_trees(nodes.limit(0)).count() == 0


# --- packing


def test_encoder_equals_the_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    mine = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for text in ["", "Hello, it's 2024!\n\n  x", "éàü ß 漢字 🙂", "a" * 3000, "<|endoftext|> a", " \t\r\n ", "\x00\x7f"]:
        assert mine.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_packing_holds_every_id_once(spark):
    draw = random.Random(3)
    rows = [(k, " ".join(draw.choice(["alpha", "beta,", "gamma", "é"]) for _ in range(draw.randint(0, 900)))) for k in range(150)]
    rows += [(500, None), (501, ""), (None, "no id"), (502, "long word " * 6000), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, start string, length int")
    got = packing.pack(df).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        want[i, len(ids)] = ids
    for _, p in got.iterrows():
        ids = want[None if np.isnan(p.doc_id) else p.doc_id, p.doc_tokens]
        assert zlib.crc32(np.array(ids[int(p.start) : int(p.start + p.length)], "<u4").tobytes()) == p.ids_crc32
    assert got.length.sum() == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= 2048 and total.sum() / got.groupby("sequence_id").sequence_tokens.first().sum() > 0.9
    assert packing.pack(df.limit(0)).count() == 0


def test_plans_cover_and_fit():
    draw = np.random.default_rng(4)
    for n in (1, 7, 300, 20_000):
        sizes, counts = np.unique(draw.integers(1, 257, n), return_counts=True)
        need = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        held = {}
        made = packing.plan(need, 256)
        for times, own in made:
            assert sum(s * k for s, k in own.items()) <= 256
            for s, k in own.items():
                held[s] = held.get(s, 0) + times * k
        assert held == need
        bound = sum(s * k for s, k in need.items()) / 256
        assert sum(times for times, _ in made) <= 1.06 * bound + 10
    assert packing.plan({}, 256) == []


# --- pages

ODD = [
    ("", ""),
    ("plain &amp;lt; text &nbsp; x", "plain &lt; text x"),
    ("<article><h1>T</h1><p>a<b>b</b> c<br>d<p>e &#233;&copy</article><footer>f</footer>", "T\n\nab c d\n\ne é©"),
    ("<nav>m</nav><main><div class='ad'>x</div><p>one</p><div class=\"comments\"><p>c</p></div></main><aside>s</aside>", "one"),
    ("<div id=content><p>a</p><script>if (a<b) {'</p>'}</script><style>p{}</style><!-- <p>n</p> --><p>b", "a\n\nb"),
    ("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "x\n\ny\n\n1\n\n2"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article></article><p>outside</p><p class='x' title='a > b'>z</p><", "outside\n\nz\n\n<"),
    ("<header>h</header><form>f</form><p>a  \n\t b</p><noscript>n</noscript><p>broken <a href='", "a b\n\nbroken"),
]


def test_odd_pages():
    for source, want in ODD:
        assert htmltext.Page(source).text() == want, source


def test_matching_is_a_greatest_mapping():
    def tree(source):
        return htmltext.Skeleton(htmltext.Page(source).skeleton())

    a, b = tree("<div><p>1</p><ul><li>a</li></ul><p>2</p></div>"), tree("<div><p>x</p><p>2</p><ul><li>a<b>q</b></li></ul><p>3</p></div>")
    pairs = htmltext.match(a, b)
    assert len(pairs) == 6 and len({x for x, _ in pairs}) == 6 and len({y for _, y in pairs}) == 6
    assert sorted(x for x, _ in pairs) == [x for x, _ in sorted(pairs, key=lambda p: p[1])]


def test_wrappers_drop_constant_nodes(spark):
    shell = "<div><div>Site name</div><p>{}</p><div>Call us today</div></div>"
    rows = [(k, f"http://h.example/{k}", shell.format(f"story {k}")) for k in range(8)] + [(50, "http://other.example/1", shell.format("alone"))]
    rows += [(60, None, None), (61, "http://h.example/9", ""), (None, "http://h.example/10", shell.format("no id")), (3, "http://h.example/3", shell.format("story 3"))]
    rows += [(70, "http://h.example/11", "<p>" * 3000 + "deep" + "<div>" * 3000)]
    got = {(r.page_id, r.url): r for r in htmltext.extract(pages(spark, rows)).collect()}
    assert len(got) == len({(i, u) for i, u, _ in rows})
    assert got[2, "http://h.example/2"].text == "story 2" and got[None, "http://h.example/10"].text == "no id"
    assert got[50, "http://other.example/1"].text == "Site name\n\nalone\n\nCall us today"
    assert got[60, None].text == "" and got[60, None].n_chars == 0 and got[70, "http://h.example/11"].text == "deep"
    assert htmltext.extract(pages(spark, [])).count() == 0


# --- packing, as the tokenizer gives ids


def test_ids_equal_the_tokenizer_with_added_tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for text in ["<|endoftext|> a", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "x <|endoftext| > y", "<|endoftext|>\n\n<|endoftext|> é", "", "plain"]:
        assert packing.token_ids(text, path, public_tokenizers.PATTERN) == t.encode(text, add_special_tokens=False).ids


def test_programmes_reach_their_gap():
    draw = np.random.default_rng(6)
    for n, low in ((5000, 1), (40_000, 60), (40_000, 100), (300, 1)):
        sizes, counts = np.unique(draw.integers(low, 257, n), return_counts=True)
        _, amounts, gap = packing.relaxed(sizes, counts.astype(float), 256)
        assert gap <= packing.GAP + 1e-9
        made, reached = packing.plan_with_gap(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), 256)
        assert reached < 0.02 and sum(k for k, _ in made) <= amounts.sum() * (1 + packing.GAP) + len(sizes)
