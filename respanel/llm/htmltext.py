"""Main text of web pages by wrapper induction over the pages of a host.

Pages of one host and layout are aligned with one of them, the pivot, by
simple tree matching (Yang 1991). Every aligned page votes on each node of the
pivot: does its text stay the same, and how many words vary there? Nodes
that stay the same are template. The slot that holds most of the varying
words is the content: menus, adverts and footers may vary too, but they are
other slots.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respanel.llm.common import arrow_map, prepare, stored

#: A node is template if this share of the layout's other pages has its text there.
CONSTANT = 0.6
#: A layout is induced from more than so many different pages, and this share of its host's; rarer ones take the host's commonest.
LEAST_PAGES, SHARE = 3, 0.02
#: The content slot lies below a node's child that holds more than this share of the varying words; a single article needs the lesser one.
DOMINANT, ARTICLE = 0.5, 0.1
#: Cells of an alignment kept for the way back; of larger ones each block of rows is computed again, with the same result.
CELLS = 1_000_000
#: Bytes of wrappers that are broadcast at once; more meet their pages in a shuffle, each host's dealt over ``SALT`` parts.
SMALL_BYTES, SALT = 16_000_000, 64
#: Weights of pairs of shapes that a task remembers.
MEMORY = 500_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Element names of HTML by what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOT_CONTENT = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas button select textarea title head dialog menu object embed audio video map datalist".split()
)
CONTAINER = frozenset("# html body div section article main center".split())
#: Elements that no name makes boilerplate.
KEPT = frozenset("html body article main".split())
#: Whole class names, ids and roles of the contract's kinds of boilerplate. A prior for small parts beside or inside the content slot only.
NAMED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer menu nav navbar navigation newsletter notice "
    "pagination promo related share sidebar social sponsored contentinfo complementary".split()
)
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: A start tag closes open elements only inside the nearest of these.
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote td th".split())


class Page:
    """Nodes of a page in document order: tag, parent, flags, own text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.rooted = ["#"], [-1], [False], [False]
        self.header, self.heading = [-1], [False]  # nearest header element, whether inside an h1
        self.marked: list[int] = []
        self.title = ""
        self.segments: list[tuple[int, str | None]] = []  # (node, raw text), with (node, None) where a block starts or ends
        stack, open_ = [0], {"#": 1}
        at, end, token = 0, len(source), TOKEN

        def closed(k: int) -> None:
            for node in stack[k:]:
                open_[self.tags[node]] -= 1
            del stack[k:]

        while at < end:
            match = token.search(source, at)
            stop = match.start() if match else end
            if stop > at:
                self.segments.append((stack[-1], source[at:stop]))
            if not match:
                break
            at = match.end()
            name = match[2]
            if name is None:
                continue
            name = name.lower()
            if match[1]:
                if open_.get(name):
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] == name:
                            if name in BLOCK:
                                self.segments.append((stack[k], None))
                            closed(k)
                            break
                continue
            if name in BLOCK:
                closing = CLOSES.get(name, CLOSES["p"])
                if any(open_.get(x) for x in closing):
                    for k in range(len(stack) - 1, 0, -1):
                        tag = self.tags[stack[k]]
                        if tag in closing:
                            closed(k)
                            break
                        if tag in SCOPE:
                            break
            parent, attributes, node = stack[-1], match[3], len(self.tags)
            drop = self.dropped[parent] or name in NOT_CONTENT
            self.tags.append(name)
            self.parents.append(parent)
            self.dropped.append(drop)
            self.rooted.append(self.rooted[parent] or not drop and name in ("article", "main"))
            self.header.append(node if name == "header" else self.header[parent])
            self.heading.append(self.heading[parent] or name == "h1")
            if attributes and name not in KEPT and self.named(attributes):
                self.marked.append(node)
            if name in BLOCK:
                self.segments.append((node, None))
            elif name == "br":
                self.segments.append((parent, " "))
            if name in RAW:
                close = re.compile(rf"</{name}\b", re.I).search(source, at)
                stop = close.start() if close else end
                if name == "title" and not self.title:
                    self.title = source[at:stop]
                at = stop
                if close and (gt := source.find(">", at)) >= 0:
                    at = gt + 1
            elif name not in VOID and not attributes.endswith("/"):
                stack.append(node)
                open_[name] = open_.get(name, 0) + 1

    @staticmethod
    def named(attributes: str) -> bool:
        return any(not NAMED.isdisjoint((m[1] or m[2] or m[3] or "").lower().split()) for m in MARK.finditer(attributes))

    def has_root(self) -> bool:
        """Whether an article or main element holds text of its own."""
        return any(text is not None and self.rooted[node] and not self.dropped[node] and text.strip() for node, text in self.segments)

    def text(self, template: frozenset[int] | set[int] = frozenset(), slot: int | None = None) -> str:
        """Content blocks in page order, two line feeds between.

        Content is what lies in the node ``slot``, by default in an article or
        main element, on a page without either in the whole page. Template
        nodes, elements that hold no article text and headers outside are
        left out, and so are named elements with under half of the words.
        """
        n = len(self.tags)
        if slot is not None:
            inside = [False] * n
            inside[slot] = True
            for k in range(slot + 1, n):
                inside[k] = inside[self.parents[k]]
        else:
            inside = self.rooted if self.has_root() else [True] * n
        free = slot is not None or inside is self.rooted
        out = [
            self.dropped[k] or not inside[k] or k in template or (h := self.header[k]) >= 0 and not (free and h != slot and inside[h])
            for k in range(n)
        ]
        if self.marked:
            size, holds = [0] * n, [False] * n
            for node, text in self.segments:
                if text is not None and not out[node]:
                    size[node] += len(text.split())
            for k in range(n - 1, 0, -1):
                size[self.parents[k]] += size[k]
                holds[self.parents[k]] |= holds[k] or k == slot or slot is None and self.tags[k] in ("article", "main")
            gone = {k for k in self.marked if 2 * size[k] < size[0] and not holds[k] and k != slot}
            hidden = [False] * n
            for k in range(1, n):
                hidden[k] = hidden[self.parents[k]] or k in gone
                out[k] = out[k] or hidden[k]
        blocks, own = [], []
        for node, text in self.segments:
            if text is None:
                if own:
                    blocks.append("".join(own))
                    own = []
            elif not out[node]:
                own.append(html.unescape(text))
        blocks.append("".join(own))
        flat = (" ".join(b.split()) for b in blocks)
        return "\n\n".join(b for b in flat if b)

    def identity(self, other: int) -> int:
        """Hash of title, headline and longest text, by which copies of an article are one page; without title and headline ``other``."""
        headline = "".join(t for node, t in self.segments if t is not None and self.heading[node]).split()
        if not self.title.split() and not headline:
            return other
        longest = max((t for node, t in self.segments if t is not None and not self.dropped[node]), key=len, default="")
        return xxhash.xxh64_intdigest("\0".join([" ".join(x) for x in (self.title.split(), headline, longest.split())])) - (1 << 63)

    def layout(self) -> int:
        """Hash of the tags below the body, repeats in a row counted once."""
        top = next((k for k, t in enumerate(self.tags) if t == "body"), next((k for k, t in enumerate(self.tags) if t == "html"), 0))
        row = [t for p, t in zip(self.parents, self.tags, strict=True) if p == top and t in BLOCK]
        row = [t for k, t in enumerate(row) if not k or t != row[k - 1]]
        return xxhash.xxh64_intdigest(" ".join(row)) - (1 << 63)

    def skeleton(self) -> bytes:
        """uint32 rows: tag hash, subtree size, hash of the node's own text (0: none), its words (0 where dropped)."""
        n = len(self.tags)
        size = [1] * n
        for k in range(n - 1, 0, -1):
            size[self.parents[k]] += size[k]
        texts: dict[int, list[str]] = {}
        for node, text in self.segments:
            if text is not None and (flat := text.split()):
                texts.setdefault(node, []).extend(flat)
        hashed = [xxhash.xxh32_intdigest(" ".join(texts[k])) | 1 if k in texts else 0 for k in range(n)]
        words = [len(texts[k]) if k in texts and not self.dropped[k] else 0 for k in range(n)]
        return np.array([list(map(tag_hash, self.tags)), size, hashed, words], np.uint32).astype("<u4").tobytes()


def tag_hash(tag: str) -> int:
    return xxhash.xxh32_intdigest(tag)


CONTAINERS = frozenset(map(tag_hash, CONTAINER))
ARTICLES = (tag_hash("article"), tag_hash("main"))


class Skeleton:
    def __init__(self, raw: bytes):
        table = np.frombuffer(raw, "<u4").reshape(4, -1)
        self.tag, self.size, self.text, self.words = table.tolist()
        n = len(self.tag)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.shape, self.whole = [0] * n, [0] * n  # hashes of the subtree's tags, and of its tags and texts (0: no text)
        for k in range(n - 1, -1, -1):
            at, own = k + 1, []
            while at < k + self.size[k]:
                own.append(at)
                at += self.size[at]
            self.children[k] = own
            self.shape[k] = hash((self.tag[k], *(self.shape[c] for c in own)))
            inner = [self.whole[c] for c in own]
            if self.text[k] or any(inner):
                self.whole[k] = hash((self.tag[k], self.text[k], *inner)) or 1


class Alignment:
    """Simple tree matching of two trees; ``known`` holds weights by pair of shapes and may be shared by many."""

    def __init__(self, a: Skeleton, b: Skeleton, known: dict[tuple[int, int], int] | None = None):
        self.a, self.b, self.known = a, b, {} if known is None else known

    def weight(self, x: int, y: int) -> int | None:
        """Pairs in a greatest mapping of the subtrees; None if not known yet."""
        a, b = self.a, self.b
        if a.tag[x] != b.tag[y]:
            return 0
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        if not a.children[x] or not b.children[y]:
            return 1
        return self.known.get((a.shape[x], b.shape[y]))

    def middle(self, x: int, y: int) -> tuple[int, list[int], list[int], int]:
        """(equal children at the start, the children between of both, equal ones at the end): equal ends always match."""
        a, b, xs, ys = self.a, self.b, self.a.children[x], self.b.children[y]
        least, head, tail = min(len(xs), len(ys)), 0, 0
        while head < least and a.shape[xs[head]] == b.shape[ys[head]]:
            head += 1
        while tail < least - head and a.shape[xs[-1 - tail]] == b.shape[ys[-1 - tail]]:
            tail += 1
        return head, xs[head : len(xs) - tail], ys[head : len(ys) - tail], tail

    def rows(self, p: list[int], q: list[int]):
        """The row of the dynamic programme after another child of ``p``, as a function of (row before, its number)."""
        a, b = self.a, self.b
        shapes = {}
        own = np.array([shapes.setdefault(b.shape[y], len(shapes)) for y in q])
        firsts = list({b.shape[y]: y for y in reversed(q)}.items())
        first = [y for _, y in sorted(firsts, key=lambda f: shapes[f[0]])]
        weights: dict[int, np.ndarray] = {}

        def step(row: np.ndarray, i: int) -> np.ndarray:
            x = p[i]
            w = weights.get(a.shape[x])
            if w is None:
                w = weights[a.shape[x]] = np.array([self.weight(x, y) for y in first], np.int64)[own]
            out = np.zeros(len(q) + 1, np.int64)
            out[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0)))
            return out

        return step

    def total(self, p: list[int], q: list[int]) -> int:
        if not p or not q:
            return 0
        step, row = self.rows(p, q), np.zeros(len(q) + 1, np.int64)
        for i in range(len(p)):
            row = step(row, i)
        return int(row[-1])

    def resolve(self, x: int, y: int) -> None:
        """Make the weight of the pair known, deepest pairs first, without recursion."""
        a, b, todo = self.a, self.b, [(x, y)]
        while todo:
            x, y = todo[-1]
            if self.weight(x, y) is not None:
                todo.pop()
                continue
            head, p, q, tail = self.middle(x, y)
            left, right = {a.shape[c]: c for c in p}.values(), {b.shape[d]: d for d in q}.values()
            open_ = [(c, d) for c in left for d in right if self.weight(c, d) is None]
            if open_:
                todo += open_
                continue
            xs = a.children[x]
            ends = sum(a.size[c] for c in xs[:head]) + sum(a.size[c] for c in xs[len(xs) - tail :])
            self.known[a.shape[x], b.shape[y]] = 1 + ends + self.total(p, q)

    def best(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        """Pairs of a greatest mapping of two child lists. Rows are kept at block starts and computed again on the way back."""
        if not p or not q:
            return []
        left, right = {self.a.shape[c]: c for c in p}.values(), {self.b.shape[d]: d for d in q}.values()
        for c in left:
            for d in right:
                self.resolve(c, d)
        block = len(p) if len(p) * (len(q) + 1) <= CELLS else isqrt(len(p)) + 1
        step, row = self.rows(p, q), np.zeros(len(q) + 1, np.int64)
        marks = [row]
        for i in range(len(p)):
            row = step(row, i)
            if (i + 1) % block == 0:
                marks.append(row)
        pairs, i, j = [], len(p), len(q)
        while i and j:
            base = (i - 1) // block * block
            table = [marks[base // block]]
            for k in range(base, i):
                table.append(step(table[-1], k))
            while i > base and j:
                here, above = table[i - base], table[i - 1 - base]
                if here[j] == above[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((p[i], q[j]))
        return pairs[::-1]

    def pairs(self) -> list[tuple[int, int]]:
        a, b = self.a, self.b
        out, open_ = [], [(0, 0)] if a.tag[0] == b.tag[0] else []
        while open_:
            x, y = open_.pop()
            out.append((x, y))
            if a.shape[x] == b.shape[y]:
                out += [(x + k, y + k) for k in range(1, a.size[x])]
            elif a.children[x] and b.children[y]:
                head, p, q, tail = self.middle(x, y)
                xs, ys = a.children[x], b.children[y]
                open_ += zip(xs[:head], ys[:head], strict=True)
                open_ += self.best(p, q)
                open_ += zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)
        return out


def match(a: Skeleton, b: Skeleton, known: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int]]:
    """Node pairs of a greatest top-down, order-keeping mapping between two trees (simple tree matching)."""
    return Alignment(a, b, known).pairs()


class Pivots:
    """Parsed pivots of a task and the weights already found for each."""

    def __init__(self):
        self.trees: dict = {}

    def get(self, key, raw) -> tuple[Skeleton, dict]:
        if key not in self.trees:
            if len(self.trees) >= 1000:
                self.trees.clear()
            self.trees[key] = (Skeleton(raw() if callable(raw) else raw), {})
        tree, known = self.trees[key]
        if len(known) > MEMORY:
            known.clear()
        return tree, known


def alike(a: Skeleton, b: Skeleton, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of subtrees with texts that are equal throughout, below the same partners; a list of other length moves them."""
    out, inside = [], bytearray(len(b.tag))
    for x, y in sorted(pairs, key=lambda p: p[1]):
        if a.children[x] and b.children[y] and not inside[y]:
            held = {a.whole[c]: c for c in a.children[x] if a.whole[c]}
            for d in b.children[y]:
                if b.whole[d] in held:
                    out.append((held[b.whole[d]], d))
                    inside[d : d + b.size[d]] = bytes([1]) * b.size[d]
    return out


def ballot(pivot: Skeleton, page: Skeleton, known: dict) -> np.ndarray:
    """Rows same and varying words for each node of the pivot: words whose text differs there, or that hang below without a partner."""
    out = np.zeros((2, len(pivot.tag)), np.int64)
    pairs = match(pivot, page, known)
    words, met = np.array(page.words), np.zeros(len(page.tag), bool)
    met[[y for _, y in pairs]] = True
    for c, d in alike(pivot, page, pairs):
        out[0, c : c + pivot.size[c]] |= np.array(pivot.text[c : c + pivot.size[c]]) > 0
        words[d : d + page.size[d]] = 0
    size = np.concatenate(([0], np.cumsum(words)))
    for x, y in pairs:
        if page.text[y] and page.text[y] == pivot.text[x]:
            out[0, x] = 1
        else:
            out[1, x] += words[y]
        for c in page.children[y]:
            if not met[c]:
                out[1, x] += size[c + page.size[c]] - size[c]
    return out


def wrapper(pivot: Skeleton, pages: int, votes: np.ndarray) -> tuple[int | None, list[int]]:
    """(content slot, template nodes) of a pivot from the votes of the other pages."""
    constant = (votes[0] >= CONSTANT * pages) & (votes[0] > 0)
    varying = np.concatenate(([0], np.cumsum(np.where(constant, 0, votes[1]))))
    held = [int(varying[k + s] - varying[k]) for k, s in enumerate(pivot.size)]
    if not held[0]:
        return None, np.flatnonzero(constant).tolist()
    for tag in ARTICLES:
        found = [k for k, t in enumerate(pivot.tag) if t == tag and held[k]]
        if len(found) == 1 and held[found[0]] >= ARTICLE * held[0]:
            return found[0], np.flatnonzero(constant).tolist()
    slot = 0
    while inner := [c for c in pivot.children[slot] if pivot.tag[c] in CONTAINERS and held[c] > DOMINANT * held[slot]]:
        slot = inner[0]
    return slot, np.flatnonzero(constant).tolist()


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, layout, identity, key, skeleton) of pages (key, host, html)."""

    def parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], []]
        for key, source in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            page = Page(source)
            for col, x in zip(cols, (page.layout(), page.identity(key), page.skeleton()), strict=True):
                col.append(x)
        layout, identity, skeleton = (pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True))
        return pa.RecordBatch.from_arrays([batch.column(1), layout, identity, batch.column(0), skeleton], names=["host", "layout", "identity", "key", "skeleton"])

    return arrow_map(pages.select("key", "host", "html"), "host string, layout long, identity long, key long, skeleton binary", parsed)


def beside(rows: DataFrame, few: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of the stored table ``few`` that agrees in ``on``: a broadcast up to ``SMALL_BYTES``, else a salted shuffle."""
    size = few.agg(F.coalesce(F.sum(F.expr(weight)), F.lit(0))).first()[0]
    if size <= SMALL_BYTES:
        return rows.join(F.broadcast(few), on, how)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    return dealt.join(salted, [*on, "salt"], how).drop("salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layouts): for every host with enough pages its layouts with pivot, content slot and template nodes, commonest first.

    Copies of an article on several pages have one vote. A map task sums the
    votes of its batch before they are shuffled, so a host of any size costs
    the sums a few rows a batch.
    """
    named = skeletons(pages.filter("host <> ''"))
    distinct = stored(named.groupBy("host", "layout", "identity").agg(F.min_by("skeleton", "key").alias("skeleton"), F.min("key").alias("key")), "skeletons")
    sizes = distinct.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min_by("skeleton", "key").alias("pivot"), F.min("key").alias("pivot_key"))
    sizes = stored(sizes.filter(F.col("n") > LEAST_PAGES), "layouts")
    hosts = sizes.groupBy("host").agg(F.sum("n").alias("all"))
    pivots = sizes.join(hosts, "host").filter(F.col("n") >= SHARE * F.col("all")).drop("all")
    pivots = stored(pivots, "pivots")
    voters = beside(distinct, pivots, ["host", "layout"], "length(pivot) + 100").filter("key <> pivot_key")

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Pivots()
        for batch in batches:
            sums: dict[tuple[str, int], np.ndarray] = {}
            hosts, layouts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (where, raw) in enumerate(zip(zip(hosts, layouts, strict=True), batch.column(2).to_pylist(), strict=True)):
                tree, known = seen.get(where, lambda i=i: batch.column(3)[i].as_py())
                votes = ballot(tree, Skeleton(raw), known)
                sums[where] = sums[where] + votes if where in sums else votes
            rows = [(h, own, x, *v) for (h, own), votes in sums.items() for x, v in enumerate(votes.T.tolist()) if any(v)]
            if rows:
                types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["host", "layout", "node", "same", "words"])

    votes = voters.select("host", "layout", "skeleton", "pivot").mapInArrow(voted, "host string, layout long, node int, same long, words long")
    summed = votes.groupBy("host", "layout", "node").agg(F.sum("same").alias("same"), F.sum("words").alias("words"))
    summed = summed.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "same", "words")).alias("votes"))

    def decided(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, nodes = [], []
        for n, raw, votes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            tree = Skeleton(raw)
            table = np.zeros((2, len(tree.tag)), np.int64)
            for v in votes:
                table[:, v["node"]] = v["same"], v["words"]
            slot, constant = wrapper(tree, n - 1, table)
            slots.append(slot)
            nodes.append(constant)
        cols = [*batch.columns[:4], pa.array(slots, pa.int32()), pa.array(nodes, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, names=["host", "layout", "n", "pivot", "slot", "nodes"])

    made = summed.join(pivots, ["host", "layout"]).select("host", "layout", "n", "pivot", "votes")
    made = arrow_map(made, "host string, layout long, n long, pivot binary, slot int, nodes array<int>", decided)
    order = F.sort_array(F.collect_list(F.struct("n", "layout", "pivot", "slot", "nodes")), asc=False)
    return made.groupBy("host").agg(order.alias("layouts"))


def main_text(source: str, layouts: list[tuple[int, Skeleton, dict, int | None, frozenset[int]]]) -> str:
    """The main text of a page, by the wrapper of its layout or else of its host's commonest layout."""
    page = Page(source)
    if not layouts:
        return page.text()
    own = page.layout()
    layout, tree, known, slot, constant = next((x for x in layouts if x[0] == own), layouts[0])
    mine = Skeleton(page.skeleton())
    pairs = match(tree, mine, known)
    template = {y for x, y in pairs if x in constant and tree.text[x] == mine.text[y]}
    for c, d in alike(tree, mine, pairs):
        template |= {d + k for k in range(mine.size[d]) if c + k in constant}
    place = dict(pairs).get(slot)
    if place is not None and ((text := page.text(template, place)) or layout == own):
        return text
    return page.text(template)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, from its whole source.

    A host's wrapper names the content slot and the template nodes; the text
    is what the page holds in that slot, without template nodes and without
    elements that hold no article text (menus, forms, scripts ...). Without a
    wrapper (at most ``LEAST_PAGES`` different pages, no host) or where the
    page lacks the slot, the slot is an article or main element, else the
    page. A page of another layout that has nothing in the slot counts as one
    without. Character references are decoded once, white space becomes one
    space, blocks are joined by two line feeds.

    A null page is empty; no text gives an empty string. Null ids and
    repeated rows are carried, other columns ignored. Broken markup never
    fails: unclosed elements end with the page. Long pages and deep nesting
    are aligned exactly as short ones, in memory that grows with the square
    root of the page times the pivot. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    source = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), source.alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = rows.withColumn("key", F.xxhash64("html")).withColumn("host", host)
    known = stored(wrappers(keyed), "wrappers")
    weight = "aggregate(layouts, 0, (s, x) -> s + length(x.pivot) + 4 * size(x.nodes) + 100)"
    joined = beside(keyed, known, ["host"], weight, "left").select("page_id", "url", "html", "host", "layouts")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            out = []
            for i, (source, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host not in held:
                    if len(held) >= 1000:
                        held.clear()
                    own = batch.column(4)[i].as_py() or []
                    held[host] = [(x["layout"], Skeleton(x["pivot"]), {}, x["slot"], frozenset(x["nodes"])) for x in own]
                for x in held[host]:
                    if len(x[2]) > MEMORY:
                        x[2].clear()
                out.append(main_text(source, held[host]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=["page_id", "url", "text"])

    found = joined.mapInArrow(texts, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
