"""SimHash groups and five-word groups against brute force."""

import random

import numpy as np
import xxhash

from respanel.llm import common, neardup, simhash

DOCS = "doc_id long, text string, fp long, label string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "l") for i, t in rows], DOCS)


def closure(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text, width=3):
    words = [w for w in text.encode().lower().split()]
    runs = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def text(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 7))) for _ in range(n))


def changed(t, n, seed):
    words, draw = t.split(), random.Random(seed)
    for k in draw.sample(range(len(words)), n):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def test_masks_cover_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    draw = random.Random(4)
    for _ in range(2000):
        gap = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3)))
        assert any(int(m) & gap == 0 for m in masks)


def test_fingerprints_match_brute_force():
    for t in ["", " \t\n", "One", "one two", "A b C d", "É é ñ a b", text(200, 1), "a b c " * 50]:
        assert simhash.fingerprint(t.encode(), 3) & (1 << 64) - 1 == brute_fingerprint(t)


def test_groups_match_brute_force(spark):
    base = [text(60, k) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)] + [(50 + k, changed(base[k % 12], 1 + k % 2, k)) for k in range(40)]
    rows += [(200, base[3]), (201, base[3]), (202, None), (203, ""), (204, " "), (205, "x"), (206, text(20_000, 7)), (200, base[3])]
    got = simhash.near_groups(table(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t or "") for _, t in rows]
    label = closure(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    want = {(i, min(rows[k][0] for k in range(len(rows)) if label[k] == g)) for (i, _), g in zip(rows, label, strict=True)}
    assert {(r.doc_id, r.component_id) for r in got} == want


def test_null_ids_and_empty_table(spark):
    got = simhash.near_groups(table(spark, [(None, "a b c"), (None, "a b c"), (3, "a b c"), (None, "other words here")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (-1, 3), (3, 3)]
    assert simhash.near_groups(table(spark, [])).count() == 0


def test_a_common_fingerprint_is_not_gathered(spark, monkeypatch):
    rows = [(k, "" if k % 3 else "one two three four five") for k in range(90)] + [(200, "some other text of a few words"), (None, "")]
    want = sorted(map(str, simhash.near_groups(table(spark, rows)).collect()))
    for few, hot in ((1, 10), (2, 1), (0, 0)):
        monkeypatch.setattr(common, "FEW_KEYS", max(few, 1))
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(map(str, simhash.near_groups(table(spark, rows)).collect())) == want


def test_long_runs_lose_no_link():
    draw = np.random.default_rng(2)
    base = np.uint64(draw.integers(0, 2**63))
    flips = [sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 6), replace=False)) for _ in range(6000)]
    fps = np.unique(np.array([int(base) ^ f for f in flips], np.uint64))
    mask = int(simhash.covering_masks(3)[0])
    run = np.sort(fps[(fps & np.uint64(mask)) == (base & np.uint64(mask))])
    small = {tuple(sorted((int(a), int(b)))) for x, y in simhash._block_edges(run, 3) for a, b in zip(x, y, strict=True)}
    old, simhash.LARGE_RUN = simhash.LARGE_RUN, 8
    try:
        split = {tuple(sorted((int(a), int(b)))) for x, y in simhash._run_edges(run, mask, 3) for a, b in zip(x, y, strict=True)}
    finally:
        simhash.LARGE_RUN = old
    at = {int(v): k for k, v in enumerate(run)}
    same = lambda edges: closure(len(run), lambda i, j: False) if not edges else _labels(len(run), [(at[a], at[b]) for a, b in edges])
    assert len(run) > 50 and same(small) == same(split)


def _labels(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 301 + 200 + 3
    groups = {}
    for node, label in got.items():
        groups.setdefault(label, set()).add(node)
    assert sorted(map(len, groups.values())) == [3, 200, 301]


def jaccard(a, b):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    x, y = runs(a), runs(b)
    return 1.0 if a.lower().split() == b.lower().split() else len(x & y) / max(1, len(x | y))


def test_five_word_groups_match_brute_force(spark):
    base = [text(300, 20 + k) for k in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(30 + k, changed(base[k % 5], 1 + k % 7, k)) for k in range(60)]
    rows += [(300, base[2].upper()), (301, None), (302, ""), (303, "a b"), (304, "a b"), (305, "a c"), (306, text(20_000, 9)), (None, base[0])]
    got = {r.doc_id: r.keeper for r in neardup.near_duplicates(table(spark, rows)).collect()}
    known = [(i, t or "") for i, t in rows if i is not None]
    label = closure(len(known), lambda i, j: jaccard(known[i][1], known[j][1]) >= 0.8)
    want = {i: min(known[k][0] for k in range(len(known)) if label[k] == g) for (i, _), g in zip(known, label, strict=True)}
    assert got == want
    kept = neardup.keep_one(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "label"]
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    hub = text(400, 77)
    rows = [(500, hub)] + [(k, changed(hub, 8, k)) for k in range(120)] + [(900 + k, text(90, 3000 + k)) for k in range(20)]
    got = {r.doc_id: r.keeper for r in neardup.near_duplicates(table(spark, rows)).collect()}
    near = [k for k in range(120) if jaccard(rows[k + 1][1], hub) >= 0.8]
    assert len(near) > 100 and {got[k] for k in near} == {min(near)} and got[500] == min(near)
    assert all(got[900 + k] == 900 + k for k in range(20))
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_appended_truncated_and_prefixed_copies_are_found(spark):
    base = [text(120 + 40 * k, 4000 + k) for k in range(40)]
    rows = list(enumerate(base))
    for k, t in enumerate(base):
        words, n = t.split(), len(t.split())
        rows.append((100 + k, f"{t} {text(n * 4 // 5 // 4, 5000 + k)}"))
        rows.append((200 + k, " ".join(words[: -(n // 6)])))
        rows.append((300 + k, f"{text(n // 8, 6000 + k)} {t}"))
        rows.append((400 + k, f"{t} {text(n // 2, 7000 + k)}"))
    assert all(jaccard(base[i % 100], t) >= 0.8 for i, t in rows if i < 400) and all(jaccard(base[i - 400], t) < 0.8 for i, t in rows if i >= 400)
    got = {r.doc_id: r.keeper for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert all(got[i] == i % 100 for i, _ in rows if i < 400)
    label = closure(len(rows), lambda i, j: rows[i][0] % 100 == rows[j][0] % 100 and jaccard(rows[i][1], rows[j][1]) >= 0.8)
    assert got == {i: min(rows[k][0] for k in range(len(rows)) if label[k] == g) for (i, _), g in zip(rows, label, strict=True)}


def test_prefixes_of_similar_sets_always_meet():
    draw = random.Random(8)
    for _ in range(300):
        own = draw.sample(range(10_000), draw.randint(1, 60))
        other = own[draw.randint(0, len(own) // 5) :] + [20_000 + k for k in range(draw.randint(0, len(own) // 5))]
        sets = [set(own), set(other)] + [set(draw.sample(range(10_000), 40)) | set(own[:3]) for _ in range(5)]
        entries = np.concatenate([np.array([(t, len(s), 0, k) for k in s], neardup.ENTRY) for t, s in enumerate(sets)])
        if 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1]):
            left = neardup.prefixes(neardup.shared(entries))
            assert set(left["key"][left["text"] == 0].tolist()) & set(left["key"][left["text"] == 1].tolist())


def test_clusters_of_several_families_are_compared_across_labels(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "HUB_FROM", 20)
    hubs = [text(150, 8000 + k) for k in range(4)]
    shared = text(12, 8100)  # rare shingles in common, so that all families meet in one cluster
    rows = [(1000 * h + k, f"{changed(t, 1 + k % 9, 100 * h + k)} {shared}") for h, t in enumerate(hubs) for k in range(30)]
    rows += [(9000 + k, f"{text(20, 8200 + k)} {shared}") for k in range(40)]
    got = {r.doc_id: r.keeper for r in neardup.near_duplicates(table(spark, rows)).collect()}
    label = closure(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    assert got == {i: min(rows[k][0] for k in range(len(rows)) if label[k] == g) for (i, _), g in zip(rows, label, strict=True)}


def test_recall_on_the_given_documents(spark, sf):
    """All pairs of different texts at 0.8 or more, by exact counts over an index of shingles."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    sets, holders, shared = {}, {}, {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                shared[own[y], own[x]] = shared.get((own[y], own[x]), 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    got = {r.doc_id: r.keeper for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 20 and all(got[a] == got[b] for a, b in pairs)
    near = _labels(len(rows), [(k[a], k[b]) for k in [{i: n for n, (i, _) in enumerate(rows)}] for a, b in pairs])
    wordless = [i for i, _ in rows if not sets[i]]
    assert sum(i != g for i, g in got.items() if i not in wordless) == sum(near[n] != n for n, (i, _) in enumerate(rows) if i not in wordless)
