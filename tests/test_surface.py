"""The probability surface against all pairs, by its parts and whole."""

import numpy as np
import pytest

from respanel.operators import crosscheck, surface


def drawn(seed, items=40, people=300, values=0):
    """Items with slopes of both signs, none, flat and steep ones; people whose first abilities are ``values`` different ones (0: all different)."""
    g = np.random.default_rng(seed)
    own = {x: g.normal(size=items) for x in ("a1", "b1", "a2", "b2")}
    own["a1"][:3], own["a2"][2:6], own["a2"][6] = (0.0, 30.0, 1e-9), (0.0, -0.0, 1e-12, 40.0), -25.0
    t1 = g.integers(0, values, people) / 7 - 1 if values else g.normal(size=people)
    return own, {"t1": t1, "t2": t1 + g.normal(size=people) * 0.4, "w": g.integers(1, 4, people)}


def packed(columns):
    return np.concatenate([np.asarray(x, dtype=float) for x in columns.values()])


def brute(own, people):
    with np.errstate(over="ignore"):
        p = lambda a, b, t: 1 / (1 + np.exp(-(a[:, None] * (t[None, :] - b[:, None]))))
        return np.abs(p(own["a1"], own["b1"], people["t1"]) - p(own["a2"], own["b2"], people["t2"]))


@pytest.mark.parametrize("values", [0, 1, 9])
@pytest.mark.parametrize("columns, size", [(1024, 1024), (12, 5)])
def test_sums_counts_and_lists_of_a_block(monkeypatch, values, columns, size):
    monkeypatch.setattr(surface, "COLUMNS", columns)
    monkeypatch.setattr(surface, "COLUMN_SIZE", size)
    monkeypatch.setattr(surface, "TOGETHER", 50)
    own, people = drawn(values + columns, values=values)
    d, w = brute(own, people), np.broadcast_to(people["w"], (40, 300))
    s = surface.Surface(packed(own), packed(people))
    (total,), (high,) = s.sums()
    assert abs(total - (d * w).sum()) < 1e-9 and high == d.max()
    for low, up in ((0.0, 1.0), (0.1, 0.1003), (0.0, 0.05), (0.37, 0.9), (float(d[20, 7]), float(d[20, 7]))):
        bins, n, least, most = s.counted(low, up, 16)
        inside = (d >= low) & (d <= up)
        assert n[bins == -1].sum() == w[d < low].sum() and n[bins >= 0].sum() == w[inside].sum()
        assert not inside.any() or (np.nanmin(least), np.nanmax(most)) == (d[inside].min(), d[inside].max())
        got = [np.concatenate(x) for x in zip(*s.listed(low, up), strict=True)]
        assert np.array_equal(np.sort(np.repeat(got[0], got[1])), np.sort(np.repeat(d[inside], w[inside])))


def test_few_pairs_are_looked_at():
    """All were, in every round: 60 million pairs of a pack and a block."""
    g = np.random.default_rng(3)
    people = {"t1": g.integers(0, 50, 6000) / 12 - 2, "t2": g.normal(size=6000), "w": np.ones(6000, int)}
    s = surface.Surface(packed({x: g.normal(size=300) for x in ("a1", "b1", "a2", "b2")}), packed(people))
    seen, differences = [], s.differences
    s.differences = lambda i, k: seen.append(np.broadcast(i, k).size) or differences(i, k)
    s.sums()
    s.counted(0.2, 0.2005, 64)
    assert sum(seen) < 300 * 6000 / 50


@pytest.mark.parametrize("listed", [1, 40])
def test_whole_surface_in_many_blocks_and_rounds(spark, monkeypatch, listed):
    for name, value in {"ITEM_PACK": 15, "PEOPLE_BLOCK": 40, "BINS": 64, "LISTED": listed}.items():
        monkeypatch.setattr(crosscheck, name, value)
    # bounds that do not hold the middle have to widen
    monkeypatch.setattr(crosscheck, "proposed", lambda *_: (0.9, 0.9001) if listed == 40 else (0.0, 0.01))
    own, people = drawn(5, values=9)
    items = lambda k: spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in enumerate(zip(own[f"a{k}"], own[f"b{k}"], strict=True))], "c long, a double, b double")
    rows = [t for t, w in zip(zip(people["t1"], people["t2"], strict=True), people["w"], strict=True) for _ in range(w)]
    thetas = lambda k: spark.createDataFrame([(r, float(t[k - 1])) for r, t in enumerate(rows)], "r long, theta double")
    want = np.repeat(brute(own, people), people["w"], axis=1)
    got = crosscheck.probability_surface((items(1), thetas(1)), (items(2), thetas(2))).first()
    assert got.n == want.size and abs(got.mean_diff - want.mean()) < 1e-12
    assert abs(got.median_diff - np.median(want)) < 1e-15 and got.max_diff == want.max()
