"""Sums over items and abilities against all pairs in numpy."""

import numpy as np

from respanel.functions.irt import information, probability
from respanel.operators import select, smooth


def tables(spark, n_items, n_people):
    rng = np.random.default_rng(5)
    a, b, theta = rng.normal(0.6, 1.5, n_items), rng.normal(0, 2, n_items), rng.normal(0, 1.3, n_people)
    a[:3], theta[:2] = (0.0, 40.0, -1.0), (-9.0, 1.0)
    items = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "c long, a double, b double")
    people = spark.createDataFrame([(k, float(t), 1 / n_people) for k, t in enumerate(theta)], "r long, theta double, weight double")
    p = 1 / (1 + np.exp(-a[:, None] * (theta[None, :] - b[:, None])))
    return items, people, p, a[:, None] ** 2 * p * (1 - p)


def test_sums_over_abilities_equal_all_pairs(spark):
    items, people, _, info = tables(spark, 60, 3000)
    got = {r.c: r.score for r in select.weighted_information(items, people).collect()}
    assert np.allclose([got[k] for k in range(60)], info.mean(axis=1), rtol=0, atol=2e-10)
    unrounded = select.at_nodes(items, people).groupBy("c").agg({"weight": "sum"}).collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in unrounded)


def test_sums_over_items_equal_all_pairs(spark):
    items, people, p, info = tables(spark, 400, 500)
    for curve, all_ in ((information, info), (probability, p)):
        both = people.join(smooth.summed(items, people, curve), "theta").collect()
        got = {r.r: r.total for r in both}
        assert np.allclose([got[k] for k in range(500)], all_.sum(axis=0), rtol=1e-12, atol=1e-11)


def test_an_item_meets_no_more_rows_for_more_abilities(spark):
    """Steps shared by sets, curves and reports: work grows with items plus abilities, not with their product."""
    items, people, _, _ = tables(spark, 20, 8000)
    items = items.filter("abs(a) < 4")
    few, many = (select.at_nodes(items, people.filter(f"r < {n}")).count() for n in (2000, 8000))
    assert many < 1.5 * few  # four times the abilities; the tails fill a few more cells



def test_minimum_variance_set_equals_the_plain_greedy_pass(spark, monkeypatch):
    """Few candidates at a time, so that bounds are passed and items are measured anew."""
    monkeypatch.setattr(select, "CANDIDATES", 4)
    items, people, _, info = tables(spark, 80, 900)
    items = items.filter("c <> 1").selectExpr("*", "cast(case when c % 3 = 0 then array('insufficient-data') else array() end as array<string>) as flags", "1L as n_resp")
    a = {r.c: r.a for r in items.collect()}
    got = select.anchor_min_variance(items, people, 79).orderBy("rank").collect()
    assert len(got) == sum(1 for c in a if c % 3 or a[c] > 0)
    precision, left = np.ones(900), {c for c in a if c % 3}
    pads = {c for c in a if c % 3 == 0 and a[c] > 0}
    for row in got:
        pool = left or pads
        gain = {c: (1 / precision - 1 / (precision + info[c])).mean() for c in pool}
        assert row.c in pool and abs(row.gain - gain[row.c]) < 1e-12 and row.gain > max(gain.values()) - 1e-12 and row.padded == (not left)
        precision = precision + info[row.c]
        pool.remove(row.c)
