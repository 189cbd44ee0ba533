"""Steps whose memory or shuffle may not grow with one group, against plain Python."""

import math

from pyspark.sql import functions as F

from respanel.functions import ranks
from respanel.operators import holdout


def test_narrowest_interval_over_many_ranges_and_slices(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE", 7)
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(400) * (F.col("id") % 3) + 5).cast("double").alias("x"))
    got = {r.g: (r.low, r.high) for r in ranks.narrowest_interval(rows, ["g"], "x", 0.9).collect()}
    for g in range(3):
        xs = sorted(r.x for r in rows.filter(f"g = {g}").collect())
        w = math.ceil(len(xs) * 0.9)
        _, low, high = min((xs[k + w - 1] - xs[k], xs[k], xs[k + w - 1]) for k in range(len(xs) - w + 1))
        assert got[g] == (low, high)


def test_narrowest_interval_sorts_no_group_in_one_task(spark):
    """The group alone was the key of its windows, so one task sorted it whole."""
    rows = spark.range(100).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    plan = ranks.narrowest_interval(rows, ["g"], "x", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("slice" in line for line in windows)


def test_random_sets_rank_few_rows_and_fall_back_whole(spark):
    answered = spark.range(20000).select(F.lit(3).cast("long").alias("k"), F.col("id").alias("c"))
    sizes = spark.createDataFrame([(3, 5, 5), (3, 25, 20)], "k long, size long, n_selected long")

    def brute(draw, n):
        h = lambda c: (c * 7919 + draw * 104729 + 3 * 1299709 + 5 * 15485863) % 1000003
        return sorted(sorted(range(20000), key=lambda c: ((h(c) * h(c) + c * 31 + draw * 17) % 999983, c))[:n])

    got = {}
    for r in holdout.random_sets(answered, sizes, 4, 5).collect():
        got.setdefault((r.size, r.draw), []).append(r.c)
    assert {key: sorted(v) for key, v in got.items()} == {(s, d): brute(d, n) for s, n in ((5, 5), (25, 20)) for d in range(4)}
    # no item under the bound: the draw is ranked whole
    high = answered.filter("(((c * 7919 + 3 * 1299709 + 5 * 15485863) % 1000003) * ((c * 7919 + 3 * 1299709 + 5 * 15485863) % 1000003) + c * 31) % 999983 > 500000")
    own = {r.c for r in high.collect()}
    first = sorted(r.c for r in holdout.random_sets(high, sizes.filter("size = 25"), 1, 5).collect())
    assert first == sorted(sorted(own, key=lambda c: (((c * 7919 + 3 * 1299709 + 5 * 15485863) % 1000003) ** 2 + c * 31) % 999983)[:20])
    few = spark.createDataFrame([(3, 50000, 50000)], "k long, size long, n_selected long")
    assert holdout.random_sets(answered.filter("c % 7 = 0"), few, 2, 5).count() == 2 * 2858


def test_grid_posterior_of_items_in_several_blocks(spark, monkeypatch):
    """The grid of an item is no row of a shuffle, and an item of many abilities comes in blocks that give the same."""
    from respanel.operators import crosscheck

    rows = spark.range(240).selectExpr("id % 2 as c", "(id % 60) / 20D - 1.5D as theta", "cast(pmod(xxhash64(id), 60) < id % 60 as int) as obs")
    whole = crosscheck.grid_posterior(rows, 0.9, 0.2, 1.3, 33)
    assert "generate explode" not in whole._jdf.queryExecution().optimizedPlan().toString().lower()
    one = {r.c: r for r in whole.collect()}
    monkeypatch.setattr(crosscheck, "ANSWER_BLOCK", 7)
    for r in crosscheck.grid_posterior(rows, 0.9, 0.2, 1.3, 33).collect():
        assert all(abs(r[x] - one[r.c][x]) < 1e-10 for x in ("a_mean", "a_lo", "a_hi", "edge"))


def test_ability_of_greatest_posterior_is_the_root_or_the_bound(spark):
    from respanel.operators import score

    answers = [[(1.2, 0.3, 1.0), (0.4, -1.0, 0.0), (-0.8, 0.1, 1.0)], [], [(2.0, 5.0, 1.0)] * 40, [(30.0, 0.5, 1.0), (30.0, 0.7, 0.0)]]
    df = spark.createDataFrame([(k, own) for k, own in enumerate(answers)], "k long, answers array<struct<a: double, b: double, y: double>>")
    got = {r.k: r.theta for r in df.select("k", score.map_theta(F.col("answers"), bound=2.5).alias("theta")).collect()}
    for k, own in enumerate(answers):
        low, high = -2.5, 2.5
        for _ in range(60):
            t = (low + high) / 2
            low, high = (t, high) if -t + sum(a * (y - 1 / (1 + math.exp(-a * (t - b)))) for a, b, y in own) > 0 else (low, t)
        assert abs(got[k] - low) < 1e-12
    plan = df.select(score.map_theta(F.col("answers")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan  # sixty passes of an interpreted aggregate before


def test_tables_behind_the_chosen_sets_are_read_and_not_made_again(spark, sf, monkeypatch):
    """Scores were summed over the nodes behind joins and distincts, in the few tasks that such small tables are gathered to."""
    from respanel.operators import select
    from respanel.plans import catalog

    seen, scored = [], select.weighted_information
    monkeypatch.setattr(select, "weighted_information", lambda items, points, *rest, **named: seen.extend([items, points]) or scored(items, points, *rest, **named))
    catalog.fresh_population_spearman(spark, sf)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    assert len(plans) == 4 and not any(word in plan for plan in plans for word in ("Join", "Aggregate", "Window"))


def test_planted_answers_of_keys_whose_product_leaves_64_bits(spark, tmp_path):
    """Supplier times part times the third factor passes 2^63 from about 300 copies of sf0.1 on; the sum was an overflow."""
    from respanel.plans import bindings as bind

    keys = [(j, i) for j in (3, 60_000, 359_999) for i in (7, 7_199_999, 7_000_003)]
    spark.createDataFrame(keys, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    for fresh, (first, second, third) in ((False, (104729, 1299709, 15485863)), (True, (7919, 611953, 32452843))):
        got = {(r.j, r.i): r for r in bind.planted_cells(spark, str(tmp_path), fresh).collect()}
        assert got.keys() == set(keys)
        for (j, i), r in got.items():
            noise = (j * first + i * second + (j * i * third) % 10000019) % 10007 / 10007
            assert r.correct == int(noise < 1 / (1 + math.exp(-r.a * (r.th - r.b))))
