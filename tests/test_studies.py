"""Studies, exports, diagnostics and validation by ability on small hand-made fits."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respanel.operators import crosscheck, diagnostics, em, fit, holdout, studies, synth, variational
from respanel.operators.matrix import ResponseMatrix, build_matrix
from respanel.schema import MatrixError

ITEMS = "c long, item_id string, n_resp long, p_correct double, a double, b double, a_sd double, a_lo double, a_hi double, flags array<string>"


def fitted(spark):
    rows = [
        (0, "i0", 9, 0.5, 1.5, 0.0, 0.1, 1.2, 1.8, []),
        (1, "i1", 9, 0.5, 0.1, 0.0, 0.1, 0.05, 0.2, ["dead"]),
        (2, "i2", 9, 0.5, -1.0, 0.0, 0.1, -1.3, -0.7, ["inverted"]),
        (3, "i3", 9, 0.5, 0.6, 0.3, 0.5, -0.4, 1.6, ["insufficient-data"]),
        (4, "i4", 9, 1.0, 0.9, -4.0, 0.1, 0.7, 1.1, ["ceiling"]),
        (5, "i5", 9, 0.5, 2.0, 0.5, 0.1, 1.8, 2.2, []),
    ]
    truth = [(0, 1.4, 0.0), (1, 1.0, 0.0), (2, -1.2, 0.0), (3, 1.0, 0.2), (4, 1.0, -3.0), (5, -0.5, 0.4)]
    return spark.createDataFrame(rows, ITEMS), spark.createDataFrame(truth, "c long, a double, b double")


def small(spark, models=6, items=12, seed=1):
    draw = random.Random(seed)
    rows = [(f"m{j}", f"i{i}", int(draw.random() < 1 / (1 + math.exp(i / 4 - j / 2))), f"s{i % 3}", j * items + i) for j in range(models) for i in range(items) if draw.random() < 0.9]
    return build_matrix(spark.createDataFrame(rows, "model_id string, item_id string, correct int, subject string, _seq long"))


def test_claims_are_shares_of_what_carries_them(spark):
    items, truth = fitted(spark)
    r = studies.claims_that_hold(items, truth).first()
    assert r.slope_covered == 4 / 6 and r.ready_but_negative == 1 / 3  # a dead item is usable
    assert r.ready_but_flat == 1 / 3 and r.dead_confirmed == 0.0 and r.inverted_confirmed == 1.0 and r.steep_withheld == 1 / 3
    none = studies.claims_that_hold(items.filter("c = 3"), truth).first()
    assert none.ready_but_flat is None and none.dead_confirmed is None
    assert {x.bucket: (x.n, x.fitted_negative) for x in studies.landing_of_miskeyed(items, truth).collect()} == {"inverted": (1, 1), "usable": (1, 0)}
    m = studies.misses(items, truth).first()
    assert m.n == 5 and m.above == 0.2 and m.below == 0.2
    assert {x.fitted_negative: x.n for x in studies.rates_by_fitted_sign(items, truth).collect()} == {True: 1, False: 1}


def test_pools_and_random_variants(spark):
    items, _ = fitted(spark)
    points = spark.createDataFrame([(0.0, 1.0)], "theta double, weight double")
    got = {}
    for r in studies.candidate_pools(items, points, 4).orderBy("variant", "rank").collect():
        got.setdefault(r.variant, []).append(r.c)
    assert got["short"] == [5, 0, 1] and got["shipped"] == [5, 0, 1, 3] and got["no-inv"] == [5, 0, 1, 3] and set(got["ungated"]) == {5, 0, 2, 3}
    drawn = studies.random_variants(items, 3, 4, 1).groupBy("variant", "draw").agg(F.sort_array(F.collect_list("c")).alias("c")).collect()
    assert all(r.c == ([0, 3, 5] if r.variant == "filtered" else [0, 1, 5]) for r in drawn) and len(drawn) == 8
    assert studies.anchor_or_none(items, points, 0).count() == 0 and studies.anchor_or_none(items, points, 2).count() == 2


def test_oracle_has_no_width(spark):
    items, truth = fitted(spark)
    people = spark.createDataFrame([(0, -1.0), (1, 1.0)], "r long, theta double")
    flags = {r.c: r.flags for r in studies.oracle_fit(items, truth, people).collect()}
    assert flags[2] == ["inverted"] and flags[5] == ["inverted"] and flags[4] == ["ceiling"] and flags[0] == []


def test_grid_leaves_out_what_is_done(spark):
    run = lambda cell: pd.DataFrame({"x": [cell["models"] * 10 + cell["seed"]]})
    done = spark.createDataFrame([(3, 0)], "models long, seed long")
    rows = studies.study_grid(spark, {"models": [3, 4], "seed": [0, 1]}, run, "x double", done).collect()
    assert {(r.models, r.seed): r.x for r in rows} == {(3, 1): 31.0, (4, 0): 40.0, (4, 1): 41.0}


def test_a_killed_study_resumes_without_running_cells_again(spark, tmp_path):
    path, log = str(tmp_path / "study"), tmp_path / "log"
    log.mkdir()

    def run(cell, broken=()):
        if cell["name"] in broken:
            raise RuntimeError("killed")
        (log / f"{cell['name']}-{cell['share']}-{cell['deep']}-{random.random()}").touch()
        return pd.DataFrame({"x": [cell["share"]] * (2 if cell["deep"] else 0)})

    axes = {"name": ["a", "b", "c"], "share": [0.25, 0.5], "deep": [True, False]}
    with pytest.raises(Exception, match="killed"):
        studies.run_study(spark, axes, lambda cell: run(cell, ("c",)), "x double", path, wave=4)
    assert len(list(log.iterdir())) == 8 and studies.stored_study(spark, path, list(axes))[0].count() == 8
    rows = studies.run_study(spark, axes, run, "x double", path, wave=3).collect()
    assert sorted((r.name, r.share) for r in rows) == sorted([(n, s) for n in "abc" for s in (0.25, 0.5)] * 2)
    assert len(list(log.iterdir())) == 12
    more = studies.run_study(spark, axes | {"share": [0.5, 0.75]}, run, "x double", path)
    assert {r.share for r in more.collect()} == {0.5, 0.75} and len(list(log.iterdir())) == 18


def test_spread_and_widening(spark):
    draw = np.random.default_rng(8)
    rows = [(c, float(draw.normal()), float(draw.uniform(0.1, 0.9))) for c in range(60)]
    items = spark.createDataFrame(rows, "c long, a double, a_sd double").withColumns({"a_lo": F.col("a") - F.col("a_sd"), "a_hi": F.col("a") + F.col("a_sd")})
    got = {r.c: r.kind for r in studies.spread_of_items(items, 12).collect()}
    by_width = [c for c, _, _ in sorted(rows, key=lambda x: x[2])]
    assert {c for c, k in got.items() if k == "narrow"} == set(by_width[:4]) and {c for c, k in got.items() if k == "wide"} == set(by_width[-4:]) and 8 <= len(got) <= 12
    sweep = studies.widening_sweep(items, (0.1, 1.0, 2.0, 5.0)).collect()
    assert [r.factor for r in sweep] == [0.1, 1.0, 2.0, 5.0] and all(r.n == 60 for r in sweep)
    assert [r.n_refused for r in sweep] == sorted(r.n_refused for r in sweep) and sweep[0].n_refused < sweep[-1].n_refused
    assert sweep[1].n_refused == sum(abs(a) <= 1.959963985 * sd for _, a, sd in rows)


def test_scales_are_recovered_by_a_refit_or_not_at_all(spark):
    m = small(spark)
    items, _, bounds = variational.joint_fit(m.responses, [], "hierarchical", 30, 4)
    own = {"items": items, "responses": m.responses, "meta": {"priors": "hierarchical", "epochs": 30, "seed": 4}}
    got = studies.recovered_scales(own)
    assert got["drift"] < 1e-9 and math.isclose(got["sigma_a"], bounds.first().sigma_a)
    with pytest.raises(studies.NothingToCompare):
        studies.recovered_scales(own | {"meta": own["meta"] | {"seed": 5}})


def test_comparisons_that_say_nothing_are_refused(spark):
    table = lambda rows: spark.createDataFrame(rows, "x double, y double")
    assert studies.common_positions(table([(1.0, 2.0), (2.0, 2.5), (3.0, 1.0), (None, 1.0)]), "x", "y") == 3
    for rows in ([(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], [(float("nan"), 1.0)] * 5):
        with pytest.raises(studies.NothingToCompare):
            studies.common_positions(table(rows), "x", "y")
    one = spark.createDataFrame([(k, float(k)) for k in range(5)], "r long, theta double")
    assert studies.reflection_agrees(one, one).first().agrees and not studies.reflection_agrees(one, one.withColumn("theta", -F.col("theta"))).first().agrees


def test_exports(spark, tmp_path):
    m = small(spark)
    rows = spark.createDataFrame([("a_x", 1), ("b", 2)], "subject string, correct int")
    studies.write_slices(rows, {"a": F.col("subject").startswith("a_"), "not_b": F.col("subject") != "b", "all": F.lit(True)}, str(tmp_path / "slices"))
    back = spark.read.json(str(tmp_path / "slices"))
    assert {r["slice"]: r["count"] for r in back.groupBy("slice").count().collect()} == {"a": 1, "not_b": 1, "all": 2}
    n = studies.write_shortlist(m, spark.createDataFrame([("m0",), ("m3",)], "model_id string"), str(tmp_path / "short"))
    assert spark.read.json(str(tmp_path / "short")).count() == 2 * n > 0
    truth = m.items.select("c", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    studies.write_cross_check(m, truth, m.respondents.select("r", F.lit(0.0).alias("theta")), str(tmp_path / "cross"), ["i1", "i2"])
    wide = spark.read.csv(str(tmp_path / "cross/wide"), header=True)
    assert wide.columns == ["respondent_id", "i1", "i2"] and wide.count() == 6 and {v for r in wide.collect() for v in (r.i1, r.i2)} <= {"0", "1", "NA"}
    maps = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "cross/responses")).collect()]
    assert sum(len(x["responses"]) for x in maps) == m.responses.count()
    with pytest.raises(MatrixError):
        studies.wide(m, [])


def test_diagnostics():
    history = [float(k) for k in range(5001)]
    kept, stride = diagnostics.thinned(history)
    assert stride == 3 and kept[-1] == 5000.0 and kept[:2] == [0.0, 3.0] and diagnostics.thinned([1.0, 2.0]) == ([1.0, 2.0], 1)
    assert diagnostics.late_improvement(history) == 499.0
    told = diagnostics.fit_diagnostics(history, seed=1, source="x", none=None, nested={"a": 1.0, "b": [1]})
    shown = dict(diagnostics.facts(told))
    assert shown["elbo_history"] == f"{len(kept)} values" and shown["nested.a"] == "1" and shown["nested.b"] == "1 values" and shown["seed"] == "1"
    assert "source" not in shown and "none" not in shown
    assert diagnostics.cut_of_scores({"score_threshold": True}, {"binarize_threshold": 0.5}) == 0.5 and diagnostics.cut_of_scores({}, {}) is None
    assert diagnostics.cut_of_scores({"threshold": 2}, {"score_threshold": 0.5}) == 2.0
    text = diagnostics.sheet({"model": diagnostics.model_metadata("newton", "x") | {"synthetic": True}, "diagnostics": told, "created": "now"}, "1")
    assert text[0].split() == ["model", "2pl"] and text[1].split() == ["priors", "ridge"] and any("known truth" in x for x in text) and text[-1] == "made by respanel 1 at now"


def test_variational_fit_keeps_its_scales(spark):
    m = small(spark)
    got = variational.vi_fit(m.responses.withColumn("fit_id", F.lit(0).cast("long")), epochs=60).toPandas()
    assert (got.sigma_a > 0).all() and (got.kind == "elbo").sum() == 60 and not got.reflected.any()
    of_a, of_b = diagnostics.prior_precisions("hierarchical", got.iloc[0][list(variational.HYPER)])
    assert math.isclose(of_a, got.sigma_a[0] ** -2) and of_b > 0 and diagnostics.prior_precisions("vague", {}) == (1 / 4, 1 / 9)


def test_validation_by_ability_and_by_model(spark):
    m = small(spark)
    sizes, rows = holdout.validation(m, holdout.newton_holdouts, (3, 5), 4, 1)
    sizes, rows = {r["size"]: r for r in sizes.collect()}, rows.collect()
    assert set(sizes) <= {3, 5} and all(r.n_short >= 0 and r.min_selected <= r["size"] and 0 <= r.beats_random_ability <= 1 for r in sizes.values())
    by_size = {}
    for r in rows:
        by_size.setdefault(r["size"], []).append(r)
    for size, own in by_size.items():
        assert math.isclose(sizes[size].mean_error, sum(r.error for r in own) / len(own)) and math.isclose(sizes[size].mean_ability_error, sum(r.ability_error for r in own) / len(own))


def test_unanswered_items_keep_the_prior(spark):
    items = spark.createDataFrame([(0, 0.5, 0.1, -0.2), (1, 0.0, 0.0, None)], "c long, a double, d double, b double")
    rows = spark.createDataFrame([(0, 0.3), (0, -0.3)], "c long, theta double")
    got = {r.c: r for r in fit.newton_intervals(items, rows).collect()}
    assert got[1].a_sd == 1.0 and got[0].a_sd < 1.0


def test_sign_is_turned_for_each_fit(spark):
    items = spark.createDataFrame([(0, 0, -1.0, 2.0, -1.5, -0.5), (1, 0, 1.0, 2.0, 0.5, 1.5)], "k long, c long, a double, b double, a_lo double, a_hi double")
    people = spark.createDataFrame([(0, 0, 3.0), (1, 0, 3.0)], "k long, r long, theta double")
    turned, own = fit.canonical_sign(items, people, ["k"])
    assert {r.k: (r.a, r.b, r.a_lo, r.a_hi) for r in turned.collect()} == {0: (1.0, -2.0, 0.5, 1.5), 1: (1.0, 2.0, 0.5, 1.5)}
    assert {r.k: r.theta for r in own.collect()} == {0: -3.0, 1: 3.0}


def test_node_sums_match_rows_by_node(spark):
    m = small(spark)
    items = m.items.select("c", F.lit(1.2).alias("a"), (F.col("c") / 10.0).alias("d"))
    nodes = crosscheck.quadrature(spark, 41)
    got = {(r.r, r.q): r.ll for r in crosscheck.log_likelihoods(m.responses, items, nodes).collect()}
    rows = m.responses.join(items, "c").crossJoin(nodes)
    z = F.col("a") * F.col("node") + F.col("d")
    want = rows.groupBy("r", "q").agg((F.first("logw") + F.sum(F.col("obs") * z - F.log1p(F.exp(z)))).alias("ll")).collect()
    assert len(got) == len(want) and all(abs(got[r.r, r.q] - r.ll) < 1e-9 for r in want)
    estimates, history = em.em_fit(m.responses, rounds=3, nodes=11)
    assert estimates.count() == m.items.count() and history == sorted(history)


def test_grid_posterior_equals_integration(spark):
    rows = [(c, t / 10 if c < 3 else 1.0, int((t * 7 + c) % 10 < 5 + t / 8)) for c in range(4) for t in range(-30, 31, 1 + 5 * (c == 2))]
    df = spark.createDataFrame(rows + rows[:9], "c long, theta double, obs int")
    points = 97
    a, b = np.linspace(-6, 6, points), np.linspace(-12, 12, points)
    for r in crosscheck.grid_posterior(df, 0.9, 0.2, 1.3, points).collect():
        own = [x for x in rows + rows[:9] if x[0] == r.c]
        lp = -0.5 * (a[:, None] / 0.9) ** 2 - 0.5 * ((b[None, :] - 0.2) / 1.3) ** 2
        for _, theta, y in own:
            z = a[:, None] * (theta - b[None, :])
            lp = lp + y * z - np.logaddexp(0, z)
        p = np.exp(lp - lp.max()).sum(axis=1)
        p /= p.sum()
        want = [a @ p, *np.interp([0.025, 0.975], np.cumsum(p), a), p[0] + p[-1]]
        assert np.allclose([r.a_mean, r.a_lo, r.a_hi, r.edge], want, atol=1e-9)
        assert r.spans_zero == (want[1] <= 0 <= want[2]) and r.grid_limited == (want[3] > 1e-4)
    limited = crosscheck.grid_posterior(df.filter("c = 0"), 400.0, 0.0, 1.0, 41).first()
    assert limited.edge >= 0
    compared = crosscheck.interval_against_grid(spark.createDataFrame([(0, -1.0, 1.0), (1, 0.1, 0.9)], "c long, a_lo double, a_hi double"), crosscheck.grid_posterior(df, 0.9, 0.2, 1.3, 41)).first()
    assert compared.n == 2 and compared.width_ratio > 0 and 0 <= compared.same_verdict <= 1


def test_the_query_integrates_over_the_whole_grid(spark, sf, monkeypatch):
    """It took 41 values of either axis where the posterior is defined on 481; a value of an interval lies between two of them."""
    from respanel.plans import catalog

    seen = []
    keep = crosscheck.grid_posterior
    monkeypatch.setattr(crosscheck, "grid_posterior", lambda rows, *given, **named: seen.append((given[3:], named)) or keep(rows, *given, **named))
    catalog.grid_posterior(spark, sf)
    assert seen == [((), {})] and catalog.oracle_sql()["grid_posterior"].count("range(481)") == 2


def test_abilities_shared_by_a_batch_give_the_posterior_of_each_item(spark):
    """Nodes stand for 400 distinct abilities, and for none where a batch has few of them."""
    rows = [(c, -3 + 6 * ((c * 37 + t * 11) % 400) / 399, int((t * 7 + c) % 5 < 2 + c % 2)) for c in range(40) for t in range(20 + c)]
    for own in (rows, [x for x in rows if x[0] == 3]):
        got = crosscheck.grid_posterior(spark.createDataFrame(own, "c long, theta double, obs int").coalesce(1), 0.9, 0.2, 1.3, 61).collect()
        assert len(got) == len({x[0] for x in own})
        a, b = np.linspace(-6, 6, 61), np.linspace(-12, 12, 61)
        for r in got:
            lp = -0.5 * (a[:, None] / 0.9) ** 2 - 0.5 * ((b[None, :] - 0.2) / 1.3) ** 2
            for _, theta, y in (x for x in own if x[0] == r.c):
                z = a[:, None] * (theta - b[None, :])
                lp = lp + y * z - np.logaddexp(0, z)
            p = np.exp(lp - lp.max()).sum(axis=1)
            p /= p.sum()
            assert np.allclose([r.a_mean, r.edge], [a @ p, p[0] + p[-1]], rtol=0, atol=1e-11)


def test_wider_intervals_only_refuse_more(spark):
    items, _ = fitted(spark)
    people = spark.createDataFrame([(0, -1.0), (1, 1.0)], "r long, theta double")

    def refused(scale):
        wide = items.withColumn("a_lo", F.col("a") - scale * F.col("a_sd")).withColumn("a_hi", F.col("a") + scale * F.col("a_sd")).drop("flags")
        return {r.c for r in fit.item_flags(wide, people).filter(F.array_contains("flags", "insufficient-data")).collect()}

    sets = [refused(s) for s in (0.5, 2.0, 6.0, 20.0)]
    assert all(x <= y for x, y in zip(sets, sets[1:], strict=False)) and len(sets[0]) < len(sets[-1])


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    from respanel.sources.jsonl import numbered_lines

    lines = [f"line {k}" if k % 5 else "" for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("x\ny")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = numbered_lines(spark, str(tmp_path))
        rows = df.orderBy("_seq").collect()
        assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in rows] == [*lines, "x", "y"] and [r._seq for r in rows] == list(range(3002)) and [r._line for r in rows] == [*range(1, 3001), 1, 2]


def test_empty_matrix_is_refused(spark):
    with pytest.raises(MatrixError):
        build_matrix(spark.createDataFrame([], "model_id string, item_id string, correct int"))
    assert isinstance(small(spark), ResponseMatrix)


def test_a_fit_travels_as_one_file(spark, tmp_path):
    from respanel.operators import store
    from respanel.schema import ArtifactError

    items, _ = fitted(spark)
    people = spark.createDataFrame([(0, "m0", 0.5)], "r long, respondent_id string, theta double")
    store.save_fit(str(tmp_path / "fit"), people, items, None, {"seed": 3})
    store.export_fit(store.load_fit(spark, str(tmp_path / "fit")), str(tmp_path / "fit.gz"))
    back = store.import_fit(spark, str(tmp_path / "fit.gz"))
    assert back["meta"]["seed"] == 3 and back["responses"] is None
    assert sorted(map(str, back["items"].collect())) == sorted(map(str, items.collect())) and back["respondents"].collect() == people.collect()
    (tmp_path / "other").mkdir()
    shuffled = items.repartition(3, "a")
    store.save_fit(str(tmp_path / "again"), people, shuffled, None, {"seed": 3})
    store.export_fit(store.load_fit(spark, str(tmp_path / "again")), str(tmp_path / "other/name.gz"))
    assert (tmp_path / "other/name.gz").read_bytes() == (tmp_path / "fit.gz").read_bytes()
    crossed = items.withColumn("a_lo", F.when(F.col("c") == 1, 9.0).otherwise(F.col("a_lo")))
    store.export_fit({"respondents": people, "items": crossed, "responses": None, "meta": {}}, str(tmp_path / "crossed.gz"))
    with pytest.raises(ArtifactError, match="i1"):
        store.load_fit(spark, str(tmp_path / "crossed.gz"))
    with pytest.raises(ArtifactError):
        store.export_fit(back, str(tmp_path / "name.json"))
    (tmp_path / "bad.gz").write_bytes(b"no")
    with pytest.raises(ArtifactError):
        store.import_fit(spark, str(tmp_path / "bad.gz"))


def test_tables_with_any_header(spark, tmp_path):
    from respanel.sources.registry import read_any

    (tmp_path / "a.csv").write_text('model_id,item_id,correct,run no.,2nd\nm,i,1,"x, y",z\nm,j,0,,w\n')
    rows = read_any(spark, str(tmp_path / "a.csv")).orderBy("_line").collect()
    assert [(r.item_id, r.correct, r.extra) for r in rows] == [("i", 1, {"run no.": "x, y", "2nd": "z"}), ("j", 0, {"2nd": "w"})]


def test_normal_quantiles():
    from respanel.operators import select

    points = select.normal_quantiles(41)
    assert len(points) == 41 and abs(sum(x * w for x, w in points)) < 1e-12 and points[20][0] == 0


def test_slopes_of_full_and_sparse_tables_agree():
    draw = np.random.default_rng(2)
    rows, cols = np.nonzero(draw.random((30, 40)) < 0.8)
    obs = draw.integers(0, 2, len(rows)).astype(float)
    at = (draw.standard_normal(40), draw.standard_normal(40), draw.standard_normal(30))
    one, other = (fn(rows, cols, obs, 30, 40)(*at) for fn in (variational.slopes_by_answer, variational.slopes_by_cell))
    a, b, theta = at
    z = a[cols] * (theta[rows] - b[cols])
    assert math.isclose(one[0], float((obs * z - np.logaddexp(0, z)).sum()), rel_tol=1e-9)
    for x, y in zip(one, other, strict=True):
        assert np.allclose(x, y, atol=1e-9)


def test_reports_of_comparisons(spark):
    rows = [(k, float(k % 37) + k / 100, float(k % 37) + k / 99) for k in range(200)]
    pairs = spark.createDataFrame(rows, "c long, x double, y double")
    assert studies.canary(pairs, "c", "x", "y")["pearson"] > 0.999
    with pytest.raises(studies.NothingToCompare):
        studies.canary(pairs.withColumn("y", F.col("c") * 17 % 41 + 0.5), "c", "x", "y")
    found, control = crosscheck.agreement(pairs, "c", "x", "y").first().asDict(), crosscheck.shuffled_control(pairs, "c", "x", "y").first().asDict()
    assert "NO SIGNAL" not in studies.agreement_line("b", found, control) and "NO SIGNAL" in studies.agreement_line("b", found, control | {"beats_control": False})
    assert "settled" in studies.convergence_line("fit", [-10.0] * 50) and "moving" in studies.convergence_line("fit", [float(k) for k in range(1, 50)])
    assert json.loads(studies.study_json([{"a": 1.23456789, "b": float("nan"), "c": "x"}])) == [{"a": 1.23457, "b": None, "c": "x"}]


def test_refits_cover(spark):
    from respanel.operators import synth

    m, truth, _ = synth.synthetic_matrix(spark, 40, 60, seed=2)
    rows = {r.epochs: r.coverage for r in studies.refit_coverage(m, truth, [50, 300]).collect()}
    assert set(rows) == {50, 300} and rows[300] > 0.7


def drawn(n_models, n_items, missing=0.0, seed=0):
    """Answers in triplets and the truth, from the distribution of ``synth``: flat items and items far off the models among them."""
    draw = np.random.default_rng(seed)
    theta, b = draw.normal(size=n_models), draw.normal(scale=synth.B_SD, size=n_items)
    off = draw.random(n_items) < synth.OFF_SHARE
    b[off] = draw.choice([-1, 1], off.sum()) * synth.OFF_CENTRE + draw.normal(scale=synth.OFF_SD, size=off.sum())
    a = np.where(draw.random(n_items) < synth.DEAD_SHARE, draw.uniform(*synth.DEAD_RANGE, n_items), np.exp(draw.normal(synth.SLOPE_LOG_MEAN, synth.SLOPE_LOG_SD, n_items)))
    rows, cols = (x.ravel() for x in np.indices((n_models, n_items)))
    kept = draw.random(len(rows)) >= missing
    rows, cols = rows[kept], cols[kept]
    obs = (draw.random(len(rows)) < 1 / (1 + np.exp(-a[cols] * (theta[rows] - b[cols])))).astype(float)
    return rows, cols, obs, a, b, theta


def test_variational_fit_recovers_within_the_published_bands():
    r = lambda x, y: np.corrcoef(x, y)[0, 1]
    for missing, bands in ((0.0, (0.45, 0.80, 0.95)), (0.3, (0.35, 0.65, 0.90))):
        rows, cols, obs, a, b, theta = drawn(15, 500, missing)
        got = variational.fit_arrays(rows, cols, obs, 15, 500)
        assert r(got["a"], a) > bands[0] and r(got["b"], b) > bands[1] and r(got["theta"], theta) > bands[2]


def test_hierarchical_slopes_pool_towards_zero():
    rows, cols, obs, a, _, _ = drawn(120, 60, seed=3)
    got = variational.fit_arrays(rows, cols, obs, 120, 90)
    assert np.abs(got["a"][60:]).max() < 0.15, "items without answers have no slope"
    assert abs(got["hyperparameters"]["sigma_a"] / np.sqrt((a**2).mean() * 60 / 90) - 1) < 0.5
    vague = variational.fit_arrays(rows, cols, obs, 120, 90, "vague")
    assert np.abs(vague["a"][60:] - 1).max() < 0.3


def test_layouts_of_the_variational_fit_agree(monkeypatch):
    rows, cols, obs, *_ = drawn(20, 40, seed=5)
    by_cell = variational.fit_arrays(rows, cols, obs, 20, 40, epochs=300)
    monkeypatch.setattr(variational, "slopes_by_cell", variational.slopes_by_answer)
    by_answer = variational.fit_arrays(rows, cols, obs, 20, 40, epochs=300)
    assert np.allclose(by_cell["elbo"], by_answer["elbo"], rtol=1e-9) and np.allclose(by_cell["a"], by_answer["a"], atol=1e-6)
