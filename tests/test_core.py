"""Coercion, matrices, fits, flags, selection, scoring, holdout and commands."""

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from respanel import cli, render
from respanel.functions import coerce, ranks
from respanel.operators import crosscheck, em, fit, holdout, matrix, report, score, select, store, synth, variational
from respanel.schema import FLAGS, ArtifactError, MatrixError, RecordError, ReportError, SelectError, ValidateError


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_coercion_table(spark):
    right, wrong, refused = ["1", " TRUE ", "t", "Yes", "y", "correct", "1.0", "+1"], ["0", "false", "F", "no", "N", "incorrect", "0.0", "-0"], ["0.5", "2", "-1", "maybe", "", None, "[]", "1e-9", "nan"]
    rows = frame(spark, [(v,) for v in right + wrong + refused], "v string").select("v", coerce.coerce_correct(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == [1] * len(right) + [0] * len(wrong) + [None] * len(refused)


def test_keys():
    assert coerce.parse_key("model_id, seed") == ["model_id", "seed"]
    for bad in ("", "seed", "model_id,", "model_id,model_id"):
        with pytest.raises(ValueError):
            coerce.parse_key(bad)
    with pytest.raises(RecordError, match="available"):
        coerce.respondent_id(["model_id", "temperature"], ["model_id"])


RECORDS = "model_id string, item_id string, correct int, subject string, prompt_variant string, _seq long"


def records(spark, rows):
    return frame(spark, [(m, i, c, s, v, k) for k, (m, i, c, s, v) in enumerate(rows)], RECORDS)


def test_matrix_integrity(spark):
    rows = [("b", "q2", 1, None, "x"), ("b", "q1", 0, "s1", "x"), ("a", "q2", 1, "s2", "x"), ("a", "q1", 1, "s3", "y")]
    m = matrix.build_matrix(records(spark, rows))
    assert [r.respondent_id for r in m.respondents.orderBy("r").collect()] == ["b", "a"]
    assert [(r.item_id, r.subject) for r in m.items.orderBy("c").collect()] == [("q2", "s2"), ("q1", "s1")]
    assert matrix.shape(m).first().density == 1.0
    with pytest.raises(MatrixError, match=r"a x q2 \(2 times\)"):
        matrix.build_matrix(records(spark, [*rows, ("a", "q2", 0, None, "x")]))
    with pytest.raises(MatrixError, match="several models"):
        matrix.build_matrix(records(spark, [("a|b", "q", 1, None, "c"), ("a", "q", 1, None, "b|c")]), ("model_id", "prompt_variant"))
    with pytest.raises(MatrixError, match="no responses"):
        matrix.build_matrix(records(spark, []))
    with pytest.raises(MatrixError, match="missing"):
        matrix.build_matrix(records(spark, [("a", "q", 1, None, None)]), ("model_id", "prompt_variant"))
    left = matrix.drop_model(m, "b")
    assert {r.model_id for r in left.respondents.collect()} == {"a"} and left.responses.count() == 2 and left.items.count() == 2
    assert [r.item_id for r in matrix.select_items(m, ["q1", "q1"]).items.collect()] == ["q1"]
    with pytest.raises(MatrixError, match="unknown"):
        matrix.select_items(m, ["zz"])


def flags_of(spark, rows, theta=(-1.0, 1.0)):
    df = frame(spark, rows, "lo double, hi double, p double, b double")
    out = fit.flag_columns(F.col("lo"), F.col("hi"), F.col("p"), F.col("b"), F.lit(theta[0]), F.lit(theta[1]))
    return [list(r.f) for r in df.select(out.alias("f")).collect()]


def test_flag_values(spark):
    table = [((0.05, 0.30), "dead"), ((-0.30, -0.10), "dead"), ((0.01, 0.34), "dead"), ((-1.17, -0.22), "inverted"), ((-0.5, -0.1), "inverted"), ((-3, -1), "inverted")]
    table += [((-0.2, 0.4), "insufficient-data"), ((-2, 2), "insufficient-data"), ((0, 0.5), "insufficient-data"), ((0.40, 0.90), None), ((0.36, 2), None), ((1, 3), None)]
    got = flags_of(spark, [(float(lo), float(hi), 0.5, 0.0) for (lo, hi), _ in table])
    assert got == [[f] if f else [] for _, f in table]
    assert flags_of(spark, [(1.0, 2.0, None, 0.0), (1.0, 2.0, 0.99, 0.0), (1.0, 2.0, 0.01, 0.0), (1.0, 2.0, 0.5, 3.1), (-1.0, 2.0, 0.5, 9.0)]) == [[], ["ceiling"], ["floor"], ["off-range"], ["insufficient-data"]]


def test_flags_exclude_each_other(spark):
    grid = [x / 10 for x in range(-15, 16)]
    got = flags_of(spark, [(lo, hi, 0.5, 0.0) for lo, hi in itertools.product(grid, grid) if lo <= hi])
    assert all(len(set(f) & set(FLAGS[:3])) <= 1 for f in got)


def test_newton_recovers_truth(spark):
    m, items, people = synth.synthetic_matrix(spark, 200, 120, seed=3)
    own, abilities = fit.newton_fit(m.responses)
    got = own.join(items.select("c", F.col("a").alias("ta"), F.col("b").alias("tb")), "c").filter("p_correct between 0.05 and 0.95 and ta > 0.4").toPandas()
    assert np.corrcoef(got.a, got.ta)[0, 1] > 0.7 and np.corrcoef(got.b, got.tb)[0, 1] > 0.85
    theta = abilities.join(people.select("r", F.col("theta").alias("t")), "r").toPandas()
    assert np.corrcoef(theta.theta, theta.t)[0, 1] > 0.9


def test_a_flat_item_is_never_dead(spark):
    rows = [(r, 0, int(r % 10 > 0), -2 + 4 * r / 59) for r in range(60)]
    df = frame(spark, rows, "r long, c long, obs int, theta double")
    out = fit.newton_intervals(fit.newton_items(df), df).first()
    assert out.a_lo < 0 < out.a_hi or abs(out.a) > 0.35


def test_sign_is_canonical(spark):
    items = frame(spark, [(0, -1.0, 0.5, -1.5, -0.5), (1, -0.5, 1.0, -0.8, -0.2)], "c long, a double, b double, a_lo double, a_hi double")
    people = frame(spark, [(0, 2.0)], "r long, theta double")
    i, p = fit.canonical_sign(items, people)
    assert [tuple(r) for r in i.orderBy("c").collect()] == [(0, 1.0, -0.5, 0.5, 1.5), (1, 0.5, -1.0, 0.2, 0.8)] and p.first().theta == -2.0


def fabricated(spark, models=30, items=80, n=120, seed=3, precision=2.0):
    m, truth, people = synth.synthetic_matrix(spark, models, items, seed=seed)
    own, abilities = synth.fabricated_fit(truth, people, n, precision, seed)
    return m, store.stored(own, "fab"), store.stored(abilities, "fab")


def test_selection(spark):
    m, items, abilities = fabricated(spark)
    points = select.ability_points(abilities, m.respondents)
    assert points.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    ten, five = (select.select_anchor(items, points, n).orderBy("rank").collect() for n in (10, 5))
    assert [r.c for r in ten][:5] == [r.c for r in five] and not any(r.padded for r in five)
    flagged = {r.c: set(r.flags) for r in items.collect()}
    assert all(not flagged[r.c] & {"inverted", "insufficient-data", "ceiling", "floor"} for r in ten if not r.padded)
    everything = select.select_anchor(items, points, 500).orderBy("rank").collect()
    pads = [r.padded for r in everything]
    assert pads == sorted(pads)
    greedy = select.anchor_min_variance(items, points, 10).orderBy("rank").collect()
    best = lambda rows: select.set_error(frame(spark, [(r.c,) for r in rows], "c long"), items, points).agg(F.sum(F.col("weight") * F.col("theta_se") * F.col("theta_se"))).first()[0]
    assert best(greedy) <= best(ten) + 1e-9
    for n in (0, -3):
        with pytest.raises(SelectError):
            select.select_anchor(items, points, n)


def test_largest_remainder_and_interval(spark):
    got = ranks.largest_remainder(frame(spark, [("a", 5), ("b", 3), ("c", 3)], "g string, n long"), "g", "n", 7).orderBy("g").collect()
    assert [r.take for r in got] == [3, 2, 2] and sum(r.take for r in got) == 7
    draw = np.random.default_rng(1).normal(size=400)
    low, high = ranks.narrowest_interval(frame(spark, [(0, float(x)) for x in draw], "g long, x double"), ["g"], "x", 0.95).select("low", "high").first()
    s, w = np.sort(draw), math.ceil(0.95 * 400)
    k = int(np.argmin(s[w - 1 :] - s[: 400 - w + 1]))
    assert (low, high) == (s[k], s[k + w - 1])


def test_map_theta(spark):
    cases = [[(1.5, 0.0, 1.0)] * 10, [(1.5, 0.0, 0.0)] * 10, [(1.0, -1.0, 1.0), (2.0, 0.5, 0.0), (-1.0, 0.2, 1.0)]]
    df = frame(spark, [(k, [{"a": a, "b": b, "y": y} for a, b, y in c]) for k, c in enumerate(cases)], "k long, xs array<struct<a:double,b:double,y:double>>")
    for r in df.select("k", score.map_theta(F.col("xs")).alias("t")).collect():
        residual = -r.t + sum(a * (y - 1 / (1 + math.exp(-a * (r.t - b)))) for a, b, y in cases[r.k])
        assert abs(residual) < 1e-6 and abs(r.t) < 6


def test_places_and_beats(spark):
    scores = frame(spark, [("s", "m0", 0.2), ("s", "m1", 0.6), ("s", "m2", 0.6)], "s string, model_id string, accuracy double")
    truth = frame(spark, [("m0", 0.9), ("m1", 0.8), ("m2", 0.7)], "model_id string, accuracy double")
    got = {r.model_id: (r.place, r.true_place) for r in score.placements(scores, truth, ["s"]).collect()}
    assert got == {"m0": (3.0, 1.0), "m1": (1.5, 2.0), "m2": (1.5, 3.0)}
    ref = frame(spark, [(-1.0,), (0.0,), (1.0,)], "theta double")
    own = frame(spark, [(0, 2.0), (1, -2.0), (2, 0.0)], "k long, theta double")
    assert [r.place for r in score.ability_places(own, ref, ["k"]).orderBy("k").collect()] == [1.0, 4.0, 2.5]
    draws = frame(spark, [(0.0,), (0.0,), (1.0,), (1.0,)], "d double")
    assert draws.agg(score.beats(F.lit(0.0), F.col("d"))).first()[0] == 0.75


def brute_kendall(x, y):
    pairs = [(np.sign(a - c), np.sign(b - d)) for (a, b), (c, d) in itertools.combinations(zip(x, y, strict=True), 2)]
    return sum(s * t for s, t in pairs) / math.sqrt(sum(abs(s) for s, _ in pairs) * sum(abs(t) for _, t in pairs))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=3, max_size=9))
def test_rank_correlations(spark, rows):
    df = frame(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "i long, x double, y double")
    got = ranks.rank_correlations(df, [], "i", "x", "y").first()
    x, y = (np.array(v, float) for v in zip(*rows, strict=True))
    if len(set(x)) == 1 or len(set(y)) == 1:
        assert got.spearman is None and got.kendall is None
        return
    rank = lambda v: np.array([(v > a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and got.kendall == pytest.approx(brute_kendall(x, y))


def test_holdout_leaks_nothing(spark):
    m, _, _ = synth.synthetic_matrix(spark, 6, 40, variants=2, seed=7)
    holdouts = holdout.all_holdouts(m)
    left = holdout.held_out_responses(m, holdouts).join(m.respondents, "r").join(holdouts, "k")
    assert left.filter(F.col("model_id") == F.col("holdout")).count() == 0 and holdouts.count() == 6
    with pytest.raises(ValidateError):
        holdout.all_holdouts(m, ["nobody"])
    with pytest.raises(ValidateError):
        holdout.all_holdouts(matrix.ResponseMatrix(m.respondents.filter("model_id = 'model-0'"), m.items, m.responses))
    for bad in ("", "0", "a,b", "-1,5"):
        with pytest.raises(ValidateError):
            holdout.parse_sizes(bad)
    assert holdout.parse_sizes("50,25,25") == [25, 50]


def test_whole_suite_places_exactly(spark):
    m, truth, people = synth.synthetic_matrix(spark, 5, 30, seed=3)
    holdouts = holdout.all_holdouts(m)
    sets = holdouts.select("k").crossJoin(m.items.select("c")).withColumn("size", F.lit(30))
    assert holdout.errors(sets, m, holdouts, ["k", "size"]).agg(F.max("error")).first()[0] == 0.0


def test_em_improves_and_recovers(spark):
    m, items, _ = synth.synthetic_matrix(spark, 150, 30, seed=5)
    got, history = em.em_fit(store.stored(m.responses, "em"), rounds=4, nodes=21)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history))
    both = got.join(items.select("c", F.col("b").alias("tb"), F.col("a").alias("ta")), "c").filter("ta > 0.4 and abs(tb) < 2.5").toPandas()
    assert np.corrcoef(both.b, both.tb)[0, 1] > 0.9


def test_variational_bands():
    draw = np.random.default_rng(0)
    a, b, theta = np.exp(0.05 + 0.42 * draw.standard_normal(200)), 1.05 * draw.standard_normal(200), draw.standard_normal(40)
    rows, cols = np.divmod(np.arange(40 * 200), 200)
    obs = (draw.random(8000) < 1 / (1 + np.exp(-a[cols] * (theta[rows] - b[cols])))).astype(float)
    got = variational.fit_arrays(rows, cols, obs, 40, 200, epochs=600)
    corr = lambda x, y: np.corrcoef(x, y)[0, 1]
    assert corr(got["a"], a) > 0.45 and corr(got["b"], b) > 0.8 and corr(got["theta"], theta) > 0.95 and got["a"].sum() > 0
    vague = variational.fit_arrays(rows, cols, obs, 40, 200, priors="vague", epochs=300)
    assert vague["hyperparameters"] == {} and corr(vague["b"], b) > 0.8
    with pytest.raises(ValueError):
        variational.fit_arrays(rows, cols, obs, 40, 200, priors="other")


def test_report_order_and_refusal(spark):
    m, items, abilities = fabricated(spark, models=4, items=60, n=20, precision=0.5)
    items = items.join(m.items.select("c", "item_id", "subject"), "c")
    rows = report.rows(items, "discrimination").orderBy("position").collect()
    rankable = [r.rankable for r in rows]
    assert rankable == sorted(rankable, reverse=True) and all((r.rank is None) == (not r.rankable) for r in rows)
    assert [r.item_id for r in report.rows(items, "id", 3).orderBy("position").collect()] == sorted(r.item_id for r in rows)[:3]
    head = report.refusal(report.header(items, m.respondents, m.responses)).first()
    assert head.level in ("refusal", "caution") and head.n_real_models == 4
    for bad in ({"sort": "size"}, {"limit": -1}):
        with pytest.raises(ReportError):
            report.rows(items, **bad)
    curve = report.information_curve(items, abilities).collect()
    assert len(curve) == 241 and all(p.all_info >= p.pool_info - 1e-9 for p in curve)


def test_ticks():
    assert render.ticks(-3.2, 3.2) == [-2.0, 0.0, 2.0] and all(0 < t < 1 for t in render.ticks(0, 1))


def test_commands(spark, tmp_path, capsys):
    m, _, _ = synth.synthetic_matrix(spark, 12, 60, seed=5, inverted=0.05)
    lines = [json.dumps(r.asDict()) for r in synth.records_of(m).select("model_id", "item_id", "correct", "subject").orderBy("model_id", "item_id").collect()]
    source, out = tmp_path / "r.jsonl", str(tmp_path / "fit")
    source.write_text("\n".join(lines))
    assert cli.main(["fit", str(source), "-o", out, "--epochs", "300"], spark) == 0
    capsys.readouterr()
    assert cli.main(["report", out, "--json", "--limit", "5", "--html", str(tmp_path / "r.html")], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["shown"] == 5 and told["header"]["n_real_models"] == 12
    page = (tmp_path / "r.html").read_text()
    assert "http" not in page and page.count("<svg") == 1
    assert cli.main(["report", out], spark) == 0 and "models 12" in capsys.readouterr().out
    code = cli.main(["select", out, "-n", "5"], spark)
    assert (code == 0 and len(capsys.readouterr().out.split()) == 5) or code == 2
    assert cli.main(["select", out, "-n", "5", "--adaptive"], spark) == 2
    assert cli.main(["validate", out, "--sizes", "5,10", "--draws", "5", "--json"], spark) == 0
    assert [s["size"] for s in json.loads(capsys.readouterr().out)["sizes"]] == [5, 10]
    assert cli.main(["fit", str(tmp_path / "none.jsonl"), "-o", out], spark) == 1
    with pytest.raises(ArtifactError):
        store.load_fit(spark, str(tmp_path / "nothing"))


def test_holdouts_by_subtraction_equal_fits_of_copies(spark):
    m, _, _ = synth.synthetic_matrix(spark, 6, 30, variants=2, seed=9, missing=0.3)
    holdouts = holdout.all_holdouts(m)
    copies = holdout.held_out_responses(m, holdouts)
    counts = {(r.k, r.c): (r.n_resp, r.n_right) for r in holdout.held_out_counts(m, holdouts).collect()}
    assert counts == {(r.k, r.c): (r.n, r.s) for r in copies.groupBy("k", "c").agg(F.count("*").alias("n"), F.sum("obs").alias("s")).collect()}
    names = ["a", "d", "b", "a_lo", "b_hi", "p_correct"]
    (one, people), (other, others) = holdout.newton_holdouts(m, holdouts), fit.newton_fit(copies, ["k"])
    want = {(r.k, r.c): r for r in other.collect()}
    got = {(r.k, r.c): r for r in one.collect()}
    assert set(got) == set(want) and len(got) > 100
    assert all(got[k].flags == want[k].flags and got[k].n_resp == want[k].n_resp and all(abs(got[k][n] - want[k][n]) < 1e-8 * (1 + abs(want[k][n])) for n in names) for k in got)
    theta = {(r.k, r.r): r.theta for r in others.collect()}
    assert all(abs(r.theta - theta[r.k, r.r]) < 1e-9 for r in people.collect()) and len(theta) == people.count()


def test_joint_fits_of_holdouts_leave_the_model_out(spark):
    m, _, _ = synth.synthetic_matrix(spark, 4, 12, seed=2)
    holdouts = holdout.all_holdouts(m, ["model-1", "model-3"])
    items, people = holdout.joint_holdouts(m, holdouts, "hierarchical", 40, 0)
    assert {(r.k, r.n) for r in items.groupBy("k").agg(F.count("*").alias("n")).collect()} == {(1, 12), (3, 12)}
    assert {(r.k, r.r) for r in people.collect()} == {(1, 0), (1, 2), (1, 3), (3, 0), (3, 1), (3, 2)}
    assert {"a_lo", "a_hi", "flags", "n_resp"} <= set(items.columns)


def test_inversions_and_tau_equal_brute_force(spark):
    draw = np.random.default_rng(6)
    rows = [(g, i, float(x), float(y)) for g, n, top in ((0, 60, 8), (1, 50, 1000), (2, 2, 5), (3, 40, 1)) for i, (x, y) in enumerate(draw.integers(-1, top, (n, 2)))]
    rows += [(1, 99, float("nan"), 1.0), (1, 98, None, 1.0), (0, 97, -0.0, 0.0)]
    got = {r.g: r for r in ranks.rank_correlations(spark.createDataFrame(rows, "g long, i long, x double, y double"), ["g"], "i", "x", "y").collect()}
    for g in got:
        own = [(x, y) for k, _, x, y in rows if k == g and x is not None and x == x]
        signs = [(np.sign(a - c), np.sign(b - d)) for k, (a, b) in enumerate(own) for c, d in own[:k]]
        s, t = (sum(abs(z[k]) for z in signs) for k in (0, 1))
        want = sum(p * q for p, q in signs) / math.sqrt(s * t) if s * t and len(own) > 2 else None
        assert got[g].n == len(own) and (got[g].kendall is None if want is None else math.isclose(got[g].kendall, want, abs_tol=1e-12))


def test_item_rest_on_the_filled_table_equals_the_table(spark):
    m, _, _ = synth.synthetic_matrix(spark, 9, 14, variants=2, seed=4, missing=0.4)
    obs = m.responses.join(m.respondents, "r").groupBy("model_id", "c").agg(F.avg("obs").alias("x")).toPandas()
    wide = obs.pivot(index="model_id", columns="c", values="x")
    wide = wide.fillna(wide.mean())
    got = {r.c: r.item_rest for r in select.item_rest_filled(m.responses, m.respondents, m.items).collect()}
    for c in wide.columns:
        rest = wide.sum(axis=1) - wide[c]
        want = np.corrcoef(wide[c], rest)[0, 1] if wide[c].std() > 1e-9 else 0.0
        assert math.isclose(got[c], want, abs_tol=1e-9)
    plan = select.item_rest_filled(m.responses, m.respondents, m.items)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("bins", [2, 4096])
def test_median_of_the_surface_is_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(crosscheck, "BINS", bins)
    monkeypatch.setattr(crosscheck, "PEOPLE_BLOCK", 3)
    draw = np.random.default_rng(bins)
    one, other = draw.normal(size=(2, 7, 2))
    t1, t2 = draw.integers(-2, 3, (2, 10)) / 2
    items = lambda x: spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in enumerate(x)] + [(99, 1.0, None)], "c long, a double, b double")
    people = lambda x: spark.createDataFrame([(r, float(t)) for r, t in enumerate(x)], "r long, theta double")
    p = lambda x, t: 1 / (1 + np.exp(-(x[:, 0][:, None] * (t[None, :] - x[:, 1][:, None]))))
    want = np.abs(p(one, t1) - p(other, t2)).ravel()
    got = crosscheck.probability_surface((items(one), people(t1)), (items(other), people(t2))).first()
    assert got.n == 70 and np.allclose([got.mean_diff, got.median_diff, got.max_diff], [want.mean(), np.median(want), want.max()], atol=1e-12)
    rows = spark.createDataFrame([(1.0, 2), (1.0, 1), (2.0, 3), (3.0, 1)], "d double, w long")
    assert [crosscheck.weighted_order_statistic(rows, "d", "w", k, 1.0, 3.0) for k in range(7)] == [1.0] * 3 + [2.0] * 3 + [3.0]
