"""Folded fits of all holdouts against fits of every holdout by itself."""

import numpy as np
import pytest

from respanel.operators import holdout, loo, matrix, select, synth
from respanel.operators.store import stored


@pytest.fixture(scope="module")
def panel(spark):
    m, _, _ = synth.synthetic_matrix(spark, 80, 90, seed=2, missing=0.7)
    return m, stored(holdout.all_holdouts(m), "holdouts")


def test_folded_fits_and_sets_equal_those_of_every_holdout(panel, monkeypatch):
    """Holdouts in the box go through its nodes, those outside by themselves; sets take several passes over the bounds."""
    m, holdouts = panel
    items, abilities = holdout.newton_holdouts(m, holdouts)
    want = {(r.k, r.c): r for r in items.collect()}
    monkeypatch.setattr(loo, "NEAR", 0.03)
    monkeypatch.setattr(loo, "CELLS", 500)
    monkeypatch.setattr(loo, "CHUNK", 7)
    folded = loo.all_fits(m, holdouts)
    assert loo.ORDER**2 < folded.holdouts.inside.sum() < 80
    assert folded.fits.count() == m.responses.select("c").distinct().count()  # a row an item is all that is stored
    got = loo.items(folded).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.k, r.c]
        assert r.n_resp == w.n_resp and np.allclose([r.p_correct, r.a, r.d, r.a_lo, r.a_hi], [w.p_correct, w.a, w.d, w.a_lo, w.a_hi], rtol=0, atol=1e-8)
    # a cut after a few items, so that holdouts are settled in several passes
    sets = {(r.k, r.size, r.c) for r in holdout.chosen_sets(items, select.ability_points(abilities, m.respondents, ["k"]), [3, 6], ["k"]).collect()}
    for first in (256, 24):
        monkeypatch.setattr(loo, "FIRST", first)
        assert {(r.k, r.size, r.c) for r in loo.chosen_sets(folded, [3, 6]).collect()} == sets


def test_turned_fits_and_models_of_several_respondents(spark):
    m, _, _ = synth.synthetic_matrix(spark, 6, 40, variants=3, seed=9, missing=0.3)
    m = matrix.ResponseMatrix(m.respondents, m.items, stored(m.responses.selectExpr("r", "c", "case when r % 3 = 0 then 1 - obs else obs end as obs"), "turned"))
    holdouts = stored(holdout.all_holdouts(m), "holdouts")
    items, abilities = holdout.newton_holdouts(m, holdouts)
    want = {(r.k, r.c): r.a for r in items.collect()}
    folded = loo.all_fits(m, holdouts)
    got = {(r.k, r.c): r.a for r in loo.items(folded).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    sets = {(r.k, r.size, r.c) for r in holdout.chosen_sets(items, select.ability_points(abilities, m.respondents, ["k"]), [5], ["k"]).collect()}
    assert {(r.k, r.size, r.c) for r in loo.chosen_sets(folded, [5]).collect()} == sets


@pytest.mark.parametrize("variants", [1, 3])
def test_random_errors_of_all_holdouts_equal_those_of_the_sets(spark, monkeypatch, variants):
    m, _, _ = synth.synthetic_matrix(spark, 9, 60, variants=variants, seed=4, missing=0.8)
    holdouts = stored(holdout.all_holdouts(m), "holdouts")
    sizes = spark.createDataFrame([(k, s, s - k % 2) for k in range(9) for s in (3, 6)], "k long, size long, n_selected long")
    sets = holdout.random_sets(holdout.held_out_counts(m, holdouts).select("k", "c"), sizes, 12, 5)
    want = {(r.k, r["size"], r.draw): r.error for r in holdout.errors(sets, m, holdouts, ["k", "size", "draw"]).collect()}
    monkeypatch.setattr(loo, "CELLS", 17)
    assert {(r.k, r["size"], r.draw): r.error for r in loo.random_errors(m, holdouts, sizes, 12, 5).collect()} == want and want


def test_the_newton_validation_holds_every_model_out(spark, sf):
    """Three named models were held out, whatever the table had."""
    from respanel.plans import catalog

    models = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert max(r.n_holdouts for r in catalog.loo_newton_placement(spark, sf).collect()) == models
    assert "hold3" not in catalog.oracle_sql()["loo_newton_placement"]
