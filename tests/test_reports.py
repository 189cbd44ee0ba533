"""Texts and drawings of reports; the marks of respondents against plain Python."""

import random

from respanel import render
from respanel.operators import report

HEAD = {"level": "none", "n_real_models": 3, "n_respondents": 6, "n_items": 9, "n_usable": 7, "n_responses": 54, "density": 1.0, "n_insufficient_data": 2, "insufficient_share": 0.2, "n_off_range": 4}
CURVE = [{"g": k, "theta": -3 + 6 * k / 240, "pool_info": max(0.0, 2 - abs(-3 + 6 * k / 240 - 1)), "all_info": 2.5} for k in range(241)]
SPREAD = {"theta_lo": -1.0, "theta_hi": 0.5, "theta_mean": -0.25}
VERDICT = {"verdict": "partial", "coverage": 0.6, "info_at_models": 1.2, "peak_info": 2.0}
CHOSEN = {"count": 5, "n_items": 9, "n_confident": 3, "n_usable_items": 7, "padded": 2, "short": 1, "requested": 6, "mean_theta_se": 0.41234, "gains": [0.5, 0.25]}


def test_summary_of_a_set():
    lines = render.set_summary(CHOSEN, 3, 6, ["model_id", "temperature"])
    assert lines[0].startswith("3 models as 6 respondents by model_id,temperature: 5 of 9 items chosen, 3 confident")
    assert "last 2 " in lines[1] and lines[2].startswith("short by 1: 6 ") and "0.412" in lines[3] and "0.5000" in lines[4] and "0.2500" in lines[4]
    plain = render.set_summary(CHOSEN | {"padded": 0, "short": 0, "gains": []}, 1, 1, ["model_id"])
    assert plain[0].startswith("1 model: ") and len(plain) == 2


def test_sentences_follow_the_verdict():
    peak = max(CURVE, key=lambda p: p["pool_info"])
    said = " ".join(render.verdict_sentences(VERDICT, HEAD, peak, SPREAD))
    for part in ("+1.00", "2.00", "-1.00", "+0.50", "-0.25", "60 %", "outside their span", "4 of 9 items are off-range", "7 usable of 9"):
        assert part in said, part
    inside = " ".join(render.verdict_sentences(VERDICT, HEAD | {"n_off_range": 0, "n_usable": 9}, peak, SPREAD | {"theta_hi": 2.0}))
    assert "within their span" in inside and "off-range" not in inside and "dashed" not in inside
    aligned = render.verdict_sentences(VERDICT | {"verdict": "aligned"}, HEAD, peak, SPREAD)
    assert len(aligned) == 3 and render.VERDICTS["aligned"] in aligned
    assert render.verdict_sentences(VERDICT | {"verdict": "unreadable"}, HEAD, None, None)[0] == render.VERDICTS["unreadable"]
    assert len(render.verdict_sentences(VERDICT, HEAD, peak, {"theta_lo": None, "theta_hi": None, "theta_mean": None})) > 2


def test_drawing_and_page():
    rug = [{"g": 1, "theta": -1.0, "weight": 0.75, "n": 3}, {"g": 2, "theta": 0.5, "weight": 0.25, "n": 3}]
    models = [{"model_id": "z<b>", "theta": -1.0, "se": 0.5}, {"model_id": "a", "theta": 9.0, "se": 0.5}]
    drawn = render.svg_curve(CURVE, models, rug, SPREAD)
    assert drawn.count('class="rug"') == 2 and 'data-weight="0.750000"' in drawn and drawn.count('class="model"') == 2 and drawn.count('class="band"') == 1
    assert drawn.count('class="grid"') == len(render.ticks(-3, 3)) + len(render.ticks(0, 2.5 * 1.08)) and "2.00 at +1.00" in drawn and 'class="peak"' in drawn
    flat = render.svg_curve([p | {"pool_info": 0.0} for p in CURVE], [])
    assert "peak" not in flat and "band" not in flat and "rug" not in flat
    item = {"item_id": "i<1>", "n_resp": 6, "p_correct": 0.5, "a": 1.2, "a_lo": 0.5, "a_hi": 2.0, "b": 0.1, "flags": ["dead"], "rank": 4}
    page = render.html_report("t", HEAD, [item, item | {"rank": None}], CURVE, models, VERDICT, ["model_id"], rug, SPREAD)
    assert "i&lt;1&gt;" in page and "<b>" not in page and page.index(">a</td>") < page.index("z&lt;b&gt;</td>") and "+0.50 to +2.00" in page
    assert all(text in page for _, text in render.LEGEND) and "2 of 9 items shown" in page and '<td data-v="4">4</td>' in page and "http" not in page


def test_marks_of_respondents(spark):
    draw = random.Random(2)
    people = [(draw.uniform(-4, 4), 1 / 200) for _ in range(200)] + [(0.0125, 0.5), (None, 1.0)]
    points = spark.createDataFrame(people, "theta double, weight double")
    curve = spark.createDataFrame([(p["g"], p["theta"]) for p in CURVE], "g long, theta double")
    want = {}
    for t, w in people:
        if t is not None:
            g = min(max(int((t + 3) / 6 * 240 + 0.5), 0), 240) if t > -3 else 0
            n, total = want.get(g, (0, 0.0))
            want[g] = (n + 1, total + w)
    got = {r.g: r for r in report.rug(curve, points).collect()}
    assert {g: r.n for g, r in got.items()} == {g: n for g, (n, _) in want.items()}
    assert all(abs(r.weight - want[g][1]) < 1e-9 and abs(r.theta - (-3 + 6 * g / 240)) < 1e-9 for g, r in got.items())
    one = report.spread(points).first()
    known = [(t, w) for t, w in people if t is not None]
    assert (one.theta_lo, one.theta_hi) == (min(t for t, _ in known), max(t for t, _ in known))
    assert abs(one.theta_mean - sum(t * w for t, w in known) / sum(w for _, w in known)) < 1e-9
    empty = points.limit(0)
    assert report.rug(curve, empty).count() == 0 and report.spread(empty).first().theta_lo is None
