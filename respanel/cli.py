"""Commands: fit, report, select, validate. Answers go to stdout, remarks to stderr."""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="respanel")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)
    fit = sub.add_parser("fit")
    fit.add_argument("responses")
    fit.add_argument("-o", "--out", required=True)
    fit.add_argument("--respondent-key", default="model_id")
    fit.add_argument("--format")
    fit.add_argument("--engine", choices=("variational", "newton"), default="variational")
    fit.add_argument("--priors", default="hierarchical")
    fit.add_argument("--epochs", type=int, default=2000)
    fit.add_argument("--seed", type=int, default=0)
    fit.add_argument("--embed-responses", action=argparse.BooleanOptionalAction, default=True)
    for name in ("--model-id", "--metric", "--lmeval-filter", "--scorer"):
        fit.add_argument(name)
    report = sub.add_parser("report")
    report.add_argument("artifact")
    report.add_argument("--html")
    report.add_argument("--json", action="store_true")
    report.add_argument("--sort", default="discrimination")
    report.add_argument("--limit", type=int, default=40)
    select = sub.add_parser("select")
    select.add_argument("artifact")
    select.add_argument("-n", type=int, required=True)
    select.add_argument("-o", "--out")
    select.add_argument("--adaptive", action="store_true")
    validate = sub.add_parser("validate")
    validate.add_argument("artifact")
    validate.add_argument("--sizes", default="25,50,100,200,400")
    validate.add_argument("--json", action="store_true")
    validate.add_argument("--seed", type=int, default=0)
    validate.add_argument("--epochs", type=int)
    validate.add_argument("--engine", choices=("variational", "newton"))
    validate.add_argument("--draws", type=int, default=200)
    return top


def run_fit(spark, a) -> None:
    import time
    from datetime import UTC, datetime

    from pyspark.sql import functions as F

    from respanel.functions.coerce import parse_key
    from respanel.operators import diagnostics, fit, matrix, store, variational
    from respanel.sources.registry import read_any

    key = tuple(parse_key(a.respondent_key))
    options = {"model_id": a.model_id, "metric": a.metric, "filter": a.lmeval_filter, "scorer": a.scorer}
    m = matrix.build_matrix(read_any(spark, a.responses, a.format, **{k: v for k, v in options.items() if v is not None}), key)
    responses, began = store.stored(m.responses, "responses"), time.time()
    history, hyper, reflected = [], {}, False
    if a.engine == "newton":
        items, abilities = fit.newton_fit(responses)
    else:
        items, abilities, bounds = variational.joint_fit(responses, [], a.priors, a.epochs, a.seed)
        first = bounds.orderBy("id").collect()  # thinned, some thousand rows
        history, reflected = [r["mean"] for r in first], bool(first[0]["reflected"])
        hyper = {} if a.priors == "vague" else {h: first[0][h] for h in variational.HYPER}
    people = m.respondents.join(abilities.select("r", "theta"), "r", "left")
    items = store.stored(m.items.join(items, "c"), "items")
    shape = matrix.shape(m).first()
    facts = {k: shape[k] for k in ("n_responses", "n_respondents", "n_real_models", "n_items", "density")}
    counts = {r["flag"]: r["n"] for r in fit.flag_counts(items).collect()}
    told = diagnostics.fit_diagnostics(
        history, epochs=a.epochs if history else None, seed=a.seed, priors=a.priors, seconds=round(time.time() - began, 3), reflected=reflected, **facts,
        flag_counts=counts, hyperparameters=hyper, interval_method="conditional-information",
    )
    meta = {"respondent_key": list(key), "engine": a.engine, "priors": a.priors, "epochs": a.epochs, "seed": a.seed, "model": diagnostics.model_metadata(a.engine, a.priors), "diagnostics": told, "created": datetime.now(UTC).isoformat(timespec="seconds")}
    store.save_fit(a.out, people, items, responses if a.embed_responses else None, meta)
    print(f"{shape['n_real_models']} models, {shape['n_respondents']} respondents, {shape['n_items']} items, {shape['n_responses']} responses -> {a.out}", file=sys.stderr)


def run_report(spark, a) -> None:
    from respanel import render
    from respanel.operators import report, select, store

    f = store.load_fit(spark, a.artifact)
    responses = f["responses"] if f["responses"] is not None else f["items"].select("c").limit(0)
    head = report.refusal(report.header(f["items"], f["respondents"], responses)).first().asDict()
    rows, key = render.rows_of(report.rows(f["items"], a.sort, a.limit).orderBy("position")), f["meta"]["respondent_key"]
    if a.html:
        people = f["respondents"].select("r", "theta")
        points = select.ability_points(people, f["respondents"])
        curve = store.stored(report.information_curve(f["items"], people), "curve")
        marks = [r.asDict() for r in report.rug(curve, points).orderBy("g").collect()]  # one a point of the curve at most
        drawn = [r.asDict() for r in curve.orderBy("g").collect()]
        models = [r.asDict() for r in report.model_positions(f["items"], people, f["respondents"]).collect()]
        page = render.html_report(a.artifact, head, rows, drawn, models, report.verdict(curve, f["items"], points).first().asDict(), key, marks, report.spread(points).first().asDict())
        with open(a.html, "w", encoding="utf-8") as file:
            file.write(page)
        print(f"wrote {a.html}", file=sys.stderr)
    from respanel.operators import diagnostics

    told = diagnostics.sheet(f["meta"], VERSION)
    print(render.json_report(head, rows, a.sort, a.limit, key) if a.json else render.text_report(head, rows, key) + "\n".join(["", *told, ""]), end="\n" if a.json else "")


def run_select(spark, a) -> None:
    from pyspark.sql import functions as F

    from respanel import render
    from respanel.operators import select, store, studies
    from respanel.schema import SelectError

    if a.adaptive:
        raise SelectError("adaptive selection is not offered")
    f = store.load_fit(spark, a.artifact)
    points = select.ability_points(f["respondents"].select("r", "theta"), f["respondents"])
    chosen = store.stored(select.select_anchor(f["items"], points, a.n).join(f["items"].select("c", "item_id"), "c"), "anchor")
    rows = chosen.orderBy("rank").collect()
    if not rows:
        raise SelectError("no item is eligible; more respondents are needed before a set can be chosen")
    error = select.set_error(chosen, f["items"], points).agg(F.sum(F.col("weight") * F.col("theta_se"))).first()[0]
    padded = sum(r["padded"] for r in rows)
    out = {"item_ids": [r["item_id"] for r in rows], "count": len(rows), "requested": a.n, "objective": "max-information", "n_confident": len(rows) - padded, "padded": padded, "short": a.n - len(rows), **studies.usable_share(f["items"]).select("n_usable_items", "n_items").first().asDict(), "mean_theta_se": error, "gains": [r["gain"] for r in rows], "source": a.artifact}
    people = f["respondents"].agg(F.count_distinct("model_id"), F.count("*")).first()
    print("\n".join(render.set_summary(out, *people, f["meta"]["respondent_key"])), file=sys.stderr)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as file:
            json.dump(out, file, indent=1)
    else:
        print("\n".join(out["item_ids"]))


def run_validate(spark, a) -> None:
    from respanel import render
    from respanel.operators import holdout, store, variational
    from respanel.operators.matrix import ResponseMatrix
    from respanel.schema import ValidateError

    f = store.load_fit(spark, a.artifact)
    if f["responses"] is None:
        raise ValidateError("the fit carries no responses; fit with --embed-responses")
    m = ResponseMatrix(f["respondents"].select("r", "respondent_id", "model_id"), f["items"].select("c", "item_id", "subject", "split"), f["responses"])
    meta = f["meta"]
    engine, priors, epochs = a.engine or meta.get("engine", "variational"), meta.get("priors", "hierarchical"), a.epochs or meta.get("epochs", variational.EPOCHS)

    def refit(m: ResponseMatrix, holdouts):
        """As the fit at hand was made."""
        return holdout.newton_holdouts(m, holdouts) if engine == "newton" else holdout.joint_holdouts(m, holdouts, priors, epochs, a.seed)

    sizes, models = holdout.validation(m, refit, holdout.parse_sizes(a.sizes), a.draws, a.seed)
    rows = [r.asDict() for r in sizes.orderBy("size").collect()]
    for own in rows:
        own["models"] = []
    at = {own["size"]: own["models"] for own in rows}
    for r in models.orderBy("size", "holdout").collect():
        at[r["size"]].append({k: v for k, v in r.asDict().items() if k not in ("size", "k")})
    n = m.respondents.select("model_id").distinct().count()
    print(json.dumps({"n_models": n, "random_draws": a.draws, "engine": engine, "sizes": rows}, indent=1) if a.json else render.validation_table(rows, n), end="\n" if a.json else "")


def main(args: list[str] | None = None, spark=None) -> int:
    """Exit codes: 0; 1 if a fit fails; 2 if another command does."""
    from respanel.schema import FitError

    a = parser().parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("respanel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        {"fit": run_fit, "report": run_report, "select": run_select, "validate": run_validate}[a.command](spark, a)
    except (ValueError, FitError) as error:
        print(f"respanel {a.command}: {error}", file=sys.stderr)
        return 1 if a.command == "fit" else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
