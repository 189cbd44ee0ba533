"""Mean-field variational fit of the hierarchical two-parameter model, one fit a group.

Model: a ~ N(0, s_a), b ~ N(m, s_b), theta ~ N(0, 1); s_a, s_b log-normal
(0, 0.5), m ~ N(0, 1); or the vague a ~ N(1, 2), b ~ N(0, 3). Slopes start at 1,
which decides between the two mirror images. Every quantity
has a normal factor (the scales on the log scale); gradients come from
reparameterised samples, steps from Adam with a decaying rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from respanel.operators.diagnostics import thinned
from respanel.schema import FitError, ModelError

PRIORS = ("hierarchical", "vague")
RATE, DECAY, EPOCHS, START_SCALE = 0.05, 0.1, 2000, 0.1


def slopes_by_answer(rows: np.ndarray, cols: np.ndarray, obs: np.ndarray, n_r: int, n_c: int):
    """Log likelihood of the answers and its gradient in a, b and theta, answer by answer."""

    def slopes(a: np.ndarray, b: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        gap = theta[rows] - b[cols]
        z = a[cols] * gap
        tail = np.exp(-np.abs(z))
        miss = obs - np.where(z > 0, 1.0, tail) / (1 + tail)
        back = miss * a[cols]
        value = float((obs * z - np.maximum(z, 0) - np.log1p(tail)).sum())
        return value, np.bincount(cols, miss * gap, n_c), -np.bincount(cols, back, n_c), np.bincount(rows, back, n_r)

    return slopes


def slopes_by_cell(rows: np.ndarray, cols: np.ndarray, obs: np.ndarray, n_r: int, n_c: int):
    """The same sums in the same precision over a matrix of counts: less work where most cells are filled."""
    given, right = np.zeros((n_r, n_c)), np.zeros((n_r, n_c))
    np.add.at(given, (rows, cols), 1)
    np.add.at(right, (rows, cols), obs)

    def slopes(a: np.ndarray, b: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        z = a * (theta[:, None] - b)
        tail = np.exp(-np.abs(z))
        miss = right - given * (np.where(z > 0, 1.0, tail) / (1 + tail))
        by_item = miss.sum(axis=0)
        value = float((right * z).sum() - (given * (np.maximum(z, 0) + np.log1p(tail))).sum())
        return value, np.einsum("rc,r->c", miss, theta) - b * by_item, -a * by_item, np.einsum("rc,c->r", miss, a)

    return slopes


def fit_arrays(rows: np.ndarray, cols: np.ndarray, obs: np.ndarray, n_r: int, n_c: int, priors: str = "hierarchical", epochs: int = EPOCHS, seed: int = 0) -> dict:
    """Posterior means and deviations of a, b, theta from answers in triplets; starts at the classical estimates."""
    if priors not in PRIORS:
        raise ModelError(f"unknown priors {priors!r}, there are {' and '.join(PRIORS)}")
    if epochs < 1:
        raise FitError("epochs must be positive")
    draw = np.random.default_rng(seed)

    def logit(x):
        x = np.clip(x, 0.02, 0.98)
        return np.log(x / (1 - x))

    def rate(index, n):
        count = np.bincount(index, minlength=n)
        return np.where(count > 0, np.bincount(index, obs, n) / np.maximum(count, 1), 0.5)

    theta0 = logit(rate(rows, n_r))
    theta0 = (theta0 - theta0.mean()) / max(theta0.std(), 1e-6)
    b0 = np.clip(-logit(rate(cols, n_c)), -6, 6)
    slopes = (slopes_by_cell if 2 * len(rows) >= n_r * n_c else slopes_by_answer)(rows, cols, obs, n_r, n_c)
    sizes = {"a": n_c, "b": n_c, "theta": n_r, "m": 1, "ls_a": 1, "ls_b": 1}
    start = {"a": np.ones(n_c), "b": b0, "theta": theta0, "m": np.zeros(1), "ls_a": np.zeros(1), "ls_b": np.zeros(1)}
    loc = np.concatenate([start[k] for k in sizes])
    log_scale = np.full(len(loc), np.log(START_SCALE))
    at, cuts = 0, {}
    for k, n in sizes.items():
        cuts[k] = slice(at, at + n)
        at += n
    state = [np.zeros_like(loc) for _ in range(4)]
    history = []
    for epoch in range(epochs):
        noise = draw.standard_normal(len(loc))
        scale = np.exp(log_scale)
        x = loc + scale * noise
        a, b, theta = x[cuts["a"]], x[cuts["b"]], x[cuts["theta"]]
        grad = np.zeros_like(x)
        likelihood, grad[cuts["a"]], grad[cuts["b"]], grad[cuts["theta"]] = slopes(a, b, theta)
        grad[cuts["theta"]] -= theta
        value = likelihood - 0.5 * float((theta**2).sum())
        if priors == "vague":
            grad[cuts["a"]] -= (a - 1) / 4
            grad[cuts["b"]] -= b / 9
            value -= float(((a - 1) ** 2).sum() / 8 + (b**2).sum() / 18)
        else:
            m, la, lb = (float(x[cuts[k]][0]) for k in ("m", "ls_a", "ls_b"))
            wa, wb = np.exp(-2 * la), np.exp(-2 * lb)
            grad[cuts["a"]] -= a * wa
            grad[cuts["b"]] -= (b - m) * wb
            grad[cuts["m"]] = ((b - m) * wb).sum() - m
            grad[cuts["ls_a"]] = -n_c + (a**2).sum() * wa - la / 0.25
            grad[cuts["ls_b"]] = -n_c + ((b - m) ** 2).sum() * wb - lb / 0.25
            value -= float(n_c * (la + lb) + 0.5 * wa * (a**2).sum() + 0.5 * wb * ((b - m) ** 2).sum() + 0.5 * m * m + 2 * la * la + 2 * lb * lb)
        value += float(log_scale.sum())
        if not np.isfinite(value):
            raise FitError(f"the bound is not finite after {epoch} steps")
        history.append(value)
        steps = RATE * DECAY ** (epoch / epochs)
        grads = (np.clip(grad, -1e3, 1e3), np.clip(grad * noise * scale + 1, -1e3, 1e3))
        for k, (target, g) in enumerate(((loc, grads[0]), (log_scale, grads[1]))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
            target += steps * (state[2 * k] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(state[2 * k + 1] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        if priors == "vague":
            loc[cuts["m"].start :] = 0.0
    sign = -1.0 if loc[cuts["a"]].sum() < 0 else 1.0
    hyper = {} if priors == "vague" else {"sigma_a": float(np.exp(loc[cuts["ls_a"]][0])), "mu_b": sign * float(loc[cuts["m"]][0]), "sigma_b": float(np.exp(loc[cuts["ls_b"]][0]))}
    out = {k: sign * loc[cuts[k]] for k in ("a", "b", "theta")}
    return out | {f"{k}_sd": np.exp(log_scale[cuts[k]]) for k in ("a", "b", "theta")} | {"elbo": history, "hyperparameters": hyper, "reflected": sign < 0}


HYPER = ("sigma_a", "mu_b", "sigma_b")
RESULT = "fit_id long, kind string, id long, mean double, sd double, elbo double, " + ", ".join(f"{h} double" for h in HYPER) + ", reflected boolean"


def vi_fit(responses: DataFrame, priors: str = "hierarchical", epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """(fit_id, kind item-a / item-b / respondent / elbo, id, mean, sd, elbo, learned scales, reflected) of every fit in ``responses`` (fit_id, r, c, obs).

    Rows of kind elbo hold the bound after the step ``id``, thinned. The
    scales are null under vague priors, where none are learned.

    A fit is one group and one task: full-batch gradient steps over its
    answers, 12 bytes an answer. Fits of a holdout run side by side.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r_ids, rows = np.unique(pdf["r"].to_numpy(), return_inverse=True)
        c_ids, cols = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        got = fit_arrays(rows, cols, pdf["obs"].to_numpy(float), len(r_ids), len(c_ids), priors, epochs, seed)
        parts = [("item-a", c_ids, "a"), ("item-b", c_ids, "b"), ("respondent", r_ids, "theta")]
        frames = [pd.DataFrame({"kind": kind, "id": ids, "mean": got[k], "sd": got[f"{k}_sd"]}) for kind, ids, k in parts]
        kept, stride = thinned(got["elbo"])
        steps = [min(k * stride, len(got["elbo"]) - 1) for k in range(len(kept))]
        frames.append(pd.DataFrame({"kind": "elbo", "id": steps, "mean": kept, "sd": np.nan}))
        out = pd.concat(frames)
        out.insert(0, "fit_id", int(pdf["fit_id"].iloc[0]))
        out["elbo"] = got["elbo"][-1]
        for name in HYPER:
            out[name] = got["hyperparameters"].get(name, np.nan)
        out["reflected"] = bool(got["reflected"])
        return out

    return responses.groupBy("fit_id").applyInPandas(one, RESULT)


def joint_fit(responses: DataFrame, by: list[str] = (), priors: str = "hierarchical", epochs: int = EPOCHS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items with intervals and flags, abilities, bound and learned scales by step) of every fit in ``responses`` (by, r, c, obs).

    ``by`` is empty or one column of whole numbers. Means are those of the
    fit; intervals of items come from the information at its abilities, with
    its learned scales as priors.
    """
    from pyspark.sql import functions as F

    from respanel.operators import diagnostics, fit
    from respanel.operators.store import stored

    key = F.col(by[0]).cast("long") if by else F.lit(0).cast("long")
    got = stored(vi_fit(responses.withColumn("fit_id", key), priors, epochs, seed), "joint-fit")
    named = [F.col("fit_id").alias(c) for c in by]
    mean = lambda kind, ident, name: got.filter(F.col("kind") == kind).select(*named, F.col("id").alias(ident), F.col("mean").alias(name))
    keys = [*by, "c"]
    items = fit.classical_items(responses, by).select(*keys, "n_resp", "p_correct").join(mean("item-a", "c", "a"), keys).join(mean("item-b", "c", "b"), keys)
    abilities = mean("respondent", "r", "theta")
    bounds = got.filter("kind = 'elbo'").select(*named, "id", "mean", *HYPER, "reflected")
    if priors == "vague":
        of_a, of_b = diagnostics.prior_precisions(priors, {})
        items = items.withColumns({"of_a": F.lit(of_a), "of_b": F.lit(of_b)})
    else:
        scales = bounds.filter("id = 0").select(*by, (1 / F.pow("sigma_a", F.lit(2))).alias("of_a"), (1 / F.pow("sigma_b", F.lit(2))).alias("of_b"))
        items = items.join(F.broadcast(scales), by) if by else items.crossJoin(F.broadcast(scales))
    rows = fit.with_theta(responses, abilities, by)
    items = fit.item_intervals(items, rows, by, F.col("of_a"), F.col("of_b")).drop("of_a", "of_b")
    return stored(fit.item_flags(items, abilities, by), "joint-items"), abilities, bounds
