"""What a stored fit says about itself: convergence, population scales, how it was identified."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

#: Points of a bound's history that are kept.
MOST_POINTS = 2000
# Keys under which a score threshold may be recorded, in the order they are looked up.
THRESHOLD_KEYS = ("score_threshold", "binarize_threshold", "threshold")
#: Facts that only programs read.
UNSHOWN = ("source",)
#: How a fact of each type is written; the first type that fits decides. What has none is counted.
WRITTEN = ((bool, "{}"), (float, "{:.6g}"), (int, "{}"), (str, "{}"))


def thinned(history: list[float], most: int = MOST_POINTS) -> tuple[list[float], int]:
    """(every stride-th point, stride) of at most about ``most`` points; the last one is always there."""
    stride = max(1, -(-len(history) // most))
    kept = list(history[::stride])
    if history and (len(history) - 1) % stride:
        kept.append(history[-1])
    return kept, stride


def late_improvement(history: list[float]) -> float:
    """How much the last tenth of the steps still gained."""
    return history[-1] - history[-max(1, len(history) // 10)]


def fit_diagnostics(history: list[float], **facts) -> dict:
    """Keys of the bound's history, where there is one, beside the facts of a fit."""
    out = dict(facts)
    if history:
        kept, stride = thinned(history)
        out |= {"elbo_final": history[-1], "elbo_history": kept, "elbo_history_stride": stride, "elbo_improvement_last_10pct": late_improvement(history)}
    return out


def model_metadata(engine: str, priors: str) -> dict[str, str]:
    """Conventions that another estimator has to share before numbers can be compared."""
    if engine == "newton":
        population = "slope ~ N(0, 1) and intercept ~ N(start, 1) for every item, abilities fixed at the standardised logit accuracy"
        inference = "ridge logistic regression of each item by Newton steps; intervals from its information matrix"
    else:
        population = "slope ~ N(0, s_a), difficulty ~ N(m, s_b), both scales and m learned" if priors == "hierarchical" else "slope ~ N(1, 2), difficulty ~ N(0, 3)"
        inference = "means by a factorised normal approximation; widths of items by the information matrix at the fitted abilities"
    return {
        "kind": "2pl",
        "priors": priors if engine != "newton" else "ridge",
        "population": population,
        "identification": "abilities ~ N(0, 1) set place and scale; slopes may be negative; of the two mirror images the one whose slopes sum to 0 or more",
        "inference": inference,
    }


def prior_precisions(priors: str, hyperparameters: Mapping[str, float]) -> tuple[float, float]:
    """(of a, of b) that intervals fall back on: learned scales, or those of the vague priors."""
    if priors == "vague":
        return 1 / 4, 1 / 9
    return 1 / hyperparameters["sigma_a"] ** 2, 1 / hyperparameters["sigma_b"] ** 2


def facts(diagnostics: Mapping, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(name, text) of everything a reader may want to see: maps are opened under dotted names, of collections only the size is told."""
    for name, value in diagnostics.items():
        if value is None or name in UNSHOWN:
            continue
        if isinstance(value, Mapping):
            yield from facts(value, f"{prefix}{name}.")
        else:
            pattern = next((text for kind, text in WRITTEN if isinstance(value, kind)), None)
            yield prefix + name, pattern.format(value) if pattern else f"{len(value)} values"


def cut_of_scores(*places: Mapping) -> float | None:
    """Where continuous scores were cut: the first number under a known key, place by place."""
    found = (place[key] for place in places for key in THRESHOLD_KEYS if type(place.get(key)) in (int, float))
    return next((float(x) for x in found), None)


def sheet(meta: Mapping, version: str) -> list[str]:
    """Lines on how a fit was made: the model, a table of its facts, remarks, and what wrote it."""
    model, told = meta.get("model", {}), meta.get("diagnostics", {})
    rows = [("model", model.get("kind", "unknown")), ("priors", model.get("priors", "unknown")), ("identified by", model.get("identification", "unknown"))]
    rows += facts(told)
    if (cut := cut_of_scores(told, model)) is not None:
        rows.append(("scores cut at", f"{cut:.6g}"))
    width = max(len(name) for name, _ in rows)
    out = [f"{name:<{width}}  {text}" for name, text in rows]
    if model.get("synthetic"):
        out.append("This fit was made up around a known truth; nothing was estimated.")
    return [*out, f"made by respanel {version} at {meta.get('created', 'an unknown time')}"]
