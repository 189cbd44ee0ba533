"""Quality classifier: a sparse ensemble of tree paths (RuleFit, Friedman and Popescu 2008).

Boosted trees over text statistics are cut into their paths, each path is a
conjunctive rule, and a lasso-penalised logistic regression weighs the rules.
The kept rules become Spark column expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respanel.llm.quality import share, with_statistics

#: Labelled rows that a fit takes at most, those of least hash of the id: the
#: documented bound of the training sample.
MAX_ROWS = 20_000
TREES, DEPTH, CUTS, RATE, LEAST_LEAF = 24, 3, 24, 0.3, 10
ROUNDS, PENALTY = 400, 0.003

Rule = tuple[tuple[str, bool, float], ...]  # (feature, True: at most / False: above, threshold), all must hold


def features() -> dict[str, Column]:
    """Features of a text on the columns ``__<statistic>``: shares, so that length alone moves few of them."""
    return {
        "log_words": F.log1p(F.col("__n_words").cast("double")),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_upper", "n_letters"),
        "exclamations": share("n_bangs", "n_words"),
        "wordlike": share("n_wordlike", "n_words"),
        "distinct": share("n_unique", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
        "letters": share("n_letters", "word_chars"),
    }


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and one double column for each feature."""
    stats = with_statistics(docs, text_col, keep)
    return stats.select(*keep, *[c.alias(f"__f_{name}") for name, c in features().items()])


def _grow(x: np.ndarray, order: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int) -> list[tuple[list, float]]:
    """Leaves of one regression tree as (conditions, step)."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for f, cuts in enumerate(order):
            if not len(cuts):
                continue
            bins = np.searchsorted(cuts, x[rows, f], "left")
            gs = np.cumsum(np.bincount(bins, gradient[rows], len(cuts) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins, hessian[rows], len(cuts) + 1))[:-1]
            ns = np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, float(cuts[k]))
    if best[1] is None:
        return [([], -g / (h + 1))]
    _, f, cut = best
    low = x[rows, f] <= cut
    left = _grow(x, order, gradient, hessian, rows[low], depth - 1)
    right = _grow(x, order, gradient, hessian, rows[~low], depth - 1)
    return [([(f, True, cut), *c], v) for c, v in left] + [([(f, False, cut), *c], v) for c, v in right]


def _holds(x: np.ndarray, conditions: list) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in conditions:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


def _simple(conditions: list) -> tuple:
    """One bound on each side of a feature."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, low, cut in conditions:
        old = bounds.get((f, low))
        bounds[f, low] = cut if old is None else min(old, cut) if low else max(old, cut)
    return tuple(sorted((f, low, cut) for (f, low), cut in bounds.items()))


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[tuple]:
    """Every path of boosted logistic trees, prefixes included, each once."""
    draw, n = np.random.default_rng(seed), len(x)
    order = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    score, found = np.full(n, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(draw.permutation(n)[: max(2 * LEAST_LEAF, n // 2)])
        for conditions, step in _grow(x, order, p - y, p * (1 - p), rows, DEPTH):
            score += RATE * step * _holds(x, conditions)
            for k in range(1, len(conditions) + 1):
                found[_simple(conditions[:k])] = None
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """(intercept, weights) of L1-penalised logistic regression by accelerated proximal gradient steps."""
    n, m = z.shape
    z = z.astype(np.float32)
    scale = 4.0 / max(1.0, float((z**2).sum(axis=1).mean()) + 1)
    weights, intercept = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    look, look0, t = weights.copy(), intercept, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(look0 + np.einsum("ij,j->i", z, look))))
        gradient = np.einsum("ij,i->j", z, p - y) / n
        new = look - scale * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - scale * penalty, 0)
        new0 = look0 - scale * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look0 = new + (t - 1) / t_new * (new - weights), new0 + (t - 1) / t_new * (new0 - intercept)
        weights, intercept, t = new, new0, t_new
    return intercept, weights


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, [(rule, weight)]) with the rules the penalty keeps."""
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0, []
    rules = [r for r in tree_rules(x, y) if 0 < _holds(x, r).mean() < 1]
    z = np.stack([_holds(x, r) for r in rules], axis=1) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso(z, y)
    kept = [(tuple((names[f], low, cut) for f, low, cut in r), float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]
    return intercept, kept


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The model's probability of label 1 as a column over the features."""
    total = F.lit(float(intercept))
    for rule, weight in rules:
        holds = F.lit(True)
        for name, low, cut in rule:
            col = F.col(f"__f_{name}")
            holds = holds & ((col <= cut) if low else (col > cut))
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(id_col: str) -> Column:
    """Ids whose checksum leaves 1 modulo 3; they are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[float, list[tuple[Rule, float]]]:
    """Fit on at most ``max_rows`` labelled documents that aren't held out.

    A document with several labels counts by their mean, 0.5 and up as 1.
    Null labels and ids are left out; without labels of both kinds, as with
    empty tables, the model is a constant. A document with several rows is
    learnt from once for each. Other columns are ignored.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = known.filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
    rows = measured(own, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toPandas()
    names = list(features())
    return fit(rows[[f"__f_{n}" for n in names]].to_numpy(float), rows["y"].to_numpy(float), names)


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text.

    A null or empty text has all-zero statistics and is scored like any
    other, a very long one whole. A null id is never held out. Repeated rows
    come back repeated. Columns other than doc_id and text are ignored,
    whatever their names. An empty table gives an empty result.
    """
    rows = measured(docs.select(F.col("doc_id"), F.col("text")), ["doc_id"])
    out = rows.select("doc_id", held_out("doc_id").alias("held_out"), compiled(*model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
