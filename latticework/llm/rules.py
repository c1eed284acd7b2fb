"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. ``statistics``: fourteen statistics of a text as Spark columns.
2. ``grow_rules``: small trees are boosted on the logistic loss; every path from
   a root to a node is a conjunction of bounds, a rule.
3. ``fit_lasso``: lasso logistic regression over the rules' indicator columns
   sets most weights to zero; the penalty is the largest one within two percent
   of the best loss on rows set aside.
4. ``compile_score``: the surviving rules become one Spark column expression, so
   scoring all documents is a single narrow scan inside the JVM.

Fitting runs on the driver over statistics (not texts) of at most ``max_rows``
labelled documents, chosen by hash order of their ids. Nothing else is sampled.

Null and empty texts have statistics of zero and a score. Without any usable
label all scores are 0.5; with labels of one class they follow that class.
Repeated rows score alike; ids, labels, lang and source are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.labelled import training_labels

STATISTICS = (
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "shout_rate", "stop_rate", "comma_rate",
    "distinct_words", "words_a_line", "distinct_lines", "short_words", "long_words", "symbol_words",
)
_SPACE = "[\\x20\\x09-\\x0D]+"


def _count(of: str, what: str) -> Column:
    return F.length(of) - F.length(F.replace(F.col(of), F.lit(what), F.lit("")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and one double per name of STATISTICS."""
    one = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    two = one.select(
        *keep,
        F.length("_t").alias("_n"),
        F.filter(F.split("_t", _SPACE), lambda w: w != "").alias("_w"),
        F.split("_t", "\n").alias("_l"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).alias("_symbols"),
        F.regexp_count("_t", F.lit("\\p{Lu}")).alias("_upper"),
        F.regexp_count("_t", F.lit("[0-9]")).alias("_digits"),
        _count("_t", "!").alias("_shouts"),
        _count("_t", ".").alias("_stops"),
        _count("_t", ",").alias("_commas"),
    )
    three = two.select(
        *keep,
        *[c for c in two.columns if c not in keep and c not in ("_w", "_l")],
        F.size("_w").alias("_words"),
        F.length(F.array_join("_w", "")).alias("_letters"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        F.size("_l").alias("_lines"),
        F.size(F.array_distinct("_l")).alias("_distinct_lines"),
        F.size(F.filter("_w", lambda w: F.length(w) <= 2)).alias("_short"),
        F.size(F.filter("_w", lambda w: F.length(w) > 14)).alias("_long"),
        F.size(F.filter("_w", lambda w: w.rlike("[#*$%&|<>]"))).alias("_symbol_words"),
    )
    c = F.col
    values = {
        "log_words": F.log1p(c("_words").cast("double")),
        "word_length": _ratio(c("_letters"), c("_words")),
        "symbol_share": _ratio(c("_symbols"), c("_n")),
        "upper_share": _ratio(c("_upper"), c("_n")),
        "digit_share": _ratio(c("_digits"), c("_n")),
        "shout_rate": _ratio(c("_shouts"), c("_words")),
        "stop_rate": _ratio(c("_stops"), c("_words")),
        "comma_rate": _ratio(c("_commas"), c("_words")),
        "distinct_words": _ratio(c("_distinct"), c("_words")),
        "words_a_line": _ratio(c("_words"), c("_lines")),
        "distinct_lines": _ratio(c("_distinct_lines"), c("_lines")),
        "short_words": _ratio(c("_short"), c("_words")),
        "long_words": _ratio(c("_long"), c("_words")),
        "symbol_words": _ratio(c("_symbol_words"), c("_words")),
    }
    return three.select(*keep, *[values[name].alias(name) for name in STATISTICS])


Rule = tuple[tuple[int, float, float], ...]
"""(statistic, above, at most) bounds that all hold."""


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        said = []
        for weight, rule in sorted(zip(self.weights, self.rules, strict=True), key=lambda x: -abs(x[0])):
            bounds = [f"{low:.4g} < {STATISTICS[i]} <= {high:.4g}" for i, low, high in rule]
            said.append(f"{weight:+.3f} if " + " and ".join(bounds))
        return said


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, i] > low) & (x[:, i] <= high) for i, low, high in rule])


def _best_split(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[int, float] | None:
    best, found = 1e-6, None
    total_g, total_h = gradient.sum(), hessian.sum()
    for i, at in enumerate(cuts):
        if not len(at):
            continue
        place = np.searchsorted(at, x[:, i], side="left")  # x <= at[j] for place <= j
        g = np.bincount(place, gradient, len(at) + 1).cumsum()[:-1]
        h = np.bincount(place, hessian, len(at) + 1).cumsum()[:-1]
        n = np.bincount(place, minlength=len(at) + 1).cumsum()[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(n < least) | (len(x) - n < least)] = 0
        j = int(gain.argmax())
        if gain[j] > best:
            best, found = float(gain[j]), (i, float(at[j]))
    return found


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, rate: float = 0.3, cuts: int = 24, seed: int = 7) -> list[Rule]:
    """Distinct rules of the nodes of boosted trees, each grown on a random two thirds of the rows."""
    rng = np.random.default_rng(seed)
    at = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, cuts + 2)[1:-1])) for i in range(x.shape[1])]
    margin, rules = np.zeros(len(x)), {}
    least = max(5, len(x) // 200)

    def grow(rows: np.ndarray, bounds: dict[int, tuple[float, float]], gradient: np.ndarray, hessian: np.ndarray, left: int) -> None:
        split = _best_split(x[rows], gradient[rows], hessian[rows], at, least) if left else None
        if split is None:
            inside = holds(tuple((i, *b) for i, b in bounds.items()), x) if bounds else np.ones(len(x), bool)
            margin[inside] -= rate * gradient[rows].sum() / (hessian[rows].sum() + 1)
            return
        i, cut = split
        low, high = bounds.get(i, (-np.inf, np.inf))
        below = x[rows, i] <= cut
        for part, bound in ((rows[below], (low, cut)), (rows[~below], (cut, high))):
            inner = bounds | {i: bound}
            rules.setdefault(tuple(sorted((j, *b) for j, b in inner.items())), None)
            grow(part, inner, gradient, hessian, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(x)) < 2 / 3)
        if len(rows) >= 2 * least:
            grow(rows, {}, p - y, p * (1 - p), depth)
    return list(rules)


def fit_lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of lasso logistic regression on 0/1 columns, by accelerated proximal gradient."""
    n, p = r.shape
    scale = r.std(0)
    scale[scale == 0] = np.inf
    z = (r - r.mean(0)) / scale
    step = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(p), 0.0
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        residual = 1 / (1 + np.exp(-(z @ ahead + ahead_b))) - y
        moved = ahead - step * (z.T @ residual) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = ahead_b - step * residual.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    raw = w / scale
    return float(b - (raw * r.mean(0)).sum()), raw


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margin) - y * margin))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A rule model of labelled statistics."""
    if not len(y):
        return RuleModel(0.0)
    base = (y.sum() + 0.5) / (len(y) + 1)
    rules = grow_rules(x, y) if 0 < y.sum() < len(y) else []
    if not rules:
        return RuleModel(float(np.log(base / (1 - base))))
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(float)
    aside = np.arange(len(y)) % 5 == 0
    tried = []
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        b, w = fit_lasso(r[~aside], y[~aside], penalty)
        tried.append((_loss(r[aside] @ w + b, y[aside]), penalty))
    best = min(tried)[0]
    penalty = max(p for loss, p in tried if loss <= best * 1.02 + 1e-4)
    b, w = fit_lasso(r, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(b, tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept))


def compile_score(model: RuleModel) -> Column:
    """The model as a Spark expression over the columns of STATISTICS."""
    margin = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        bounds = []
        for i, low, high in rule:
            value = F.col(STATISTICS[i])
            bounds += [value > low] * bool(np.isfinite(low)) + [value <= high] * bool(np.isfinite(high))
        margin = margin + F.when(reduce(Column.__and__, bounds), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on the statistics of at most ``max_rows`` labelled documents that are not held out."""
    chosen = F.broadcast(training_labels(labels, label_col, max_rows, id_col=id_col))
    sample = docs.select(id_col, text_col).join(chosen, id_col)
    rows = statistics(sample, text_col, (id_col, "y")).groupBy(id_col, "y").agg(F.min(F.struct(*STATISTICS)).alias("s")).select(id_col, "y", "s.*")
    frame = rows.toPandas().sort_values(id_col)
    order = np.random.default_rng(0).permutation(len(frame))
    return fit(frame[list(STATISTICS)].to_numpy(float)[order], frame["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score double."""
    # a filter on the score must not move below the statistics, where every rule would measure the text anew
    measured = statistics(docs, text_col, keep).withColumn("_row_number", F.monotonically_increasing_id())
    return measured.withColumn("score", F.when(F.col("_row_number") >= 0, compile_score(model))).select(*keep, "score")
