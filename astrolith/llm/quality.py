"""Quality classifier: a sparse ensemble of rules over text statistics, as Spark columns.

Boosted trees are fitted on a bounded sample of labelled rows. Each path from a root to a node is a conjunctive rule; a logistic
model with a lasso penalty weighs the rules, most of them with nothing. The rules left become one column expression, so that scoring is a
projection without Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the rules are fitted on.
FIT_ROWS = 4000
TREES, DEPTH, CUTS, MIN_LEAF = 24, 3, 24, 8
PENALTY = 0.01
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: F.Column) -> dict[str, F.Column]:
    """Statistics of a text; those of a null text are those of an empty one. Shares are of all signs, or of all words or lines."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / F.greatest(n, F.lit(1))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_length": n / F.greatest(F.size(words), F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_length": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
        "upper": share(r"\p{Lu}"),
        "letters": share(r"\p{L}"),
        "digits": share(r"\p{N}"),
        "stops": share(r"[.!?]"),
        "commas": share(r"[,;:]"),
        "signs": share(r"[^\s\p{L}\p{N}.!?,;:'\"()-]"),
        "doubled": share(r"([^\s\p{L}\p{N}])\1"),
        "bars": share(r"[|\t]"),
    }


def _best_split(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]):
    best = (1e-9, None, None)
    r = residual[rows]
    total, n = r.sum(), len(rows)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for c in cuts[f]:
            left = v <= c
            k = int(left.sum())
            if MIN_LEAF <= k <= n - MIN_LEAF:
                s = r[left].sum()
                gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
                if gain > best[0]:
                    best = (gain, f, float(c))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 5) -> list[Rule]:
    """The distinct paths of boosted trees, each as (statistic, at most?, cut) conditions."""
    r = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(x.shape[1])]
    score, rules = np.zeros(len(y)), {}

    def grow(rows: np.ndarray, path: Rule, depth: int, residual: np.ndarray) -> None:
        if path:
            rules.setdefault(tuple(sorted(path)), None)
        _, f, c = _best_split(x, residual, rows, cuts) if depth else (0, None, None)
        if f is None:
            score[rows] += 0.3 * 4 * residual[rows].mean()
            return
        left = x[rows, f] <= c
        grow(rows[left], (*path, (names[f], True, c)), depth - 1, residual)
        grow(rows[~left], (*path, (names[f], False, c)), depth - 1, residual)

    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-score))
        sample = r.random(len(y)) < 0.7
        masked = np.where(sample, residual, 0.0)
        grow(np.arange(len(y)), (), DEPTH, masked)
    return list(rules)


def holds(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    """(rows, rules) of whether each rule holds."""
    at = {n: i for i, n in enumerate(names)}
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for name, most, cut in rule:
            out[:, k] &= (x[:, at[name]] <= cut) == most
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[np.ndarray, float]:
    """(weights, intercept) of accelerated proximal descent; each class weighs the same in all."""
    if not a.shape[1]:
        return np.zeros(0), 0.0
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    step = 1 / (0.25 * np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 + 0.25)
    b, c = np.zeros(a.shape[1]), 0.0
    zb, zc, t = b, c, 1.0
    for _ in range(steps):
        g = w * (1 / (1 + np.exp(-(a @ zb + zc))) - y)
        nb, nc = zb - step * (a.T @ g), zc - step * g.sum()
        nb = np.sign(nb) * np.maximum(np.abs(nb) - step * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zb, zc = nb + (t - 1) / t1 * (nb - b), nc + (t - 1) / t1 * (nc - c)
        b, c, t = nb, nc, t1
    return b, c


class Model:
    """Weighted rules and an intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def column(self, names: dict[str, F.Column]) -> F.Column:
        """The probability of good quality, as a column expression."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            c = F.lit(True)
            for name, most, cut in rule:
                c = c & ((names[name] <= cut) if most else (names[name] > cut))
            z = z + F.when(c, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(holds(self.rules, x, names) @ np.array(self.weights) + self.intercept))) if self.rules else np.full(len(x), 1 / (1 + np.exp(-self.intercept)))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY) -> Model:
    """A model of labelled statistics. With one class only, or no rows, it says that class everywhere, or good."""
    if len(set(y.tolist())) < 2:
        return Model([], [], 5.0 if not len(y) or y[0] == 1 else -5.0)
    rules = tree_rules(x, y, names)
    a = holds(rules, x, names).astype(float)
    w, c = lasso_logistic(a, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    # the penalty shrinks; the rules left are fitted once more with a tenth of it
    w, c = lasso_logistic(a[:, keep], y, penalty / 10)
    return Model([rules[i] for i in keep], w.tolist(), float(c))


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Statistics and labels of at most fit_rows labelled rows, those whose identifiers have the smallest hashes."""
    own = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("label_id").agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id")
    stats = statistics(F.col("text"))
    got = rows.select("label_id", "label", *[c.cast("double").alias(n) for n, c in stats.items()]).orderBy("label_id", *stats).limit(fit_rows).collect()
    return np.array([[float(v) for v in r[2:]] for r in got]).reshape(-1, len(stats)), np.array([r[1] for r in got], np.int64), list(stats)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, model: Model | None = None) -> DataFrame:
    """(doc_id, score, good) for each row of docs: the probability of good quality, and whether it is at least a half.

    Rules are fitted on at most fit_rows labelled rows. Null texts are scored as empty ones; null identifiers stay null; rows that
    repeat are scored each. Identifiers with several labels count with the smallest. Without labels of both classes everything is good, or of
    the one class there is. An empty table gives no rows; further columns are not read.
    """
    model = model or fit(*sample(docs, labels, fit_rows, id_col, text_col, label_col))
    used = {name for rule in model.rules for name, _, _ in rule}
    stats = {n: c for n, c in statistics(F.col("text")).items() if n in used}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", *[c.cast("double").alias(n) for n, c in stats.items()])
    score = model.column({n: F.col(n) for n in stats})
    return rows.select("doc_id", score.alias("score")).withColumn("good", F.col("score") >= 0.5)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
