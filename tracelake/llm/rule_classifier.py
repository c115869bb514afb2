"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; every path from a root to a
node is a rule, a conjunction of comparisons. A logistic model with an L1 penalty weighs the rules,
which leaves few of them, and those are compiled into one Spark Column. Scoring is that Column.

The sample is the TRAIN_ROWS labelled rows with the smallest hashes of their id, of the rows that
may be learned from; only their statistics reach the driver. Every document is scored, whole.

Null and empty texts have all statistics 0 and get a score like any other, very long ones are scored
whole. A null id is never held out and never learned from. Without labels of both classes the score is
the share of label 1 (0.5 without any). An empty table gives no rows. Rows that repeat are scored alike;
extra columns stay, except those named like the results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import quality_rules as q
from tracelake.llm._shared import by_least_hash, unused

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS = 24, 3, 32
PENALTY = 0.002
STEPS = 400

FEATURES = ("words", "word_length", "symbols_a_word", "distinct_words", "duplicate_lines", "capitals", "digits", "words_a_line")


def held_out(doc: Column) -> Column:
    """Rows never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string")), F.lit(3)) == 1, F.lit(False))


def statistics(docs: DataFrame, text: str = "text", prefix: str = "__f_") -> DataFrame:
    """docs with one column for each of FEATURES, from the text alone."""
    body = q.text_of(text)
    w, own = unused(docs.columns, "__w", "__l")
    out = docs.withColumn(w, q._words(body)).withColumn(own, q._lines(body))
    n, lines, chars = F.size(w), F.size(own), F.greatest(F.length(body), F.lit(1))
    some = F.greatest(n, F.lit(1))
    values = {
        "words": F.log1p(n),
        "word_length": q.word_chars(F.col(w)) / some,
        "symbols_a_word": q.n_symbols(body) / some,
        "distinct_words": F.size(F.array_distinct(w)) / some,
        "duplicate_lines": (lines - F.size(F.array_distinct(own))) / F.greatest(lines, F.lit(1)),
        "capitals": (F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))) / chars,
        "digits": (F.length(body) - F.length(F.regexp_replace(body, "[0-9]+", ""))) / chars,
        "words_a_line": n / F.greatest(lines, F.lit(1)),
    }
    return out.withColumns({prefix + k: v.cast("double") for k, v in values.items()}).drop(w, own)


@dataclass(frozen=True)
class Rule:
    """A conjunction: (feature number, whether above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self, prefix: str) -> Column:
        out = None
        for f, above, t in self.terms:
            c = F.col(prefix + FEATURES[f])
            test = c > F.lit(t) if above else c <= F.lit(t)
            out = test if out is None else out & test
        return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, terms: tuple, rules: set, step: np.ndarray) -> None:
    if terms:
        rules.add(terms)
    best = (1e-6, None)
    if len(terms) < DEPTH and len(rows) >= 20:
        total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            code = np.searchsorted(edges, x[rows, f])
            g = np.cumsum(np.bincount(code, gradient[rows], len(edges) + 1))[:-1]
            h = np.cumsum(np.bincount(code, hessian[rows], len(edges) + 1))[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float(edges[k])))
    if best[1] is None:
        step[rows] = -gradient[rows].sum() / (hessian[rows].sum() + 1)
        return
    f, t = best[1]
    low = x[rows, f] <= t
    _grow(x, cuts, gradient, hessian, rows[low], (*terms, (f, False, t)), rules, step)
    _grow(x, cuts, gradient, hessian, rows[~low], (*terms, (f, True, t)), rules, step)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Weights of a logistic model with an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    a = np.column_stack([np.ones(len(a)), a])
    w = np.zeros(a.shape[1])
    probe = np.ones(a.shape[1])
    for _ in range(30):  # largest eigenvalue, for the step
        probe = a.T @ (a @ probe)
        probe /= np.linalg.norm(probe) or 1.0
    rate = 4 * len(y) / max(1e-9, float(np.linalg.norm(a.T @ (a @ probe))))
    v, k = w.copy(), 1.0
    for _ in range(STEPS):
        new = v - rate * (a.T @ (_sigmoid(a @ v) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        nk = (1 + (1 + 4 * k * k) ** 0.5) / 2
        v, w, k = new + (k - 1) / nk * (new - w), new, nk
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))

    def column(self, prefix: str = "__f_") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else min(0.99, max(0.01, float(y.mean())))
        return Model(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    share = y.mean()
    z, rules, random = np.full(len(y), np.log(share / (1 - share))), set(), np.random.default_rng(7)
    for _ in range(TREES):
        p = _sigmoid(z)
        rows = np.sort(random.choice(len(y), max(1, len(y) * 2 // 3), replace=False))
        step = np.zeros(len(y))
        grown: set = set()
        _grow(x, cuts, p - y, p * (1 - p), rows, (), grown, step)
        rules |= grown
        z[rows] += 0.3 * step[rows]
    found, columns, seen = [], [], set()
    for terms in sorted(rules):
        rule = Rule(terms)
        holds = rule.holds(x)
        if 0 < holds.sum() < len(y) and (key := holds.tobytes()) not in seen:
            seen.add(key)
            found.append(rule)
            columns.append(holds)
    if not found:
        return Model(float(np.log(share / (1 - share))), ())
    intercept, weights = _lasso(np.column_stack(columns).astype(float), y, penalty)
    return Model(intercept, tuple((r, float(w)) for r, w in zip(found, weights) if w))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model of label from docs' texts, on at most ``rows`` labelled rows that are not held out."""
    own = F.col(doc).cast("string")
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(F.col(doc)))
    hashed = usable.select(F.col(doc).alias("__id"), F.col(label).cast("double").alias("__y"), F.xxhash64(own).alias("__h"))
    chosen = by_least_hash(hashed, "__h", rows).orderBy("__h", "__id").limit(rows)
    # At most ``rows`` pairs of numbers, so the side is bounded.
    joined = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    table = statistics(joined, "text").orderBy("__h", "__id").select("__y", *("__f_" + f for f in FEATURES)).limit(2 * rows).collect()
    x = np.array([r[1:] for r in table], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[0] for r in table], float))


def score(docs: DataFrame, model: Model, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """docs with held_out, score and predicted."""
    prefix = "__f_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    out = statistics(docs, text, prefix).withColumn("score", model.column(prefix))
    out = out.withColumns({"held_out": held_out(F.col(doc)), "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})
    return out.drop(*(prefix + f for f in FEATURES))
