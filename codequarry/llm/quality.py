"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Statistics of each text (shares of capitals, symbols and digits, repetition, word and line
lengths) feed small boosted trees; every path of every tree is a conjunctive rule; a lasso
logistic regression picks few of the rules and weighs them; what is left becomes one Spark
column expression over the statistics.

Training takes at most ``max_train`` labelled rows (default 12,000), chosen by hash. Ids,
language, source and labels are never inputs. Without labelled rows of both kinds the score
is the labels' mean, or 0.5.

Defined results: a null text counts as empty, whose statistics are all 0; rows with repeated
or null ids are scored one by one; other columns are passed on, but give way to made names.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_columns, whole_row
from .labelled import id_crc, sigmoid, training_rows

STATS = (
    "words", "mean_word", "longest_word", "upper", "symbols", "digits", "marks", "beyond_ascii", "distinct_words",
    "repeated_next", "distinct_pairs", "top_word", "lines", "repeated_lines", "mean_line",
)

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
#: Marks of ordinary prose; other ASCII punctuation counts as symbols.
_MARKS = b".,;:'\"()-?"
_SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in _MARKS)
_BEYOND = bytes(range(0x80, 0x100))


def statistics(text: str | None) -> tuple[float, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATS)
    n, k = len(raw), len(words)
    share = lambda drop: (n - len(raw.translate(None, drop))) / n
    lines = raw.split(b"\n")
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, k - 1)
    return (
        float(k), sum(map(len, words)) / k, float(max(map(len, words))), share(_UPPER), share(_SYMBOLS), share(_DIGITS),
        share(_MARKS), share(_BEYOND), len(counts) / k, sum(map(operator.eq, words, words[1:])) / k, pairs, max(counts.values()) / k,
        float(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines),
    )


def text_statistics(text: Column) -> Column:
    """The statistics of a text column, as a struct."""

    @F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts.tolist()], columns=list(STATS))

    return measure(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction: each condition is (statistic, whether above, bound)."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, bound in self.conditions:
            out &= (x[:, f] > bound) == above
        return out

    def column(self, prefix: str) -> Column:
        out = F.lit(True)
        for f, above, bound in self.conditions:
            value = F.col(f"{prefix}.{STATS[f]}")
            out = out & ((value > bound) if above else (value <= bound))
        return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, rules: set, rng) -> np.ndarray:
    """A regression tree on gradients g and weights h; adds its paths, returns its values."""
    value = g.sum() / (h.sum() + 1.0)
    out = np.full(len(x), value)
    if depth == 0 or len(x) < 20:
        return out
    best = (1e-3, -1, 0.0)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        bins = np.searchsorted(cuts[f], x[:, f], side="left")
        n = len(cuts[f]) + 1
        gs, hs = np.cumsum(np.bincount(bins, g, n)), np.cumsum(np.bincount(bins, h, n))
        left = gs[:-1] ** 2 / (hs[:-1] + 1.0)
        right = (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0)
        if len(left) and (gain := left + right - base).max() > best[0]:
            best = (float(gain.max()), int(f), float(cuts[f][int(gain.argmax())]))
    _, f, bound = best
    if f < 0:
        return out
    above = x[:, f] > bound
    for side in (False, True):
        part = above == side
        if part.any():
            longer = (*path, (f, side, bound))
            rules.add(Rule(tuple(sorted(longer))))
            out[part] = _grow(x[part], g[part], h[part], cuts, depth - 1, longer, rules, rng)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 11) -> list[Rule]:
    """Every path of ``trees`` boosted trees, each grown on half the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: set[Rule] = set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        part = rng.random(len(y)) < 0.5
        before = len(rules)
        grown: set[Rule] = set()
        own = x[part]
        _grow(own, (y - p)[part], (p * (1 - p))[part] + 1e-6, cuts, depth, (), grown, rng)
        rules |= grown
        if len(rules) == before:
            continue
        # The step towards the labels: mean gradient of each deepest region.
        for rule in (r for r in grown if len(r.conditions) == max(len(q.conditions) for q in grown)):
            inside = rule.holds(x)
            if inside.any():
                score[inside] += 0.5 * (y - p)[inside].sum() / ((p * (1 - p))[inside].sum() + 1.0)
    return sorted(rules, key=lambda r: (len(r.conditions), r.conditions))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights, by accelerated proximal gradient."""
    n, k = a.shape
    # A bound on the curvature: the largest eigenvalue of a'a / 4n, by power iteration.
    v = np.ones(k) / max(1, np.sqrt(k))
    for _ in range(12):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * n / (np.linalg.norm(a @ v) ** 2 + n)
    w, z, b, bz, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ z + bz))) - y
        new_w = z - step * (a.T @ r) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = bz - step * r.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return float(b), w


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.0008) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            mean = float(y.mean()) if len(y) else 0.5
            return RuleEnsemble(float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), ())
        rules = tree_rules(x, y)
        a = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
        b, w = lasso_logistic(a, y, penalty)
        return RuleEnsemble(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6))

    def column(self, prefix: str) -> Column:
        """The score as an expression over the struct ``prefix`` of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(prefix), weight).otherwise(0.0)
        return sigmoid(total)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(id_crc(id_col), F.lit(5)) == 0


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = 12_000) -> RuleEnsemble:
    """The model from labelled rows outside the held-out fold; at most ``max_train`` of them."""
    rows = training_rows(docs, labels, "quality", held_out(), max_train)
    stats = rows.select(text_statistics(F.col("_text")).alias("s"), "_y").select("s.*", "_y").toPandas()
    # Rows come in any order; sorted, the fit is the same each time.
    stats = stats.sort_values([*STATS, "_y"], kind="stable")
    return RuleEnsemble.fit(stats[list(STATS)].to_numpy(np.float64).reshape(-1, len(STATS)), stats["_y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted."""
    made = ["score", "predicted"]
    rated = docs.select(whole_row(docs), text_statistics(F.col(text_col)).alias("_stats")).withColumn("_score", model.column("_stats"))
    return rated.select(
        *row_columns(docs, made),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    model = fit_quality(docs, labels)
    rated = docs.select(whole_row(docs), text_statistics(F.col("text")).alias("_stats"))
    return rated.where(model.column("_stats") >= threshold).select(*row_columns(docs))
