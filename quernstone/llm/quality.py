"""Quality classifier: a sparse ensemble of rules, compiled into column expressions.

Statistics of a text are column expressions. On a bounded sample of labelled rows, boosted shallow
trees are grown over them; every path from a root to a node is a rule, a conjunction of thresholds;
a logistic model with a lasso penalty weighs the rules and leaves few. The rules that stay become
column expressions again, so scoring is one projection without Python.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import fresh

#: Labelled rows that a fit uses at most: those whose hashed ids come first.
SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
LEARNING_RATE = 0.3
LEAF_ROWS = 5
PENALTIES = (0.03, 0.01, 0.003, 0.001)


def _times(text: Column, mark: str) -> Column:
    """Occurrences of a short string."""
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(float(len(mark)))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; null counts as empty and every ratio of an empty text is 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(t, "\\s+")
    lines = F.split(t, "\n")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n = F.size(words).cast("double")
    upper = F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).cast("double")
    symbols = F.length(F.translate(t, "*#$%&@^~=+<>{}[]\\_", "")).cast("double")
    digits = F.length(F.translate(t, "0123456789", "")).cast("double")
    return {
        "chars": F.length(t).cast("double"),
        "words": F.when(F.length(t) > 0, n).otherwise(0.0),
        "word_length": F.when(F.length(t) > 0, F.length(t) / n).otherwise(0.0),
        "upper_share": (F.length(t) - upper) / chars,
        "symbol_share": (F.length(t) - symbols) / chars,
        "digit_share": (F.length(t) - digits) / chars,
        "bang_share": _times(t, "!") / chars,
        "pipe_share": _times(t, "|") / chars,
        "stop_share": _times(t, ".") / chars,
        "comma_share": _times(t, ",") / chars,
        "colon_share": (_times(t, ":") + _times(t, ";")) / chars,
        "question_share": _times(t, "?") / chars,
        "dots_share": _times(t, "...") / chars,
        "lines": F.size(lines).cast("double"),
        "line_length": F.length(t) / F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "brace_share": (_times(t, "(") + _times(t, '"')) / chars,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): the statistic is > it, or <= it."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = None
        for name, above, at in self.terms:
            c = F.col(name) > F.lit(at) if above else F.col(name) <= F.lit(at)
            out = c if out is None else out & c
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.terms:
            v = x[:, names.index(name)]
            out &= v > at if above else v <= at
        return out


@dataclass
class RuleEnsemble:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))"""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _tree(binned, gradient, hessian, cuts, names, rows, terms, depth, rules, step):
    """Grow one node: add its rule, and set ``step`` at the leaves."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    step[rows] = -g / (h + 1.0)
    if terms:
        rules.append(Rule(tuple(terms)))
    if depth == 0 or len(rows) < 2 * LEAF_ROWS:
        return
    best = (1e-6, None)
    for j in range(binned.shape[1]):
        size = len(cuts[j]) + 1
        if size < 2:
            continue
        b = binned[rows, j]
        gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (gradient[rows], hessian[rows], None))
        ok = (nl >= LEAF_ROWS) & (len(rows) - nl >= LEAF_ROWS)
        gain = np.where(ok, gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0), 0)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (j, k))
    if best[1] is None:
        return
    j, k = best[1]
    low = binned[rows, j] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        _tree(binned, gradient, hessian, cuts, names, side, [*terms, (names[j], above, float(cuts[j][k]))], depth - 1, rules, step)


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """Distinct rules of boosted trees, in the order of their growth."""
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(q[q < x[:, j].max()])
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = _sigmoid(score)
        step = np.zeros(len(y))
        _tree(binned, p - y, p * (1 - p), cuts, names, np.arange(len(y)), [], DEPTH, rules, step)
        score += LEARNING_RATE * step
    return list(dict.fromkeys(rules))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model with an L1 penalty on the weights, by FISTA."""
    n = len(y)
    a1 = np.c_[np.ones(n), a]
    rate = 4.0 * n / max(np.linalg.norm(a1, 2) ** 2, 1e-12)
    w = np.zeros(a1.shape[1])
    w[0] = np.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        nxt = ahead - rate * (a1.T @ (_sigmoid(a1 @ ahead) - y)) / n
        nxt[1:] = np.sign(nxt[1:]) * np.maximum(np.abs(nxt[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    return float(w[0]), w[1:]


def fit_ensemble(x: np.ndarray, y: np.ndarray, names: list[str], fold: np.ndarray) -> RuleEnsemble:
    """Rules and weights; the penalty is the largest whose loss on the rows of ``fold`` is near the best.

    Without rows of both labels the ensemble is a constant: the share of label 1, or 0.5 without rows.
    """
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return RuleEnsemble(float(np.log(p / (1 - p))), [])
    rules = grow_rules(x, y, names)
    a = np.stack([r.holds(x, names) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(a, axis=1, return_index=True)
    keep = np.sort(first)
    rules, a = [rules[i] for i in keep], a[:, keep]
    penalty = PENALTIES[-1]
    if 0 < fold.sum() < len(y) and 0 < y[~fold].mean() < 1:
        loss = []
        for p in PENALTIES:
            b, w = lasso_logistic(a[~fold], y[~fold], p)
            q = np.clip(_sigmoid(b + a[fold] @ w), 1e-6, 1 - 1e-6)
            loss.append(-np.mean(y[fold] * np.log(q) + (1 - y[fold]) * np.log(1 - q)))
        penalty = next(p for p, v in zip(PENALTIES, loss) if v <= min(loss) * 1.02 + 1e-4)
    b, w = lasso_logistic(a, y, penalty)
    return RuleEnsemble(b, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def held_out(doc_id: Column) -> Column:
    """Rows that no fit reads labels of: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> RuleEnsemble:
    """An ensemble from at most ``sample_rows`` labelled rows outside the held-out third.

    The sample is the rows whose hashed ids come first, so it does not depend on the order of the
    tables; its ids are broadcast (that bound holds at any size) and only its statistics are collected.
    Null ids and labels, and labels other than 0 and 1, are not used; of a repeated id the smaller label
    and the text whose hash comes first count. Ids are of any type; a null text counts as empty.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = usable.groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    stats = statistics(F.col("__text"))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    numbers = F.struct(*[c.alias(n) for n, c in stats.items()])
    one = rows.select("__id", "__label", F.xxhash64("__text").alias("__order"), numbers.alias("__s")).groupBy("__id").agg(F.min("__label").alias("__label"), F.min_by("__s", F.struct("__order", "__s")).alias("__s"))
    sample = one.select("__id", "__label", "__s.*").toPandas().sort_values("__id")
    fold = np.array([zlib.crc32(f"fold:{i}".encode()) % 5 == 0 for i in sample["__id"]], bool)
    return fit_ensemble(sample[list(stats)].to_numpy(float), sample["__label"].to_numpy(float), list(stats), fold)


def score(docs: DataFrame, model: RuleEnsemble, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, in one projection.

    Null texts count as empty; repeated rows stay; a null doc_id is not held out.
    """
    used = {name for rule, _ in model.rules for name, _, _ in rule.terms}
    stats = {n: c for n, c in statistics(F.col("__text")).items() if n in used}
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).select("doc_id", *[c.alias(n) for n, c in stats.items()])
    scored = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the ensemble predicts label 1 for, all columns kept.

    Null texts count as empty; repeated rows stay or go together; null ids are as any others; an empty
    table stays empty.
    """
    used = {name for rule, _ in model.rules for name, _, _ in rule.terms}
    stats = {n: c for n, c in statistics(F.col(f"`{text}`")).items() if n in used}
    (held,) = fresh(docs, "stats")
    # Generated rows are a barrier: the optimiser would else repeat each statistic wherever a rule names it.
    nested = docs.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in stats.items()], F.lit(0).alias("none")))).alias(held))
    inside = RuleEnsemble(model.bias, [(Rule(tuple((f"{held}.{n}", a, t) for n, a, t in r.terms)), w) for r, w in model.rules])
    return nested.where(inside.score() >= 0.5).drop(held)
