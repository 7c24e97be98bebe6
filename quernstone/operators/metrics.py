"""Ranking and classification metrics with ties, thresholds and bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.scalar import safe_div
from quernstone.scratch import written
from quernstone.session import ship_package


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), buckets: int = 32, totals: bool = False) -> DataFrame:
    """``df`` with cum_<c>: the sum of c over rows of the group with an equal or larger ``order``.

    Two levels, so no window holds all rows: rows fall into buckets between approximate quantiles,
    windows run inside a bucket, and sums of whole buckets are added. (group, order) must be unique.
    With ``totals`` all_<c> is the sum over the group.
    """
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("cuts"))
    tagged = df.withColumn("__cuts", cuts.scalar()).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")
    inner = Window.partitionBy(*by, "__b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    outer = whole.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    total = tagged.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    before = total.select(F.col("__b").alias("__b2"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(f"__s_{c}").over(outer), F.lit(0)).alias(f"__before_{c}") for c in sums], *([F.sum(f"__s_{c}").over(whole).alias(f"all_{c}") for c in sums] if totals else []))
    local = tagged.withColumns({f"cum_{c}": F.sum(c).over(inner) for c in sums})
    on = [F.col("__b").eqNullSafe(F.col("__b2")), *[F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]]
    joined = local.join(before, on)
    return joined.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__before_{c}") for c in sums}).drop("__b", "__b2", *[f"__by{i}" for i in range(len(by))], *[f"__before_{c}" for c in sums])


def score_frame(df: DataFrame, y: Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, n, pos, cum_n, cum_pos, all_n, all_pos) over distinct scores: all that the ranking metrics
    need. The counts are written once, as their quantiles and sums are read apart."""
    counts = df.select(*by, y.cast("int").alias("y"), score.cast("double").alias("score")).where("y IS NOT NULL AND score IS NOT NULL")
    counts = written(counts.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), "scores")
    return running_totals(counts, "score", ["n", "pos"], by, totals=True)


def _below() -> Column:
    """Negatives at or above a row's score."""
    return F.col("cum_n") - F.col("cum_pos")


def _negatives() -> Column:
    return F.col("all_n") - F.col("all_pos")


def _auroc() -> Column:
    """Aggregate over a frame: the area under the ROC curve by average ranks; null if a class is missing."""
    wins = F.sum(F.col("pos") * ((F.col("n") - F.col("pos")) / 2.0) - F.col("pos") * _below())
    p, q = F.max("all_pos"), F.max(_negatives())
    return F.when((p > 0) & (q > 0), (wins + p * q) / (p * q))


def _stepped_precision() -> Column:
    """Aggregate over a frame: average precision with equal scores as one step."""
    p = F.max("all_pos")
    return F.when(p > 0, F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / p)


def auroc(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks, and the size of both classes; null if a class is missing."""
    return frame.groupBy(*by).agg(_auroc().alias("auroc"), F.max("all_pos").alias("pos"), F.max(_negatives()).alias("neg"))


def _cells(df: DataFrame, y: Column, score: Column, order: Column, by: Sequence[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """Labelled rows (by, y, score, o, part) and their counts (by, score, part, n, pos).

    A part is a range of the order between approximate quantiles, so that a score of all rows is dealt to
    many tasks. Both are written: the table is read once, and what follows reads narrow rows.
    """
    rows = df.select(*by, y.cast("int").alias("y"), score.cast("double").alias("score"), order.cast("double").alias("o"))
    rows = written(rows.where("y IS NOT NULL AND score IS NOT NULL"), "ranked")
    cuts = rows.agg(F.percentile_approx("o", [i / parts for i in range(1, parts)], 1000).alias("cuts")).first()["cuts"] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("o"))) if cuts else F.lit(0)
    tagged = rows.withColumn("part", part)
    return tagged, written(tagged.groupBy(*by, "score", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), "cells")


def _cell_frame(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The frame of ``score_frame`` from counts by score and part, written."""
    counts = cells.groupBy(*by, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return written(running_totals(counts, "score", ["n", "pos"], by, totals=True), "frame")


def _placed_precision(tagged: DataFrame, cells: DataFrame, frame: DataFrame, by: Sequence[str]) -> DataFrame:
    ahead = Window.partitionBy(*by, "score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.select(*by, "score", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n1"), F.coalesce(F.sum("pos").over(ahead), F.lit(0)).alias("p1"))
    before = inside.join(frame.select(*by, "score", (F.col("cum_n") - F.col("n")).alias("n0"), (F.col("cum_pos") - F.col("pos")).alias("p0")), [*by, "score"])
    before = before.select(*by, F.col("score").alias("s2"), F.col("part").alias("part2"), (F.col("n0") + F.col("n1")).alias("n0"), (F.col("p0") + F.col("p1")).alias("p0"))
    w = Window.partitionBy(*by, "score", "part").orderBy("o")
    placed = tagged.withColumn("k", F.row_number().over(w)).withColumn("tp", F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("y = 1")
    joined = placed.join(before.withColumnsRenamed({c: f"__{c}" for c in by}), [F.col("score") == F.col("s2"), F.col("part") == F.col("part2"), *[F.col(c) == F.col(f"__{c}") for c in by]])
    return joined.groupBy(*by).agg(F.avg((F.col("p0") + F.col("tp")) / (F.col("n0") + F.col("k"))).alias("average_precision"), F.count(F.lit(1)).alias("pos"))


def average_precision(df: DataFrame, y: Column, score: Column, order: Column, by: Sequence[str] = (), parts: int = 32) -> DataFrame:
    """Mean over the positives of the precision at their place, ties by ``order``, a number.

    Rows without label or score are left out. Ranks are two-level twice: sums over larger scores, and
    within a score sums over parts of the order.
    """
    tagged, cells = _cells(df, y, score, order, by, parts)
    return _placed_precision(tagged, cells, _cell_frame(cells, by), by)


def _ratios(threshold: float) -> list[Column]:
    """Threshold and ratios from the columns tp, fp, tn and fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return [F.lit(threshold).alias("threshold"), safe_div(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), safe_div(tn, tn + fp).alias("specificity"), safe_div(2 * precision * recall, precision + recall).alias("f1")]


def confusion_at(df: DataFrame, y: Column, score: Column, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn with ``score >= threshold`` as positive, and the ratios."""
    hit, pos = score >= threshold, y == 1
    out = df.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    return out.select(*by, "tp", "fp", "tn", "fn", *_ratios(threshold))


def _at_least(t: float) -> tuple[Column, Column]:
    """Aggregates over a frame: positives and negatives at or above a score."""
    hit = F.col("score") >= t
    return F.coalesce(F.max(F.when(hit, F.col("cum_pos"))), F.lit(0)), F.coalesce(F.max(F.when(hit, _below())), F.lit(0))


def _criterion(name: str, tp: Column, fp: Column, p: Column, n: Column) -> Column:
    if name == "f1":
        return safe_div(2.0 * tp, tp + fp + p)
    if name == "youden":
        return safe_div(tp, p) - safe_div(fp, n - p)
    return safe_div(tp + (n - p - fp), n)


def _best(name: str) -> Column:
    """Aggregate over a frame: struct (against, threshold) of the best threshold, -value first."""
    row = lambda v, t: F.struct((-F.round(v, 12)).alias("against"), t.cast("double").alias("threshold"))
    p, n = F.coalesce(F.max("all_pos"), F.lit(0)), F.coalesce(F.max("all_n"), F.lit(0))
    inside = F.min(row(_criterion(name, F.col("cum_pos"), _below(), F.col("all_pos"), F.col("all_n")), F.col("score")))
    return F.least(inside, *[row(_criterion(name, *_at_least(t), p, n), F.lit(t)) for t in (0.0, 1.0)])


def best_threshold(frame: DataFrame, criterion: str = "f1") -> DataFrame:
    """The smallest threshold with the best f1, youden or accuracy among 0, all scores and 1.

    ``score >= threshold`` is positive. One aggregate over distinct scores; scores lie in any range, but 0
    and 1 are candidates as well.
    """
    return best_thresholds(frame, [criterion])


def best_thresholds(frame: DataFrame, criteria: Sequence[str] = ("f1", "youden", "accuracy")) -> DataFrame:
    """(criterion, threshold, value) of several criteria, in one aggregate."""
    if unknown := set(criteria) - {"f1", "youden", "accuracy"}:
        raise ValueError(f"no criteria: {sorted(unknown)}")
    row = frame.agg(*[_best(c).alias(c) for c in criteria])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c)["threshold"].alias("threshold"), (-F.col(c)["against"]).alias("value")) for c in criteria])))


def _sensitivity(specificity: float) -> tuple[Column, Column]:
    """Aggregates over a frame: true and false positives where only scores above the k-th largest negative count.

    A score is above it if fewer than k negatives are at or above the score.
    """
    q = _negatives()
    k = F.floor((1 - specificity) * q + 1e-9)
    over = _below() < F.greatest(k, F.lit(1))
    lowest = F.max(F.when(F.col("n") > F.col("pos"), F.col("cum_pos")))  # positives down to the lowest negative
    given_up = F.max(k >= q)
    tp = F.when(given_up, lowest).otherwise(F.coalesce(F.max(F.when(over, F.col("cum_pos"))), F.lit(0)))
    fp = F.when(given_up, F.max(q)).otherwise(F.coalesce(F.max(F.when(over, _below())), F.lit(0)))
    return tp, fp


def sensitivity_at(frame: DataFrame, specificity: float) -> DataFrame:
    """Sensitivity where only scores strictly above the k-th largest negative are positive.

    k = max(1, floor((1 - specificity) * negatives + 1e-9)); with k = negatives and more, everything from
    the lowest negative up is positive. The achieved specificity stands beside; both null without a class.
    """
    tp, fp = _sensitivity(specificity)
    p, q = F.max("all_pos"), F.max(_negatives())
    both = (p > 0) & (q > 0)
    return frame.agg(F.lit(specificity).alias("target"), F.when(both, tp / p).alias("sensitivity"), F.when(both, 1 - fp / q).alias("specificity"))


def binary_metrics(df: DataFrame, y: Column, score: Column, order: Column, threshold: float = 0.5, specificity: float = 0.95) -> DataFrame:
    """All binary metrics in one row: one aggregate over distinct scores, and the ranks of average precision.

    Both come from the same counts, so ``df`` is read once. Rows without label or score are left out.
    """
    tagged, cells = _cells(df, y, score, order, (), 32)
    frame = _cell_frame(cells, ())
    tp, fp = _at_least(threshold)
    hits, _ = _sensitivity(specificity)
    p, q = F.max("all_pos"), F.max(_negatives())
    row = frame.agg(_auroc().alias("auroc"), p.alias("pos"), q.alias("neg"), tp.alias("tp"), fp.alias("fp"), (q - fp).alias("tn"), (p - tp).alias("fn"), _best("f1").alias("best"), F.when((p > 0) & (q > 0), hits / p).alias("sens_at_spec"))
    precise = _placed_precision(tagged, cells, frame, ()).select("average_precision")
    out = row.withColumn("average_precision", precise.scalar())
    return out.select("auroc", "pos", "neg", "average_precision", "tp", "fp", "tn", "fn", *_ratios(threshold), F.col("best.threshold").alias("best_f1_threshold"), (-F.col("best.against")).alias("best_f1"), "sens_at_spec")


def ovr_report(df: DataFrame, y: Column, probabilities: Column, classes: int, order: Column) -> DataFrame:
    """(class_id, support, auroc_ovr, auprc_ovr) of one class against the rest; null without both classes."""
    long = df.select(y.cast("int").alias("__y"), order.cast("double").alias("__o"), F.posexplode(F.slice(probabilities, 1, classes)).alias("class_id", "__p"))
    truth, by = F.col("__y") == F.col("class_id"), ["class_id"]
    tagged, cells = _cells(long, truth, F.col("__p"), F.col("__o"), by, 32)
    frame = _cell_frame(cells, by)
    ranks = auroc(frame, by).select("class_id", F.col("pos").alias("support"), F.col("auroc").alias("auroc_ovr"))
    precise = _placed_precision(tagged, cells, frame, by).select("class_id", F.col("average_precision").alias("auprc_ovr"))
    return ranks.join(precise, "class_id", "left")


def ovr_macro(report: DataFrame) -> DataFrame:
    """Means over the classes whose value is defined."""
    return report.agg(F.avg("auroc_ovr").alias("macro_auroc_ovr"), F.avg("auprc_ovr").alias("macro_auprc_ovr"))


def merge_classes(report: DataFrame, ovr: DataFrame) -> DataFrame:
    """A class report with the one-against-rest metrics of its classes beside."""
    return report.join(ovr.drop("support"), "class_id", "left")


def tail_classes(report: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The listed classes of a report; ids that it does not have are passed over."""
    return report.where(F.col("class_id").isin(*ids))


def masked_accuracy(df: DataFrame, y: Column, p: Column, mask: Column, part: Column, positive: int = 1) -> DataFrame:
    """(part, n, accuracy, positive_rate) overall (part null) and by part, over rows of the mask.

    positive_rate is the share of rows predicted ``positive``.
    """
    rows = df.where(mask).select(part.alias("part"), (y == p).alias("hit"), (p == positive).alias("positive"))
    return rows.rollup("part").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("int")).alias("accuracy"), F.avg(F.col("positive").cast("int")).alias("positive_rate"))


def masked_loss(df: DataFrame, loss: Column, mask: Column, part: Column) -> DataFrame:
    """Mean over the parts of their mean loss under the mask; parts without rows do not count."""
    return df.where(mask).groupBy(part.alias("part")).agg(F.avg(loss).alias("loss")).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("parts"))


def epoch_means(df: DataFrame, by: Sequence[str], loss: str, accuracy: str, n: str) -> DataFrame:
    """Loss as the plain mean over batches, accuracy weighted by their rows."""
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), safe_div(F.sum(F.col(accuracy) * F.col(n)), F.sum(n)).alias("accuracy"))


def confusion(df: DataFrame, y: Column, p: Column) -> DataFrame:
    return df.groupBy(y.alias("y_true"), p.alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Precision, recall, specificity, F1 and support of every class, from confusion cells."""
    spark = cells.sparkSession
    listed = spark.createDataFrame([(int(c),) for c in classes], "class_id int")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    row = cells.groupBy(F.col("y_true").cast("int").alias("class_id")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    col = cells.groupBy(F.col("y_pred").cast("int").alias("class_id")).agg(F.sum("n").alias("predicted"))
    out = listed.join(row, "class_id", "left").join(col, "class_id", "left").fillna(0).withColumn("t", total.scalar())
    tp, s, q, t = (F.col(c) for c in ("tp", "support", "predicted", "t"))
    precision, recall = safe_div(tp, q), safe_div(tp, s)
    return out.select("class_id", "support", precision.alias("precision"), recall.alias("recall"), safe_div(t - s - q + tp, t - s).alias("specificity"), safe_div(2 * precision * recall, precision + recall).alias("f1"))


def overall_report(report: DataFrame) -> DataFrame:
    """Macro means over all classes, those without support too, weighted F1 and accuracy."""
    s = F.col("support")
    return report.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), safe_div(F.sum(F.col("f1") * s), F.sum(s)).alias("weighted_f1"), safe_div(F.sum(F.col("recall") * s), F.sum(s)).alias("accuracy"))


def bootstrap_auroc(df: DataFrame, y: Column, score: Column, group: Column, replicates: int = 1000, seed: str = "0", level: float = 0.95, multiplicity: bool = True) -> DataFrame:
    """Mean and percentile interval of the AUROC over bootstrap replicates of whole groups."""
    out = bootstrap_metrics(df, y, score, group, replicates, seed, level=level, multiplicity=multiplicity)
    return out.where("metric = 'auroc'").select("mean", "low", "high", "replicates")


BOOTSTRAPPED = ("auroc", "auprc", "accuracy", "sensitivity", "specificity", "f1", "sensitivity_at_spec", "specificity_at_spec")
#: (group, score) rows a cell where scores are many, cells at most, weights handled at a time, and weights that a task draws at least.
PART_ROWS, CELLS, BLOCK, DRAWS = 32_768, 2048, 1_000_000, 4_000_000


def poisson_steps() -> list[float]:
    """Where the Poisson(1) count goes up by one, until less than 2^-32 is left."""
    p = total = math.exp(-1)
    steps = []
    while total < 1 - 2.0**-32:
        steps.append(total)
        p /= len(steps)
        total += p
    return steps


def poisson(u: Column) -> Column:
    """The Poisson(1) count at ``u``, a multiple of 2^-32 below 1, with its whole tail."""
    steps = poisson_steps()
    out = F.when(u < steps[0], 0)
    for i, t in enumerate(steps[1:], 1):
        out = out.when(u < t, i)
    return out.otherwise(len(steps))


#: MD5 over arrays of messages: constants, rotations, and the start.
_MD5_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_S = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _leading_words(words: list) -> np.ndarray:
    """The first word of MD5 over one-block messages, each given by its 16 words: arrays of one shape, or numbers."""
    shape = np.broadcast_shapes(*(np.shape(w) for w in words))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _MD5_START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps do not touch the first word
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        w = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        np.add(f, a, out=f)
        if np.ndim(w):
            np.add(f, w, out=f), np.add(f, np.uint32(_MD5_K[i]), out=f)
        else:
            np.add(f, np.uint32((_MD5_K[i] + int(w)) & 0xFFFFFFFF), out=f)
        s = _MD5_S[kind][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # the old a is used up
        a, b, c, d = d, a, b, c
    return b + np.uint32(_MD5_START[0]) if shape else b


def drawn(seed: str, groups: Sequence[bytes], replicates: int, multiplicity: bool = True, lanes: int = 65_536) -> np.ndarray:
    """Weights of groups (rows) in replicates 1, 2, ... (columns): Poisson(1) counts at md5(seed:replicate:group), or
    whether they are positive. Messages of one block are hashed in arrays, longer ones one by one."""
    steps = [np.uint32(math.ceil(t * 2**32)) for t in poisson_steps()]
    out = np.zeros((len(groups), replicates), np.int8)
    lengths = np.array([len(g) for g in groups], np.int64)

    def count(value: np.ndarray) -> np.ndarray:
        w = (value >= steps[0]).astype(np.int8)
        for t in steps[1:] if multiplicity else []:
            w += value >= t
        return w

    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        text = np.frombuffer(b"".join(groups[i] for i in at), np.uint8).reshape(len(at), length)
        for digits in range(1, len(str(replicates)) + 1):
            low, high = 10 ** (digits - 1), min(replicates, 10**digits - 1)
            front = len(seed.encode()) + digits + 2
            size = front + int(length)
            if size > 55:
                heads = [f"{seed}:{r}:".encode() for r in range(low, high + 1)]
                value = np.array([[int.from_bytes(hashlib.md5(h + groups[i]).digest()[:4]) for h in heads] for i in at], np.uint32)
                out[at, low - 1 : high] = count(value)
                continue
            body = np.zeros((len(at), 64), np.uint8)
            body[:, front:size], body[:, size] = text, 128
            body[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
            body = body.view("<u4")
            head = np.zeros((high - low + 1, 64), np.uint8)
            head[:, :front] = np.frombuffer("".join(f"{seed}:{r}:" for r in range(low, high + 1)).encode(), np.uint8).reshape(-1, front)
            head = head.view("<u4")
            moving = [k for k in range(16) if k * 4 < size and k * 4 + 4 > front - digits - 2]
            rows = max(1, lanes // len(head))
            for lo in range(0, len(at), rows):
                part = body[lo : lo + rows]
                words: list = [int(part[0, k]) | int(head[0, k]) for k in range(16)]
                for k in moving:
                    words[k] = np.ascontiguousarray(np.broadcast_to(part[:, None, k] | head[None, :, k], (len(part), len(head))))
                out[at[lo : lo + rows], low - 1 : high] = count(_leading_words(words).byteswap())
    return out


def _weighted(w: np.ndarray, group: np.ndarray, count: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over runs of rows of a row's count times its group's weights."""
    rows = w[group] if count.max() == 1 == count.min() else w[group] * count[:, None].astype(np.int64)
    return np.add.reduceat(rows, starts, axis=0, dtype=np.int64)


def _cell_sums(seed: str, replicates: int, multiplicity: bool, cells: int):
    """A task's (cell, n, pos) over rows (g, cell, n, pos) in order of g: sums of its groups' rows in every replicate."""

    def run(batches):
        total = np.zeros((cells, 2, replicates), np.int64)
        seen = np.zeros(cells, bool)
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column("g").dictionary_encode()
            names, code = [x.encode() for x in code.dictionary.to_pylist()], code.indices.to_numpy(zero_copy_only=False)
            cell, n, pos = (b.column(c).to_numpy() for c in ("cell", "n", "pos"))
            step = max(1, BLOCK // replicates)
            for at in range(0, len(names), step):
                w = drawn(seed, names[at : at + step], replicates, multiplicity)
                held = np.flatnonzero((code >= at) & (code < at + step))
                seen[cell[held]] = True
                for i, c, k, p in zip((code[held] - at).tolist(), cell[held].tolist(), n[held].tolist(), pos[held].tolist(), strict=True):
                    total[c, 0] += w[i] if k == 1 else w[i].astype(np.int64) * k
                    if p:
                        total[c, 1] += w[i] if p == 1 else w[i].astype(np.int64) * p
        some = np.flatnonzero(seen)
        for at in range(0, len(some), 128):
            c = some[at : at + 128]
            lists = [pa.ListArray.from_arrays(np.arange(len(c) + 1, dtype=np.int32) * replicates, total[c, k].ravel()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), *lists], ["cell", "n", "pos"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The sums of one cell over all tasks, a row each."""
    both = [rows.column(c).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(0) for c in ("n", "pos")]
    return pa.Table.from_arrays([rows.column("cell").slice(0, 1), *[pa.array([x], pa.list_(pa.int64())) for x in both]], ["cell", "n", "pos"])


def _replicated(rows: pa.Table, seed: str, replicates: int, multiplicity: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of a cell in falling order with their rows and positives in every replicate, some scores at a time."""
    score, n, pos = (rows.column(c).to_numpy() for c in ("score", "n", "pos"))
    order = np.argsort(-score, kind="stable")
    code = rows.column("g").combine_chunks().dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    names, code = code.dictionary, code.indices.to_numpy(zero_copy_only=False)
    held = None
    for at in range(0, len(order), max(1, BLOCK // replicates)):
        r = order[at : at + max(1, BLOCK // replicates)]
        used, place = np.unique(code[r], return_inverse=True)
        w, s = drawn(seed, [x.encode() for x in names.take(pa.array(used)).to_pylist()], replicates, multiplicity), score[r]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        many, positive = (_weighted(w, place, x[r], starts).astype(np.float64) for x in (n, pos))
        s = s[starts]
        if held is not None:  # the last score of the block before may go on
            if held[0][0] == s[0]:
                many[0] += held[1][0]
                positive[0] += held[2][0]
            else:
                yield held
        if len(s) > 1:
            yield s[:-1], many[:-1], positive[:-1]
        held = s[-1:], many[-1:], positive[-1:]
    if held is not None:
        yield held


def bootstrap_metrics(df: DataFrame, y: Column, score: Column, group: Column, replicates: int = 1000, seed: str = "0", threshold: float = 0.5, specificity: float = 0.95, level: float = 0.95, multiplicity: bool = True, part_rows: int = PART_ROWS, most_cells: int = CELLS) -> DataFrame:
    """(metric, mean, low, high, replicates) of the eight binary metrics over replicates of whole groups.

    A group's weight in a replicate is Poisson(1), read off md5(seed:replicate:group), or with
    ``multiplicity`` off whether that weight is positive.
    Rows meet at (replicate, score) before any ranking, so equal scores are one step of the average
    precision. The threshold at a specificity is as in ``sensitivity_at``, but a single negative is never
    given up. A replicate without positives has no auroc and auprc, one without negatives no auroc and no
    metric at a specificity; ``replicates`` counts those with a value. Other ratios over nothing are 0.

    All replicates have the same order of scores, so scores are dealt to at most ``most_cells`` cells once: one score a
    cell, or where there are more scores ranges of about equal size. Rows meet by group, each task draws the weights
    of its groups and returns a sum for each of its cells and replicates, so weights are never moved. Cells of several
    scores are weighed once more, each behind what is before it; weights are drawn from the same hashes again.
    """
    if replicates < 1:
        raise ValueError("a replicate is required")
    base = df.select(group.cast("string").alias("g"), y.cast("int").alias("y"), F.nanvl(score.cast("double"), F.lit(float("inf"))).alias("score")).where("y IS NOT NULL AND score IS NOT NULL")
    spark = df.sparkSession
    ship_package(spark)
    base = written(base.groupBy(F.coalesce("g", F.lit("")).alias("g"), "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), "bootstrap")
    some = base.select("score").distinct().limit(most_cells + 1).collect()
    few = len(some) <= most_cells
    if few:
        cuts = [r["score"] for r in some]
    else:
        count = min(most_cells, -(-base.count() // part_rows))
        cuts = base.agg(F.percentile_approx("score", [i / count for i in range(1, count)], 100_000).alias("cuts")).first()["cuts"] if count > 1 else []
    edges_ = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def cell_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges_, x.to_numpy(), "left").astype(np.int32))

    placed = written(base.select("g", "score", "n", "pos", cell_of("score").alias("cell")), "bootstrap")
    size = placed.agg(F.approx_count_distinct("g").alias("g"), F.max("cell").alias("c")).first()
    by_group = placed.select("g", "cell", "n", "pos") if few else placed.groupBy("g", "cell").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # what a task returns does not grow with its rows, so tasks are as many as keep the cores busy
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-size["g"] * replicates // DRAWS)))
    sums_ = by_group.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(_cell_sums(seed, replicates, multiplicity, (size["c"] or 0) + 1), "cell int, n array<long>, pos array<long>")
    met_cells = written(sums_.groupBy("cell").applyInArrow(_added, "cell int, n array<long>, pos array<long>"), "cells")
    ranges = written(placed.groupBy("cell").agg(F.max("score").alias("score"), (F.max("score") == F.min("score")).alias("edge")), "ranges")
    long = met_cells.join(F.broadcast(ranges), "cell").select("cell", "score", "edge", F.posexplode(F.arrays_zip("n", "pos")).alias("r", "x"))
    met = long.select("r", "score", "edge", F.col("x.n").cast("double").alias("n"), F.col("x.pos").cast("double").alias("pos"), F.col("cell").alias("part"))
    whole = Window.partitionBy("r")
    w = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    frame = written(met.withColumns({"cum_n": F.sum("n").over(w), "cum_pos": F.sum("pos").over(w), "p": F.sum("pos").over(whole), "q": F.sum(F.col("n") - F.col("pos")).over(whole)}), "steps")
    before = frame.where("NOT edge").select("part", "r", (F.col("cum_n") - F.col("n")).alias("cn"), (F.col("cum_pos") - F.col("pos")).alias("cp"), "q").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("r", "cn", "cp", "q"))).alias("b"))
    before = before.select(F.col("part").alias("cell"), F.concat(F.col("b.cn"), F.col("b.cp"), F.col("b.q")).alias("before"))
    sums = ("wins", "steps", "tp", "fp", "tp2", "fp2")

    def inside(rows: pa.Table, given: pa.Table) -> pa.Table:
        out = np.zeros((len(sums), replicates))
        if rows.num_rows and given.num_rows:
            cn, cp, q = given.column("before").combine_chunks().flatten().to_numpy().reshape(3, replicates)
            k = np.floor((1 - specificity) * q + 1e-9)
            for s, n, p in _replicated(rows, seed, replicates, multiplicity):
                neg, upto, ahead = n - p, cn + np.cumsum(n, 0), cp + np.cumsum(p, 0)
                below = upto - ahead
                over = np.where(k >= q, below - neg < q, below < np.maximum(k, 1))
                hit = (s >= threshold)[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    step = np.where(p > 0, p * ahead / upto, 0)
                out += [(p * (neg / 2) - p * below).sum(0), step.sum(0), (p * hit).sum(0), (neg * hit).sum(0), (p * over).sum(0), (neg * over).sum(0)]
                cn, cp = upto[-1], ahead[-1]
        return pa.Table.from_arrays([pa.array([list(x)], pa.list_(pa.float64())) for x in out], list(sums))

    ranged = placed.join(F.broadcast(ranges.where("NOT edge").select("cell")), "cell", "left_semi")
    inner = ranged.groupBy("cell").cogroup(before.groupBy("cell")).applyInArrow(inside, ", ".join(f"{c} array<double>" for c in sums))
    inner = inner.select(F.posexplode(F.arrays_zip(*sums)).alias("r", "x")).select("r", "x.*")
    neg, below = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    k = F.floor((1 - specificity) * F.col("q") + 1e-9)
    over = F.when(k >= F.col("q"), below - neg < F.col("q")).otherwise(below < F.greatest(k, F.lit(1)))
    hit = F.col("score") >= threshold
    held = lambda c, at: F.when(at, c).otherwise(0.0)
    edges = frame.where("edge").select("r", (F.col("pos") * (neg / 2.0) - F.col("pos") * below).alias("wins"), F.when(F.col("pos") > 0, F.col("pos") * F.col("cum_pos") / F.col("cum_n")).otherwise(0.0).alias("steps"), held(F.col("pos"), hit).alias("tp"), held(neg, hit).alias("fp"), held(F.col("pos"), over).alias("tp2"), held(neg, over).alias("fp2"))
    added = (edges if few else edges.unionByName(inner)).groupBy("r").agg(*[F.sum(c).alias(c) for c in sums])
    totals = frame.groupBy(F.col("r").alias("__r")).agg(F.max("p").alias("p"), F.max("q").alias("q"))
    done = added.join(totals, F.col("r") == F.col("__r")).where("p + q > 0")
    p, q, tp, fp = (F.col(c) for c in ("p", "q", "tp", "fp"))
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, p)
    values = {
        "auroc": F.when((p > 0) & (q > 0), (F.col("wins") + p * q) / (p * q)),
        "auprc": F.when(p > 0, F.col("steps") / p),
        "accuracy": safe_div(tp + q - fp, p + q),
        "sensitivity": recall,
        "specificity": safe_div(q - fp, q),
        "f1": safe_div(2 * precision * recall, precision + recall),
        "sensitivity_at_spec": F.when(q > 0, safe_div(F.col("tp2"), p)),
        "specificity_at_spec": F.when(q > 0, safe_div(q - F.col("fp2"), q)),
    }
    long = done.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), values[m].cast("double").alias("value")) for m in BOOTSTRAPPED])))
    a = (1 - level) / 2
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(a)).alias("low"), F.percentile("value", F.lit(1 - a)).alias("high"), F.count("value").alias("replicates"))
