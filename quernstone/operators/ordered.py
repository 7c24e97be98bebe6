"""Ordered computation: run logs, moving averages, gap filling, as-of interpolation, caps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.scratch import written


def best_epoch(df: DataFrame, run: str, epoch: str, metric: str, larger: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Best metric of each run and its epoch, the first on ties, with sibling columns."""
    m = -F.col(metric) if larger else F.col(metric)
    best = F.min_by(F.struct(epoch, metric, *carry), F.struct(m, F.col(epoch)))
    return df.where(F.col(metric).isNotNull()).groupBy(run).agg(best.alias("b"), F.count(F.lit(1)).alias("epochs")).select(run, "epochs", "b.*")


def run_status(lines: Column, broken: Column, last_checkpoint: Column, checkpoints: Column) -> Column:
    """no_metrics without a log, metrics_parse_error if any line is broken, empty_metrics without lines; else ok,
    unless there are checkpoints but not the last one: incomplete."""
    return (
        F.when(lines.isNull(), "no_metrics").when(broken > 0, "metrics_parse_error").when(lines == 0, "empty_metrics")
        .when(F.coalesce(last_checkpoint, F.lit(False)), "ok").when(F.coalesce(checkpoints, F.lit(False)), "incomplete").otherwise("ok")
    )


def leaderboard(df: DataFrame, by: Sequence[str], ok: Column, metric: str, name: str, k: int) -> DataFrame:
    """The k best of each group: complete ones first, then by metric, then by name."""
    w = Window.partitionBy(*by).orderBy(ok.desc(), F.desc_nulls_last(metric), F.col(name))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def early_stop(df: DataFrame, run: str, epoch: str, metric: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """(run, best_epoch, best, stop_epoch) of a fold: only gains over min_delta count, patience misses stop.

    A run's epochs are one array: their number is bounded by training, not by the corpus.
    """
    seq = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(metric).cast("double").alias("m"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("misses"), F.lit(None).cast("long").alias("stop"))

    def step(s, x):
        gain = s["best"].isNull() | (x["m"] > s["best"] + min_delta)
        going = F.struct(
            F.when(gain, x["m"]).otherwise(s["best"]).alias("best"),
            F.when(gain, x["e"]).otherwise(s["at"]).alias("at"),
            F.when(gain, F.lit(0)).otherwise(s["misses"] + 1).alias("misses"),
            F.when(~gain & (s["misses"] + 1 >= patience), x["e"]).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(going)

    folded = df.groupBy(run).agg(F.aggregate(seq, start, step).alias("s"))
    return folded.select(run, F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best"), F.col("s.stop").alias("stop_epoch"))


def seed_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count of metrics by group, null keys kept."""
    return df.groupBy(*by).agg(*[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std_samp"), F.count(m).alias(f"{m}_n"))])


@dataclass
class Segments:
    """Rows in range parts of (group, order), so that a group of any size lies in many tasks.

    ``rows`` is a written table with ``__part`` and ``__tie``, which orders rows with the same group and order;
    ``inside`` is a window over one group's rows in one part, and ``back`` the same in falling order. A part
    ends at most one group that began before it and leaves at most one open, so what is carried from part to
    part (``carried``) has at most two rows a part: its size is bounded by the number of parts.
    """

    rows: DataFrame
    group: str
    order: str

    @classmethod
    def of(cls, df: DataFrame, group: str, order: str, parts: int | None = None) -> Segments:
        keys = [group, order, "__tie"]
        tied = df.withColumn("__tie", F.monotonically_increasing_id())
        ranged = tied.repartitionByRange(parts, *keys) if parts else tied.repartitionByRange(*keys)
        return cls(written(ranged.withColumn("__part", F.spark_partition_id()), "segments"), group, order)

    def window(self, down: bool = False):
        keys = [F.desc(self.order), F.desc("__tie")] if down else [F.asc(self.order), F.asc("__tie")]
        return Window.partitionBy("__part", self.group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)

    def carried(self, state: dict[str, Column], carry) -> DataFrame:
        """(__part, group, carried columns) of the groups that lie in several parts.

        ``state`` are aggregates of a group's rows in a part; ``carry`` maps a window over a group's parts to the
        columns that a part gets from the others.
        """
        names = [f"__s_{k}" for k in state]
        each = self.rows.groupBy("__part", self.group).agg(*[c.alias(n) for n, c in zip(names, state.values(), strict=True)])
        w = Window.partitionBy(self.group)
        many = each.withColumn("__parts", F.count(F.lit(1)).over(w)).where("__parts > 1")
        return many.select(F.col("__part").alias("__p2"), F.col(self.group).alias("__g2"), *[c.alias(n) for n, c in carry(w.orderBy("__part")).items()])

    def join(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        on = (F.col("__part") == F.col("__p2")) & F.col(self.group).eqNullSafe(F.col("__g2"))
        return rows.join(F.broadcast(carried), on, "left").drop("__p2", "__g2")


BEFORE, AFTER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def moving_average(df: DataFrame, group: str, order: str, value: str, reach: int, parts: int | None = None) -> DataFrame:
    """Adds ``smooth``: the mean of up to ``reach`` rows on each side, fewer at the ends.

    A part borrows the ``reach`` rows before and after it from its neighbours, through their ends.
    """
    if reach < 1:
        return df.withColumn("smooth", F.col(value).cast("double"))
    s = Segments.of(df, group, order, parts)
    fields = [order, "__tie", value]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(fields)])
    # Only ends of parts are collected: each group's first and last rows in a part, ``reach`` of either.
    up, down = (F.row_number().over(s.window(d)) for d in (False, True))
    ends = s.rows.select("__part", group, row.alias("row"), up.alias("first"), down.alias("last")).where((F.col("first") <= reach) | (F.col("last") <= reach))
    by_part = ends.groupBy("__part", group).agg(F.array_sort(F.collect_list(F.when(F.col("first") <= reach, F.col("row")))).alias("head"), F.array_sort(F.collect_list(F.when(F.col("last") <= reach, F.col("row")))).alias("tail"))
    w = Window.partitionBy(group).orderBy("__part")
    # Every part of a group has a row, so ``reach`` parts on either side hold all the rows that are needed.
    before = F.flatten(F.collect_list("tail").over(w.rowsBetween(-reach, -1)))
    after = F.flatten(F.collect_list("head").over(w.rowsBetween(1, reach)))
    nearby = by_part.select("__part", group, before.alias("before"), after.alias("after"))
    borrowed = nearby.select("__part", group, F.explode(F.concat(F.slice(F.reverse("before"), 1, reach), F.slice("after", 1, reach))).alias("row"))
    lent = borrowed.select("__part", group, *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(fields)], F.lit(True).alias("__lent"))
    both = s.rows.unionByName(lent, allowMissingColumns=True)
    near = Window.partitionBy("__part", group).orderBy(order, "__tie").rowsBetween(-reach, reach)
    return both.withColumn("smooth", F.avg(value).over(near)).where("__lent IS NULL").select(*df.columns, "smooth")


def peak(df: DataFrame, group: str, order: str, value: str, digits: int = 9) -> DataFrame:
    """The first place of each group's largest value, compared after rounding."""
    return df.groupBy(group).agg(F.min_by(F.struct(order, value), F.struct(-F.round(value, digits), F.col(order))).alias("b")).select(group, "b.*")


def cumulative_max(df: DataFrame, group: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Adds ``cummax``: the largest value so far; null before the first value. Parts carry the largest of those before."""
    s = Segments.of(df, group, order, parts)
    carried = s.carried({"most": F.max(value)}, lambda w: {"__most": F.max("__s_most").over(w.rowsBetween(*BEFORE))})
    local = s.rows.withColumn("cummax", F.max(value).over(s.window()))
    return s.join(local, carried).select(*df.columns, F.greatest("cummax", "__most").alias("cummax"))


def _around(s: Segments, known: Column, count: bool) -> DataFrame:
    """The segments' rows with ``lo`` and ``hi``, the nearest known struct at or before and at or after, across parts.

    With ``count``, known structs begin with ``i``, the 1-based place in the part, which becomes that in the group.
    """
    rows = s.rows.withColumn("__i", F.row_number().over(s.window())) if count else s.rows
    held = Segments(rows.withColumn("__k", known), s.group, s.order)
    here = F.when(F.col("__k").isNotNull(), F.struct(s.order, "__tie"))
    state = {"n": F.count(F.lit(1)), "first": F.min_by("__k", here), "last": F.max_by("__k", here)}

    def carry(w):
        # places of a carried struct count from the start of its own part, so its part's offset goes with it
        offset = F.coalesce(F.sum("__s_n").over(w.rowsBetween(*BEFORE)), F.lit(0))
        return {"__off": offset, "__first": F.col("__s_first"), "__last": F.col("__s_last")}

    each = held.carried(state, carry)
    w = Window.partitionBy("__g2").orderBy("__p2")
    tagged = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("k"), F.col("__off").alias("off")))
    carried = each.select(
        "__p2", "__g2", "__off", F.last(tagged("__last"), True).over(w.rowsBetween(*BEFORE)).alias("__before"),
        F.last(tagged("__first"), True).over(Window.partitionBy("__g2").orderBy(F.desc("__p2")).rowsBetween(*BEFORE)).alias("__after"),
    )
    # Both windows look back, one in falling order: a frame with an open end is quadratic in its part.
    local = held.rows.withColumns({"__lo": F.last("__k", True).over(s.window()), "__hi": F.last("__k", True).over(s.window(True))})
    joined = s.join(local, carried).withColumn("__off", F.coalesce("__off", F.lit(0)))
    place = lambda k, off: k.withField("i", k["i"] + off) if count else k
    other = lambda c: F.when(F.col(c).isNotNull(), place(F.col(f"{c}.k"), F.col(f"{c}.off")))
    own = lambda c: F.when(F.col(c).isNotNull(), place(F.col(c), F.col("__off")))
    out = joined.withColumns({"lo": F.coalesce(own("__lo"), other("__before")), "hi": F.coalesce(own("__hi"), other("__after"))})
    return out.withColumn("__at", F.col("__i") + F.col("__off")) if count else out


def fill_linear(df: DataFrame, group: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Adds ``filled``: gaps between known values on a line over row places, flat at the ends."""
    s = Segments.of(df, group, order, parts)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").cast("long").alias("i"), F.col(value).cast("double").alias("x")))
    rows = _around(s, known, True)
    line = F.col("lo.x") + (F.col("hi.x") - F.col("lo.x")) * (F.col("__at") - F.col("lo.i")) / (F.col("hi.i") - F.col("lo.i"))
    filled = F.coalesce(F.col(value).cast("double"), F.when(F.col("lo").isNull(), F.col("hi.x")).when(F.col("hi").isNull(), F.col("lo.x")).otherwise(line))
    return rows.select(*df.columns, filled.alias("filled"))


def median_spacing(df: DataFrame, group: str, order: str) -> DataFrame:
    """Median of the positive steps between neighbours, and their count; a group is one stack of slices."""
    step = F.col(order) - F.lag(order).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("__d", step.cast("double")).where("__d > 0").groupBy(group).agg(F.median("__d").alias("spacing"), F.count(F.lit(1)).alias("steps"))


def interpolate_asof(points: DataFrame, grid: DataFrame, group: str, x: str, y: str, at: str, parts: int | None = None) -> DataFrame:
    """``y`` on a grid, linear between the points around and flat outside; points at the same place are averaged.

    Points and grid are merged by order within the group, so each row sees only the last point before
    and the first after; no range join, and a group of any size lies in many tasks.
    """
    p = points.select(group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).groupBy(group, "__x").agg(F.avg("__y").alias("__y"))
    both = p.withColumn("__grid", F.lit(False)).unionByName(grid.select(group, F.col(at).cast("double").alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(True).alias("__grid")))
    s = Segments.of(both, group, "__x", parts)
    known = F.when(~F.col("__grid"), F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    # A point at a grid's own place may lie on either side of it among rows with the same order; the line is its value from both.
    rows = _around(s, known, False).where("__grid")
    line = F.when(F.col("hi.x") == F.col("lo.x"), F.col("lo.y")).otherwise(F.col("lo.y") + (F.col("hi.y") - F.col("lo.y")) * (F.col("__x") - F.col("lo.x")) / (F.col("hi.x") - F.col("lo.x")))
    value = F.when(F.col("lo").isNull(), F.col("hi.y")).when(F.col("hi").isNull(), F.col("lo.y")).otherwise(line)
    return rows.select(group, F.col("__x").alias(at), value.alias(y))


def cap_per_unit(df: DataFrame, unit: Sequence[str], order: str, k: int) -> DataFrame:
    """The first k rows of each unit."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*unit).orderBy(order))).where(F.col("__r") <= k).drop("__r")


def top_weights(weights: Column, k: int) -> Column:
    """The k largest weights with their places, as (index, weight)."""
    ranked = F.array_sort(F.transform(weights, lambda w, i: F.struct((-w).alias("neg"), i.alias("index"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["index"].alias("index"), (-s["neg"]).alias("weight")))


def block_around(best: Column, n: Column, k: int) -> Column:
    """First place of a block of k centred on ``best``, clamped to 0..n-k."""
    return F.greatest(F.lit(0), F.least(best - k // 2, n - k))
