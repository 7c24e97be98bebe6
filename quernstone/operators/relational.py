"""Labels, views, unpivots, matching, audits and profiles of labelled cohorts."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.metrics import running_totals
from quernstone.scratch import written


#: The binary label views by name, each with its positive and its negative codes. Other codes
#: are not part of a view.
VIEWS: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {
    "normal_vs_diseased": ((1, 2, 3, 4), (5,)),
    "normal_vs_abnormal": ((1, 2, 3, 4, 6), (5,)),
    "normal_vs_csoma": ((1,), (5,)),
    "normal_vs_cholesteatoma": ((2,), (5,)),
    "normal_vs_cholesterol_granuloma": ((4,), (5,)),
    "normal_vs_ome": ((3,), (5,)),
    "ome_vs_cholesterol_granuloma": ((4,), (3,)),
    "cholesteatoma_vs_csoma": ((1,), (2,)),
    "cholesteatoma_vs_other_abnormal": ((2,), (1, 3, 4, 6)),
}
#: The name of the view of all six classes, and other names of views.
SIX_CLASS = "six_class"
ALIASES = {
    "6": "six_class",
    "6class": "six_class",
    "multiclass": "six_class",
    "二分类_正常_vs_患病": "normal_vs_diseased",
    "正常vs患病": "normal_vs_diseased",
    "正常vs非正常": "normal_vs_abnormal",
    "正常vs异常": "normal_vs_abnormal",
    "正常vs慢性化脓性中耳炎": "normal_vs_csoma",
    "正常vs中耳胆脂瘤": "normal_vs_cholesteatoma",
    "正常vs胆固醇肉芽肿": "normal_vs_cholesterol_granuloma",
    "正常vs分泌性中耳炎": "normal_vs_ome",
    "分泌性中耳炎vs胆固醇肉芽肿": "ome_vs_cholesterol_granuloma",
    "中耳胆脂瘤vs慢性化脓性中耳炎": "cholesteatoma_vs_csoma",
    "胆脂瘤vs其他异常": "cholesteatoma_vs_other_abnormal",
} | {"abnormal": "normal_vs_abnormal", "diseased": "normal_vs_diseased"}  # the last two are short names of our own


def views_frame(spark, views: dict | None = None) -> DataFrame:
    """(view, code, y) of every code that a view uses."""
    rows = [(v, c, y) for v, (pos, neg) in (views or VIEWS).items() for y, codes in ((1, pos), (0, neg)) for c in codes]
    return spark.createDataFrame(rows, "view string, code int, y int")


def resolve_view(name: str, views: dict | None = None) -> str:
    """A view's name from any of its names; others raise, naming those there are."""
    asked = name.strip()
    views = VIEWS if views is None else views
    found = ALIASES.get(asked, asked)
    if found != SIX_CLASS and found not in views:
        raise ValueError(f"there is no view {asked!r}; those known are {sorted([SIX_CLASS, *views])}")
    return found


def keep_labelled(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.where(F.col(left).isNotNull() | F.col(right).isNotNull())


def mask_codes(df: DataFrame, left: str, right: str, keep: Sequence[int] | None = None, drop: Sequence[int] | None = None) -> DataFrame:
    """Null unwanted codes on each side, then drop rows without any; a code outside 1..6 raises."""
    for c in (*(keep or ()), *(drop or ())):
        if not 1 <= c <= 6:
            raise ValueError(f"code {c} is outside 1..6")

    def kept(c: Column) -> Column:
        ok = F.lit(True)
        if keep is not None:
            ok = ok & c.isin(*keep)
        if drop:
            ok = ok & ~c.isin(*drop)
        return F.when(ok, c)

    return keep_labelled(df.withColumns({left: kept(F.col(left)), right: kept(F.col(right))}), left, right)


def drop_units(df: DataFrame, left: str, right: str, codes: Sequence[int]) -> DataFrame:
    """Drop a row when either side has a listed code; rows without codes stay."""
    hit = lambda c: F.coalesce(F.col(c).isin(*codes), F.lit(False))
    return df.where(~(hit(left) | hit(right)))


def label_views(parts: DataFrame, views: DataFrame, code: str = "code") -> DataFrame:
    """Every part under every view that uses its code, long: view and y."""
    return parts.join(F.broadcast(views.withColumnRenamed("code", "__code")), F.col(code) == F.col("__code")).drop("__code")


def unpivot_sides(df: DataFrame, ids: Sequence[str], left: str, right: str, keep_null: bool = True) -> DataFrame:
    """Two rows a unit: side and code; without ``keep_null`` those without a code go."""
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("code")) for n, c in (("left", left), ("right", right))])
    out = df.select(*ids, F.inline(sides))
    return out if keep_null else out.where(F.col("code").isNotNull())


def dense_counts(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Counts of all listed values, zeros too."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return F.broadcast(listed).join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").fillna(0, ["n"])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def pick_child(children: DataFrame, unit: str, child: str) -> DataFrame:
    """For each unit the child with the most rows, the smaller name on ties, and whether there was a choice."""
    counts = children.groupBy(unit, child).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(F.col(child), F.col("n")), F.struct(-F.col("n"), F.col(child)))
    return counts.groupBy(unit).agg(best.alias("b"), (F.count(F.lit(1)) > 1).alias("ambiguous")).select(unit, f"b.{child}", "b.n", "ambiguous")


def attach_owner(df: DataFrame, owners: DataFrame, unit: str, owner: str) -> DataFrame:
    """Owner by unit; a unit without one is its own: ``UNIT_<id>``."""
    found = owners.groupBy(unit).agg(F.min(F.nullif(F.col(owner).cast("string"), F.lit(""))).alias(owner))
    return df.join(found, unit, "left").withColumn(owner, F.coalesce(owner, F.concat(F.lit("UNIT_"), F.col(unit).cast("string"))))


def attach_series(parts: DataFrame, meta: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """``parts`` with ``columns`` of their series' metadata, null where there is none; no part is lost or doubled.

    Of several rows of metadata with the same keys the first by ``order`` counts; a null key has no metadata. The metadata
    is one narrow row a series after a partial aggregate.
    """
    first = meta.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*columns), F.struct(order, *columns)).alias("__m"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    return parts.join(first, on, "left").select(*parts.columns, *[F.col(f"__m.{c}").alias(c) for c in columns])


def match_audit(labels: DataFrame, stored: DataFrame, unit: str, date: str) -> DataFrame:
    """One row: labels matched by id and date, by id with another date only, and missing."""
    dates = stored.groupBy(unit).agg(F.collect_set(date).alias("__dates"))
    both = labels.join(dates, unit, "left")
    hit, there = F.array_contains("__dates", F.col(date)), F.col("__dates").isNotNull()
    return both.agg(F.count(F.lit(1)).alias("labels"), F.count_if(there & F.coalesce(hit, F.lit(False))).alias("id_and_date"), F.count_if(there & ~F.coalesce(hit, F.lit(False))).alias("id_only"), F.count_if(~there).alias("missing"))


def leaking_owners(df: DataFrame, owner: str, split: str) -> DataFrame:
    """Owners in more than one split, all pairs of splits considered."""
    return df.groupBy(owner).agg(F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")


def order_statistics(df: DataFrame, value: str, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles as NumPy interpolates them, of any number of rows a group.

    Rows meet at (group, value), and two-level running totals give the places of values, so no task holds a
    whole group. Values must be finite or null; nulls do not count.
    """
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n")), "values")
    frame = running_totals(counts, "__x", ["__n"], by, totals=True)
    upto = F.col("all___n") - F.col("cum___n") + F.col("__n")  # rows with this value or a smaller one
    at = lambda k: F.min(F.when(upto > k, F.col("__x")))
    place = lambda p: (F.col("all___n") - 1) * F.lit(float(p))
    cells = [c for i, p in enumerate(points) for c in (at(F.floor(place(p))).alias(f"__l{i}"), at(F.ceil(place(p))).alias(f"__h{i}"))]
    out = frame.groupBy(*by).agg(F.max("all___n").alias("n"), *cells)
    share = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return out.select(*by, "n", *[(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * share(p)).alias(f"q{i}") for i, p in enumerate(points)])


def profile(df: DataFrame, column: str, by: Sequence[str] = (), points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """n, mean, population std, min, quantiles and max of finite values, in groups; exact, in bounded tasks."""
    x = F.col(column).cast("double")
    ok = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(*by, x.alias("__v"))
    moments = ok.groupBy(*by).agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std_pop"), F.min("__v").alias("min"), F.max("__v").alias("max"))
    places = order_statistics(ok, "__v", by, points)
    cells = [F.col(f"q{i}").alias(f"p{round(100 * p)}") for i, p in enumerate(points)]
    if not by:
        row = moments.withColumn("__q", places.select(F.struct("*")).scalar())
        return row.select(F.coalesce("__q.n", F.lit(0)).alias("n"), "mean", "std_pop", "min", "max", *[F.col(f"__q.q{i}").alias(f"p{round(100 * p)}") for i, p in enumerate(points)])
    renamed = places.withColumnsRenamed({c: f"__g{i}" for i, c in enumerate(by)})
    joined = moments.join(renamed, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)])
    return joined.select(*by, "n", "mean", "std_pop", "min", "max", *cells)


def profile_cells(df: DataFrame, column: str, dims: dict[str, Sequence], points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """``profile`` for every combination of the listed values, with n = 0 where there are no rows."""
    names, kinds = list(dims), {f.name: f.dataType.simpleString() for f in df.schema}
    cells = list(itertools.product(*dims.values()))
    listed = df.sparkSession.createDataFrame(cells, ", ".join(f"{n} {kinds[n]}" for n in names))
    return F.broadcast(listed).join(profile(df, column, names, points), names, "left").fillna(0, ["n"])


def value_counts(df: DataFrame, column: str, top: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts by value, null as ``NA``; with ``top`` the most frequent, smaller value first on ties."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("value")
    out = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows and most frequent label of each group, the smaller label on ties."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("n"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("label"))


def class_weights(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """total / (classes present * n) of each class; a class without rows has weight 1."""
    counts = dense_counts(df.where(F.col(label).isNotNull()), label, classes)
    totals = df.where(F.col(label).isin(*classes)).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(label).alias("k"))
    return counts.withColumn("total", totals.select("total").scalar()).withColumn("k", totals.select("k").scalar()).select(label, "n", F.when(F.col("n") > 0, F.col("total") / (F.col("k") * F.col("n"))).otherwise(F.lit(1.0)).alias("weight"))


def unit_weights(parts: DataFrame, weights: DataFrame, unit: str, label: str) -> DataFrame:
    """Mean, largest and summed weight of a unit's parts; 1 if no part has one."""
    joined = parts.join(F.broadcast(weights.select(label, "weight")), label, "left")
    one = lambda f: F.coalesce(f("weight"), F.lit(1.0))
    return joined.groupBy(unit).agg(one(F.avg).alias("mean_weight"), one(F.max).alias("max_weight"), one(F.sum).alias("sum_weight"))


def mad_outliers(df: DataFrame, value: str, group: str, k: float, cap: float | None = None, order: str | None = None) -> DataFrame:
    """Rows above median + k * MAD of their group, at most floor(cap * n) of the largest; MAD near 0 flags none.

    Medians are exact and of bounded tasks; what is flagged is the tail, whose ranks count values first and
    rows of equal values after.
    """
    med = order_statistics(df, value, [group], [0.5]).select(F.col(group).alias("__g"), F.col("q0").alias("median"), F.col("n"))
    with_med = df.join(med, F.col(group) == F.col("__g")).drop("__g")
    apart = with_med.select(group, F.abs(F.col(value) - F.col("median")).alias("__d"))
    mad = order_statistics(apart, "__d", [group], [0.5]).select(F.col(group).alias("__g"), F.col("q0").alias("mad")).where("mad > 1e-12")
    out = with_med.join(mad, F.col(group) == F.col("__g")).drop("__g").where(F.col(value) > F.col("median") + k * F.col("mad"))
    if cap is None:
        return out
    out = written(out, "flagged")
    counts = out.groupBy(group, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = running_totals(written(counts, "flagged-values"), "__x", ["__n"], [group]).select(F.col(group).alias("__g"), "__x", (F.col("cum___n") - F.col("__n")).alias("__before"))
    tied = F.row_number().over(Window.partitionBy(group, value).orderBy(order))
    most = F.floor(F.col("n") * cap)
    near = out.join(ahead, (F.col(group) == F.col("__g")) & (F.col(value).cast("double") == F.col("__x"))).where(F.col("__before") < most)
    return near.withColumn("rank", (tied + F.col("__before")).cast("int")).where(F.col("rank") <= most).drop("__g", "__x", "__before")


def trimmed_mean(df: DataFrame, group: str, value: str, drop: float) -> DataFrame:
    """Mean of each group's ceil((1 - drop) * n) smallest values, from counts of values."""
    counts = written(df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n")), "values")
    frame = running_totals(counts, "__x", ["__n"], [group], totals=True)
    keep = F.ceil(F.col("all___n") * (1 - drop))
    taken = F.least(F.col("__n"), F.greatest(F.lit(0), keep - (F.col("all___n") - F.col("cum___n"))))
    return frame.groupBy(group).agg((F.sum(F.col("__x") * taken) / F.sum(taken)).alias("mean"), F.sum(taken).cast("long").alias("kept"))


def null_census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, distinct) of each column, in one pass."""
    row = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c)).alias("n_distinct")).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.col(c) for c in columns])))


def keep_relevant(df: DataFrame, left: str, right: str, codes: Sequence[int]) -> DataFrame:
    """Rows with a listed code on either side."""
    return df.where(F.coalesce(F.col(left).isin(*codes), F.lit(False)) | F.coalesce(F.col(right).isin(*codes), F.lit(False)))


def code_flags(code: Column, flags: dict[str, Sequence[int]]) -> list[Column]:
    """A boolean column for each flag: whether the code is one of its codes; a null code is none."""
    return [F.coalesce(code.isin(*codes), F.lit(False)).alias(name) for name, codes in flags.items()]


def view_columns(code: Column, views: dict | None = None) -> list[Column]:
    """For every view valid__<view>, whether it uses the code, and y__<view>: 1, 0 or null."""
    out = []
    for view, (pos, neg) in (VIEWS if views is None else views).items():
        y = F.when(code.isin(*pos), 1).when(code.isin(*neg), 0)
        out += [y.isNotNull().alias(f"valid__{view}"), y.alias(f"y__{view}")]
    return out


def relabel_slots(labels: Column, mask: Column, pos: Sequence[int], neg: Sequence[int]) -> tuple[Column, Column]:
    """Labels and mask of slots under a view: class ids of its positive codes become 1, all others 0, and the
    mask stays only where the view uses the class."""
    p, used = [c - 1 for c in pos], [c - 1 for c in (*pos, *neg)]
    known = lambda y, ids: F.coalesce(y.isin(*ids), F.lit(False))
    return F.transform(labels, lambda y: known(y, p).cast("int")), F.zip_with(labels, mask, lambda y, m: m & known(y, used))


def membership_split(df: DataFrame, key: str, train: DataFrame, val: DataFrame) -> DataFrame:
    """Adds ``split``: train where the key is of train, else val where it is of val, else other."""
    flags = lambda d, name: d.select(F.col(key).alias(f"__{name}")).distinct()
    out = df.join(flags(train, "t"), F.col(key) == F.col("__t"), "left").join(flags(val, "v"), F.col(key) == F.col("__v"), "left")
    return out.withColumn("split", F.when(F.col("__t").isNotNull(), "train").when(F.col("__v").isNotNull(), "val").otherwise("other")).drop("__t", "__v")


def unpivot_texts(df: DataFrame, ids: Sequence[str], left: str, right: str, text: str, classes: int = 6) -> DataFrame:
    """(ids, side, class_id, text) of labelled sides with a text that is not blank."""
    parts = unpivot_sides(df.where(F.trim(F.coalesce(text, F.lit(""))) != ""), [*ids, text], left, right)
    return parts.where(F.col("code").between(1, classes)).select(*ids, "side", (F.col("code") - 1).alias("class_id"), text)


def distinct_parts(df: DataFrame, unit: str, left: str, right: str) -> DataFrame:
    """One row for each labelled (unit, side), with the smallest code where rows repeat."""
    return unpivot_sides(df, [unit], left, right, keep_null=False).groupBy(unit, "side").agg(F.min("code").alias("code"))


def stack_codes(df: DataFrame, left: str, right: str) -> DataFrame:
    """Both code columns as one, nulls dropped."""
    return df.select(F.explode(F.array(left, right)).alias("code")).where("code IS NOT NULL")


def slot_rows(df: DataFrame, ids: Sequence[str], label: str, mask: str, prediction: str, probabilities: str, slots: Sequence[str] = ("left", "right")) -> DataFrame:
    """A row for each masked slot of arrays by slot: side, y_true, y_pred, probs and whether they agree."""
    zipped = F.arrays_zip(F.col(label).alias("y_true"), F.col(mask).alias("m"), F.col(prediction).alias("y_pred"), F.col(probabilities).alias("probs"))
    rows = df.select(*ids, F.posexplode(zipped).alias("__slot", "z")).where("z.m")
    side = F.get(F.array(*[F.lit(s) for s in slots]), F.col("__slot"))
    return rows.select(*ids, side.alias("side"), "z.y_true", "z.y_pred", (F.col("z.y_true") == F.col("z.y_pred")).alias("correct"), "z.probs")


def probability_columns(df: DataFrame, probabilities: str, classes: int, most: int = 12) -> DataFrame:
    """Adds p_0 ... p_<classes-1>, unless there are more than ``most`` classes."""
    return df.withColumns({f"p_{k}": F.get(F.col(probabilities), k) for k in range(classes)}) if classes <= most else df


def wide_predictions(rows: DataFrame, ids: Sequence[str], names: dict[int, str], slots: Sequence[str] = ("left", "right")) -> DataFrame:
    """One row a unit: label, prediction, their names and the largest probability of each slot."""
    name = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return rows.groupBy(*ids).agg(*[f for s in slots for f in (
        F.max(F.when(F.col("side") == s, F.col("y_true"))).alias(f"{s}_label"),
        F.max(F.when(F.col("side") == s, F.try_element_at(name, F.col("y_true")))).alias(f"{s}_name"),
        F.max(F.when(F.col("side") == s, F.col("y_pred"))).alias(f"{s}_pred"),
        F.max(F.when(F.col("side") == s, F.try_element_at(name, F.col("y_pred")))).alias(f"{s}_pred_name"),
        F.max(F.when(F.col("side") == s, F.array_max("probs"))).alias(f"{s}_prob"),
    )])


def complement(codes: Sequence[int], classes: int = 6) -> list[int]:
    """The codes 1..classes that are not listed."""
    return [c for c in range(1, classes + 1) if c not in set(codes)]


def distinct_union(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key of several tables, the first in a stated order, earlier tables first."""
    tagged = [f.withColumn("__from", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    return keep_first(out, keys, [F.col("__from"), *order]).drop("__from")


def union_by_source(frames: dict[str, DataFrame], column: str = "split") -> DataFrame:
    """All rows of several tables with the name of theirs; ``where(column = name)`` gives a table back."""
    tagged = [f.withColumn(column, F.lit(name)) for name, f in frames.items()]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    return out


def side_differences(parts: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, left, right, difference) of units that have both sides."""
    one = lambda s: F.max(F.when(F.col("side") == s, F.col(value)))
    both = parts.groupBy(unit).agg(one("left").alias("left"), one("right").alias("right")).where("left IS NOT NULL AND right IS NOT NULL")
    return both.withColumn("difference", F.col("left") - F.col("right"))


def first_known(df: DataFrame, group: str, value: str, order: Sequence[str]) -> DataFrame:
    """(group, value): the first value of each group that is not null, in a stated order; null if all are."""
    return df.groupBy(group).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def count_codes(df: DataFrame, left: str, right: str, codes: Sequence[int]) -> DataFrame:
    """One row: sides with a listed code, both columns counted."""
    hit = lambda c: F.count_if(F.coalesce(F.col(c).isin(*codes), F.lit(False)))
    return df.agg((hit(left) + hit(right)).alias("n"))


def label_lists(df: DataFrame, group: str, left: str, right: str, classes: int = 6) -> DataFrame:
    """(group, labels): class ids of both sides of all rows of a group, sorted, codes out of range dropped.

    A group is one unit or owner: its rows are few by nature, whatever the table's size.
    """
    ids = F.filter(F.array(left, right), lambda c: c.between(1, classes))
    return df.groupBy(group).agg(F.array_sort(F.flatten(F.collect_list(F.transform(ids, lambda c: c - 1)))).alias("labels"))


def view_counts(parts: DataFrame, views: DataFrame, code: str = "code") -> DataFrame:
    """(view, n, pos, neg), the largest first, then by name."""
    return label_views(parts, views, code).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).orderBy(F.desc("n"), "view")


def normalised_weights(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, weight): 1 / rows of the class, over the sum of all rows' such weights, which is the number of classes."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    k = counts.agg(F.count(F.lit(1)).alias("k"))
    return df.join(counts, F.col(label) == F.col("__l")).withColumn("__k", k.scalar()).select(key, (1.0 / F.col("__n") / F.col("__k")).alias("weight"))


def positive_weight(df: DataFrame, y: Column, cap: float) -> DataFrame:
    """One row: pos, neg and min(cap, neg / pos), null without both classes."""
    row = df.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    return row.withColumn("weight", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.least(F.lit(float(cap)), F.col("neg") / F.col("pos"))))


def class_priors(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """(label, prior, bias): shares of the classes and the logits that a classifier starts from.

    Two classes: half the log odds each way, shares clipped at 1e-4; more: logs clipped at 1e-8, less their
    mean. A class without rows leaves all biases null.
    """
    counts = dense_counts(df.where(F.col(label).isin(*classes)), label, classes)
    total = counts.agg(F.sum("n").alias("t"), F.min("n").alias("least")).select(F.struct("t", "least"))
    shares = counts.withColumn("__t", total.scalar()).select(label, (F.col("n") / F.col("__t.t")).alias("prior"), (F.col("__t.least") > 0).alias("__ok"))
    eps = 1e-4 if len(classes) == 2 else 1e-8
    logs = shares.withColumn("__log", F.ln(F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col("prior")))))
    mean = logs.agg(F.avg("__log").alias("m"))
    return logs.withColumn("__m", mean.scalar()).select(label, "prior", F.when(F.col("__ok"), F.col("__log") - F.col("__m")).alias("bias")) if len(classes) != 2 else _two_biases(logs, label, classes, eps)


def _two_biases(logs: DataFrame, label: str, classes: Sequence[int], eps: float) -> DataFrame:
    one = logs.agg(F.max(F.when(F.col(label) == classes[1], F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col("prior"))))).alias("p"))
    odds = lambda p: F.ln(p / (1 - p)) / 2
    return logs.withColumn("__p", one.scalar()).select(label, "prior", F.when(F.col("__ok"), F.when(F.col(label) == classes[1], odds(F.col("__p"))).otherwise(-odds(F.col("__p")))).alias("bias"))
