"""Sampling and splitting by hashed order, so that any cluster draws the same rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.metrics import running_totals
from quernstone.operators.relational import complement, drop_units, mask_codes
from quernstone.scratch import discard, written


def hashed(key: Column, seed: str = "0") -> Column:
    """The order of a seeded shuffle: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def place_in_stratum(df: DataFrame, key: str, stratum: Column, seed: str) -> DataFrame:
    """Adds __n and __rank (from 1) of each row within its stratum, in hashed order; null is a stratum.

    Ranks come from two levels: counts of 256 hash buckets a stratum, and a window inside a bucket.
    """
    tagged = df.withColumn("__s", stratum).withColumn("__h", hashed(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, 2))
    counts = tagged.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__s").orderBy("__b")
    before = counts.select("__s", "__b", (F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy("__s")).alias("__n"))
    inner = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", key))
    joined = tagged.withColumn("__r", inner).join(before.withColumnsRenamed({"__s": "__s2", "__b": "__b2"}), F.col("__s").eqNullSafe(F.col("__s2")) & F.col("__b").eqNullSafe(F.col("__b2")))
    return joined.withColumn("__rank", F.col("__r") + F.col("__before")).drop("__s", "__h", "__b", "__c", "__s2", "__b2", "__r", "__before")


def usable_stratum(df: DataFrame, keys: Sequence[Column], holdout: float) -> Column:
    """The first of several keys that can stratify all rows, as text, else one stratum.

    A key can if each of its values has two rows and both sides of the split have room for all values; null
    counts as a value.
    """
    tests = []
    for i, key in enumerate(keys):
        sizes = df.groupBy(key.cast("string").alias("k")).agg(F.count(F.lit(1)).alias("c"))
        n, held = F.sum("c"), F.ceil(F.sum("c") * F.lit(holdout))
        fits = (F.min("c") >= 2) & (held >= F.count(F.lit(1))) & (n - held >= F.count(F.lit(1)))
        tests.append((sizes.agg(F.coalesce(fits, F.lit(False)).alias(f"k{i}")).scalar(), key.cast("string")))
    out = None
    for fits, key in tests:
        out = F.when(fits, F.coalesce(key, F.lit("~"))) if out is None else out.when(fits, F.coalesce(key, F.lit("~")))
    return out.otherwise(F.lit("")) if out is not None else F.lit("")


def stratified_split(df: DataFrame, key: str, full: Column, shares: Sequence[tuple[str, float]], fallback: Column | None = None, seed: str = "0") -> DataFrame:
    """Adds ``split``; each stratum is cut at the rounded cumulative shares, the last split takes the rest.

    With a ``fallback`` the strata are those of the first key of (full, fallback, none) that can stratify all
    rows. Null is a stratum; no row is lost.
    """
    stratum = full.cast("string") if fallback is None else usable_stratum(df, [full, fallback], sum(x for _, x in shares[1:]))
    placed = place_in_stratum(df, key, stratum, seed)
    split, total = None, 0.0
    for name, share in shares[:-1]:
        total += share
        hit = F.col("__rank") <= F.bround(F.col("__n") * F.lit(total))
        split = F.when(hit, name) if split is None else split.when(hit, name)
    last = shares[-1][0]
    return placed.withColumn("split", split.otherwise(last) if split is not None else F.lit(last)).drop("__n", "__rank")


def owner_split(df: DataFrame, owner: str, label: Column, shares: Sequence[tuple[str, float]], seed: str = "0") -> DataFrame:
    """Stratified by owners' majority label; all rows of an owner share a split."""
    counts = df.groupBy(owner, label.alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    owners = counts.groupBy(owner).agg(F.min_by("__label", F.struct(-F.col("__n"), F.col("__label"))).alias("__label"))
    return df.join(stratified_split(owners, owner, F.col("__label"), shares, seed=seed).select(owner, "split"), owner)


def downsample(df: DataFrame, key: str, label: str, ratio: float, least: int = 1, seed: str = "0") -> DataFrame:
    """Of each class the first clamp(round half even(n * ratio), least, n) rows in hashed order."""
    placed = place_in_stratum(df, key, F.col(label), seed)
    return placed.where(F.col("__rank") <= F.least(F.col("__n"), F.greatest(F.lit(least), F.bround(F.col("__n") * ratio)))).drop("__n", "__rank")


def quotas_of(counts: dict, ratio: float, least: int = 1) -> dict:
    """Rows wanted of each class: min(n, max(least, round half even(ratio * n)))."""
    return {c: min(n, max(least, round(ratio * n))) for c, n in counts.items() if n > 0}


def greedy_quota(rows: Iterable[tuple], quotas: dict, orders: dict | None = None) -> list:
    """Ids in the order in which they are picked so that each class reaches its quota: the plain form of ``quota_select``.

    ``rows`` are (id, labels), a label that counts twice given twice. Classes take turns in ascending order: a class
    under its quota picks its next id that nobody has, in its order of ``orders``, else in that of the rows,
    and a pick counts for all its labels. It ends when no class can go on.
    """
    labels = dict(rows)
    orders = {c: [k for k, ls in labels.items() if c in ls] for c in quotas} if orders is None else orders
    waiting, have, picked, moved = {c: iter(orders[c]) for c in quotas}, dict.fromkeys(quotas, 0), {}, True
    while moved:
        moved = False
        for c in sorted(quotas):
            key = next((k for k in waiting[c] if k not in picked), None) if have[c] < quotas[c] else None
            if key is not None:
                picked[key] = moved = True
                for x in labels[key]:
                    have[x] = have.get(x, 0) + 1
    return list(picked)


#: Places of a class that are counted in one task, and cells of a histogram that finds where a class stops.
RUN, CELLS = 65_536, 2_048
NEVER = 1 << 62


def _stops(picks: DataFrame, quotas: list[int]) -> list[int]:
    """For each class the turn at which its picked labels reach its quota, NEVER where they do not.

    ``picks`` has cls, tau and mult. Histograms of falling cell width, of CELLS cells a class at most, narrow the
    turn down; the driver sees counts of cells only.
    """
    last = picks.agg(F.max("tau")).first()[0]
    span = 1 if last is None else last + 1
    low, before, width = [0] * len(quotas), [0] * len(quotas), -(-span // CELLS)
    done = [q <= 0 for q in quotas]
    while True:
        bounds = picks.sparkSession.createDataFrame([(c, low[c]) for c in range(len(quotas)) if not done[c]], "__c int, __low long")
        near = picks.join(F.broadcast(bounds), F.col("cls") == F.col("__c")).where((F.col("tau") >= F.col("__low")) & (F.col("tau") < F.col("__low") + width * CELLS))
        cells: dict = {}
        for r in near.groupBy("cls", F.expr(f"(tau - __low) div {width}").alias("cell")).agg(F.sum("mult").alias("n")).collect():
            cells.setdefault(r["cls"], []).append((r["cell"], r["n"]))
        for c in range(len(quotas)):
            if done[c]:
                continue
            for cell, n in sorted(cells.get(c, [])):
                if before[c] + n >= quotas[c]:
                    low[c] += cell * width
                    break
                before[c] += n
            else:
                low[c], done[c] = NEVER, True
        if width == 1 or all(done):
            return [-1 if q <= 0 else x for q, x in zip(quotas, low, strict=True)]
        width = -(-width // CELLS)


def quota_select(df: DataFrame, key: str, labels: Column, ratio: float, seed: str = "0", least: int = 1) -> DataFrame:
    """Keys picked by the greedy of ``greedy_quota`` with ``quotas_of``, each class in a hashed order of its own.

    A label counts as often as a row has it; null labels, null keys and rows without labels are never picked, and a
    repeated key counts once, with its first labels in sorted order. A ratio of 1 or more picks every key.

    Round r of class number c is turn r * classes + c. A class would reach a key at the round that is the number of
    keys before it that the class picked itself, and a key goes to the class that reaches it at the earliest turn not
    after the class's stop, the turn at which its quota is full. Who reaches a key first depends on earlier turns
    alone, so there is one solution, and recomputing all turns from the last one settles at least
    one more turn each time; in practice some dozens of times settle any table, as two classes' orders are
    independent. Each time is one pass over narrow rows: counts inside runs of places, offsets of runs, and the
    least turn of each key. Passes are written tables, of which the last two exist at most.
    """
    if ratio >= 1:
        return df.where(F.col(key).isNotNull()).select(key).distinct()
    rows = df.select(F.col(key).alias("k"), F.array_sort(F.array_compact(labels)).alias("ls")).where("k IS NOT NULL AND size(ls) > 0").groupBy("k").agg(F.min("ls").alias("ls"))
    each = written(rows.select("k", F.explode("ls").alias("label")).groupBy("k", "label").agg(F.count(F.lit(1)).alias("mult")), "labels")
    counts = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.sum("mult").alias("n")).collect()}
    quotas, classes = quotas_of(counts, ratio, least), sorted(counts)
    kind, many = each.schema["label"].dataType.simpleString(), len(classes)
    if not classes:
        return df.select(key).limit(0)
    numbers = df.sparkSession.createDataFrame(list(enumerate(classes)), f"cls int, __l {kind}")
    placed = place_in_stratum(each.join(F.broadcast(numbers), F.col("label") == F.col("__l")).select("k", "cls", "mult", F.concat_ws(":", "cls", "k").alias("o")), "o", F.col("cls"), seed)
    owners = Window.partitionBy("k")
    state = written(placed.select("k", "cls", "mult", (F.col("__rank") - 1).cast("long").alias("place"), F.lit(0).alias("lost"), F.lit(0).cast("long").alias("tau")).withColumn("shared", F.count(F.lit(1)).over(owners) > 1), "quota")
    stops, wanted = [NEVER] * many, [quotas.get(c, 0) for c in classes]
    while True:
        runs = state.withColumn("run", F.expr(f"place div {RUN}"))
        w = Window.partitionBy("cls").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        offsets = runs.groupBy("cls", "run").agg(F.sum("lost").alias("n")).select(F.col("cls").alias("__c"), F.col("run").alias("__r"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("off"))
        inside = F.coalesce(F.sum("lost").over(Window.partitionBy("cls", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        turned = runs.withColumn("inside", inside).join(offsets, (F.col("cls") == F.col("__c")) & (F.col("run") == F.col("__r")))
        turn = (F.col("place") - F.col("inside") - F.col("off")) * many + F.col("cls")
        stop = F.element_at(F.array(*[F.lit(x).cast("long") for x in stops]), F.col("cls") + 1)
        turned = turned.select("k", "cls", "mult", "place", "shared", F.col("lost").alias("was"), F.when(turn <= stop, turn).otherwise(F.lit(NEVER)).alias("turn"))
        # Only keys of several classes meet; the others are their class's own.
        several = turned.where("shared").withColumn("tau", F.min("turn").over(owners))
        both = several.unionByName(turned.where("NOT shared").withColumn("tau", F.col("turn")))
        nxt = written(both.select("k", "cls", "mult", "place", "shared", "was", "tau", (F.col("turn") > F.col("tau")).cast("int").alias("lost")), "quota")
        picks = nxt.where(F.col("tau") < NEVER)
        changed = picks.where("was <> lost").limit(1).count()
        found = _stops(picks.select("cls", "tau", "mult"), wanted)
        discard(state)
        state = nxt
        if not changed and found == stops:
            return picks.select(F.col("k").alias(key)).distinct()
        stops = found


def uniform(seed: str, i: Column) -> Column:
    """A number in [0, 1) for each draw, of 52 bits of md5(seed:i)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), i)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted_draw(df: DataFrame, key: str, weight: str, n: int, seed: str = "0", parts: int = 64) -> DataFrame:
    """(key, draws) of n independent draws with replacement, each row in proportion to its weight.

    Rows lie one after another on a line of the summed weight, in falling order of the key, and draw i falls
    at uniform(seed, i) of it. Running weights are two-level; rows and draws meet by order within ``parts``
    equal lengths of the line, a row in each that it reaches into. Keys are unique numbers; weights that are
    null, 0 or less are never drawn; without any positive weight the result is empty.
    """
    rows = written(df.select(F.col(key).alias("__k"), F.col(weight).cast("double").alias("w")).where("w > 0"), "weights")
    run = written(running_totals(rows, "__k", ["w"], totals=True).select("__k", (F.col("cum_w") - F.col("w")).alias("lo"), F.col("cum_w").alias("hi"), F.col("all_w").alias("total")), "running")
    at = lambda x: F.least(F.floor(x / F.col("total") * parts), F.lit(parts - 1)).cast("int")
    spans = run.select("__k", F.col("lo").alias("x"), F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))).alias("part"), F.lit(0).alias("kind"))
    total = run.agg(F.max("total").alias("t"))
    draws = df.sparkSession.range(1, n + 1).select((uniform(seed, F.col("id")) * 1.0).alias("u")).withColumn("total", total.scalar()).where("total IS NOT NULL")
    points = draws.select(F.lit(None).cast(df.schema[key].dataType).alias("__k"), (F.col("u") * F.col("total")).alias("x"), at(F.col("u") * F.col("total")).alias("part"), F.lit(1).alias("kind"))
    before = Window.partitionBy("part").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = spans.unionByName(points).withColumn("__at", F.last("__k", True).over(before)).where("kind = 1")
    return met.groupBy(F.col("__at").alias(key)).agg(F.count(F.lit(1)).alias("draws"))


def sub_split(df: DataFrame, key: str, labels: Column, percent: int, split: str = "split", train: str = "train", seed: str = "0", least: int = 1) -> DataFrame:
    """A smaller split of a whole one: training rows picked by quotas of ``percent``, at least ``least`` a class, all others kept."""
    if not 0 < percent <= 100:
        raise ValueError(f"{percent} is not a percentage above 0")
    picked = quota_select(df.where(F.col(split) == train), key, labels, percent / 100, seed, least)
    return df.where(F.col(split) != train).unionByName(df.where(F.col(split) == train).join(picked, key, "left_semi").select(*df.columns))


def random_rows(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows, the first in the order of a seeded shuffle."""
    return df.orderBy(hashed(F.col(key), seed), key).limit(n)


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def code_setting(df: DataFrame, left: str, right: str, keep: Sequence[int] = (), drop_train: Sequence[int] = (), keep_mode: str = "mask_side", drop_mode: str = "drop_unit", split: str = "split") -> DataFrame:
    """Keep only some codes in all splits, and drop others from training alone.

    Modes: ``mask_side`` nulls a side's unwanted code and drops rows without any, ``drop_unit`` drops a row
    with an unwanted code on either side. Empty lists filter nothing.
    """
    if unknown := {keep_mode, drop_mode} - {"mask_side", "drop_unit"}:
        raise ValueError(f"no modes: {sorted(unknown)}")
    if keep:
        df = drop_units(df, left, right, complement(keep)) if keep_mode == "drop_unit" else mask_codes(df, left, right, keep=keep)
    if drop_train:
        train, rest = df.where(F.col(split) == "train"), df.where(~F.col(split).eqNullSafe("train"))
        train = drop_units(train, left, right, drop_train) if drop_mode == "drop_unit" else mask_codes(train, left, right, drop=drop_train)
        df = train.unionByName(rest)
    return df


def split_stats(df: DataFrame, split: str, label: str, splits: Sequence[str], labels: Sequence) -> DataFrame:
    """Rows of every listed (split, label), zeros too."""
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    cells = spark.createDataFrame([(s, x) for s in splits for x in labels], f"{split} string, {label} {kind}")
    return F.broadcast(cells).join(df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n")), [split, label], "left").fillna(0, ["n"])
