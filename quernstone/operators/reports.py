"""Composed reports: index and match audits, manifest tables, outlier cleaning, evaluations, experiment jobs."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import scalar as S
from quernstone.operators import metrics as M
from quernstone.operators import nearest as N
from quernstone.operators import ordered as O
from quernstone.operators import relational as R
from quernstone.operators import vectors as V
from quernstone.scratch import written


class Report(Mapping):
    """The tables of a report by name; a table is built when it is first asked for, and only then."""

    def __init__(self, tables: dict[str, Callable[[], DataFrame]]):
        self.tables = {name: cache(build) for name, build in tables.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def long_form(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, item, value) of one-row frames: every column of every section, as text."""
    out = None
    for section, df in parts.items():
        cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in df.columns])
        rows = df.select(F.lit(section).alias("section"), F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out


def matched_index(labels: DataFrame, folders: DataFrame, unit: str, date: str, child: str) -> DataFrame:
    """One row for each label whose unit is stored: its best folder and series, and how they fit.

    ``folders`` has a row for each stored item: unit, date, child. Of a unit's folders that with most items is
    taken, then its child with most items; smaller names win ties. Adds folder_date, child, n_items,
    date_match (false where a date is missing) and ambiguous (whether there was a choice of folders).
    """
    counts = folders.groupBy(unit, date, child).agg(F.count(F.lit(1)).alias("__n"))
    dates = counts.groupBy(unit, date).agg(F.sum("__n").alias("__all"), F.min_by(F.struct(F.col(child), F.col("__n")), F.struct(-F.col("__n"), F.col(child))).alias("__best"))
    picked = dates.groupBy(unit).agg(F.min_by(F.struct(F.col(date).alias("d"), F.col("__best").alias("b")), F.struct(-F.col("__all"), F.col(date))).alias("__p"), (F.count(F.lit(1)) > 1).alias("ambiguous"))
    picked = picked.select(F.col(unit).alias("__u"), F.col("__p.d").alias("folder_date"), F.col(f"__p.b.{child}").alias(child), F.col("__p.b.__n").alias("n_items"), "ambiguous")
    joined = labels.join(picked, F.col(unit) == F.col("__u")).drop("__u")
    return joined.withColumn("date_match", F.coalesce(F.col(date) == F.col("folder_date"), F.lit(False)))


def index_report(labels: DataFrame, index: DataFrame, unit: str) -> DataFrame:
    """One row: labels, matched, date_match, date_mismatch, ambiguous, missing units, n_items in all."""
    missing = labels.select(unit).distinct().join(index.select(unit).distinct(), unit, "left_anti").agg(F.count(F.lit(1)).alias("m"))
    total = labels.agg(F.count(F.lit(1)).alias("t"))
    row = index.agg(F.count(F.lit(1)).alias("matched"), F.count_if("date_match").alias("date_match"), F.count_if(~F.col("date_match")).alias("date_mismatch"), F.count_if("ambiguous").alias("ambiguous"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"))
    return row.withColumns({"labels": total.scalar(), "missing": missing.scalar()})


def match_report(labels: DataFrame, stored: DataFrame, unit: str, date: str, top: int = 10) -> DataFrame:
    """(section, item, value): the match audit, and the most frequent pairs of label year and stored year that differ."""
    audit = R.match_audit(labels, stored, unit, date)
    years = labels.select(unit, F.substring(date, 1, 4).alias("a")).join(stored.select(F.col(unit).alias("__u"), F.substring(date, 1, 4).alias("b")).distinct(), F.col(unit) == F.col("__u")).where("a <> b")
    pairs = R.value_counts(years.select(F.concat_ws("/", "a", "b").alias("pair")), "pair", top=top)
    return long_form({"audit": audit}).unionByName(pairs.select(F.lit("years").alias("section"), F.col("value").alias("item"), F.col("n").cast("string").alias("value")))


def manifest_report(parts: DataFrame, train: DataFrame, val: DataFrame, unit: str, numeric: Sequence[str], categories: Sequence[str], views: DataFrame, code: str = "code") -> dict[str, DataFrame]:
    """Tables of labelled parts in train or val: numeric profiles by split and date_match with empty cells,
    counts of each category, and view counts of val, the largest first."""
    rows = written(R.membership_split(parts.where(F.col(code).isNotNull()).withColumn("date_match", F.coalesce("date_match", F.lit(False))), unit, train, val).where("split <> 'other'"), "manifest")
    dims = {"split": ["train", "val"], "date_match": [True, False]}
    out = {f"numeric_{c}": R.profile_cells(rows, c, dims) for c in numeric}
    out |= {f"category_{c}": R.value_counts(rows, c, by=["split", "date_match"]) for c in categories}
    out["views"] = R.view_counts(rows.where("split = 'val'"), views, code)
    return out


def group_distances(df: DataFrame, key: str, group: str, vector: str, width: int) -> DataFrame:
    """(key, group, distance): distance of each row's z-scored vector to the median of its group, by position.

    Deviations are of the population, below 1e-6 they count as 1. Medians are exact and of bounded tasks.
    """
    long = written(df.select(key, group, F.posexplode(F.slice(vector, 1, width)).alias("pos", "x")).withColumn("x", F.col("x").cast("double")), "positions")
    moments = long.groupBy(group, "pos").agg(F.avg("x").alias("m"), F.when(F.stddev_pop("x") < 1e-6, 1.0).otherwise(F.stddev_pop("x")).alias("d"))
    middle = R.order_statistics(long, "x", [group, "pos"], [0.5]).select(group, "pos", F.col("q0").alias("c"))
    frame = moments.join(middle, [group, "pos"])
    z = (F.col("x") - F.col("c")) / F.col("d")  # the mean drops out of the difference
    return long.join(frame, [group, "pos"]).groupBy(key, group).agg(F.sqrt(F.sum(z * z)).alias("distance"))


def clean_outliers(units: DataFrame, distances: DataFrame, key: str, group: str, split: str, least: int = 30, k: float = 6.0, cap: float = 0.05, drop_val: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed, summary) of units by distance within their group.

    A group under ``least`` rows is left alone. Rows over median + k * MAD go, at most floor(cap * n) of the
    farthest (0: no limit), and only those of train unless ``drop_val``. The summary has a row for each group
    with its note: skip_small_group, no_outliers, val_only_outliers or removed.
    """
    rows = written(units.join(distances.select(key, "distance"), key), "distances")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    big = rows.join(sizes.where(F.col("n") >= least).select(F.col(group).alias("__g")), F.col(group) == F.col("__g")).drop("__g")
    flagged = written(R.mad_outliers(big, "distance", group, k, cap if cap > 0 else None, key), "outliers")
    gone = flagged if drop_val else flagged.where(F.col(split) == "train")
    counts = flagged.groupBy(group).agg(F.count(F.lit(1)).alias("flagged"), F.count_if(F.lit(drop_val) | (F.col(split) == "train")).alias("removed"), F.max("median").alias("median"), F.max("mad").alias("mad"))
    note = F.when(F.col("n") < least, "skip_small_group").when(F.coalesce("flagged", F.lit(0)) == 0, "no_outliers").when(F.col("removed") == 0, "val_only_outliers").otherwise("removed")
    summary = sizes.join(counts, group, "left").select(group, "n", F.coalesce("removed", F.lit(0)).alias("removed"), note.alias("note"), "median", "mad", (F.col("median") + k * F.col("mad")).alias("threshold"))
    removed = gone.select(*[c for c in rows.columns], "median", "mad", (F.col("median") + k * F.col("mad")).alias("threshold"))
    return units.join(gone.select(key), key, "left_anti"), removed, summary


def binary_evaluation(predictions: DataFrame, unit: str, order: str, y: str = "y_true", p: str = "y_prob", replicates: int = 1000, seed: str = "42", threshold: float = 0.5, specificity: float = 0.95, top: int = 200) -> Report:
    """Report tables of a binary evaluation: metrics with counts, intervals over units, and the hard cases.

    Hard cases are the ``top`` rows by cross-entropy, of all and of those wrong with high confidence.
    """
    rows = predictions.withColumn("loss", S.cross_entropy(F.col(y), F.col(p)))
    hard = lambda d: d.orderBy(F.desc(F.round("loss", 9)), order).limit(top)

    def metrics() -> DataFrame:
        counts = predictions.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(unit).alias("n_units")).select(F.struct("n_rows", "n_units").alias("c"))
        return M.binary_metrics(predictions, F.col(y), F.col(p), F.col(order), threshold, specificity).withColumn("__c", counts.scalar()).select("*", "__c.n_rows", "__c.n_units").drop("__c")

    return Report({
        "metrics": metrics,
        "intervals": lambda: M.bootstrap_metrics(predictions, F.col(y), F.col(p), F.col(unit), replicates, seed, threshold, specificity),
        "high_confidence_wrong": lambda: hard(rows.where(S.high_confidence_wrong(F.col(y), F.col(p)))),
        "top_loss": lambda: hard(rows),
    })


def multiclass_evaluation(rows: DataFrame, classes: int, order: str, tail: Sequence[int] = ()) -> Report:
    """Report tables of rows with y_true, y_pred and probs: overall, by class, the listed tail, the dense confusion."""

    @cache
    def cells() -> DataFrame:
        return written(M.confusion(rows, F.col("y_true"), F.col("y_pred")), "confusion")

    @cache
    def ovr() -> DataFrame:
        return written(M.ovr_report(rows, F.col("y_true"), F.col("probs"), classes, F.col(order)), "ovr")

    report = lambda: M.class_report(cells(), range(classes))
    by_class = lambda: M.merge_classes(report(), ovr())

    def overall() -> DataFrame:
        specific = report().agg(F.avg("specificity").alias("macro_specificity"))
        macro = M.ovr_macro(ovr()).select(F.struct("macro_auroc_ovr", "macro_auprc_ovr").alias("m"))
        return M.overall_report(report()).withColumn("macro_specificity", specific.scalar()).withColumn("__m", macro.scalar()).select("*", "__m.*").drop("__m")

    return Report({"overall": overall, "classes": by_class, "tail": lambda: M.tail_classes(by_class(), tail) if tail else by_class().limit(0), "confusion": cells})


def dual_evaluation(rows: DataFrame, unit: str, order: str, classes: int, names: dict[int, str], tail: Sequence[int] = (), replicates: int = 1000, seed: str = "42", threshold: float = 0.5, specificity: float = 0.95) -> Report:
    """Report tables of two-slot predictions, rows with unit, side, y_true, y_pred and probs.

    ``predictions`` has the rows with names of classes, whether they are right, and p_k up to 12 classes; ``counts``
    the rows and units. With two classes ``binary`` has the metrics of the second class's probability and
    ``intervals`` those over units in ``replicates``; with more there are the tables of ``multiclass_evaluation``.
    """
    label = F.create_map(*[F.lit(x) for k, n in names.items() for x in (k, n)])
    named = rows.withColumns({"y_true_name": label[F.col("y_true")], "y_pred_name": label[F.col("y_pred")], "correct": F.col("y_true") == F.col("y_pred")})
    tables: dict[str, Callable[[], DataFrame]] = {
        "predictions": lambda: named.select(*[c for c in named.columns if c != "probs"], *[F.get("probs", F.lit(k)).alias(f"p_{k}") for k in range(classes if classes <= 12 else 0)]),
        "counts": lambda: rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(unit).alias("n_units")),
    }
    if classes != 2:
        return Report(tables | multiclass_evaluation(rows, classes, order, tail).tables)
    scored = rows.withColumn("y_prob", F.get("probs", F.lit(1)))
    two = binary_evaluation(scored, unit, order, replicates=replicates, seed=seed, threshold=threshold, specificity=specificity)
    return Report(tables | {"binary": two.tables["metrics"], "intervals": two.tables["intervals"]})


def two_stage_evaluation(rows: DataFrame, code: str, p: str, second: str, order: str, threshold: float = 0.5, merged: dict[int, int] | None = None, codes: Sequence[int] = (1, 2, 3, 5, 6), negative: int = 5) -> dict[str, DataFrame]:
    """Final codes of a first stage's probability and a second stage's code, their report over ``codes`` in order,
    and the first stage's binary metrics on the same rows. Codes are merged first (4 into 6 by default)."""
    merged = {4: 6} if merged is None else merged
    place = lambda c: S.merge_codes(c, {}, codes)
    one = F.col(code)
    for old, new in merged.items():
        one = F.when(F.col(code) == old, new).otherwise(one)
    final = rows.withColumn("code_merged", one).withColumn("code_final", S.two_stage(F.col(p), threshold, F.col(second), negative))
    used = final.where(F.col("code_merged").isin(*codes))
    cells = M.confusion(used, place(F.col("code_merged")), place(F.col("code_final"))).where("y_pred IS NOT NULL")
    report = M.class_report(cells, range(len(codes)))
    return {"rows": final, "classes": report, "overall": M.overall_report(report), "stage1": M.binary_metrics(used, (F.col("code_merged") != negative).cast("int"), F.col(p), F.col(order), threshold)}


def few_shot_report(train: DataFrame, val: DataFrame, key: str, unit: str, vector: str, code: str, pos: Sequence[int], neg: Sequence[int], temperature: float = 1.0, k: int = 5, replicates: int = 1000, seed: str = "42") -> Report:
    """Prototype scores of a view's rows, their metrics, intervals and nearest training rows as JSON.

    Only codes of the view are used; the score is the cosine with the positive prototype less that with the
    negative, over the temperature. ``val`` is the stated query set.
    """
    label = F.when(F.col(code).isin(*pos), 1).otherwise(0)
    a, b = (written(V.with_codes(d, code, [*pos, *neg]).withColumn("y_true", label), "few-shot") for d in (train, val))
    protos = written(V.prototypes(a, "y_true", vector), "prototypes")

    @cache
    def scored() -> DataFrame:
        scores = V.contrast_scores(b, protos, key, vector, label="y_true").withColumn("y_prob", S.sigmoid(F.round("score", 9), temperature))
        return written(b.drop(vector).join(scores, key).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")), "scored")

    def rows() -> DataFrame:
        near = N.neighbours(b.select(key, vector), a.select(key, vector), key, vector, k, skip_self=False).join(a.select(F.col(key).alias("neighbour"), F.col(code)), "neighbour")
        lists = near.groupBy("query").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour", code, "sim"))), lambda s: F.struct(s["neighbour"].alias("id"), s[code].alias("code"), s["sim"].alias("sim")))).alias("neighbours"))
        return scored().join(lists, F.col(key) == F.col("query"), "left").drop("query")

    return Report({
        "rows": rows,
        "metrics": lambda: M.binary_metrics(scored(), F.col("y_true"), F.col("y_prob"), F.col(key)),
        "intervals": lambda: M.bootstrap_metrics(scored(), F.col("y_true"), F.col("y_prob"), F.col(unit), replicates, seed),
    })


def retrieval_records(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, k: int = 5, query_codes: Sequence[int] = (), base_codes: Sequence[int] = ()) -> DataFrame:
    """(query, label, neighbours): for every query a JSON list of its nearest base rows, with rank, id, label and similarity.

    Codes keep only rows with these labels on either side; empty ones keep all. A query without a neighbour has an empty list.
    """
    asked, held = V.with_codes(queries, label, query_codes), V.with_codes(base, label, base_codes)
    near = N.neighbours(asked.select(key, vector), held.select(key, vector), key, vector, k)
    told = near.join(held.select(F.col(key).alias("__n"), F.col(label).alias("__l")), F.col("neighbour") == F.col("__n"))
    lists = told.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour").alias("id"), F.col("__l").alias("label"), "sim"))).alias("found"))
    rows = asked.select(F.col(key).alias("__q"), label).join(lists, F.col("__q") == F.col("query"), "left")
    return rows.select(F.col("__q").alias("query"), label, F.coalesce(F.to_json("found"), F.lit("[]")).alias("neighbours"))


#: The metrics of a run's report, and where they stand in it.
SEED_METRICS = ("auroc", "auprc", "accuracy", "sensitivity", "specificity", "f1", "sensitivity_at_spec", "specificity_at_spec")


def seed_report(spark, root: str, report: str = "report.json", metrics: Sequence[str] = SEED_METRICS, sort: str = "auprc", top: int = 50) -> Report:
    """Runs in several seeds, from the report documents in their folders: ``runs``, a row each, and ``summary``.

    A run's folder is named ``<backbone>_<task>_<n>pct[_seed<n>]``; its document has the metrics under ``binary``. A run
    whose document is empty or broken has its status and no metrics. The summary has mean, sample deviation and count of
    every metric for each (backbone, task, pct), the best ``top`` by the mean of ``sort`` first (0: all).
    """
    from quernstone.sources.files import parse_run, report_documents

    @cache
    def runs() -> DataFrame:
        found = report_documents(spark, root, "binary struct<" + ", ".join(f"{m}: double" for m in metrics) + ">", report)
        name = F.element_at(F.split("path", "/"), -2)
        backbone, task, pct, seed = parse_run(name)
        return found.select(name.alias("run"), "status", backbone.alias("backbone"), task.alias("task"), pct.alias("pct"), seed.alias("seed"), *[F.col(f"binary.{m}").alias(m) for m in metrics])

    def summary() -> DataFrame:
        out = O.seed_summary(runs(), ["backbone", "task", "pct"], metrics).orderBy(F.desc_nulls_last(f"{sort}_mean"), "backbone", "task", "pct")
        return out.limit(top) if top else out

    return Report({"runs": runs, "summary": summary})


def run_report(lines: DataFrame, runs: DataFrame, metric: str, k: int = 5, larger: bool = True) -> DataFrame:
    """The k best runs of each (task, pct) with status and their best epoch's metrics; runs of no percentage are left out.

    ``lines`` are run-log lines (run, epoch, metric columns, _corrupt); ``runs`` has run, model, task, pct,
    has_log, last_checkpoint and checkpoints. Complete runs come first.
    """
    from quernstone.sources.files import METRICS

    broken = F.col("_corrupt").isNotNull()
    counts = lines.groupBy("run").agg(F.count(F.lit(1)).alias("lines"), F.count_if(broken).alias("broken"), F.max("label_task").alias("logged_task"), F.min("batch_size").alias("batch_size"))
    best = O.best_epoch(lines.where(~broken), "run", "epoch", metric, larger, [c for c in METRICS if c != metric])
    joined = runs.join(counts, "run", "left").join(best.withColumnsRenamed({"run": "__r", "epochs": "epochs_ran", "epoch": "best_epoch", metric: "best_metric"}), F.col("run") == F.col("__r"), "left").drop("__r")
    lines_of = F.when(F.col("has_log"), F.coalesce("lines", F.lit(0)))
    status = O.run_status(lines_of, F.coalesce("broken", F.lit(0)), F.col("last_checkpoint"), F.col("checkpoints"))
    task = F.coalesce("task", F.when(~(F.coalesce("broken", F.lit(0)) > 0), F.col("logged_task")), F.lit("six_class"))
    out = joined.withColumns({"status": status, "task": task})
    usable = F.col("status").isin("ok", "incomplete")
    out = out.withColumns({c: F.when(usable, F.col(c)) for c in ("best_epoch", "best_metric", "epochs_ran", "batch_size", *[m for m in METRICS if m != metric])})
    score = F.col("best_metric") if larger else -F.col("best_metric")
    return O.leaderboard(out.where("pct >= 0").withColumn("__s", score), ["task", "pct"], F.col("status") == "ok", "__s", "run", k).drop("__s")


def experiment_jobs(spark, pcts: Sequence[int], models: Sequence[str], tasks: Sequence[str] = ("six_class",), seeds: Sequence[int] = (42,)) -> DataFrame:
    """(job, pct, model, task, seed, name) of an experiment matrix: percentages outermost, then models, tasks, seeds.

    The name is ``<model>__<task>_<pct>pct``, with ``_seed<n>`` where there are several seeds.
    """
    rows = [(i, p, m, t, s, f"{m}__{t}_{p}pct" + f"_seed{s}" * (len(seeds) > 1)) for i, (p, m, t, s) in enumerate(itertools.product(pcts, models, tasks, seeds))]
    return spark.createDataFrame(rows, "job int, pct int, model string, task string, seed int, name string")


def census_report(tables: dict[str, DataFrame], dates: dict[str, str], distinct: dict[str, Sequence[str]]) -> DataFrame:
    """(section, item, value): rows of each table, distinct values and nulls of columns, first and last dates."""
    parts: dict[str, DataFrame] = {}
    for name, df in tables.items():
        cells: list[Column] = [F.count(F.lit(1)).alias("rows")]
        for c in distinct.get(name, ()):
            cells += [F.count_distinct(c).alias(f"distinct_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
        if name in dates:
            cells += [F.date_format(F.min(dates[name]), "yyyy-MM-dd").alias("first"), F.date_format(F.max(dates[name]), "yyyy-MM-dd").alias("last")]
        parts[name] = df.agg(*cells)
    return long_form(parts)


def task_census(parts: DataFrame, unit: str, owner: str, code: str, categories: Sequence[str] = (), numeric: Sequence[str] = (), dates: Sequence[str] = (), classes: Sequence[int] = range(1, 7), view: str = "normal_vs_abnormal", top: int = 15, points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), cache: DataFrame | None = None) -> DataFrame:
    """(section, item, value): what a cohort, its labels and its caches hold, as text.

    Sections: counts (rows, units, owners, labelled, unlabelled), codes, ``top_<category>`` with the ``top`` most
    frequent values, a profile and the range of dates for each named column, class weights, the view's positives and
    negatives, and with ``cache`` (path, length) the files and bytes of a cache. All but counts are of labelled parts.
    """
    out: dict[str, DataFrame] = {}
    held = parts.where(F.col(code).isNotNull())
    counts = parts.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(unit).alias("units"), F.count_distinct(owner).alias("owners"), F.count(code).alias("labelled"), F.count_if(F.col(code).isNull()).alias("unlabelled"))
    lines = long_form({"counts": counts})
    listed = lambda section, df, item, value: df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), value.cast("string").alias("value"))
    lines = lines.unionByName(listed("codes", held.groupBy(code).agg(F.count(F.lit(1)).alias("n")), code, F.col("n")))
    for c in categories:
        lines = lines.unionByName(listed(f"top_{c}", R.value_counts(held, c, top=top), "value", F.col("n")))
    for c in numeric:
        row = R.profile(held, c, points=points)
        four = lambda x: F.format_string("%.4f", F.col(x).cast("double"))
        out[c] = row.select(F.col("n").cast("string").alias("n"), *[four(x).alias(x) for x in ("min", "max", *[f"p{round(100 * p)}" for p in points])])
    for c in dates:
        day = lambda f: F.date_format(f, "yyyy-MM-dd")
        out[f"{c}s" if len(dates) > 1 else "dates"] = held.agg(day(F.min(c)).alias("min"), day(F.max(c)).alias("max"), F.count(c).cast("string").alias("n"))
    if cache is not None:
        out["cache"] = cache.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    weights = R.class_weights(held.select(F.col(code).cast("int").alias("code")), "code", list(classes))
    lines = lines.unionByName(listed("weights", weights, "code", F.format_string("%.6f", F.col("weight"))))
    positive, negative = R.VIEWS[view]
    out["views"] = held.agg(F.count_if(F.col(code).isin(*positive)).alias("positives"), F.count_if(F.col(code).isin(*negative)).alias("negatives"))
    return lines.unionByName(long_form(out))
