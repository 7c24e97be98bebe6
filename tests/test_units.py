"""Hand-sized frames with values written out by hand."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import scalar as S
from quernstone.operators import metrics as M
from quernstone.operators import ordered as O
from quernstone.operators import relational as R
from quernstone.operators import splits as X
from quernstone.operators import text as T
from quernstone.operators import vectors as V
from quernstone.sources import files


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_scalars(spark):
    lit = F.lit
    row = one(spark, S.lenient_int(lit(" 3.0 ")), S.lenient_int(lit("x")), S.lenient_date(lit("2024/02/03")), S.lenient_date(lit("soon")), *S.parse_code_name(lit("4 ：abc ")), *S.parse_code_name(lit("abc")), S.clean_text(lit(" a\r\nb\r")), S.first_number(lit("1.5\\2")), S.merge_codes(lit(4), {4: 6}, [1, 5, 6]), S.merge_codes(lit(9), {}, [1]), S.argmax(F.array(*map(lit, (0.1, 0.7, 0.7)))), S.even_index(lit(10), 4), S.even_index(lit(2), 4))
    assert list(row) == [3, None, "2024-02-03", None, 4, "abc", None, "abc", "a\nb", 1.5, 2, None, 1, [0, 3, 6, 9], [0, 1, 1, 1]]
    assert math.isclose(sum(one(spark, S.softmax(F.array(*map(lit, (1.0, 2.0, 3.0)))))[0]), 1.0)
    with pytest.raises(ValueError):
        S.pseudonym("", lit("a"))
    assert S.parse_list("1, 2,,3") == [1, 2, 3] and S.percent(1, 0) == "0.0%"


def test_code_filters(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, None, None), (3, 5, None), (4, 2, 2)], "id int, l int, r int")
    assert [tuple(r) for r in R.mask_codes(df, "l", "r", keep=[5]).orderBy("id").collect()] == [(1, None, 5), (3, 5, None)]
    assert [r["id"] for r in R.drop_units(df, "l", "r", [5]).orderBy("id").collect()] == [2, 4]
    with pytest.raises(ValueError):
        R.mask_codes(df, "l", "r", keep=[7])
    with pytest.raises(ValueError, match="known"):
        R.resolve_view("nothing")
    assert R.resolve_view("abnormal") == "normal_vs_abnormal"


def test_metrics_with_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 1, 0.8), (2, 0, 0.8), (3, 1, 0.3), (4, 0, 0.1)], "id int, y int, s double")
    frame = M.score_frame(df, F.col("y"), F.col("s"))
    assert M.auroc(frame).first()["auroc"] == 0.625
    assert math.isclose(M.average_precision(df, F.col("y"), F.col("s"), F.col("id")).first()["average_precision"], (1 + 2 / 3) / 2)
    assert tuple(M.best_threshold(frame, "f1").first())[1] == 0.3
    alone = M.score_frame(df.where("y = 1"), F.col("y"), F.col("s"))
    assert M.auroc(alone).first()["auroc"] is None and M.sensitivity_at(alone, 0.9).first()["sensitivity"] is None
    assert M.auroc(M.score_frame(df.limit(0), F.col("y"), F.col("s"))).count() == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=25))
def test_auroc_equals_pair_count(spark, rows):
    df = spark.createDataFrame([(y, float(s)) for y, s in rows], "y int, s double")
    got = M.auroc(M.score_frame(df, F.col("y"), F.col("s"))).first()["auroc"]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert got == want or math.isclose(got, want)


@pytest.mark.parametrize("specificity", [0.95, 0.6, 0.0])
def test_bootstrap_metrics_against_plain_replicates(spark, specificity):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(g), int(y), int(s) / 10) for g, y, s in zip(rng.integers(0, 6, 60), rng.integers(0, 2, 60), rng.integers(0, 11, 60))]
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])
    safe = lambda a, b: a / b if b else 0.0
    got = {m: [] for m in M.BOOTSTRAPPED}
    for r in range(1, 61):
        draw = []
        for g, y, s in rows:
            u = int(hashlib.md5(f"x:{r}:{g}".encode()).hexdigest()[:8], 16) / 2**32
            draw += [(y, s)] * int((u >= cdf).sum())
        pos, neg = [s for y, s in draw if y], sorted((s for y, s in draw if not y), reverse=True)
        hits = lambda xs, f: sum(map(f, xs))
        tp, fp = hits(pos, lambda s: s >= 0.5), hits(neg, lambda s: s >= 0.5)
        pr, rc = safe(tp, tp + fp), safe(tp, len(pos))
        got["accuracy"].append(safe(tp + len(neg) - fp, len(draw))), got["sensitivity"].append(rc), got["specificity"].append(safe(len(neg) - fp, len(neg))), got["f1"].append(safe(2 * pr * rc, pr + rc))
        if pos:
            got["auprc"].append(sum(safe(hits(pos, lambda x: x >= s), hits(pos, lambda x: x >= s) + hits(neg, lambda x: x >= s)) for s in pos) / len(pos))
        if neg:
            k = math.floor((1 - specificity) * len(neg) + 1e-9)
            over = (lambda s: s >= neg[-1]) if k >= len(neg) else (lambda s: s > neg[max(k, 1) - 1])
            got["sensitivity_at_spec"].append(safe(hits(pos, over), len(pos))), got["specificity_at_spec"].append(1 - hits(neg, over) / len(neg))
        if pos and neg:
            got["auroc"].append(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    df = spark.createDataFrame(rows, "g int, y int, s double")
    out = {r["metric"]: r for r in M.bootstrap_metrics(df, F.col("y"), F.col("s"), F.col("g"), 60, seed="x", specificity=specificity).collect()}
    assert set(out) == set(got)
    for m, xs in got.items():
        assert out[m]["replicates"] == len(xs)
        assert np.allclose([out[m]["mean"], out[m]["low"], out[m]["high"]], [np.mean(xs), *np.quantile(xs, [0.025, 0.975])])


def test_poisson_has_its_tail(spark):
    assert list(one(spark, *[M.poisson(F.lit(u)) for u in (0.0, 0.5, 0.9995, 0.99995, 1 - 2.0**-32)])) == [0, 1, 6, 7, 12]


def test_splits(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("owner"), (F.col("id") % 2).alias("y"))
    split = X.owner_split(df, "owner", F.col("y"), [("a", 0.5), ("b", 0.5)])
    assert split.count() == 200 and R.leaking_owners(split, "owner", "split").count() == 0
    again = X.owner_split(df.repartition(7), "owner", F.col("y"), [("a", 0.5), ("b", 0.5)])
    assert split.exceptAll(again).count() == 0
    assert X.greedy_quota([(1, ["a"]), (2, ["b"]), (3, ["a", "b"]), (4, ["a"])], {"a": 2, "b": 1}) == [1, 2, 3]


def test_quota_select_meets_the_global_quota_of_each_class(spark):
    rows = [(i, ["a"]) for i in range(64)] + [(100 + i, ["b"]) for i in range(3)] + [(200 + i, ["a", "c"]) for i in range(40)] + [(300, [None])]
    df = spark.createDataFrame(rows, "id long, ls array<string>")
    ids = [r["id"] for r in X.quota_select(df, "id", F.col("ls"), 0.2).collect()]
    held = [x for i, ls in rows if i in set(ids) for x in ls]
    # a picks from its own order, so some of its rows count for c, too: class c goes beyond its quota of 8, as the greedy's rule has it
    assert len(ids) == len(set(ids)) and [held.count(c) for c in "ab"] == [21, 1] and held.count("c") >= 8
    assert X.quota_select(df.where("id < 64"), "id", F.col("ls"), 0.2).count() == 13
    assert sorted(ids) == sorted(r["id"] for r in X.quota_select(df.repartition(7), "id", F.col("ls"), 0.2).collect())
    assert X.quota_select(df.limit(0), "id", F.col("ls"), 0.2).count() == 0


def test_mad_of_constant_values_flags_none(spark):
    df = spark.createDataFrame([(i, "g", 1.0) for i in range(5)] + [(9, "g", 50.0)], "id int, g string, v double")
    assert R.mad_outliers(df, "v", "g", 3.0).count() == 0


def test_ordered(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 2.0, 2.5, 2.6, 2.7, 9.0])], "run string, e int, m double")
    stop = O.early_stop(df, "run", "e", "m", 2, 0.6).first()
    assert (stop["best_epoch"], stop["stop_epoch"]) == (1, 3)
    gaps = spark.createDataFrame([("g", 1, None), ("g", 2, 2.0), ("g", 3, None), ("g", 4, 4.0), ("g", 5, None)], "g string, t int, v double")
    assert [r["filled"] for r in O.fill_linear(gaps, "g", "t", "v").orderBy("t").collect()] == [2.0, 2.0, 3.0, 4.0, 4.0]
    points = spark.createDataFrame([("g", 0.0, 0.0), ("g", 10.0, 100.0)], "g string, x double, y double")
    grid = spark.createDataFrame([("g", x) for x in (-1.0, 0.0, 2.5, 10.0, 11.0)], "g string, at double")
    assert [r["y"] for r in O.interpolate_asof(points, grid, "g", "x", "y", "at").orderBy("at").collect()] == [0.0, 0.0, 25.0, 100.0, 100.0]


def test_triplets(spark):
    lexicon = T.Lexicon({"drum": ("drum",), "canal": ("ear canal", "canal")}, {"thick": ("thickened",), "clear": ("clear",)}, ("no ", "not "), ("left",), ("right",), ("both",))
    df = spark.createDataFrame([(1, "left drum thickened；right canal not clear\nboth fine"), (2, None), (3, " ")], "id int, t string")
    got = sorted(tuple(r)[2:6] for r in T.triplets(df, "id", "t", lexicon).collect())
    assert got == [("L", "drum", "thick", False), ("R", "canal", "clear", True)]
    assert one(spark, T.occurrences(F.lit("aaaa b aa"), "aa"))[0] == [1, 3, 8]


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i == 0), float(i == 1), float(i)]) for i in range(4)], "id int, v array<float>")
    got = V.neighbours(df, df, "id", "v", 10).collect()
    assert len(got) == 12 and all(r["query"] != r["neighbour"] for r in got)
    assert V.neighbours(df.limit(0), df, "id", "v", 3).count() == 0


def test_files(spark, tmp_path):
    for p in ("2024-01-02/17/s1/a.dcm", "2024-01-02/17/s1/b.DCM", "2024-01-02/17/s2/a.dcm", "other/17/s1/a.dcm", "2024-01-02/17/.x/a.dcm"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12")
    got = files.tree(files.inventory(spark, str(tmp_path)), str(tmp_path)).collect()
    assert sorted((r["unit"], r["series"], r["n_items"], r["bytes"]) for r in got) == [(17, "s1", 2, 4), (17, "s2", 1, 2)]
    logs = tmp_path / "runs/net_task_20pct_seed3"
    logs.mkdir(parents=True)
    (logs / "metrics.jsonl").write_text('{"epoch": 1, "val_metrics": {"macro_f1": 0.5}}\nbroken\n{"epoch": 2, "val": {"acc": 0.7}}\n')
    rows = files.run_logs(spark, str(tmp_path / "runs")).collect()
    assert sorted(r["metric"] for r in rows if r["metric"]) == [0.5, 0.7] and sum(r["_corrupt"] is not None for r in rows) == 1
    assert list(one(spark, *files.parse_run(F.lit("net_task_20pct_seed3")))) == ["net", "task", 20, 3]
    sheet = spark.createDataFrame([("1", "2024-01-02", "1:a", "5：b"), ("1", "2024-01-02", "2:a", None), (None, "x", None, None)], "u string, t string, l string, r string")
    assert [tuple(r)[:5] for r in files.label_sheet(sheet, "u", "t", "l", "r", ["text"]).collect()] == [(1, "2024-01-02", 1, "a", 5)]


def test_stream(spark, tmp_path):
    from quernstone.streaming.events import read_events, tumbling

    q = tumbling(read_events(spark, "/root/testdata/sf0.001")).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == 1000


def test_six_digits_of_doubles_near_a_tie(spark):
    # 0.1234565 is a little less than its decimal form, 0.1000005 a little more
    df = spark.createDataFrame([(1, [0.1234565, 0.1000005, 1 / 3, 2.5e-5, -0.0, None]), (2, [1.0] * 5)], "id int, v array<double>")
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", S.six_digits(F.col("v")).alias("a"), S.six_numbers(F.col("v")).alias("b")).collect()}
    want = ",".join("%g" % x for x in (0.1234565, 0.1000005, 1 / 3, 2.5e-5, -0.0))
    assert got == {1: (want, want), 2: ("1,1,1,1,1", None)}
