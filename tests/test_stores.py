"""Stores that grow: the memo of encoded texts, sketches of parts, run logs as a stream, lexicons of any size."""

import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import lexicon as L
from quernstone.operators import memo as E
from quernstone.operators import ordered as O
from quernstone.operators import profiles as P
from quernstone.operators import text as T
from quernstone.streaming import runs as G


def counted(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def encode(text):
        seen.add(1)
        return len(text) * 7

    return seen, encode.asNondeterministic()


def test_memo_encodes_nothing_twice(spark, tmp_path):
    texts = [None, "", "a", "a", "bb", "ccc", "ccc", "dddd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = {i: None if t is None else len(t) * 7 for i, t in enumerate(texts)}
    seen, encode = counted(spark)
    for _ in range(2):
        got = {r["id"]: r["code"] for r in E.encode_memo(df, "t", encode, str(tmp_path), "v1").collect()}
        assert got == want and seen.value == 5
    more = spark.createDataFrame([(9, "eeeee"), (10, "a")], "id int, t string")
    assert {r["id"]: r["code"] for r in E.encode_memo(more, "t", encode, str(tmp_path), "v1").collect()} == {9: 35, 10: 7} and seen.value == 6
    E.encode_memo(df, "t", encode, str(tmp_path), "v2").collect()
    assert seen.value == 11
    memo = E.Memo(spark, str(tmp_path), "v1")
    assert memo.rows().count() == 6
    memo.trim(7)
    assert len(memo.runs()) == 1 and E.Memo(spark, str(tmp_path), "v2").rows().count() == 5
    assert [r["code"] for r in memo.rows().orderBy("stamp").collect()][-1] == 35 and memo.rows().count() == 2
    assert E.encode_memo(df.limit(0), "t", encode, str(tmp_path), "v1").count() == 0


def test_memo_of_two_writers_and_a_broken_run(spark, tmp_path):
    _, encode = counted(spark)
    frames = [spark.createDataFrame([(i, f"t{i % 20}") for i in range(k, k + 30)], "id int, t string") for k in (0, 10)]
    errors = []

    def work(df):
        try:
            E.encode_memo(df, "t", encode, str(tmp_path), "v").collect()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    both = [threading.Thread(target=work, args=(f,)) for f in frames]
    [t.start() for t in both], [t.join() for t in both]
    assert not errors
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"PAR1")
    rows = E.Memo(spark, str(tmp_path), "v").rows()
    assert rows.count() == 20 and rows.select("digest").distinct().count() == 20


def test_sketched_profiles_merge_within_their_bounds(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"p{i % 5}", float(x) if i % 11 else None, f"u{int(i * 7 % 3000)}") for i, x in enumerate(rng.lognormal(size=20_000))] + [("p0", float("nan"), None), ("p9", None, None)]
    df = spark.createDataFrame(rows, "part string, x double, u string")
    store = P.ProfileStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="nothing is stored"):
        store.profile()
    assert store.add(df.where("part < 'p2'"), "part", ["x"], ["u"]) == 2
    assert store.add(df, "part", ["x"], ["u"]) == 4 and store.add(df, "part", ["x"], ["u"]) == 0
    got = {r["column"]: r for r in store.profile().collect()}
    x = np.sort([v for _, v, _ in rows if v is not None and v == v])
    assert (got["x"]["n"], got["x"]["nulls"], got["x"]["min"], got["x"]["max"]) == (len(x), len(rows) - len(x), x[0], x[-1])
    assert np.isclose(got["x"]["mean"], x.mean()) and np.isclose(got["x"]["std_pop"], x.std())
    for p in (10, 25, 50, 75, 90, 95, 99):
        assert abs(np.searchsorted(x, got["x"][f"p{p}"]) / len(x) - p / 100) <= P.RANK_ERROR
    assert abs(got["u"]["distinct"] - 3000) <= P.DISTINCT_ERROR * 3000 and got["u"]["p50"] is None
    parts = {r["part"]: r for r in store.profile(by=["part"]).where("column = 'x'").collect()}
    assert set(parts) == {"p0", "p1", "p2", "p3", "p4", "p9"} and parts["p9"]["n"] == 0 and parts["p9"]["p50"] is None


def test_streamed_runs_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, lines = random.Random(2), []
    for run in ("a", "b", "c"):
        lines += [{"run": run, "epoch": e, "metric": rng.choice([None, round(rng.random(), 3)]), "ts": f"2024-01-01T00:{e:02}:00"} for e in range(1, 21)]
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    batch = spark.createDataFrame([(x["run"], x["epoch"], x["metric"]) for x in lines], "run string, epoch long, metric double").where("metric IS NOT NULL")
    want = {r["run"]: (r["best_epoch"], r["best"], r["stop_epoch"]) for r in O.early_stop(batch, "run", "epoch", "metric", 4).collect()}

    def trigger():
        q = G.follow_runs(G.read_logs(spark, str(logs)), 4, delay="5 minutes").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check"))
        q.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(out))).trigger(availableNow=True).start().awaitTermination(120)

    early = [x for x in lines if x["epoch"] <= 10]
    rng.shuffle(early)
    (logs / "1.json").write_text("\n".join(map(json.dumps, early[:18])))
    (logs / "2.json").write_text("\n".join(map(json.dumps, early[18:])))
    trigger()
    late = [x for x in lines if x["epoch"] > 10] + [{"run": "end", "epoch": 1, "metric": 0.5, "ts": "2024-01-01T02:00:00"}]
    rng.shuffle(late)
    (logs / "3.json").write_text("\n".join(map(json.dumps, late)))
    trigger()
    (logs / "4.json").write_text(json.dumps({"run": "a", "epoch": 3, "metric": 9.0, "ts": "2024-01-01T00:03:00"}))  # too late
    trigger()
    got = {r["run"]: (r["best_epoch"], r["best"], r["stop_epoch"]) for r in G.latest(spark.read.parquet(str(out))).collect() if r["run"] != "end"}
    assert got == want


def plain_hits(text, patterns):
    out = []
    for p in patterns:
        at = text.find(p)
        while at >= 0:
            out.append((at + 1, len(p), p))
            at = text.find(p, at + len(p))
    return sorted(out)


def test_automaton_finds_what_plain_search_finds(spark):
    rng = random.Random(8)
    patterns = {"".join(rng.choice("ab中") for _ in range(rng.randint(1, 4))) for _ in range(40)}
    texts = [None, "", *["".join(rng.choice("ab中😀 ") for _ in range(rng.randint(0, 60))) for _ in range(40)]]
    lexicon = spark.createDataFrame([(f"c{i % 7}", p) for i, p in enumerate(sorted(patterns))] + [("c0", None), ("c0", "")], "canonical string, pattern string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for size in (200, 1 << 20):  # several blocks, and one
        got: dict = {}
        for r in L.hits(df, "id", "t", lexicon, block_bytes=size).collect():
            got.setdefault(r["id"], []).append((r["start"], r["length"], r["pattern"]))
        assert {i: sorted(x) for i, x in got.items()} == {i: plain_hits(t, patterns) for i, t in enumerate(texts) if t and plain_hits(t, patterns)}
    assert L.hits(df, "id", "t", lexicon.limit(0)).count() == 0
    few, many = (str(L.hits(df, "id", "t", x)._jdf.queryExecution().analyzed()) for x in (lexicon.limit(1), lexicon))
    assert abs(len(few) - len(many)) < 40


def test_triplets_of_a_lexicon_table(spark):
    marks = T.Lexicon({"drum": ("drum",), "canal": ("ear canal", "canal")}, {"thick": ("thickened",), "clear": ("clear",)}, ("no ", "not "), ("left",), ("right",), ("both",))
    table = [(c, p, "entity") for c, ps in marks.entities.items() for p in ps] + [(c, p, "attribute") for c, ps in marks.attributes.items() for p in ps]
    df = spark.createDataFrame([(1, "left drum thickened; right ear canal not clear"), (2, None), (3, "drum and canal; clear"), (4, "both canal clear drum thickened")], "id int, t string")
    want = sorted(map(tuple, T.triplets(df, "id", "t", marks).collect()))
    assert sorted(map(tuple, L.triplets(df, "id", "t", spark.createDataFrame(table, "canonical string, pattern string, kind string"), marks).collect())) == want != []
