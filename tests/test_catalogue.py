"""Every query with an oracle against DuckDB on the smallest data."""

import duckdb
import pandas as pd
import pytest

from quernstone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows(frame: pd.DataFrame) -> list:
    return sorted(map(tuple, frame[sorted(frame.columns)].map(plain).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_quota_select_meets_quotas(spark):
    picked = catalogue.QUERIES["quota_select"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n, m = picked.join(labels, "doc_id").count(), labels.count()
    assert 0 < n < m and picked.distinct().count() == n


def test_weighted_draw_counts(spark):
    assert catalogue.QUERIES["weighted_draw"](spark, SF).agg({"draws": "sum"}).first()[0] == 500


def test_interp_asof_hourly_and_match_audit_all_take_every_row(spark):
    import numpy as np

    ev = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    ev["x"] = (ev["ts"] - pd.Timestamp("2024-01-01")).dt.total_seconds()
    got = catalogue.QUERIES["interp_asof_hourly"](spark, SF).toPandas()
    assert len(got) == 720 * ev["event_type"].nunique()
    for kind, part in got.groupby("event_type"):
        p = ev[ev["event_type"] == kind].groupby("x")["value"].mean()
        assert np.allclose(part["y"], np.interp(part["at"] - 1704067200, p.index, p), atol=1e-4)
    orders, items = (set(spark.read.parquet(f"{SF}/{t}.parquet").toPandas()[c]) for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    assert catalogue.QUERIES["match_audit_all"](spark, SF).first()["missing"] == len(orders - items)


def test_bootstrap_metrics_by_user_has_all_replicates_and_metrics(spark):
    got = {r["metric"]: r for r in catalogue.QUERIES["bootstrap_metrics_by_user"](spark, SF).collect()}
    assert len(got) == 8 and {r["replicates"] for r in got.values()} == {1000}
    assert all(r["low"] <= r["mean"] <= r["high"] for r in got.values())


def test_six_numbers_rounds_ties_and_odd_vectors_as_its_sql(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    ties = [0.1015625, 0.1171875, -0.1015625, 0.0131835938, 1234565.0, 28570250.0]  # halves of the sixth digit
    odd = [None, [], [None], [None, 1.5], [0.5, 0.25], [float("nan"), float("inf"), -float("inf"), -0.0, 0.0], [1e20, 1e-5, 1e-4, 999999.5, 1e-45, 3.4e38, 7.0], ties]
    vectors = odd + (rng.integers(-(2**24), 2**24, (500, 6)) / 2.0 ** rng.integers(0, 40, (500, 6))).tolist()
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["numbers"] for r in catalogue.QUERIES["six_numbers"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == dict(con.execute(catalogue.ORACLE["six_numbers"]).fetchall())
    assert got[len(odd) - 1].startswith("0.101562,0.117188,-0.101562,")


def test_recall_at_k_ranks_every_vector(spark, tmp_path):
    import numpy as np

    # vectors whose id 20 divides have a neighbour of their label next to them, the others one of another label
    angles, labels = [], []
    for i in range(100):
        angles.append(i // 20 * 1.2 + (i % 20 > 1) * (0.3 + i % 20 * 0.02) + (i % 20 == 1) * 1e-3)
        labels.append(0 if i % 20 < 2 else i % 2 + 1)
    x = np.c_[np.cos(angles), np.sin(angles)]
    spark.createDataFrame([(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["k_requested"]: r["recall"] for r in catalogue.QUERIES["recall_at_k"](spark, str(tmp_path)).collect()}
    sims = np.round(x @ x.T, 6)
    ranks = []
    for i in range(100):
        order = sorted((-sims[i, j], j) for j in range(100) if j != i)
        ranks.append(next(k for k, (_, j) in enumerate(order, 1) if labels[j] == labels[i]))
    assert got == {k: round(sum(r <= k for r in ranks) / 100, 6) for k in (1, 5, 10)} and got[1] < 1
    assert all(ranks[i] == 1 for i in range(0, 100, 20))
