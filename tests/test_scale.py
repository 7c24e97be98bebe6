"""Operators whose plans must hold for one group of all rows: equal to plain versions, and dealt to many tasks."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import metrics as M
from quernstone.operators import nearest as N
from quernstone.operators import ordered as O
from quernstone.operators import splits as X
from quernstone.operators import vectors as V
from quernstone.plans import catalogue

SF = "/root/testdata/sf0.001"


def series(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3]), t, rng.choice([None, float(rng.randint(-9, 9))])) for t in rng.sample(range(n * 3), n)]
    return rows, spark.createDataFrame(rows, "g int, t int, v double").repartition(5)


def by_group(rows):
    out = {}
    for g, t, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((t, v))
    return out


@pytest.mark.parametrize("parts", [1, 2, 7, 60])
def test_segmented_scans_equal_plain_ones(spark, parts):
    rows, df = series(spark, parts)
    want_max, want_mean, want_fill = {}, {}, {}
    for ts in by_group(rows).values():
        known = [i for i, (_, v) in enumerate(ts) if v is not None]
        for i, (t, _) in enumerate(ts):
            so_far = [v for _, v in ts[: i + 1] if v is not None]
            near = [v for _, v in ts[max(0, i - 3) : i + 4] if v is not None]
            want_max[t] = max(so_far, default=None)
            want_mean[t] = sum(near) / len(near) if near else None
            want_fill[t] = float(np.interp(i, known, [ts[k][1] for k in known])) if known else None
    got = {r["t"]: r["cummax"] for r in O.cumulative_max(df, "g", "t", "v", parts).collect()}
    assert got == want_max
    got = {r["t"]: r["smooth"] for r in O.moving_average(df, "g", "t", "v", 3, parts).collect()}
    assert set(got) == set(want_mean) and all((got[t] is None) == (x is None) and (x is None or math.isclose(got[t], x, abs_tol=1e-12)) for t, x in want_mean.items())
    got = {r["t"]: r["filled"] for r in O.fill_linear(df, "g", "t", "v", parts).collect()}
    assert set(got) == set(want_fill) and all((got[t] is None) == (x is None) and (x is None or math.isclose(got[t], x, abs_tol=1e-9)) for t, x in want_fill.items())


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_interpolation_over_parts(spark, parts):
    rng = random.Random(5)
    points = [(g, float(rng.randint(0, 400)), float(rng.randint(0, 9))) for g in ("a", "a", "a", "b") for _ in range(60)]
    grid = [(g, float(x)) for g in ("a", "b", "c") for x in range(-10, 420, 7)]
    got = {(r["g"], r["at"]): r["y"] for r in O.interpolate_asof(spark.createDataFrame(points, "g string, x double, y double"), spark.createDataFrame(grid, "g string, at double"), "g", "x", "y", "at", parts).collect()}
    assert set(got) == set(grid)
    for g, at in grid:
        mean = {}
        for h, x, y in points:
            if h == g:
                mean.setdefault(x, []).append(y)
        xs = sorted(mean)
        assert (got[g, at] is None) if not xs else math.isclose(got[g, at], np.interp(at, xs, [np.mean(mean[x]) for x in xs]), abs_tol=1e-9)


def test_one_group_of_all_rows_is_dealt_to_many_parts(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("t"), (F.col("id") % 97).cast("double").alias("v"))
    rows = O.Segments.of(df, "g", "t", 10).rows
    sizes = [r["count"] for r in rows.groupBy("__part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1500
    plan = O.cumulative_max(df, "g", "t", "v", 10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "windowspecdefinition" in x and "__s_" not in x and "__parts" not in x]
    assert windows and all("windowspecdefinition(__part" in x for x in windows)
    empty = df.limit(0)
    assert O.cumulative_max(empty, "g", "t", "v").count() == O.moving_average(empty, "g", "t", "v", 2).count() == O.fill_linear(empty, "g", "t", "v").count() == 0


def clustered(seed, n, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * 4
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.1
    x[: n // 20] = x[0]  # copies
    x[-1] = 0
    return x


def test_neighbours_equal_brute_force_without_shuffling_the_base(spark):
    x = clustered(1, 700)
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "id long, v array<double>, y int").repartition(6)
    odd = spark.createDataFrame([(None, [1.0] * 8, 0), (9001, None, 0), (9002, [None] * 8, 0), (9003, [float("nan")] * 8, 1)], "id long, v array<double>, y int")
    u = x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]
    sims = N.rounded(N.sums(np.repeat(u, len(u), 0), np.tile(u, (len(u), 1)))).reshape(len(u), -1)
    base, queries = df.unionByName(odd), df.where("id % 20 = 0")
    got = {}
    for r in N.neighbours(queries, base, "id", "v", 5, block_bytes=800).collect():  # several blocks
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["sim"]))
    ranks = {r["query"]: r["true_rank"] for r in N.first_match_ranks(queries, base, "id", "v", "y").collect()}
    for q in range(0, 700, 20):
        order = sorted((-sims[q, j], j) for j in range(700) if j != q)
        assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(order[:5])]
        assert ranks[q] == next(k + 1 for k, (_, j) in enumerate(order) if j % 5 == q % 5)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    plan = N.neighbours(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[-1] and "Join" not in plan
    assert N.neighbours(queries.limit(0), base, "id", "v", 5).count() == N.neighbours(queries, base.limit(0), "id", "v", 5).count() == 0


def test_ranks_of_all_rows_in_many_blocks_equal_brute_force(spark, monkeypatch):
    x = np.float32(clustered(4, 400)).astype(float)
    names = [f"k{i:03d}" for i in range(400)]
    labels = [None if i % 50 == 7 else 99 if i == 8 else i % 6 for i in range(400)]  # 99: no other row has it
    rows = [(n, v.tolist(), y) for n, v, y in zip(names, x, labels, strict=True)]
    odd = [(None, [1.0] * 8, 0), ("n0", None, 0), ("n1", [None] * 8, 0), ("n2", [float("nan")] * 8, 1), ("n3", [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows + odd, "id string, v array<float>, y int")
    u = x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]
    sims = N.rounded(N.sums(np.repeat(u, 400, 0), np.tile(u, (400, 1)))).reshape(400, -1)
    want = {}
    for q in range(400):
        order = sorted((-sims[q, j], j) for j in range(400) if j != q)
        if hit := [k + 1 for k, (_, j) in enumerate(order) if labels[q] is not None and labels[j] == labels[q]]:
            want[names[q]] = hit[0]
    monkeypatch.setattr(N, "PART_BYTES", 6400)  # four parts
    ranks = N.first_match_ranks(df, df, "id", "v", "y", block_bytes=1500)
    assert {r["query"]: r["true_rank"] for r in ranks.collect()} == want and len(want) == 391
    assert "CartesianProduct" in ranks._jdf.queryExecution().executedPlan().toString()
    once = N.first_match_ranks(df.unionByName(df.where("id < 'k010'")), df, "id", "v", "y")  # repeated queries count once
    assert {r["query"]: r["true_rank"] for r in once.collect()} == want and once.count() == 391
    assert N.first_match_ranks(df.limit(0), df, "id", "v", "y").count() == N.first_match_ranks(df, df.limit(0), "id", "v", "y").count() == 0
    wide = spark.createDataFrame([(f"w{i}", [1.0] * (3 + i % 2), 1) for i in range(6)], "id string, v array<double>, y int")
    with pytest.raises(Exception, match="different widths|inhomogeneous"):
        N.first_match_ranks(wide, wide, "id", "v", "y").collect()


def test_single_precision_rules_out_no_query_that_is_reached():
    rng = np.random.default_rng(6)
    for width in (2, 64, 700):
        u = rng.normal(size=(300, width)) * 10.0 ** rng.uniform(-6, 0, (300, width))
        u /= np.sqrt((u * u).sum(1))[:, None]
        block = N.Block(list(range(200)), u[:200], [()] * 200, u[:1], *N._angles(u[:200], u[:1]))
        exact = u[:200] @ u[200:].T
        rows, every = np.arange(200, 300), np.arange(200)
        assert np.array_equal(N._reached(block, every, u, rows, exact.max(1))[0], every)  # each is just reached
        live, products = N._reached(block, every, u, rows, np.where(every % 3 == 0, exact.max(1), 1.5))
        assert np.array_equal(live, every[::3]) and np.allclose(products, exact[::3], atol=1e-12)


def test_pivots_save_most_pairs_of_clustered_vectors():
    x = clustered(2, 4000)[:-1]
    u = x / np.sqrt((x * x).sum(1))[:, None]
    pivots = N.spread(u[:500], N.PIVOTS)
    angles, short = N._angles(u[:100], pivots)
    top = N.TopK(N.Block(list(range(100)), u[:100], [()] * 100, pivots, angles, short), 5, True)
    for at in range(0, len(u), 1000):
        top.add(list(range(at, min(at + 1000, len(u)))), u[at : at + 1000])
    assert top.compared < 0.5 * 100 * len(u)


def test_means_by_class(spark):
    x = clustered(3, 60)
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)] + [(0, None), (7, None)], "y int, v array<double>")
    got = {r["y"]: r["mean"] for r in V.mean_vectors(df, "y", "v").collect()}
    assert set(got) == {0, 1, 2} and all(np.allclose(got[k], x[k::3].mean(0)) for k in got)
    assert "Generate" not in V.mean_vectors(df, "y", "v")._jdf.queryExecution().optimizedPlan().toString()


def greedy(rows, ratio, seed, least):
    labels = {}
    for k, ls in rows:
        ls = sorted(x for x in ls if x is not None)
        if k is not None and ls:
            labels[k] = min(labels.get(k, ls), ls)
    classes = sorted({x for ls in labels.values() for x in ls})
    quotas = X.quotas_of({c: sum(ls.count(c) for ls in labels.values()) for c in classes}, ratio, least)
    place = lambda c, k: (hashlib.md5(f"{seed}:{classes.index(c)}:{k}".encode()).hexdigest(), f"{classes.index(c)}:{k}")
    return X.greedy_quota(labels.items(), quotas, {c: sorted((k for k in labels if c in labels[k]), key=lambda k: place(c, k)) for c in classes})


@pytest.mark.parametrize("n, classes, ratio, least", [(40, 3, 0.2, 1), (300, 6, 0.2, 1), (300, 6, 0.9, 1), (120, 4, 0.01, 5), (60, 2, 0.5, 0)])
def test_quota_select_equals_the_greedy(spark, n, classes, ratio, least):
    rng = random.Random(n + classes)
    rows = [(i, [rng.choice([None, *range(classes), 0, 0]) for _ in range(rng.randint(0, 3))]) for i in range(n)] + [(None, [0])]
    df = spark.createDataFrame(rows, "id long, ls array<int>").repartition(3)
    got = [r["id"] for r in X.quota_select(df, "id", F.col("ls"), ratio, "s", least).collect()]
    assert len(got) == len(set(got)) and set(got) == set(greedy(rows, ratio, "s", least))


def test_quota_queries_equal_the_greedy_over_whole_tables(spark):
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {r["doc_id"] for r in catalogue.QUERIES["quota_select"](spark, SF).collect()}
    assert got == set(greedy([(i, [a, b]) for i, a, b in labels], 0.2, "0", 1))
    rows = catalogue.QUERIES["sub_split_20"](spark, SF).collect()
    val = {r["doc_id"] for r in rows if r["split"] != "train"}
    train = [(i, [a, b]) for i, a, b in labels if i not in val]
    assert {r["doc_id"] for r in rows if r["split"] == "train"} == set(greedy(train, 0.2, "0", 1))
    assert X.quota_select(spark.createDataFrame([(1, None), (2, [1])], "id int, ls array<int>"), "id", F.col("ls"), 1.0).count() == 2


@pytest.mark.parametrize("part_rows", [1, 5, 1000])
def test_bootstrap_does_not_depend_on_the_parts(spark, part_rows):
    rng = np.random.default_rng(9)
    rows = [(int(g), int(y), int(s) / 4) for g, y, s in zip(rng.integers(0, 5, 80), rng.integers(0, 2, 80), rng.integers(0, 5, 80), strict=True)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    run = lambda n: {r["metric"]: tuple(r)[1:] for r in M.bootstrap_metrics(df, F.col("y"), F.col("s"), F.col("g"), 30, seed="q", part_rows=n).collect()}
    one, many = run(10_000), run(part_rows)
    assert set(one) == set(many) == set(M.BOOTSTRAPPED) and all(np.allclose(one[m], many[m]) for m in one)


def test_bootstrap_draws_and_ranges_of_scores(spark):
    import hashlib

    groups = [b"1", b"", "é".encode(), b"12345678", b"y" * 44, b"y" * 49, b"x" * 60]
    steps = np.array(M.poisson_steps())
    want = [[np.searchsorted(steps, int(hashlib.md5(b"42:%d:" % r + g).hexdigest()[:8], 16) / 2**32, "right") for r in range(1, 1005)] for g in groups]
    assert (M.drawn("42", groups, 1004) == want).all() and (M.drawn("42", groups, 1004, False) == np.minimum(want, 1)).all()
    rng = np.random.default_rng(4)
    rows = [(int(g), int(y), float(s)) for g, y, s in zip(rng.integers(0, 40, 400), rng.integers(0, 2, 400), rng.integers(0, 150, 400) / 150, strict=True)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    run = lambda **kw: {r["metric"]: tuple(r)[1:] for r in M.bootstrap_metrics(df, F.col("y"), F.col("s"), F.col("g"), 30, seed="q", **kw).collect()}
    one = run()
    for most, part_rows in ((1, 10), (7, 10), (60, 1), (3, 1000)):
        many = run(most_cells=most, part_rows=part_rows)
        assert set(one) == set(many) == set(M.BOOTSTRAPPED) and all(np.allclose(one[m], many[m]) for m in one)


def test_what_a_task_holds_does_not_grow_with_queries_and_pairs():
    import tracemalloc

    rng = np.random.default_rng(5)
    v = rng.normal(size=(8192, 16))
    v /= np.sqrt((v * v).sum(1))[:, None]
    v[:300] = v[0]
    pivots = N.spread(v[:500], 8)
    angles, short = N._angles(v, pivots)
    block, base = N.Block(list(range(len(v))), v, [()] * len(v), pivots, angles, short), v[:512]
    sims = np.round(v @ base.T, 9)
    limit, counts = rng.permutation(sims[:, 0]), np.zeros(len(v), np.int64)
    tracemalloc.start()
    for q, _, sim in N._ahead(block, base, limit, 9, counts):
        np.add.at(counts, q[sim > limit[q]], 1)
    top = N.TopK(block, 3, True)
    top.add(list(range(len(base))), base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 8192 queries times 256 rows times 16 components, twice, would be 537 MB
    assert np.abs(counts - (sims > limit[:, None]).sum(1)).max() == 0
    for i in (0, 5, 299, 300, 4000, 8191):
        want = sorted((-s, j) for j, s in enumerate(N.rounded(N.sums(np.repeat(v[i : i + 1], 512, 0), base))) if j != i)[:3]
        assert [(-s, j) for s, j in top.best[i]] == want


def test_ngrams_of_rows_that_share_a_key_and_of_any_size(spark):
    from quernstone.operators import text as T

    docs = [(1, "a", "abab c"), (2, "b", "é😀a😀"), (2, "b", "ab"), (3, None, "b"), (4, "a", None), (5, "a", ""), (None, "b", "abc")]
    df = spark.createDataFrame(docs, "id long, label string, t string")
    grams = lambda t, sizes: [t[i : i + n] for n in sizes for i in range(len(t or "") - n + 1)]
    for sizes in ((1, 2), (2, 4)):
        want = Counter(g for _, _, t in docs for g in set(grams(t, sizes)))
        assert {r["gram"]: r["df"] for r in T.document_frequencies(df, "id", F.col("t"), sizes).collect()} == want
        tf, members = {}, Counter(x for _, x, _ in docs)
        for i, x, t in docs:
            for g in grams(t, sizes):
                tf.setdefault((i, x), Counter())[g] += 1
        many = Counter(g for c in tf.values() for g in c)
        sums = Counter()
        for (i, x), c in tf.items():
            w = {g: k * (math.log((1 + len(docs)) / (1 + many[g])) + 1) for g, k in c.items()}
            for g in w if i is not None and x is not None else ():
                sums[x, g] += w[g] / math.sqrt(sum(v * v for v in w.values())) / members[x]
        got = {(r["label"], r["gram"]): r["weight"] for r in T.tfidf_class_means(df, "id", F.col("t"), "label", sizes=sizes).collect()}
        assert set(got) == set(sums) and all(math.isclose(got[k], sums[k]) for k in got)
        plan = T.document_frequencies(df, "id", F.col("t"), sizes)._jdf.queryExecution().executedPlan().toString()
        assert sizes != (1, 2) or "Generate" not in plan  # no row for each n-gram of a text
