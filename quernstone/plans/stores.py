"""Queries of the operators that keep something: lexicon tables, the memo of codes, sketched profiles, the census."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.operators import lexicon as L
from quernstone.operators import memo, profiles
from quernstone.operators import reports as C
from quernstone.plans.catalogue import LEXICON
from quernstone.plans.registry import ORACLE, query
from quernstone.scratch import scratch_root


def _pairs(table):
    """The distinct pairs of neighbouring words of the benchmark, as a lexicon."""
    words = table("benchmark").select(F.split("text", " ").alias("w"))
    pairs = words.select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pattern"))
    return pairs.distinct().withColumn("canonical", F.col("pattern"))


@query("""WITH p AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS pattern FROM (SELECT string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')))) AS i FROM benchmark))
SELECT pattern, count(*) AS documents, CAST(sum((length(text) - length(replace(text, pattern, ''))) // length(pattern)) AS BIGINT) AS hits FROM documents JOIN p ON contains(text, pattern) GROUP BY pattern""", python=True)
def lexicon_table_hits(table):
    """Documents and occurrences of every pair of neighbouring benchmark words: thousands of patterns, one pass."""
    found = L.hits(table("documents"), "doc_id", "text", _pairs(table)).groupBy("pattern", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("hits"))


@query(ORACLE["lexicon_triplets"], python=True)
def lexicon_table_triplets(table):
    """Triplets under the lexicon as a table of patterns: the rows of the fixed lexicon."""
    spark = table("documents").sparkSession
    rows = [(c, p, kind) for kind, group in (("entity", LEXICON.entities), ("attribute", LEXICON.attributes)) for c, ps in group.items() for p in ps]
    return L.triplets(table("documents"), "doc_id", "text", spark.createDataFrame(rows, "canonical string, pattern string, kind string"), LEXICON)


@query("SELECT doc_id, CAST(length(text) AS INT) AS code FROM documents")
def memo_codes(table):
    """Codes of all texts by way of a kept memo: the second run takes every code from it."""
    docs = table("documents").select("doc_id", "text")
    folder = f"{scratch_root(docs.sparkSession)}/quernstone/memo-{uuid.uuid4().hex}"
    memo.encode_memo(docs, "text", F.length, folder, "length")
    return memo.encode_memo(docs, "text", F.length, folder, "length").select("doc_id", "code")


@query("SELECT 'value' AS \"column\", count(value) AS n, count(*) - count(value) AS nulls, min(value) AS min, max(value) AS max, true AS quantiles_hold, true AS distinct_holds FROM events UNION ALL SELECT 'user_id', count(user_id), count(*) - count(user_id), NULL, NULL, true, true FROM events")
def sketched_profile(table):
    """Profiles of events merged from stored sketches of each type; the last columns say that estimates hold their stated bounds."""
    events = table("events")
    store = profiles.ProfileStore(events.sparkSession, f"{scratch_root(events.sparkSession)}/quernstone/profiles-{uuid.uuid4().hex}")
    store.add(events.where("event_type < 'd'"), "event_type", ["value"], ["user_id"])
    store.add(events, "event_type", ["value"], ["user_id"])
    points = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    merged = store.profile(points)
    wanted = {p: f"p{round(100 * p)}" for p in points}
    guess = merged.where("column = 'value'").select(F.struct(*wanted.values()).alias("g"))
    inside = None
    for p, name in wanted.items():
        below, upto = F.avg((F.col("value") < F.col(f"g.{name}")).cast("int")), F.avg((F.col("value") <= F.col(f"g.{name}")).cast("int"))
        ok = (below <= p + profiles.RANK_ERROR) & (upto >= p - profiles.RANK_ERROR)
        inside = ok if inside is None else inside & ok
    held = events.where("value IS NOT NULL").withColumn("g", guess.scalar()).agg(inside.alias("ok"), F.count_distinct("value").alias("d"))
    users = events.agg(F.count_distinct("user_id").alias("d"))
    near = lambda d: F.abs(F.col("distinct") - d) <= profiles.DISTINCT_ERROR * d
    exact = F.when(F.col("column") == "value", held.select("d").scalar()).otherwise(users.scalar())
    return merged.select("column", "n", "nulls", "min", "max", F.when(F.col("column") == "value", held.select("ok").scalar()).otherwise(F.col("p50").isNull()).alias("quantiles_hold"), near(exact).alias("distinct_holds"))


def _section(name: str, items: str) -> str:
    return f"SELECT '{name}' AS section, item, CAST(value AS VARCHAR) AS value FROM ({items})"


@query("\nUNION ALL\n".join([
    _section("counts", "SELECT unnest(['rows', 'units', 'owners', 'labelled', 'unlabelled']) AS item, unnest([count(*), count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(*) FILTER (o_orderkey % 7 < 6), count(*) FILTER (o_orderkey % 7 >= 6)]) AS value FROM orders"),
    _section("codes", "SELECT CAST(o_orderkey % 7 + 1 AS VARCHAR) AS item, count(*) AS value FROM orders WHERE o_orderkey % 7 < 6 GROUP BY 1"),
    _section("top_priority", "SELECT coalesce(o_orderpriority, 'NA') AS item, count(*) AS value FROM orders WHERE o_orderkey % 7 < 6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    _section("price", "SELECT unnest(['n', 'min', 'max', 'p50', 'p95']) AS item, unnest([CAST(count(o_totalprice) AS VARCHAR), printf('%.4f', min(o_totalprice)), printf('%.4f', max(o_totalprice)), printf('%.4f', quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5)), printf('%.4f', quantile_cont(CAST(o_totalprice AS DOUBLE), 0.95))]) AS value FROM orders WHERE o_orderkey % 7 < 6"),
    _section("dates", "SELECT unnest(['min', 'max', 'n']) AS item, unnest([strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'), CAST(count(o_orderdate) AS VARCHAR)]) AS value FROM orders WHERE o_orderkey % 7 < 6"),
    _section("weights", "SELECT CAST(c AS VARCHAR) AS item, printf('%.6f', (SELECT count(*) FROM orders WHERE o_orderkey % 7 < 6) / (6.0::DOUBLE * n)) AS value FROM (SELECT o_orderkey % 7 + 1 AS c, count(*) AS n FROM orders WHERE o_orderkey % 7 < 6 GROUP BY 1)"),
    _section("views", "SELECT 'positives' AS item, count(*) FILTER (o_orderkey % 7 + 1 IN (1, 2, 3, 4, 6)) AS value FROM orders WHERE o_orderkey % 7 < 6 UNION ALL SELECT 'negatives', count(*) FILTER (o_orderkey % 7 + 1 = 5) FROM orders WHERE o_orderkey % 7 < 6"),
]))
def data_task_census(table):
    """The census of parts: counts, codes, most frequent categories, numeric profile, dates, class weights and a view."""
    parts = table("orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderkey") % 7 < 6, F.col("o_orderkey") % 7 + 1).cast("int").alias("code"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))
    return C.task_census(parts, "unit", "owner", "code", categories=["priority"], top=15, numeric=["price"], points=(0.5, 0.95), dates=["day"], classes=range(1, 7), view="normal_vs_abnormal")


_UNITS = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) + 1e-12)) AS v FROM embeddings"


@query(f"""WITH u AS ({_UNITS}), s AS (SELECT a.vec_id AS query, a.label, b.vec_id AS id, b.label AS other, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 6) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.label IN (1, 2, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) SELECT query, label, string_agg(rank || ':' || id || ':' || other || ':' || printf('%.6f', sim), ',' ORDER BY rank) AS neighbours FROM r WHERE rank <= 5 GROUP BY 1, 2""", python=True)
def retrieval_export(table):
    """The retrieval export of a stated query set, searched among rows of three labels; its JSON told again as text."""
    e = table("embeddings")
    rows = C.retrieval_records(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "label", 5, base_codes=[1, 2, 3])
    parsed = F.from_json("neighbours", "array<struct<rank:int,id:long,label:int,sim:double>>")
    told = F.transform(parsed, lambda x: F.concat_ws(":", x["rank"].cast("string"), x["id"].cast("string"), x["label"].cast("string"), F.format_string("%.6f", x["sim"])))
    return rows.select("query", "label", F.array_join(told, ",").alias("neighbours"))
