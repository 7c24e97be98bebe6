"""Queries of row forms: texts, codes, losses, pooling and projections as columns, and the slice order of a series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import scalar as S
from quernstone.operators import ordered as O
from quernstone.operators import relational as R
from quernstone.operators import slices as I
from quernstone.operators import text as T
from quernstone.operators import vectors as V
from quernstone.plans.catalogue import _CHARS, _DOC_GRAMS
from quernstone.plans.registry import query, rounded

_CLEAN = "regexp_replace(regexp_replace(coalesce({}, ''), '\\r\\n?', chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query(f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned, md5({_CLEAN.format('x')}) AS joined FROM (SELECT doc_id, text, {_CLEAN.format('source')} || chr(10) || {_CLEAN.format('text')} AS x FROM documents)")
def cleaned_texts(table):
    """Digests of cleaned texts, and of source and text joined."""
    return table("documents").select("doc_id", F.md5(S.clean_text(F.col("text"))).alias("cleaned"), F.md5(S.join_text(F.col("source"), F.col("text"))).alias("joined"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 1 AND 6 THEN l_linenumber - 1 END AS class_id, CAST(l_quantity AS DOUBLE) AS first FROM lineitem")
def class_ids(table):
    """Codes as class ids, and the first of several numbers in a text."""
    several = F.concat_ws("\\", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"))
    return table("lineitem").select("l_orderkey", "l_linenumber", S.class_id(F.col("l_linenumber")).alias("class_id"), S.first_number(several).alias("first"))


@query("SELECT event_id, round((least(greatest(value, 100.0), 300.0) - 100.0) / (200.0 + 1e-6), 9) AS unit, round(CASE WHEN event_id % 60 < 5 THEN 0.001 * (event_id % 60 + 1) / 5.0 ELSE 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(3.141592653589793 * least(1.0, (event_id % 60 - 5) / 45.0))) END, 9) AS lr FROM events")
def windowed_values(table):
    """Values clipped to a window and scaled, and the learning rate at an epoch read from the id."""
    return table("events").select("event_id", F.round(S.window_unit(F.col("value"), 100.0, 300.0), 9).alias("unit"), F.round(S.learning_rate(F.col("event_id") % 60, 0.001, 5, 50, 0.00001), 9).alias("lr"))


_P = "SELECT event_id, CAST(event_type = 'purchase' AS INT) AS y, (event_id % 101) / 100.0::DOUBLE AS p FROM events"
_Q = "least(greatest(p, 1e-6), 1 - 1e-6)"


@query(f"SELECT event_id, round(pow(1 - (q * t + (1 - q) * (1 - t)), 2.0) * -(3.0::DOUBLE * t * ln(q) + (1 - t) * ln(1 - q)), 6) AS focal FROM (SELECT event_id, {_Q} AS q, y * (1 - 0.1::DOUBLE) + 0.5 * 0.1::DOUBLE AS t FROM ({_P}))")
def focal_losses(table):
    """Focal losses with smoothed labels and a weight of positives."""
    y, p = (F.col("event_type") == "purchase").cast("int"), (F.col("event_id") % 101) / F.lit(100.0)
    return table("events").select("event_id", F.round(S.focal_loss(y, p, 2.0, 0.1, 3.0), 6).alias("focal"))


_SOFT = "SELECT vec_id, label, list_transform(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - m)), lambda e: e / s) AS p FROM (SELECT vec_id, label, embedding, m, list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - m))) AS s FROM (SELECT *, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings))"


@query(f"SELECT vec_id, round(list_max(p), 9) AS top, round(list_sum(p), 6) AS total, round(-(0.9::DOUBLE * ln(p[label + 1]) + 0.1::DOUBLE / 64 * list_sum(list_transform(p, lambda x: ln(greatest(x, 1e-12))))), 6) AS loss FROM ({_SOFT})")
def softmax_losses(table):
    """Softmax of each vector, and its smoothed cross-entropy against the label."""
    p = table("embeddings").select("vec_id", "label", S.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 9).alias("top"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(S.smoothed_cross_entropy(F.col("p"), F.col("label"), 64, 0.1), 6).alias("loss"))


@query("""WITH e AS (SELECT vec_id, list_transform(range(8), lambda k: exp(CAST(embedding[k + 1] AS DOUBLE) - CAST(list_max(embedding[1:8]) AS DOUBLE))) AS w, embedding AS v FROM embeddings)
SELECT vec_id, i AS place, round(list_sum(list_transform(range(8), lambda k: w[k + 1] / list_sum(w) * CAST(v[CAST(8 * k + i + 1 AS INT)] AS DOUBLE))), 6) AS pooled FROM e, range(8) t(i)""")
def attention_pools(table):
    """Eight slices of eight numbers a vector, weighted by the softmax of its first eight numbers."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table("embeddings").select("vec_id", F.slice(v, 1, 8).alias("w"), F.array(*[F.slice(v, 8 * k + 1, 8) for k in range(8)]).alias("s"))
    return rounded(rows.select("vec_id", F.posexplode(V.attention_pool(F.col("w"), F.col("s"), 8)).alias("place", "pooled")), "pooled")


_EVEN = "(CAST('0x' || substr(md5('7:' || i || ':' || j || ':{}'), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE"


@query(f"WITH w AS (SELECT j, list(sqrt(-2 * ln({_EVEN.format(0)})) * cos(2 * pi() * {_EVEN.format(1)}) / sqrt(8::DOUBLE) ORDER BY i) AS r FROM range(64) a(i), range(8) b(j) GROUP BY j) SELECT vec_id, j AS place, round(list_sum(list_transform(list_zip(embedding, r), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS x FROM embeddings, w")
def gaussian_projection(table):
    """Vectors of 64 projected to 8 numbers by seeded normal weights."""
    return rounded(table("embeddings").select("vec_id", F.posexplode(V.projection(F.col("embedding"), 64, 8, "7")).alias("place", "x")), "x")


@query("SELECT u.unit, coalesce(nullif(c.c_name, ''), 'UNIT_' || u.unit) AS owner FROM (SELECT o_orderkey AS unit FROM orders) u LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = u.unit")
def owners_or_units(table):
    """Owners by unit; a unit without one, or with an empty one, is its own."""
    owners = table("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("unit"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("owner"))
    return R.attach_owner(table("orders").select(F.col("o_orderkey").alias("unit")), owners, "unit", "owner")


@query("SELECT user_id, CAST(greatest(0, least(best - 5, n - 10)) AS BIGINT) AS first FROM (SELECT user_id, count(*) AS n, arg_min(k, (-value, k)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) GROUP BY user_id)")
def block_starts(table):
    """The first place of ten rows around each user's largest value, clamped to the user's rows."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    best = table("events").withColumn("k", k).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("k", F.struct(-F.col("value"), F.col("k"))).alias("best"))
    return best.select("user_id", O.block_around(F.col("best"), F.col("n"), 10).cast("long").alias("first"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN z IS NOT NULL THEN 0 WHEN i IS NOT NULL THEN 1 ELSE 2 END, coalesce(z, CAST(i AS DOUBLE), CAST(f AS DOUBLE)), CASE WHEN z IS NOT NULL THEN coalesce(i, 0) ELSE 0 END, o_orderkey) AS place FROM (
SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DOUBLE) END AS z, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS i, o_orderkey % 11 AS f FROM orders)""")
def slice_places(table):
    """The order of slices of a series, whose z, instance number or file number stands in the order."""
    z = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("double"))
    key = I.slice_order(z, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5), F.concat(F.lit("s/a."), F.col("o_orderkey") % 11, F.lit(".dcm")))
    return table("orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(key, "o_orderkey")).alias("place"))


@query("""WITH p AS (SELECT o_orderkey AS unit, unnest(['left', 'right']) AS side FROM orders), m AS (SELECT l_orderkey, arg_min(l_quantity, (l_linenumber, l_quantity, l_returnflag)) AS spacing, arg_min(l_returnflag, (l_linenumber, l_quantity, l_returnflag)) AS kernel FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1)
SELECT unit, side, CAST(spacing AS DOUBLE) AS spacing, kernel FROM p LEFT JOIN m ON l_orderkey = unit""")
def series_of_parts(table):
    """Parts with the metadata of their series, the first line of an order; a third of the orders have none."""
    p = table("orders").select(F.col("o_orderkey").alias("unit"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    meta = table("lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("unit"), "l_linenumber", F.col("l_quantity").cast("double").alias("spacing"), F.col("l_returnflag").alias("kernel"))
    return R.attach_series(p, meta, ["unit"], ["spacing", "kernel"], "l_linenumber")


_HOURS = "SELECT event_type, x FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(generate_series(CAST(floor(min(epoch(ts)) / 3600) AS BIGINT), CAST(ceil(max(epoch(ts)) / 3600) AS BIGINT))) * 3600.0::DOUBLE AS x FROM events)"


@query(f"""WITH p AS (SELECT event_type, CAST(epoch(ts) AS DOUBLE) AS x, avg(value) AS y FROM events GROUP BY 1, 2), g AS ({_HOURS}),
l AS (SELECT g.event_type, g.x, p.x AS lo, p.y AS ly FROM g ASOF LEFT JOIN p ON p.event_type = g.event_type AND g.x >= p.x), n AS (SELECT l.*, p.x AS hi, p.y AS hy FROM l ASOF LEFT JOIN p ON p.event_type = l.event_type AND l.x <= p.x)
SELECT event_type, x AS at, round(CASE WHEN lo IS NULL THEN hy WHEN hi IS NULL THEN ly WHEN hi = lo THEN ly ELSE ly + (hy - ly) * (x - lo) / (hi - lo) END, 4) AS y FROM n""")
def interp_asof_all_hours(table):
    """All events on the hours from the first to the last, whatever the table's span."""
    ev = table("events").withColumn("x", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) / 1e6"))
    span = ev.agg(F.sequence(F.floor(F.min("x") / 3600), F.ceil(F.max("x") / 3600)).alias("h"))
    grid = ev.select("event_type").distinct().withColumn("h", span.scalar()).select("event_type", F.explode("h").alias("h")).select("event_type", (F.col("h") * F.lit(3600.0)).alias("at"))
    return rounded(O.interpolate_asof(ev, grid, "event_type", "x", "value", "at").withColumnRenamed("value", "y"), "y", digits=4)


@query(f"WITH {_CHARS}, g AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 64 AS INT) AS bucket, count(*) AS n FROM ({_DOC_GRAMS}) GROUP BY 1, 2) SELECT doc_id, bucket, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS weight FROM g")
def document_hash_vectors(table):
    """Hashed n-gram vectors of whole documents."""
    return rounded(T.hash_vector(table("documents"), "doc_id", "text", 64), "weight")
