"""All queries on the shared tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import scalar as S
from quernstone.operators import metrics as M
from quernstone.operators import nearest as N
from quernstone.operators import ordered as O
from quernstone.operators import relational as R
from quernstone.operators import splits as X
from quernstone.operators import text as T
from quernstone.operators import vectors as V
from quernstone.plans.registry import ORACLE, QUERIES, query, rounded

# Scored events: y is informative, a score has many ties.
Y = lambda: F.expr("CAST(value + event_id % 37 > 60 AS INT)")  # noqa: E731  columns need a session, which imports do without
SCORE = lambda: F.expr("round(value, 0)")
_EV = "SELECT event_id, user_id, event_type, value, CAST(value + event_id % 37 > 60 AS INT) AS y, round(value, 0) AS s FROM events"
_AUC = "(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))"
_RANKED = f"SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ({_EV})"
_AP = f"SELECT avg(tp / CAST(k AS DOUBLE)) AS ap FROM (SELECT y, row_number() OVER (ORDER BY s DESC, event_id) AS k, sum(y) OVER (ORDER BY s DESC, event_id ROWS UNBOUNDED PRECEDING) AS tp FROM ({_EV})) WHERE y = 1"


def _confusion_sql(t: float) -> str:
    return f"SELECT count(*) FILTER (s >= {t} AND y = 1) AS tp, count(*) FILTER (s >= {t} AND y = 0) AS fp, count(*) FILTER (s < {t} AND y = 0) AS tn, count(*) FILTER (s < {t} AND y = 1) AS fn FROM ({_EV})"


def _best_sql(value: str) -> str:
    return f"""WITH e AS ({_EV}), c AS (SELECT DISTINCT s AS t FROM e UNION SELECT 0 UNION SELECT 1),
a AS (SELECT s, count(*) AS n, sum(y) AS p FROM e GROUP BY s),
x AS (SELECT t, sum(CASE WHEN s >= t THEN p ELSE 0 END) AS tp, sum(CASE WHEN s >= t THEN n - p ELSE 0 END) AS fp, sum(p) AS P, sum(n) AS N FROM c, a GROUP BY t),
v AS (SELECT t, round({value}, 12) AS v FROM x) SELECT t AS threshold, v AS value FROM v ORDER BY v DESC, t LIMIT 1"""


_F1 = "CASE WHEN tp + fp + P > 0 THEN 2.0 * tp / (tp + fp + P) ELSE 0 END"
_YOUDEN = "tp / CAST(P AS DOUBLE) - fp / CAST(N - P AS DOUBLE)"
_ACC = "(tp + N - P - fp) / CAST(N AS DOUBLE)"
_SENS = f"""WITH e AS ({_EV}), k AS (SELECT greatest(1, CAST(floor(0.05 * count(*) FILTER (y = 0) + 1e-9) AS BIGINT)) AS k FROM e),
n AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS i FROM e WHERE y = 0), t AS (SELECT s AS t FROM n, k WHERE i = k)
SELECT 0.95 AS target, count(*) FILTER (y = 1 AND s > t) / CAST(count(*) FILTER (y = 1) AS DOUBLE) AS sensitivity, 1 - count(*) FILTER (y = 0 AND s > t) / CAST(count(*) FILTER (y = 0) AS DOUBLE) AS specificity FROM e, t"""


@query(f"""SELECT round(a.auroc, 6) AS auroc, a.pos, a.neg, round(p.ap, 6) AS average_precision, c.tp, c.fp, c.tn, c.fn, 60.0 AS threshold,
round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
round(tn / CAST(tn + fp AS DOUBLE), 6) AS specificity, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, b.threshold AS best_f1_threshold, round(b.value, 6) AS best_f1, round(q.sensitivity, 6) AS sens_at_spec
FROM (SELECT {_AUC} AS auroc, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg FROM ({_RANKED})) a, ({_AP}) p, ({_confusion_sql(60)}) c, ({_best_sql(_F1)}) b, ({_SENS}) q""")
def binary_metrics_events(table):
    """The whole binary metric bundle in one row."""
    out = M.binary_metrics(table("events"), Y(), SCORE(), F.col("event_id"), threshold=60.0)
    return rounded(out, "auroc", "average_precision", "accuracy", "precision", "recall", "specificity", "f1", "best_f1", "sens_at_spec")


@query(f"SELECT round({_AUC}, 6) AS auroc, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg FROM ({_RANKED})")
def auroc_tie_aware(table):
    return rounded(M.auroc(M.score_frame(table("events"), Y(), SCORE())), "auroc")


@query(f"SELECT round(ap, 6) AS average_precision FROM ({_AP})")
def average_precision(table):
    return rounded(M.average_precision(table("events"), Y(), SCORE(), F.col("event_id")).drop("pos"), "average_precision")


@query(_confusion_sql(100))
def confusion_at_threshold(table):
    return M.confusion_at(table("events"), Y(), SCORE(), 100.0).select("tp", "fp", "tn", "fn")


@query(f"SELECT target, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM ({_SENS})")
def sens_at_spec(table):
    return rounded(M.sensitivity_at(M.score_frame(table("events"), Y(), SCORE()), 0.95), "sensitivity", "specificity")


def _best(name: str, value: str):
    def best(table):
        return rounded(M.best_threshold(M.score_frame(table("events"), Y(), SCORE()), name).select("threshold", "value"), "value")

    best.__name__ = f"best_threshold_{name}"
    return query(f"SELECT threshold, round(value, 6) AS value FROM ({_best_sql(value)})")(best)


_best("f1", _F1), _best("youden", _YOUDEN), _best("accuracy", _ACC)


@query("\nUNION ALL\n".join(f"SELECT '{n}' AS criterion, threshold, round(value, 6) AS value FROM ({_best_sql(v)})" for n, v in (("f1", _F1), ("youden", _YOUDEN), ("accuracy", _ACC))))
def calibration_report(table):
    return rounded(M.best_thresholds(M.score_frame(table("events"), Y(), SCORE())), "value")


# All steps of the Poisson(1) law above 2^-32, as the operator draws them.
_POISSON = " ".join(f"WHEN u < {t!r} THEN {i}" for i, t in enumerate(M.poisson_steps()))
def boot_sql(rows: str, seed: str, threshold: float, groups: str) -> str:
    """All eight metrics over 1000 replicates of the groups of ``rows`` (groups, y, s)."""
    return f"""WITH e AS ({rows}), b AS (SELECT CAST({groups} AS VARCHAR) AS g, s, count(*) AS n, sum(y) AS pos FROM e GROUP BY 1, 2),
w AS (SELECT r, g, CASE {_POISSON} ELSE {len(M.poisson_steps())} END AS w FROM (SELECT r, g, CAST('0x' || substr(md5('{seed}:' || r || ':' || g), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT g FROM b), range(1, 1001) t(r))),
d AS (SELECT r, s, CAST(sum(n * w) AS DOUBLE) AS n, CAST(sum(pos * w) AS DOUBLE) AS pos FROM w JOIN b USING (g) WHERE w > 0 GROUP BY r, s),
c AS (SELECT *, n - pos AS neg, sum(n) OVER x AS cn, sum(pos) OVER x AS cp, sum(n - pos) OVER (PARTITION BY r) AS q FROM d WINDOW x AS (PARTITION BY r ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, floor(0.05::DOUBLE * q + 1e-9) AS k FROM c),
t AS (SELECT *, max(CASE WHEN cn - cp >= greatest(k, 1) THEN s END) OVER (PARTITION BY r) AS kth, min(CASE WHEN neg > 0 THEN s END) OVER (PARTITION BY r) AS low FROM k),
h AS (SELECT *, CASE WHEN k >= q THEN s >= low ELSE s > kth END AS hit FROM t),
a AS (SELECT r, sum(pos) AS p, sum(neg) AS q, sum(pos * (neg / 2) - pos * (cn - cp)) AS wins, sum(pos * cp / cn) AS steps, sum(CASE WHEN s >= {threshold} THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s >= {threshold} THEN neg ELSE 0 END) AS fp, sum(CASE WHEN hit THEN pos ELSE 0 END) AS tp2, sum(CASE WHEN hit THEN neg ELSE 0 END) AS fp2 FROM h GROUP BY r),
v AS (SELECT unnest([{{'m': 'auroc', 'v': CASE WHEN p > 0 AND q > 0 THEN (wins + p * q) / (p * q) END}}, {{'m': 'auprc', 'v': CASE WHEN p > 0 THEN steps / p END}}, {{'m': 'accuracy', 'v': (tp + q - fp) / (p + q)}}, {{'m': 'sensitivity', 'v': CASE WHEN p > 0 THEN tp / p ELSE 0 END}}, {{'m': 'specificity', 'v': CASE WHEN q > 0 THEN (q - fp) / q ELSE 0 END}}, {{'m': 'f1', 'v': CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END}}, {{'m': 'sensitivity_at_spec', 'v': CASE WHEN q > 0 THEN CASE WHEN p > 0 THEN tp2 / p ELSE 0 END END}}, {{'m': 'specificity_at_spec', 'v': CASE WHEN q > 0 THEN (q - fp2) / q END}}]) AS x FROM a)
SELECT x.m AS metric, round(avg(x.v), 6) AS mean, round(quantile_cont(x.v, 0.025), 6) AS low, round(quantile_cont(x.v, 0.975), 6) AS high, count(x.v) AS replicates FROM v GROUP BY 1"""


_BOOT = boot_sql(_EV, "7", 60, "user_id")


@query(_BOOT, python=True)
def bootstrap_metrics_by_user(table):
    """All eight metrics over 1000 replicates of whole users."""
    out = M.bootstrap_metrics(table("events"), Y(), SCORE(), F.col("user_id"), 1000, seed="7", threshold=60.0)
    return rounded(out, "mean", "low", "high")


@query(f"SELECT mean, low, high, replicates FROM ({_BOOT}) WHERE metric = 'auroc'", python=True)
def auroc_bootstrap_by_user(table):
    out = M.bootstrap_metrics(table("events"), Y(), SCORE(), F.col("user_id"), 1000, seed="7", threshold=60.0)
    return rounded(out.where("metric = 'auroc'"), "mean", "low", "high").select("mean", "low", "high", "replicates")


_CELLS = "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_quantity > 25 THEN 0 ELSE 2 END AS p FROM lineitem"
_REPORT = f"""WITH c AS ({_CELLS}), k AS (SELECT unnest(range(4)) AS class_id), t AS (SELECT count(*) AS t FROM c),
x AS (SELECT class_id, count(*) FILTER (y = class_id) AS support, count(*) FILTER (p = class_id) AS q, count(*) FILTER (y = class_id AND p = class_id) AS tp FROM k, c GROUP BY class_id),
r AS (SELECT class_id, support, CASE WHEN q > 0 THEN tp / CAST(q AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall,
CASE WHEN t > support THEN (t - support - q + tp) / CAST(t - support AS DOUBLE) ELSE 0 END AS specificity, CASE WHEN q + support > 0 THEN 2.0 * tp / (q + support) ELSE 0 END AS f1 FROM x, t)"""
_TRUE = lambda: F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
_PRED = lambda: F.expr("CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_quantity > 25 THEN 0 ELSE 2 END")


@query(_REPORT + " SELECT class_id, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1 FROM r")
def multiclass_report(table):
    return rounded(M.class_report(M.confusion(table("lineitem"), _TRUE(), _PRED()), range(4)), "precision", "recall", "specificity", "f1")


@query(_REPORT + " SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(recall * support) / sum(support), 6) AS accuracy FROM r")
def multiclass_overall(table):
    report = M.class_report(M.confusion(table("lineitem"), _TRUE(), _PRED()), range(4))
    return rounded(M.overall_report(report), "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "accuracy")


@query(f"WITH c AS ({_CELLS}), k AS (SELECT unnest(range(4)) AS y_true) SELECT a.y_true, b.y_true AS y_pred, count(c.y) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.y = a.y_true AND c.p = b.y_true GROUP BY 1, 2")
def confusion_dense(table):
    cells = M.confusion(table("lineitem"), _TRUE(), _PRED())
    every = cells.sparkSession.createDataFrame([(i, j) for i in range(4) for j in range(4)], "y_true int, y_pred int")
    return F.broadcast(every).join(cells, ["y_true", "y_pred"], "left").fillna(0, ["n"])


_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) + 1e-12)) AS v FROM embeddings"
_PROTO = f"""u AS ({_UNIT}), l AS (SELECT label, unnest(range(1, 65)) AS i, v FROM u), m AS (SELECT label, i, avg(v[i]) AS x FROM l GROUP BY label, i),
q AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY label), proto AS (SELECT label, list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda z: z * z))) + 1e-12)) AS p FROM q)"""


@query(f"WITH {_PROTO} SELECT vec_id, p.label AS class, round(list_sum(list_transform(list_zip(v, p.p), lambda z: z[1] * z[2])), 6) AS score FROM u, proto p")
def prototype_scores(table):
    e = table("embeddings")
    return rounded(V.prototype_scores(e, V.prototypes(e, "label", "embedding"), "vec_id", "label", "embedding"), "score")


@query(f"WITH {_PROTO}, s AS (SELECT vec_id, u.label AS truth, p.label AS class, round(list_sum(list_transform(list_zip(v, p.p), lambda z: z[1] * z[2])), 6) AS score FROM u, proto p), r AS (SELECT *, truth = class AS y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM s) SELECT class, count(*) FILTER (y) AS pos, round((sum(CASE WHEN y THEN r ELSE 0 END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM r GROUP BY class")
def ovr_auroc(table):
    e = table("embeddings")
    scores = V.prototype_scores(e, V.prototypes(e, "label", "embedding"), "vec_id", "label", "embedding").join(e.select("vec_id", "label"), "vec_id")
    frame = M.score_frame(scores, F.col("label") == F.col("class"), F.round("score", 6), ["class"])
    return rounded(M.auroc(frame, ["class"]).select("class", "pos", "auroc"), "auroc")


@query("SELECT event_id, CASE WHEN value / 500 >= 0.5 THEN CAST(user_id % 4 AS INT) ELSE 5 END AS code FROM events")
def two_stage_pred(table):
    return table("events").select("event_id", S.two_stage(F.col("value") / 500, 0.5, F.expr("CAST(user_id % 4 AS INT)"), 5).alias("code"))


_SIDES = "SELECT d.doc_id, l.quality + 1 AS lc, l.toxic + 1 AS rc FROM documents d LEFT JOIN labels l USING (doc_id)"


def _sides(table):
    return table("documents").select("doc_id").join(table("labels"), "doc_id", "left").select("doc_id", (F.col("quality") + 1).alias("lc"), (F.col("toxic") + 1).alias("rc"))


@query(f"SELECT doc_id, 'left' AS side, lc AS code FROM ({_SIDES}) UNION ALL SELECT doc_id, 'right', rc FROM ({_SIDES})")
def unpivot_sides_keep_null(table):
    return R.unpivot_sides(_sides(table), ["doc_id"], "lc", "rc")


@query(f"SELECT * FROM (SELECT doc_id, 'left' AS side, lc AS code FROM ({_SIDES}) UNION ALL SELECT doc_id, 'right', rc FROM ({_SIDES})) WHERE code IS NOT NULL")
def unpivot_sides(table):
    return R.unpivot_sides(_sides(table), ["doc_id"], "lc", "rc", keep_null=False)


_VIEW_ROWS = ", ".join(f"('{v}', {c}, {y})" for v, (pos, neg) in R.VIEWS.items() for y, cs in ((1, pos), (0, neg)) for c in cs)


@query(f"SELECT p_partkey, p_size, view, y FROM part JOIN (VALUES {_VIEW_ROWS}) t(view, code, y) ON p_size = code")
def label_views_long(table):
    part = table("part").select("p_partkey", "p_size")
    return R.label_views(part, R.views_frame(part.sparkSession), "p_size")


@query(f"SELECT view, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM part JOIN (VALUES {_VIEW_ROWS}) t(view, code, y) ON p_size = code GROUP BY view")
def view_counts(table):
    part = table("part").select("p_size")
    return R.label_views(part, R.views_frame(part.sparkSession), "p_size").groupBy("view").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


@query("SELECT * FROM (SELECT doc_id, CASE WHEN quality + 1 IN (2) THEN quality + 1 END AS lc, CASE WHEN toxic + 1 IN (2) THEN toxic + 1 END AS rc FROM labels) WHERE lc IS NOT NULL OR rc IS NOT NULL")
def code_filter_mask_side(table):
    return R.mask_codes(table("labels").select("doc_id", (F.col("quality") + 1).alias("lc"), (F.col("toxic") + 1).alias("rc")), "lc", "rc", keep=[2])


@query("SELECT doc_id, quality + 1 AS lc, toxic + 1 AS rc FROM labels WHERE NOT (quality + 1 IN (1) OR toxic + 1 IN (1))")
def code_filter_drop_unit(table):
    return R.drop_units(table("labels").select("doc_id", (F.col("quality") + 1).alias("lc"), (F.col("toxic") + 1).alias("rc")), "lc", "rc", [1])


@query(f"SELECT 'L' || coalesce(CAST(lc AS VARCHAR), 'NA') || '_R' || coalesce(CAST(rc AS VARCHAR), 'NA') AS stratum, count(*) AS n FROM ({_SIDES}) GROUP BY 1")
def stratum_key_counts(table):
    return _sides(table).groupBy(S.stratum_key(F.col("lc"), F.col("rc")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT coalesce(lc, -1) || '_' || coalesce(rc, -1) AS value, count(*) AS n FROM ({_SIDES}) GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def pair_topk(table):
    return R.value_counts(_sides(table).select(S.pair_key(F.col("lc"), F.col("rc")).alias("pair")), "pair", top=3)


@query("SELECT o_custkey, day, o_orderkey FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS day, o_orderkey, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def dedup_keep_first(table):
    orders = table("orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("day"), "o_orderkey")
    return R.keep_first(orders, ["o_custkey", "day"], [F.col("o_orderkey")])


@query("SELECT p_partkey, p_size AS code, trim(p_name) AS name FROM part")
def parse_code_name(table):
    part = table("part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " : ").otherwise("："), F.col("p_name")).alias("cell"))
    code, name = S.parse_code_name(F.col("cell"))
    return part.select("p_partkey", code.alias("code"), name.alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(event_type AS DOUBLE) AS bad, strftime(ts, '%Y-%m-%d') AS day FROM events")
def lenient_casts(table):
    return table("events").select("event_id", S.lenient_int(F.get_json_object("props", "$.k")).alias("k"), S.lenient_double(F.col("event_type")).alias("bad"), S.lenient_date(F.date_format("ts", "yyyy/MM/dd")).alias("day"))


@query("SELECT c_custkey, sha1('pepper' || c_name) AS pseudonym FROM customer")
def pseudonymise(table):
    return table("customer").select("c_custkey", S.pseudonym("pepper", F.lit(""), F.col("c_name")).alias("pseudonym"))


@query("""WITH c AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, n, k > 1 AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS k FROM c) WHERE r = 1""")
def pick_best_child(table):
    return R.pick_child(table("lineitem"), "l_orderkey", "l_suppkey")


@query("""WITH i AS (SELECT l_orderkey, count(*) AS n_items, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name AS owner, coalesce(n_items, 0) AS n_items, coalesce(strftime(last_ship, '%Y') = strftime(o_orderdate, '%Y'), FALSE) AS date_match FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN i ON l_orderkey = o_orderkey""")
def index_match(table):
    items = table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"), F.max("l_shipdate").alias("last_ship"))
    joined = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    same = F.coalesce(F.year("last_ship") == F.year("o_orderdate"), F.lit(False))
    return joined.select("o_orderkey", F.col("c_name").alias("owner"), F.coalesce("n_items", F.lit(0)).alias("n_items"), same.alias("date_match"))


@query("""WITH l AS (SELECT o_orderkey AS u, strftime(o_orderdate, '%Y-%m') AS d FROM orders), s AS (SELECT DISTINCT l_orderkey AS u, strftime(l_shipdate, '%Y-%m') AS d FROM lineitem),
m AS (SELECT l.u, count(s.u) AS there, count(*) FILTER (s.d = l.d) AS hit FROM l LEFT JOIN s ON s.u = l.u GROUP BY l.u)
SELECT count(*) AS labels, count(*) FILTER (hit > 0) AS id_and_date, count(*) FILTER (there > 0 AND hit = 0) AS id_only, count(*) FILTER (there = 0) AS missing FROM m""")
def match_audit(table):
    labels = table("orders").select(F.col("o_orderkey").alias("u"), F.date_format("o_orderdate", "yyyy-MM").alias("d"))
    stored = table("lineitem").select(F.col("l_orderkey").alias("u"), F.date_format("l_shipdate", "yyyy-MM").alias("d"))
    return R.match_audit(labels, stored, "u", "d")


@query("""WITH l AS (SELECT o_orderkey AS u, strftime(o_orderdate, '%Y-%m') AS d FROM orders), s AS (SELECT DISTINCT l_orderkey AS u, strftime(l_shipdate, '%Y-%m') AS d FROM lineitem),
m AS (SELECT l.u, count(s.u) AS there, count(*) FILTER (s.d = l.d) AS hit FROM l LEFT JOIN s ON s.u = l.u GROUP BY l.u)
SELECT count(*) AS labels, count(*) FILTER (hit > 0) AS id_and_date, count(*) FILTER (there > 0 AND hit = 0) AS id_only, count(*) FILTER (there = 0) AS missing FROM m""")
def match_audit_all(table):
    labels = table("orders").select(F.col("o_orderkey").alias("u"), F.date_format("o_orderdate", "yyyy-MM").alias("d"))
    stored = table("lineitem").select(F.col("l_orderkey").alias("u"), F.date_format("l_shipdate", "yyyy-MM").alias("d"))
    return R.match_audit(labels, stored, "u", "d")


@query("SELECT strftime(o_orderdate, '%Y') || '/' || strftime(l_shipdate, '%Y') AS value, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y') <> strftime(l_shipdate, '%Y') GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def year_mismatch_top(table):
    pairs = table("orders").join(table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).where(F.year("o_orderdate") != F.year("l_shipdate"))
    return R.value_counts(pairs.select(F.concat_ws("/", F.year("o_orderdate").cast("string"), F.year("l_shipdate").cast("string")).alias("pair")), "pair", top=10)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_units(table):
    return table("documents").select("doc_id", "lang").join(table("labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_units(table):
    return table("documents").select("doc_id", "lang").join(table("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS n_splits, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def owner_leakage(table):
    return R.leaking_owners(table("orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("split")), "o_custkey", "split")


@query("SELECT o_orderkey, o_custkey, o_orderkey % 3 AS split FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) = 2)")
def owner_leakage_detail(table):
    rows = table("orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("split"))
    return rows.join(R.leaking_owners(rows, "o_custkey", "split").where("n_splits = 2").select("o_custkey"), "o_custkey", "left_semi")


def _split_sql(rows: str, key: str, stratum: str, shares, seed: str) -> str:
    total, cases = 0.0, []
    for name, share in shares[:-1]:
        total += share
        cases.append(f"WHEN r <= round_even(n * {total}, 0) THEN '{name}'")
    return f"SELECT *, CASE {' '.join(cases)} ELSE '{shares[-1][0]}' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY {stratum}) AS n, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('{seed}:' || {key}), {key}) AS r FROM ({rows}))"


TWO, THREE = (("train", 0.8), ("val", 0.2)), (("train", 0.7), ("val", 0.1), ("test", 0.2))
_OWNERS = "SELECT o_custkey, o_orderstatus AS label FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS q FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE q = 1"


@query("SELECT o_orderkey, o_custkey, split FROM orders JOIN (SELECT o_custkey AS c, split FROM (" + _split_sql(_OWNERS, "o_custkey", "label", TWO, "3") + ")) ON c = o_custkey")
def owner_exclusive_split(table):
    return X.owner_split(table("orders"), "o_custkey", F.col("o_orderstatus"), TWO, seed="3").select("o_orderkey", "o_custkey", "split")


@query("SELECT doc_id, split FROM (" + _split_sql("SELECT *, quality || '_' || toxic AS k FROM labels", "doc_id", "k", TWO, "1") + ")")
def stratified_split(table):
    return X.stratified_split(table("labels"), "doc_id", F.concat_ws("_", "quality", "toxic"), TWO, seed="1").select("doc_id", "split")


@query("SELECT o_orderkey, split FROM (" + _split_sql("SELECT * FROM orders", "o_orderkey", "o_orderpriority", THREE, "2") + ")")
def three_way_split(table):
    return X.stratified_split(table("orders"), "o_orderkey", F.col("o_orderpriority"), THREE, seed="2").select("o_orderkey", "split")


@query("SELECT split, o_orderstatus, count(*) AS n FROM (" + _split_sql("SELECT * FROM orders", "o_orderkey", "o_orderpriority", THREE, "2") + ") GROUP BY 1, 2")
def split_stats(table):
    split = X.stratified_split(table("orders"), "o_orderkey", F.col("o_orderpriority"), THREE, seed="2")
    return X.split_stats(split, "split", "o_orderstatus", ["train", "val", "test"], ["F", "O", "P"])


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= least(n, greatest(10, round_even(n * 0.05, 0)))")
def downsample_per_class(table):
    return X.downsample(table("orders"), "o_orderkey", "o_orderpriority", 0.05, least=10, seed="5").select("o_orderkey", "o_orderpriority")


@query(python=True)
def quota_select(table):
    return X.quota_select(table("labels"), "doc_id", F.array("quality", "toxic"), 0.2)


_Q = ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{round(100 * p)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))
_STATS = f"count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std_pop, min(x) AS min, max(x) AS max, {_Q}"
_PCOLS = ("mean", "std_pop", "p10", "p25", "p50", "p75", "p90")


@query(f"SELECT {_STATS} FROM (SELECT value AS x FROM events)")
def numeric_profile(table):
    return rounded(R.profile(table("events"), "value"), *_PCOLS)


@query(f"SELECT l_returnflag, l_linestatus, {_STATS} FROM (SELECT *, l_quantity AS x FROM lineitem) GROUP BY 1, 2")
def profile_by_group(table):
    return rounded(R.profile(table("lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]), *_PCOLS)


@query("SELECT coalesce(p_brand, 'NA') AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def value_counts_topk(table):
    return R.value_counts(table("part"), "p_brand", top=15)


@query("SELECT source, coalesce(lang, 'NA') AS value, count(*) AS n FROM documents GROUP BY 1, 2")
def value_counts_by_group(table):
    return R.value_counts(table("documents"), "lang", by=["source"])


@query("\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def null_and_distinct_census(table):
    return R.null_census(table("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT 'orders' AS \"table\", strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(o_orderdate) AS n FROM orders UNION ALL SELECT 'events', strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d'), count(ts) FROM events")
def date_range_census(table):
    day = lambda f, c: F.date_format(f(c), "yyyy-MM-dd")
    one = lambda t, c: table(t).agg(day(F.min, c).alias("first"), day(F.max, c).alias("last"), F.count(c).alias("n")).select(F.lit(t).alias("table"), "first", "last", "n")
    return one("orders", "o_orderdate").unionByName(one("events", "ts"))


@query("WITH k AS (SELECT unnest(range(3)) AS quality), c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM c) SELECT k.quality, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN t / (t.k * n) ELSE 1.0 END, 6) AS weight FROM k LEFT JOIN c USING (quality), t")
def class_weights(table):
    return rounded(R.class_weights(table("labels").select(F.col("quality").cast("int")), "quality", [0, 1, 2]), "weight")


@query(f"""WITH p AS (SELECT doc_id, unnest([quality, toxic]) AS c FROM labels), n AS (SELECT c, count(*) AS n FROM p GROUP BY c), w AS (SELECT c, (SELECT count(*) FROM p) / CAST(n * (SELECT count(*) FROM n) AS DOUBLE) AS w FROM n)
SELECT doc_id, round(avg(w), 6) AS mean_weight, round(max(w), 6) AS max_weight, round(sum(w), 6) AS sum_weight FROM p JOIN w USING (c) GROUP BY doc_id""")
def unit_sampling_weights(table):
    parts = R.unpivot_sides(table("labels"), ["doc_id"], "quality", "toxic").withColumn("code", F.col("code").cast("int"))
    out = R.unit_weights(parts, R.class_weights(parts, "code", [0, 1]), "doc_id", "code")
    return rounded(out, "mean_weight", "max_weight", "sum_weight")


@query("SELECT doc_id, round(0.5 / count(*) OVER (PARTITION BY quality), 9) AS weight FROM labels")
def balanced_weights(table):
    labels = table("labels")
    n = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    n = F.broadcast(n.withColumnRenamed("quality", "q"))  # a row for each class
    return labels.join(n, F.col("quality").eqNullSafe(F.col("q"))).select("doc_id", F.round(0.5 / F.col("n"), 9).alias("weight"))


_P = "1 / (1 + exp(-(value - 250) / 60))"
_LOSS = f"SELECT event_id, y, p, -(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS loss FROM (SELECT event_id, CAST(event_type = 'purchase' AS INT) AS y, {_P} AS p FROM events)"


def _losses(table):
    scored = table("events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), S.sigmoid((F.col("value") - 250) / 60).alias("p"))
    return scored.withColumn("loss", S.cross_entropy(F.col("y"), F.col("p")))


@query(f"SELECT event_id, y, round(p, 6) AS p, round(loss, 6) AS loss FROM ({_LOSS}) ORDER BY round(loss, 6) DESC, event_id LIMIT 200")
def bce_hard_cases(table):
    return rounded(_losses(table), "p", "loss").orderBy(F.desc("loss"), "event_id").limit(200)


@query(f"SELECT event_id, y, round(p, 6) AS p FROM ({_LOSS}) WHERE (y = 0 AND p >= 0.9) OR (y = 1 AND p <= 0.1)")
def high_conf_wrong(table):
    return rounded(_losses(table).where(S.high_confidence_wrong(F.col("y"), F.col("p"))).select("event_id", "y", "p"), "p")


_MAD = "SELECT p_partkey, p_brand, p_retailprice, m AS median, mad, n FROM part JOIN (SELECT p_brand AS b, median(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1) ON b = p_brand JOIN (SELECT p_brand AS b2, median(abs(p_retailprice - m)) AS mad FROM part JOIN (SELECT p_brand AS b3, median(p_retailprice) AS m FROM part GROUP BY 1) ON b3 = p_brand GROUP BY 1) ON b2 = p_brand WHERE mad > 1e-12 AND p_retailprice > m + 1.2 * mad"


@query(f"SELECT p_partkey, p_brand, round(median, 6) AS median, round(mad, 6) AS mad FROM ({_MAD})")
def mad_outliers(table):
    return rounded(R.mad_outliers(table("part"), "p_retailprice", "p_brand", 1.2).select("p_partkey", "p_brand", "median", "mad"), "median", "mad")


@query(f"SELECT p_partkey, p_brand, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM ({_MAD})) WHERE rank <= floor(n * 0.02)")
def mad_outliers_capped(table):
    return R.mad_outliers(table("part"), "p_retailprice", "p_brand", 1.2, cap=0.02, order="p_partkey").select("p_partkey", "p_brand", "rank")


@query("SELECT event_type, round(avg(value), 6) AS mean, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= ceil(n * 0.9) GROUP BY 1")
def robust_trim_mean(table):
    return rounded(R.trimmed_mean(table("events"), "event_type", "value", 0.1), "mean")


@query("""WITH l AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, embedding FROM embeddings), x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM l),
s AS (SELECT label, i, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS d FROM x GROUP BY 1, 2)
SELECT vec_id, round(sqrt(sum(((x - m) / d) * ((x - m) / d))), 4) AS distance FROM x JOIN s USING (label, i) GROUP BY vec_id""")
def zscore_group_distance(table):
    return V.zscore_distance(table("embeddings"), "vec_id", "label", "embedding").withColumn("distance", F.round("distance", 4))


_ALL_SIMS = f"WITH u AS ({_UNIT}), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 6) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS rank FROM s)"
_SIMS = _ALL_SIMS.replace("a.vec_id <> b.vec_id", "a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0")


@query(_SIMS + " SELECT query, neighbour, sim, rank FROM r WHERE rank <= 5")
def cosine_knn(table):
    e = table("embeddings")
    return N.neighbours(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query", "neighbour", "sim", "rank")


@query(_SIMS + " SELECT query, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY rank) AS neighbours FROM r WHERE rank <= 5 GROUP BY query")
def knn_lists(table):
    e = table("embeddings")
    near = N.neighbours(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return near.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"].cast("string")), ",").alias("neighbours"))


@query(_ALL_SIMS + ", t AS (SELECT query, min(rank) AS true_rank FROM r JOIN embeddings e ON e.vec_id = neighbour JOIN embeddings q ON q.vec_id = query WHERE e.label = q.label GROUP BY query) SELECT k AS k_requested, round(avg(CAST(true_rank <= k AS INT)), 6) AS recall FROM t, (VALUES (1), (5), (10)) v(k) GROUP BY k")
def recall_at_k(table):
    e = table("embeddings")
    ranks = N.first_match_ranks(e, e, "vec_id", "embedding", "label")
    return V.recall(ranks, [1, 5, 10])


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 4) AS apart, 192 AS width FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_features(table):
    e = table("embeddings")
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", V.pair_features(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")).alias("f"))
    return pair.select("vec_id", F.round(F.aggregate(F.slice("f", 129, 64), F.lit(0.0), lambda s, x: s + x), 4).alias("apart"), F.size("f").alias("width"))


_NORM = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\x{3000}]+', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(12288))"


@query(f"SELECT doc_id, length(t) AS length, md5(t) AS digest FROM (SELECT doc_id, {_NORM} AS t FROM documents)")
def text_normalise(table):
    return table("documents").select("doc_id", T.normalise(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("length"), F.md5("t").alias("digest"))


_CLAUSE = f"SELECT doc_id, unnest(range(len(c))) AS clause_no, unnest(c) AS clause FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_NORM}, '[。；;\\n.]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(12) || chr(13) || chr(12288))), lambda s: s <> '') AS c FROM documents)"


@query(f"SELECT doc_id, count(*) AS clauses, CAST(sum(length(clause)) AS BIGINT) AS characters FROM ({_CLAUSE}) GROUP BY doc_id")
def clause_split(table):
    c = table("documents").select("doc_id", F.explode(T.clauses(F.col("text"), "[。；;\\n.]+")).alias("clause"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"), F.sum(F.length("clause")).alias("characters"))


LEXICON = T.Lexicon({"article": ("the ", "The "), "license": ("License",)}, {"public": ("Public",), "version": ("Version", "version"), "of": (" of ",)}, ("no ", "not "), left=("left",), right=("right",), both=("both",))


@query(f"""WITH p(canonical, pattern) AS (VALUES ('license', 'License'), ('public', 'Public'), ('version', 'Version'), ('version', 'version')),
h AS (SELECT doc_id, canonical, (length(text) - length(replace(text, pattern, ''))) / length(pattern) AS n FROM documents, p)
SELECT doc_id, canonical, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2 HAVING sum(n) > 0""")
def lexicon_hits(table):
    patterns = {"license": ("License",), "public": ("Public",), "version": ("Version", "version")}
    found = table("documents").select("doc_id", F.explode(T.mentions(F.col("text"), patterns)).alias("m"))
    return found.groupBy("doc_id", F.col("m.canonical").alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


_GRAMS = "SELECT item_id, substr(text, i, n) AS gram FROM (SELECT item_id, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM benchmark, (VALUES (1), (2)) v(n))"
_DOC_GRAMS = "SELECT doc_id, gram FROM (SELECT doc_id, unnest(c) AS gram FROM d UNION ALL SELECT doc_id, unnest(list_transform(list_zip(c[:-2], c[2:]), lambda z: z[1] || z[2])) AS gram FROM d)"
_CHARS = "d AS (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0)"


@query(f"WITH {_CHARS} SELECT gram, count(DISTINCT doc_id) AS df FROM ({_DOC_GRAMS}) GROUP BY gram")
def char_ngram_df(table):
    return T.document_frequencies(table("documents"), "doc_id", F.col("text"))


@query(f"SELECT item_id, CAST(CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 64 AS INT) AS bucket, count(*) AS n FROM ({_GRAMS}) GROUP BY 1, 2")
def ngram_hash_vector(table):
    grams = table("benchmark").select("item_id", F.explode(T.char_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("item_id", T.bucket(F.col("gram"), 64).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CHARS}, l AS (SELECT doc_id, quality AS label FROM labels JOIN documents USING (doc_id)), g AS (SELECT doc_id, label, gram, count(*) AS tf FROM ({_DOC_GRAMS}) JOIN l USING (doc_id) GROUP BY 1, 2, 3),
f AS (SELECT gram, count(*) AS df, sum(tf) AS total FROM g GROUP BY gram ORDER BY total DESC, gram LIMIT 20000),
i AS (SELECT gram, ln((1 + (SELECT count(*) FROM l)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM f), w AS (SELECT doc_id, label, gram, tf * idf AS w FROM g JOIN i USING (gram)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
SELECT label, gram, round(sum(w / norm) / any_value(members), 6) AS weight FROM w JOIN n USING (doc_id) JOIN (SELECT label, count(*) AS members FROM l GROUP BY 1) USING (label) GROUP BY 1, 2""")
def tfidf_class_means(table):
    docs = table("documents").select("doc_id", "text").join(table("labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return rounded(T.tfidf_class_means(docs, "doc_id", F.col("text"), "label"), "weight")


@query("SELECT doc_id, length(text) AS code FROM documents")
def distinct_encode_join(table):
    """Equal texts are encoded once and meet by digest; null texts keep their row."""
    return T.encode_distinct(table("documents"), "text", F.length).select("doc_id", "code")


@query("SELECT event_type, epochs, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS epochs FROM events) WHERE r = 1")
def best_epoch(table):
    return O.best_epoch(table("events"), "event_type", "event_id", "value")


@query("WITH u AS (SELECT user_id, event_type, max(value) AS best, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, user_id, best, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n >= 10 DESC, best DESC, user_id) AS rank FROM u) WHERE rank <= 3")
def leaderboard_topk(table):
    runs = table("events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n"))
    return O.leaderboard(runs, ["event_type"], F.col("n") >= 10, "best", "user_id", 3).select("event_type", "user_id", "best", "rank")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, i, m AS best, event_id AS best_at, 0 AS misses, CAST(NULL AS BIGINT) AS stop FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, CASE WHEN e.m > f.best + 5 THEN e.m ELSE f.best END, CASE WHEN e.m > f.best + 5 THEN e.event_id ELSE f.best_at END, CASE WHEN e.m > f.best + 5 THEN 0 ELSE f.misses + 1 END, CASE WHEN e.m <= f.best + 5 AND f.misses + 1 >= 4 THEN e.event_id END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1 WHERE f.stop IS NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS q FROM f) SELECT user_id, best_at AS best_epoch, best, stop AS stop_epoch FROM l WHERE q = 1""")
def early_stop_epoch(table):
    return O.early_stop(table("events"), "user_id", "event_id", "value", patience=4, min_delta=5.0)


@query("SELECT event_type, user_id % 5 AS pct, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std_samp, count(value) AS value_n FROM events GROUP BY 1, 2")
def multi_seed_mean_std(table):
    out = O.seed_summary(table("events").withColumn("pct", F.col("user_id") % 5), ["event_type", "pct"], ["value"])
    return rounded(out, "value_mean", "value_std_samp")


@query("SELECT e AS epoch, round(CASE WHEN e < 5 THEN 0.001 * (e + 1) / 5.0 ELSE 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(3.141592653589793 * least(1.0, (e - 5) / 45.0))) END, 9) AS lr FROM range(50) t(e)")
def lr_schedule(table):
    spark = table("region").sparkSession
    return spark.range(50).select(F.col("id").alias("epoch"), F.round(S.learning_rate(F.col("id"), 0.001, 5, 50, 0.00001), 9).alias("lr"))


@query("WITH m AS (SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM events) SELECT user_id, event_id, smooth FROM (SELECT user_id, event_id, round(s, 6) AS smooth, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, event_id) AS r FROM m) WHERE r = 1")
def moving_avg_argmax(table):
    return rounded(O.peak(O.moving_average(table("events"), "user_id", "event_id", "value", 5), "user_id", "event_id", "smooth"), "smooth")


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cummax FROM events")
def cummax(table):
    return O.cumulative_max(table("events"), "user_id", "event_id", "value").select("event_id", "user_id", "cummax")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), k AS (SELECT user_id, i, v FROM e WHERE v IS NOT NULL),
b AS (SELECT e.user_id, e.event_id, e.i, e.v, (SELECT max(i) FROM k WHERE k.user_id = e.user_id AND k.i <= e.i) AS lo, (SELECT min(i) FROM k WHERE k.user_id = e.user_id AND k.i >= e.i) AS hi FROM e)
SELECT b.event_id, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN lo IS NULL THEN h.v WHEN hi IS NULL THEN l.v ELSE l.v + (h.v - l.v) * (b.i - lo) / (hi - lo) END, 6) AS filled FROM b LEFT JOIN k l ON l.user_id = b.user_id AND l.i = lo LEFT JOIN k h ON h.user_id = b.user_id AND h.i = hi""")
def gap_fill_linear(table):
    gaps = table("events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return rounded(O.fill_linear(gaps, "user_id", "event_id", "v").select("event_id", "filled"), "filled")


@query("SELECT l_orderkey, median(d) AS spacing, count(*) AS steps FROM (SELECT l_orderkey, date_diff('day', lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate), l_shipdate) AS d FROM lineitem) WHERE d > 0 GROUP BY 1")
def lag_median_spacing(table):
    return O.median_spacing(table("lineitem").select("l_orderkey", F.datediff("l_shipdate", F.lit("1990-01-01")).alias("day")), "l_orderkey", "day")


@query("SELECT conv_id, CAST(floor(i * (n - 1) / 3.0) AS INT) AS turn_index, i AS place FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), range(4) t(i) WHERE n >= 4 UNION ALL SELECT conv_id, CAST(least(i, n - 1) AS INT), i FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), range(4) t(i) WHERE n < 4")
def even_index_pick(table):
    n = table("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("conv_id", F.posexplode(S.even_index(F.col("n"), 4)).alias("place", "turn_index"))


@query("""WITH p AS (SELECT event_type, CAST(epoch(ts) AS DOUBLE) AS x, avg(value) AS y FROM events GROUP BY 1, 2), g AS (SELECT event_type, 1704067200 + 3600.0::DOUBLE * i AS x FROM (SELECT DISTINCT event_type FROM events), range(720) t(i)),
l AS (SELECT g.event_type, g.x, p.x AS lo, p.y AS ly FROM g ASOF LEFT JOIN p ON p.event_type = g.event_type AND g.x >= p.x), n AS (SELECT l.*, p.x AS hi, p.y AS hy FROM l ASOF LEFT JOIN p ON p.event_type = l.event_type AND l.x <= p.x)
SELECT event_type, x AS at, round(CASE WHEN lo IS NULL THEN hy WHEN hi IS NULL THEN ly WHEN hi = lo THEN ly ELSE ly + (hy - ly) * (x - lo) / (hi - lo) END, 4) AS y FROM n""")
def interp_asof_hourly(table):
    """All events on the whole hourly grid."""
    ev = table("events").withColumn("x", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) / 1e6"))
    grid = ev.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("i")).select("event_type", (F.lit(1704067200.0) + 3600.0 * F.col("i")).alias("at"))
    return rounded(O.interpolate_asof(ev, grid, "event_type", "x", "value", "at").withColumnRenamed("value", "y"), "y", digits=4)


#: The same query under its older name.
QUERIES["interp_asof"], ORACLE["interp_asof"] = QUERIES["interp_asof_hourly"], ORACLE["interp_asof_hourly"]


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r <= 2")
def per_unit_cap(table):
    return O.cap_per_unit(table("conversations"), ["conv_id", "role"], "turn", 2).select("conv_id", "turn", "role")


@query("SELECT vec_id, i - 1 AS place, round(CAST(w AS DOUBLE), 6) AS weight FROM (SELECT vec_id, i, w, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, i) AS r FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS w FROM embeddings)) WHERE r <= 3")
def top_weights_per_row(table):
    top = table("embeddings").select("vec_id", F.inline(O.top_weights(F.col("embedding"), 3)))
    return top.select("vec_id", F.col("index").alias("place"), F.round(F.col("weight").cast("double"), 6).alias("weight"))


from quernstone.plans import cohort, evaluation, forms, stores  # noqa: E402, F401  their queries register themselves
