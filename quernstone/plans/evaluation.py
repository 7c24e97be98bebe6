"""Queries of evaluations, vectors, text and slices, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import scalar as S
from quernstone.operators import metrics as M
from quernstone.operators import nearest as N
from quernstone.operators import relational as R
from quernstone.operators import reports as C
from quernstone.operators import slices as I
from quernstone.operators import text as T
from quernstone.operators import vectors as V
from quernstone.plans.catalogue import _UNIT, LEXICON, boot_sql
from quernstone.plans.cohort import _PRED as _SLOT_ROWS
from quernstone.plans.cohort import _UNITS, slots, units
from quernstone.plans.registry import query, rounded

# Classes against the rest over two-slot predictions; ties in order of unit and side.
_LONG = f"SELECT k AS class_id, y_true = k AS y, p[k + 1] AS s, unit * 2 + CAST(side = 'right' AS INT) AS o FROM ({_SLOT_ROWS}), range(6) t(k)"
_OVR = f"""l AS ({_LONG}), r AS (SELECT *, rank() OVER (PARTITION BY class_id ORDER BY s) + (count(*) OVER (PARTITION BY class_id, s) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY class_id ORDER BY s DESC, o) AS k, sum(CAST(y AS INT)) OVER (PARTITION BY class_id ORDER BY s DESC, o ROWS UNBOUNDED PRECEDING) AS tp FROM l),
ovr AS (SELECT class_id, count(*) FILTER (y) AS support, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auroc_ovr, avg(tp / CAST(k AS DOUBLE)) FILTER (y) AS auprc_ovr FROM r GROUP BY class_id)"""
_SLOT_REPORT = f"""k AS (SELECT unnest(range(6)) AS class_id), c AS (SELECT y_true AS y, y_pred AS p FROM ({_SLOT_ROWS})), t AS (SELECT count(*) AS t FROM c),
x AS (SELECT class_id, count(*) FILTER (y = class_id) AS support, count(*) FILTER (p = class_id) AS q, count(*) FILTER (y = class_id AND p = class_id) AS tp FROM k, c GROUP BY class_id),
rep AS (SELECT class_id, support, CASE WHEN q > 0 THEN tp / CAST(q AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall,
CASE WHEN t > support THEN (t - support - q + tp) / CAST(t - support AS DOUBLE) ELSE 0 END AS specificity, CASE WHEN q + support > 0 THEN 2.0 * tp / (q + support) ELSE 0 END AS f1 FROM x, t)"""
_CLASS_COLS = ("precision", "recall", "specificity", "f1", "auroc_ovr", "auprc_ovr")


def _with_order(table):
    return slots(table).withColumn("o", F.col("unit") * 2 + (F.col("side") == "right").cast("int"))


@query(f"WITH {_OVR} SELECT round(avg(auroc_ovr), 6) AS macro_auroc_ovr, round(avg(auprc_ovr), 6) AS macro_auprc_ovr FROM ovr")
def ovr_macro(table):
    rows = _with_order(table)
    return rounded(M.ovr_macro(M.ovr_report(rows, F.col("y_true"), F.col("probs"), 6, F.col("o"))), "macro_auroc_ovr", "macro_auprc_ovr")


@query(f"WITH {_OVR}, {_SLOT_REPORT} SELECT rep.class_id, rep.support, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CLASS_COLS) + " FROM rep LEFT JOIN ovr USING (class_id)")
def evaluation_classes(table):
    """Per-class report of the two-slot predictions with one-against-rest metrics beside."""
    return rounded(C.multiclass_evaluation(_with_order(table), 6, "o")["classes"], *_CLASS_COLS)


@query(f"WITH {_OVR}, {_SLOT_REPORT} SELECT rep.class_id, rep.support, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CLASS_COLS) + " FROM rep LEFT JOIN ovr USING (class_id) WHERE rep.class_id IN (1, 3)")
def evaluation_tail(table):
    return rounded(C.multiclass_evaluation(_with_order(table), 6, "o", tail=[1, 3, 99])["tail"], *_CLASS_COLS)


_OVERALL = ("macro_precision", "macro_recall", "macro_f1", "weighted_f1", "accuracy", "macro_specificity", "macro_auroc_ovr", "macro_auprc_ovr")


@query(f"WITH {_OVR}, {_SLOT_REPORT} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(specificity), 6) AS macro_specificity, (SELECT round(avg(auroc_ovr), 6) FROM ovr) AS macro_auroc_ovr, (SELECT round(avg(auprc_ovr), 6) FROM ovr) AS macro_auprc_ovr FROM rep")
def evaluation_overall(table):
    return rounded(C.multiclass_evaluation(_with_order(table), 6, "o")["overall"], *_OVERALL)


# Two stages: a probability of being abnormal, then a code; code 4 is merged into 6.
_STAGES = f"SELECT unit, lc AS code, CASE WHEN lc = 4 THEN 6 ELSE lc END AS merged, ((unit * 13 + owner) % 97) / 97.0::DOUBLE AS p, [1, 2, 3, 6][CAST(owner % 4 + 1 AS INT)] AS second FROM ({_UNITS}) WHERE lc IS NOT NULL"
_FINAL = f"SELECT *, CASE WHEN p >= 0.4 THEN second ELSE 5 END AS final FROM ({_STAGES})"


def _stages(table):
    u = units(table).where("lc IS NOT NULL").selectExpr("unit", "lc AS code", "((unit * 13 + owner) % 97) / CAST(97 AS DOUBLE) AS p", "array(1, 2, 3, 6)[CAST(owner % 4 AS INT)] AS second")
    return C.two_stage_evaluation(u, "code", "p", "second", "unit", 0.4)


@query(f"""WITH k AS (SELECT unnest(range(5)) AS class_id, unnest([1, 2, 3, 5, 6]) AS code), c AS (SELECT merged AS y, final AS p FROM ({_FINAL})), t AS (SELECT count(*) AS t FROM c),
x AS (SELECT class_id, count(*) FILTER (y = code) AS support, count(*) FILTER (p = code) AS q, count(*) FILTER (y = code AND p = code) AS tp FROM k, c GROUP BY class_id)
SELECT class_id, support, round(CASE WHEN q > 0 THEN tp / CAST(q AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END, 6) AS recall, round((t - support - q + tp) / CAST(t - support AS DOUBLE), 6) AS specificity, round(CASE WHEN q + support > 0 THEN 2.0 * tp / (q + support) ELSE 0 END, 6) AS f1 FROM x, t""")
def two_stage_classes(table):
    return rounded(_stages(table)["classes"], "precision", "recall", "specificity", "f1")


@query(f"SELECT unit, code, merged AS code_merged, final AS code_final FROM ({_FINAL})")
def two_stage_rows(table):
    return _stages(table)["rows"].select("unit", "code", "code_merged", "code_final")


_S1 = f"SELECT unit, CAST(merged <> 5 AS INT) AS y, p AS s FROM ({_FINAL})"


@query(f"""WITH e AS ({_S1}), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, row_number() OVER (ORDER BY s DESC, unit) AS k, sum(y) OVER (ORDER BY s DESC, unit ROWS UNBOUNDED PRECEDING) AS tp FROM e)
SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auroc, round(avg(tp / CAST(k AS DOUBLE)) FILTER (y = 1), 6) AS average_precision, CAST(sum(y) AS BIGINT) AS pos, count(*) FILTER (s >= 0.4 AND y = 1) AS tp, count(*) FILTER (s >= 0.4 AND y = 0) AS fp FROM r""")
def two_stage_first(table):
    """Binary metrics of the first stage."""
    return rounded(_stages(table)["stage1"].select("auroc", "average_precision", "pos", "tp", "fp"), "auroc", "average_precision")


_SCORED = "SELECT event_id, user_id, CAST(event_type = 'purchase' AS INT) AS y_true, round(1 / (1 + exp(-(value - 250) / 60)), 3) AS y_prob FROM events"
_HARD = f"SELECT *, -(y_true * ln(least(greatest(y_prob, 1e-6), 1 - 1e-6)) + (1 - y_true) * ln(1 - least(greatest(y_prob, 1e-6), 1 - 1e-6))) AS loss FROM ({_SCORED})"


def _binary(table):
    scored = table("events").select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("y_true"), F.round(S.sigmoid((F.col("value") - 250) / 60), 3).alias("y_prob"))
    return C.binary_evaluation(scored, "user_id", "event_id")


@query(f"""WITH e AS ({_SCORED}), r AS (SELECT *, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2.0 AS r, row_number() OVER (ORDER BY y_prob DESC, event_id) AS k, sum(y_true) OVER (ORDER BY y_prob DESC, event_id ROWS UNBOUNDED PRECEDING) AS tp FROM e)
SELECT round((sum(CASE WHEN y_true = 1 THEN r ELSE 0 END) - sum(y_true) * (sum(y_true) + 1) / 2.0) / (sum(y_true) * (count(*) - sum(y_true))), 6) AS auroc, round(avg(tp / CAST(k AS DOUBLE)) FILTER (y_true = 1), 6) AS average_precision, count(*) FILTER (y_prob >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (y_prob >= 0.5 AND y_true = 0) AS fp, count(*) AS n_rows, count(DISTINCT user_id) AS n_units FROM r""")
def binary_evaluation(table):
    """Metrics and counts of a binary evaluation over units."""
    return rounded(_binary(table)["metrics"].select("auroc", "average_precision", "tp", "fp", "n_rows", "n_units"), "auroc", "average_precision")


@query(f"SELECT event_id, y_true, y_prob, round(loss, 6) AS loss FROM ({_HARD}) WHERE (y_true = 0 AND y_prob >= 0.9) OR (y_true = 1 AND y_prob <= 0.1) ORDER BY round(loss, 9) DESC, event_id LIMIT 200")
def binary_evaluation_wrong(table):
    return rounded(_binary(table)["high_confidence_wrong"].select("event_id", "y_true", "y_prob", "loss"), "loss")


@query(f"SELECT event_id, y_true, y_prob, round(loss, 6) AS loss FROM ({_HARD}) ORDER BY round(loss, 9) DESC, event_id LIMIT 200")
def binary_evaluation_top_loss(table):
    return rounded(_binary(table)["top_loss"].select("event_id", "y_true", "y_prob", "loss"), "loss")


@query(boot_sql(f"SELECT user_id, y_true AS y, y_prob AS s FROM ({_SCORED})", "42", 0.5, "user_id"), python=True)
def binary_evaluation_intervals(table):
    """Intervals of the evaluation over 1000 replicates of whole users."""
    return rounded(_binary(table)["intervals"], "mean", "low", "high")


# The two-slot predictions as those of a two-class task: class 4 is the negative one.
_TWO = f"SELECT unit, side, CAST(y_true <> 4 AS INT) AS y, round(1 - p[5] / list_sum(p), 3) AS s FROM ({_SLOT_ROWS})"


def _dual(table):
    p = F.round(1 - F.col("probs")[4] / F.aggregate("probs", F.lit(0.0), lambda s, x: s + x), 3)
    rows = _with_order(table).select("unit", "side", "o", (F.col("y_true") != 4).cast("int").alias("y_true"), F.array(1 - p, p).alias("probs"))
    return C.dual_evaluation(rows.withColumn("y_pred", (F.col("probs")[1] >= 0.5).cast("int")), "unit", "o", 2, {0: "normal", 1: "diseased"})


@query(boot_sql(f"SELECT unit, y, s FROM ({_TWO})", "42", 0.5, "unit"), python=True)
def dual_binary_intervals(table):
    """Intervals of a two-class task's second probability over 1000 replicates of whole units."""
    return rounded(_dual(table)["intervals"], "mean", "low", "high")


@query(f"""WITH e AS (SELECT *, unit * 2 + CAST(side = 'right' AS INT) AS o FROM ({_TWO})), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, row_number() OVER (ORDER BY s DESC, o) AS k, sum(y) OVER (ORDER BY s DESC, o ROWS UNBOUNDED PRECEDING) AS tp FROM e)
SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auroc, round(avg(tp / CAST(k AS DOUBLE)) FILTER (y = 1), 6) AS average_precision, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y = 0) AS fp, count(*) AS n_rows, count(DISTINCT unit) AS n_units FROM r""")
def dual_binary_metrics(table):
    return rounded(_dual(table)["binary"].select("auroc", "average_precision", "tp", "fp", "n_rows", "n_units"), "auroc", "average_precision")


@query(f"SELECT unit, side, y AS y_true, CAST(s >= 0.5 AS INT) AS y_pred, CASE WHEN y = 1 THEN 'diseased' ELSE 'normal' END AS y_true_name, y = CAST(s >= 0.5 AS INT) AS correct, round(s, 3) AS p_1 FROM ({_TWO})")
def dual_binary_predictions(table):
    return _dual(table)["predictions"].select("unit", "side", "y_true", "y_pred", "y_true_name", "correct", "p_1")


# Few-shot: classes 0 to 4 are codes 1 to 5, training rows are those whose id 20 does not divide.
_FEW = f"""u AS (SELECT vec_id, label + 1 AS code, CAST(label = 3 AS INT) AS y, v FROM ({_UNIT}) WHERE label IN (3, 4)), l AS (SELECT y, unnest(range(1, 65)) AS i, v FROM u WHERE vec_id % 20 <> 0), m AS (SELECT y, i, avg(v[i]) AS x FROM l GROUP BY y, i),
q AS (SELECT y, list(x ORDER BY i) AS m FROM m GROUP BY y), proto AS (SELECT y, list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda z: z * z))) + 1e-12)) AS p FROM q),
s AS (SELECT vec_id, code, u.y, v, list_sum(list_transform(list_zip(v, a.p), lambda z: z[1] * z[2])) - list_sum(list_transform(list_zip(v, b.p), lambda z: z[1] * z[2])) AS score FROM u, (SELECT p FROM proto WHERE y = 1) a, (SELECT p FROM proto WHERE y = 0) b WHERE vec_id % 20 = 0)"""


def _few(table):
    e = table("embeddings").withColumn("code", F.col("label") + 1)
    return C.few_shot_report(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), "vec_id", "vec_id", "embedding", "code", [4], [5])


@query(f"WITH {_FEW}, n AS (SELECT s.vec_id, u.vec_id AS other, row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_sum(list_transform(list_zip(s.v, u.v), lambda z: z[1] * z[2])), 6) DESC, u.vec_id) AS r FROM s JOIN u ON u.vec_id % 20 <> 0) SELECT s.vec_id, code, y AS y_true, round(score, 6) AS score, round(1 / (1 + exp(-round(score, 9))), 6) AS y_prob, (SELECT string_agg(CAST(other AS VARCHAR), ',' ORDER BY r) FROM n WHERE n.vec_id = s.vec_id AND r <= 5) AS neighbours FROM s")
def few_shot_rows(table):
    """Prototype scores of a view's held-out rows with their nearest training rows."""
    rows = _few(table)["rows"]
    ids = F.array_join(F.transform(F.from_json("neighbours", "array<struct<id:long>>"), lambda s: s["id"].cast("string")), ",")
    return rounded(rows.select("vec_id", "code", "y_true", "score", "y_prob", ids.alias("neighbours")), "score", "y_prob")


@query(f"WITH {_FEW} SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, count(*) FILTER (score >= 0 AND y = 1) AS tp, count(*) FILTER (score >= 0 AND y = 0) AS fp FROM s")
def few_shot_metrics(table):
    m = _few(table)["metrics"]
    return m.select((F.col("pos") + F.col("neg")).alias("n"), "pos", "tp", "fp")


@query(boot_sql(f"WITH {_FEW} SELECT vec_id, y, 1 / (1 + exp(-round(score, 9))) AS s FROM s", "42", 0.5, "vec_id"), python=True)
def few_shot_intervals(table):
    """Intervals of the few-shot scores over 1000 replicates of units."""
    return rounded(_few(table)["intervals"], "mean", "low", "high")


_CODED = f"SELECT vec_id, label FROM ({_UNIT}) WHERE label IN (2, 5)"


@query(_CODED)
def filter_by_codes(table):
    return V.with_codes(table("embeddings"), "label", [2, 5]).select("vec_id", "label")


_COS = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_PROTOS = f"""u AS ({_UNIT}), l AS (SELECT label, unnest(range(1, 65)) AS i, v FROM u), m AS (SELECT label, i, avg(v[i]) AS x FROM l GROUP BY label, i), q AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY label),
proto AS (SELECT label, list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda z: z * z))) + 1e-12)) AS p FROM q),
first AS (SELECT label, arg_min(v, vec_id) AS p FROM u GROUP BY label)"""


def _protos(table):
    e = table("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).select("label", V.unit(F.col("e")).alias("prototype"))
    return e, V.prototypes(e, "label", "embedding"), first


@query(f"WITH {_PROTOS}, used AS (SELECT * FROM proto WHERE label > 1 UNION ALL SELECT * FROM first WHERE label <= 1) SELECT vec_id, used.label AS class, round(100.0::DOUBLE * {_COS('v', 'p')}, 4) AS logit FROM u, used")
def prototype_logits(table):
    """Cosine logits under a scale clamped to 100, two classes frozen at their first vector."""
    e, protos, first = _protos(table)
    return rounded(V.prototype_logits(e, protos, "vec_id", "label", "embedding", 250.0, first, [0, 1]), "logit", digits=4)


@query(f"WITH {_PROTOS} SELECT round(avg(list_sum(list_transform(list_zip(proto.p, first.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS drift, count(*) AS classes FROM proto JOIN first USING (label) WHERE label NOT IN (0, 1)")
def prototype_drift(table):
    _, protos, first = _protos(table)
    return rounded(V.prototype_drift(protos, first, "label", [0, 1]), "drift")


@query(f"WITH u AS ({_UNIT}) SELECT q.vec_id AS query, t.label, round(max({_COS('q.v', 't.v')}), 6) AS sim FROM u q, u t WHERE q.vec_id % 20 = 0 GROUP BY 1, 2")
def token_similarity(table):
    """The largest similarity of a query to any vector of each label."""
    e = table("embeddings")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")
    return rounded(N.token_similarity(q, e, "query", "label", "embedding"), "sim")


@query("SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2")
def mean_vectors(table):
    return V.mean_vectors(table("embeddings"), "label", "embedding").select("label", F.posexplode("mean").alias("pos", "x")).withColumn("x", F.round("x", 6))


# Pairs: a vector and the same vector with its halves exchanged, for the ids that 20 divides.
_PAIRED = f"u AS ({_UNIT}), a AS (SELECT vec_id, v FROM u WHERE vec_id % 20 = 0), b AS (SELECT vec_id, list_concat(v[33:64], v[1:32]) AS v FROM u)"


def _paired(table):
    e = table("embeddings").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    return e.where("vec_id % 20 = 0"), e.select("vec_id", F.concat(F.slice("v", 33, 32), F.slice("v", 1, 32)).alias("w"))


@query(f"WITH {_PAIRED}, m AS (SELECT a.vec_id, round({_COS('a.v', 'b.v')}, 9) AS s FROM a JOIN b USING (vec_id)) SELECT m.vec_id AS query, 1 + count(*) FILTER (round({_COS('a.v', 'b.v')}, 9) > m.s) AS true_rank FROM m JOIN a USING (vec_id), b GROUP BY 1")
def retrieval_ranks(table):
    a, b = _paired(table)
    return N.paired_ranks(a, b, "vec_id", "v", "w")


@query(f"WITH {_PAIRED}, bq AS (SELECT * FROM b WHERE vec_id % 20 = 0), m AS (SELECT bq.vec_id, round({_COS('u.v', 'bq.v')}, 9) AS s FROM bq JOIN u USING (vec_id)) SELECT m.vec_id AS query, 1 + count(*) FILTER (round({_COS('bq.v', 'u.v')}, 9) > m.s) AS true_rank FROM m JOIN bq USING (vec_id), u GROUP BY 1")
def retrieval_ranks_back(table):
    """The other direction: exchanged vectors as queries against the plain ones."""
    _, b = _paired(table)
    e = table("embeddings").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    return N.paired_ranks(b.where("vec_id % 20 = 0"), e, "vec_id", "w", "v")


@query(f"WITH u AS ({_UNIT}), w AS (SELECT vec_id, list_concat(v[33:64], v[1:32]) AS v FROM u), r AS (SELECT ln(sum(exp(z))) - max(z) FILTER (i = j) AS l FROM (SELECT a.vec_id AS i, c.vec_id AS j, {_COS('a.v', 'c.v')} / 0.1::DOUBLE AS z FROM u a, w c WHERE a.vec_id % 20 = 0) GROUP BY i), k AS (SELECT ln(sum(exp(z))) - max(z) FILTER (i = j) AS l FROM (SELECT a.vec_id AS i, c.vec_id AS j, {_COS('a.v', 'c.v')} / 0.1::DOUBLE AS z FROM u a, w c WHERE c.vec_id % 20 = 0) GROUP BY j) SELECT round(((SELECT avg(l) FROM r) + (SELECT avg(l) FROM k)) / 2, 6) AS loss")
def contrastive_loss(table):
    """The ids that 20 divides, as queries of either side, against all rows of the other."""
    e = table("embeddings").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    b = e.select("vec_id", F.concat(F.slice("v", 33, 32), F.slice("v", 1, 32)).alias("w"))
    return rounded(N.contrastive_loss(e, b, "vec_id", "v", "w", 0.1, F.col("vec_id") % 20 == 0), "loss")


@query(f"""WITH u AS ({_UNIT}), p AS (SELECT {_COS('a.v', 'b.v')} AS sim, a.label = 5 AS l, b.label = 5 AS r FROM u a JOIN u b ON b.vec_id = a.vec_id + 1),
t AS (SELECT avg(1 - sim) FILTER (l AND r) AS a, avg(greatest(0, sim - 0.1)) FILTER (l <> r) AS b, count(*) FILTER (l AND r) AS normal_pairs, count(*) FILTER (l <> r) AS unilateral_pairs FROM p)
SELECT round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS loss, normal_pairs, unilateral_pairs FROM t""")
def pair_loss(table):
    e = table("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("right"), F.col("label").alias("rl"))
    return rounded(V.pair_loss(e.join(other, "vec_id"), "embedding", "right", "label", "rl", 5, 0.1), "loss")


@query(f"SELECT unit, side, round(-power(1 - p[y_true + 1], 2) * ln(p[y_true + 1]), 6) AS loss FROM (SELECT unit, side, y_true, list_transform(p, lambda x: exp(x) / list_sum(list_transform(p, lambda z: exp(z)))) AS p FROM ({_SLOT_ROWS}))")
def focal_loss_classes(table):
    rows = slots(table).select("unit", "side", S.multiclass_focal_loss(F.col("probs"), F.col("y_true")).alias("loss"))
    return rounded(rows, "loss")


# Triplets of the documents under the shared lexicon. Of occurrences that overlap the first counts; those of a
# pattern here overlap its next one alone, so every other of a chain goes.
_TRIM = "' ' || chr(9) || chr(10) || chr(12) || chr(13) || chr(12288)"
_TEXT = f"trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{3000}}]+', ' ', 'g'), {_TRIM})"
_PATTERNS = ", ".join(f"('{kind}', '{name}', '{p}')" for kind, group in (("e", LEXICON.entities), ("a", LEXICON.attributes)) for name, ps in group.items() for p in ps)
_TRIPLETS = f"""WITH c AS (SELECT doc_id, unnest(range(len(c))) AS clause_no, unnest(c) AS clause FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_TEXT}, '[。；;\\n]+'), lambda s: trim(s, {_TRIM})), lambda s: s <> '') AS c FROM documents)),
p(kind, canonical, pattern) AS (VALUES {_PATTERNS}),
w AS (SELECT c.*, kind, canonical, pattern, length(pattern) AS len FROM c JOIN p ON contains(clause, pattern)),
o AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, clause_no, pattern ORDER BY i) < len AS near FROM (SELECT *, unnest(range(1, length(clause) - len + 2)) AS i FROM w) WHERE substr(clause, i, len) = pattern),
g AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, clause_no, pattern ORDER BY i) AS chain FROM o),
h AS (SELECT doc_id, clause_no, clause, kind, canonical, len, i AS start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_no, pattern, chain ORDER BY i) AS place FROM g) WHERE place % 2 = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY start, -len, canonical) AS idx FROM h WHERE kind = 'e'), a AS (SELECT * FROM h WHERE kind = 'a'),
j AS (SELECT a.doc_id, a.clause_no, a.clause, a.canonical AS attribute, a.start AS a0, a.start + a.len AS a1, e.canonical AS entity, e.start AS e0, e.start + e.len AS e1, idx FROM a JOIN e USING (doc_id, clause_no)),
r AS (SELECT *, CASE WHEN e1 <= a0 AND a0 - e1 <= 16 THEN 0 WHEN e0 >= a1 AND e0 - a1 <= 16 THEN 1 WHEN least(abs(a0 - e0), abs(a0 - e1)) <= 32 THEN 2 ELSE 3 END AS tier FROM j),
f AS (SELECT *, CASE tier WHEN 0 THEN -e1 WHEN 1 THEN e0 ELSE least(abs(a0 - e0), abs(a0 - e1)) END AS far FROM r WHERE tier < 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_no, a0, a1, attribute ORDER BY tier, far, idx) AS q FROM f),
t AS (SELECT doc_id, CAST(clause_no AS INT) AS clause_no, CASE WHEN contains(clause, 'both') THEN 'B' WHEN contains(clause, 'left') AND contains(clause, 'right') THEN 'LR' WHEN contains(clause, 'left') THEN 'L' WHEN contains(clause, 'right') THEN 'R' ELSE 'U' END AS location, entity, attribute,
contains(substr(clause, greatest(1, a0 - 6), least(6, a0 - 1)), 'no ') OR contains(substr(clause, greatest(1, a0 - 6), least(6, a0 - 1)), 'not ') AS negated, e0 AS entity_start, a0 AS attribute_start FROM b WHERE q = 1)"""


@query(_TRIPLETS + " SELECT * FROM t")
def lexicon_triplets(table):
    return T.triplets(table("documents"), "doc_id", "text", LEXICON)


@query(_TRIPLETS + " SELECT location || ':' || entity || ':' || CASE WHEN negated THEN 'NEG:' ELSE '' END || attribute AS triplet, count(*) AS n FROM t GROUP BY 1")
def triplet_strings(table):
    found = T.triplets(table("documents"), "doc_id", "text", LEXICON)
    return found.groupBy(T.compact(F.col("location"), F.col("entity"), F.col("attribute"), F.col("negated")).alias("triplet")).agg(F.count(F.lit(1)).alias("n"))


@query(_TRIPLETS + f" SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM documents WHERE trim(coalesce(text, ''), {_TRIM}) <> '') AS with_text, count(DISTINCT doc_id) AS with_triplets, count(*) AS triplets FROM t")
def triplet_report(table):
    return T.triplet_report(table("documents"), "doc_id", "text", LEXICON)


@query(_TRIPLETS + """, s AS (SELECT *, unnest(CASE location WHEN 'L' THEN ['left'] WHEN 'R' THEN ['right'] ELSE ['left', 'right'] END) AS side FROM t WHERE NOT negated),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY clause_no, attribute_start, attribute) AS place FROM s) SELECT doc_id, side, CAST(place AS INT) AS place, CASE side WHEN 'left' THEN '左侧 ' ELSE '右侧 ' END || entity || ' ' || attribute AS query FROM k WHERE place <= 4""")
def side_queries(table):
    found = T.triplets(table("documents"), "doc_id", "text", LEXICON)
    return T.side_queries(found, "doc_id", 4, drop_negated=True)


@query("SELECT doc_id, CASE WHEN contains(text, 'both') THEN 'B' WHEN contains(text, 'left') AND contains(text, 'right') THEN 'LR' WHEN contains(text, 'left') THEN 'L' WHEN contains(text, 'right') THEN 'R' ELSE 'U' END AS location FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def clause_locations(table):
    return table("documents").select("doc_id", T.location(F.coalesce("text", F.lit("")), LEXICON).alias("location"))


@query(f"SELECT lang, count(*) FILTER (trim(coalesce(text, ''), {_TRIM}) <> '') AS with_text, count(*) AS n FROM documents GROUP BY 1")
def non_empty_texts(table):
    return table("documents").groupBy("lang").agg(F.count_if(S.non_empty(F.col("text"))).alias("with_text"), F.count(F.lit(1)).alias("n"))


_GRAMS = "SELECT item_id, substr(text, i, n) AS gram FROM (SELECT item_id, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM benchmark, (VALUES (1), (2)) v(n))"


@query(f"WITH h AS (SELECT item_id, CAST(CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 64 AS INT) AS bucket, count(*) AS n FROM ({_GRAMS}) GROUP BY 1, 2) SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM h")
def hash_vectors(table):
    return rounded(T.hash_vector(table("benchmark"), "item_id", "text", 64), "weight")


_VIEWS = ", ".join(f"('{v}', {c}, {y})" for v, (pos, neg) in R.VIEWS.items() for y, cs in ((1, pos), (0, neg)) for c in cs)
_CLASSES = ", ".join(f"({k}, '检查结论：{name}。')" for k, name in T.CLASS_NAMES.items())


@query(f"SELECT view, y, string_agg(prompt, chr(10) ORDER BY class_id) AS prompt FROM (VALUES {_VIEWS}) v(view, code, y) JOIN (VALUES {_CLASSES}) c(class_id, prompt) ON class_id = code - 1 GROUP BY 1, 2")
def view_prompts(table):
    spark = table("region").sparkSession
    return T.view_prompts(T.class_prompts(spark), R.views_frame(spark))


@query("""WITH t AS (SELECT quality + 2 * toxic AS class_id, text FROM labels JOIN documents USING (doc_id) WHERE trim(coalesce(text, ''), ' ') <> ''), n AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1)
SELECT k AS class_id, coalesce(n, 1) AS n, CASE WHEN n IS NULL THEN 'prompt' ELSE 'texts' END AS source FROM range(6) r(k) LEFT JOIN (SELECT * FROM n WHERE n >= 20) m ON m.class_id = k""")
def class_texts(table):
    """Texts of each class, or its prompt alone below 20 of them."""
    docs = table("labels").join(table("documents").select("doc_id", "text"), "doc_id").withColumn("c", F.col("quality") + 2 * F.col("toxic"))
    out = T.class_texts(docs, "c", "text", T.class_prompts(docs.sparkSession))
    return out.groupBy("class_id", "source").agg(F.count(F.lit(1)).alias("n"))


# Slices: a vector is an image of 8 x 8 in thousandths, a label a series.
_IMG = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2500) AS px FROM embeddings"
_PIX = f"SELECT vec_id, label, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(px) AS v FROM ({_IMG}))"


def _slices(table):
    return table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 2500).alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w"))


@query(f"SELECT label, CAST(round_even(median(m), 0) AS INT) AS mid_x FROM (SELECT label, vec_id, avg(x) FILTER (v > 300) AS m FROM ({_PIX}) GROUP BY 1, 2) GROUP BY label")
def bone_midlines(table):
    return I.midlines(_slices(table), "label")


@query(f"SELECT vec_id, round(sum(v * (y * 3 + x)) FILTER (x < 3), 3) AS left_sum, round(sum(v * (y * 5 + 7 - x)) FILTER (x >= 3), 3) AS right_sum FROM ({_PIX}) GROUP BY 1")
def split_sides(table):
    """Both sides at column 3, the right one mirrored, each under weights that tell places apart."""
    left, right, _ = I.split_sides(F.col("pixels"), F.col("h"), F.col("w"), F.lit(3))
    weighted = lambda a: F.round(F.aggregate(F.transform(a, lambda v, i: v * i), F.lit(0.0), lambda s, x: s + x), 3)
    return _slices(table).select("vec_id", weighted(left).alias("left_sum"), weighted(right).alias("right_sum"))


_BOX = f"SELECT vec_id, label, min(y) FILTER (v > 300) AS y0, max(y) FILTER (v > 300) AS y1, min(x) FILTER (v > 300) AS x0, max(x) FILTER (v > 300) AS x1 FROM ({_PIX}) GROUP BY 1, 2"


@query(f"SELECT vec_id, CAST(y0 AS INT) AS y0, CAST(y1 AS INT) AS y1, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1 FROM ({_BOX})")
def bounding_boxes(table):
    return _slices(table).select("vec_id", I.bounding_box(F.col("pixels"), F.col("w")).alias("b")).select("vec_id", "b.*")


@query(f"SELECT label, CAST(round_even(median(cy), 0) AS INT) AS y, CAST(round_even(median(cx), 0) AS INT) AS x FROM (SELECT label, CAST(coalesce(round_even((y0 + y1) / 2, 0), 4) AS INT) AS cy, CAST(coalesce(round_even(x0 + 0.25 * greatest(1, x1 - x0), 0), 4) AS INT) AS cx FROM ({_BOX})) GROUP BY label")
def stack_centres(table):
    s = _slices(table)
    box = I.bounding_box(F.col("pixels"), F.col("w"))
    return I.stack_centres(s, "label", "vec_id", I.crop_centre(box, F.col("h"), F.col("w")), 100_000)


@query(f"SELECT b.vec_id, round(coalesce(count(*) FILTER (v < -500) / nullif(CAST(count(v) AS DOUBLE), 0), 0), 6) AS air FROM ({_BOX}) b LEFT JOIN ({_PIX}) p ON p.vec_id = b.vec_id AND y BETWEEN y0 - 1 AND y1 + 1 AND x BETWEEN x0 - 1 AND x1 + 1 GROUP BY 1")
def air_ratios(table):
    box = I.bounding_box(F.col("pixels"), F.col("w"))
    return rounded(_slices(table).withColumn("box", box).select("vec_id", I.air_ratio(F.col("pixels"), F.col("h"), F.col("w"), F.col("box")).alias("air")), "air")


_BAND = lambda lo, hi: f"(SELECT b.vec_id, coalesce(count(*) FILTER (v < -500) / nullif(CAST(count(v) AS DOUBLE), 0), 0) AS a FROM (SELECT vec_id, min(y) FILTER (v > 300) AS y0, max(y) FILTER (v > 300) AS y1, min(x) FILTER (v > 300) AS x0, max(x) FILTER (v > 300) AS x1 FROM ({_PIX}) WHERE x BETWEEN {lo} AND {hi} GROUP BY 1) b LEFT JOIN ({_PIX}) p ON p.vec_id = b.vec_id AND y BETWEEN y0 - 1 AND y1 + 1 AND x BETWEEN greatest({lo}, x0 - 1) AND least({hi}, x1 + 1) GROUP BY 1)"


@query(f"SELECT l.vec_id, round(CASE WHEN greatest(l.a, r.a) > 0 THEN greatest(l.a, r.a) ELSE m.a END, 6) AS score FROM {_BAND(0, 1)} l JOIN {_BAND(6, 7)} r USING (vec_id) JOIN {_BAND(0, 7)} m USING (vec_id)")
def lateral_air_scores(table):
    return rounded(_slices(table).select("vec_id", I.lateral_air_score(F.col("pixels"), F.col("h"), F.col("w")).alias("score")), "score")


@query(f"SELECT vec_id, r * 3 + c AS cell, round(avg(v), 4) AS mean FROM ({_PIX}), range(3) a(r), range(3) b(c) WHERE y >= r * 8 // 3 AND y < (r * 8 + 10) // 3 AND x >= c * 8 // 3 AND x < (c * 8 + 10) // 3 GROUP BY 1, 2")
def pooled_features(table):
    cells = _slices(table).select("vec_id", F.posexplode(I.pooled(F.col("pixels"), 8, 8, 3, 3)).alias("cell", "mean"))
    return rounded(cells, "mean", digits=4)


@query(f"SELECT vec_id, round(sum(v * (y * 5 + x + 1)), 3) AS inside, CAST(25 - count(*) AS INT) AS padded FROM (SELECT vec_id, y - 4 AS y, x + 1 AS x, v FROM ({_PIX}) WHERE y >= 4 AND x <= 3) GROUP BY 1")
def square_crops(table):
    """A square of five around row 6, column 1, of which parts lie outside of the slice."""
    crop = I.crop_square(F.col("pixels"), F.col("h"), F.col("w"), F.lit(6), F.lit(1), 5)
    inside = F.aggregate(F.transform("c", lambda v, i: F.when(v == -1024, 0.0).otherwise(v * (i + 1))), F.lit(0.0), lambda s, x: s + x)
    return _slices(table).select("vec_id", crop.alias("c")).select("vec_id", F.round(inside, 3).alias("inside"), F.size(F.filter("c", lambda v: v == -1024)).alias("padded"))


@query("SELECT p_partkey, CAST(coalesce(TRY_CAST(string_split(p_name, ' ')[-1] AS BIGINT), 0) AS BIGINT) AS number FROM part")
def file_numbers(table):
    path = F.concat(F.lit("/root/series/1.2."), F.regexp_replace("p_name", " ", "."), F.lit(".dcm"))
    return table("part").select("p_partkey", S.file_number(path).alias("number"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END + coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, 0), 6) AS hu, CASE WHEN l_tax > 0.04 AND l_discount > 0 THEN l_tax - l_discount / 2 ELSE 500.0 - 3000.0 / 2 END AS low FROM lineitem")
def rescaled_windows(table):
    """Rescaled values, and the lower bound of a window or of the default one."""
    low, _ = S.window_bounds(F.when(F.col("l_tax") > 0.04, F.col("l_tax")), F.col("l_discount"))
    return table("lineitem").select("l_orderkey", "l_linenumber", F.round(S.rescaled(F.col("l_quantity"), F.col("l_discount"), F.when(F.col("l_tax") > 0.02, F.col("l_tax"))), 6).alias("hu"), low.alias("low"))
