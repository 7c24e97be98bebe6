"""Vectors as arrays: norms, prototypes, pooling, recall. Comparison of all pairs is in ``nearest``."""

from __future__ import annotations

import hashlib
import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.scratch import sided, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2 normalised, 1e-12 added to the norm."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-12
    return F.transform(v, lambda x: x.cast("double") / n)


def mean_of(v: Column) -> Column:
    """Aggregate: the mean of vectors, as an array; one buffer of the vectors' width a group, no row a position."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(v, lambda x: x.cast("double")))))


def neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, skip_self: bool = True) -> DataFrame:
    """``nearest.neighbours``, which itself builds on this module."""
    from quernstone.operators import nearest

    return nearest.neighbours(queries, base, key, vector, k, skip_self)


def prototypes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, prototype): the normalised mean of each class's normalised vectors."""
    mean = df.where(F.col(vector).isNotNull()).groupBy(label).agg(mean_of(unit(F.col(vector))).alias("mean"))
    return mean.select(label, unit(F.col("mean")).alias("prototype"))


def zscore_distance(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(key, distance): the length of each row's vector of z-scores by position in its group.

    Deviations are of the population, below 1e-6 they count as 1. A group's moments are one row with two arrays;
    rows without a group or a vector take no part.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(key, group, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    m = rows.groupBy(group).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("v")).alias("m"))
    population = F.transform(vector_to_array("m.variance"), lambda x: F.sqrt(F.greatest(F.lit(0.0), x * (F.col("m.count") - 1) / F.col("m.count"))))
    moments = m.select(F.col(group).alias("__g"), vector_to_array("m.mean").alias("mean"), F.transform(population, lambda d: F.when(d < 1e-6, 1.0).otherwise(d)).alias("deviation"))
    joined = rows.join(sided(written(moments, "moments"), 100_000), F.col(group) == F.col("__g"))
    z = F.zip_with(F.zip_with("v", "mean", lambda x, y: x - y), "deviation", lambda x, d: x / d)
    return joined.select(key, F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x)).alias("distance"))


def prototype_scores(df: DataFrame, protos: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, class, score): cosine of every row with every class prototype; classes are few."""
    classes = protos.select(F.collect_list(F.struct(F.col(label).alias("class"), F.col("prototype"))).alias("ps"))
    out = df.select(key, unit(F.col(vector)).alias("v")).withColumn("ps", classes.scalar())
    return out.select(key, F.inline(F.transform("ps", lambda p: F.struct(p["class"].alias("class"), dot(F.col("v"), p["prototype"]).alias("score")))))


def pair_features(left: Column, right: Column) -> Column:
    """left, right and their absolute differences, in one array."""
    return F.concat(left, right, F.zip_with(left, right, lambda a, b: F.abs(a - b)))


def attention_pool(weights: Column, vectors: Column, width: int) -> Column:
    """Softmax-weighted mean of an array of vectors."""
    from quernstone.functions.scalar import softmax

    w = softmax(weights)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.zip_with(w, vectors, lambda a, v: a * F.get(v, i)), F.lit(0.0), lambda s, x: s + x))


def gaussian_weights(width: int, out: int, seed: str = "0") -> list[list[float]]:
    """``out`` rows of ``width`` normal numbers over sqrt(out), by Box and Muller from 52 bits each of md5(seed:i:j:0) and md5(seed:i:j:1)."""
    even = lambda *at: (int(hashlib.md5(":".join(map(str, (seed, *at))).encode()).hexdigest()[:13], 16) + 1) / 2**52
    return [[math.sqrt(-2 * math.log(even(i, j, 0))) * math.cos(2 * math.pi * even(i, j, 1)) / math.sqrt(out) for i in range(width)] for j in range(out)]


def projection(v: Column, width: int, out: int, seed: str = "0") -> Column:
    """Seeded Gaussian random projection to ``out`` numbers; the weights are one literal matrix in the plan."""
    matrix = F.lit(gaussian_weights(width, out, seed))
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(F.slice(v, 1, width), row, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x))


def recall(ranks: DataFrame, ks) -> DataFrame:
    """(k_requested, recall): the share of queries whose true rank is within k; larger k than rows count as all."""
    long = ranks.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k_requested"), "true_rank")
    return long.groupBy("k_requested").agg(F.round(F.avg((F.col("true_rank") <= F.col("k_requested")).cast("int")), 6).alias("recall"))


def with_codes(df: DataFrame, code: str, codes) -> DataFrame:
    """Rows with a listed code; an empty list filters nothing."""
    return df.where(F.col(code).isin(*codes)) if codes else df


def contrast_scores(df: DataFrame, protos: DataFrame, key: str, vector: str, positive=1, negative=0, label: str = "label") -> DataFrame:
    """(key, score): cosine with the positive prototype less that with the negative; raises where either is missing."""
    one = lambda v: protos.where(F.col(label) == v).agg(F.first("prototype").alias("p")).scalar()
    out = df.select(key, unit(F.col(vector)).alias("v")).withColumns({"p": one(positive), "q": one(negative)})
    both = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), dot(F.col("v"), F.col("p")) - dot(F.col("v"), F.col("q")))
    return out.select(key, F.coalesce(both, F.raise_error(F.lit("a prototype of each side is required")).cast("double")).alias("score"))


def prototype_logits(df: DataFrame, protos: DataFrame, key: str, label: str, vector: str, scale: float, initial: DataFrame | None = None, frozen=()) -> DataFrame:
    """(key, class, logit): cosine times a scale clamped to 1..100; frozen classes use their initial prototype."""
    used = protos
    if initial is not None and frozen:
        used = protos.where(~F.col(label).isin(*frozen)).select(label, "prototype").unionByName(initial.where(F.col(label).isin(*frozen)).select(label, "prototype"))
    used = used.select(label, unit(F.col("prototype")).alias("prototype"))
    return prototype_scores(df, used, key, label, vector).select(key, "class", (F.col("score") * min(100.0, max(1.0, scale))).alias("logit"))


def prototype_drift(protos: DataFrame, initial: DataFrame, label: str, frozen=()) -> DataFrame:
    """One row: mean squared distance of normalised prototypes to their initial ones, frozen classes left out; 0 without others."""
    both = protos.select(label, unit(F.col("prototype")).alias("p")).join(initial.select(label, F.col("prototype").alias("i")), label)
    both = both.where(~F.col(label).isin(*frozen)) if frozen else both
    square = F.aggregate(F.zip_with("p", "i", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.coalesce(F.avg(square), F.lit(0.0)).alias("drift"), F.count(F.lit(1)).alias("classes"))


def mean_vectors(df: DataFrame, unit_key: str, vector: str) -> DataFrame:
    """(unit, mean): the mean of the vectors of each unit's parts; null vectors do not count."""
    return df.where(F.col(vector).isNotNull()).groupBy(unit_key).agg(mean_of(F.col(vector)).alias("mean"))


def pair_loss(pairs: DataFrame, left: str, right: str, left_label: str, right_label: str, normal: int, most: float) -> DataFrame:
    """One row: the mean of the terms there are: 1 - cosine over pairs normal on both sides, and what the cosine
    exceeds ``most`` by over pairs normal on one; null without either."""
    sim = dot(unit(F.col(left)), unit(F.col(right)))
    rows = pairs.where(F.col(left_label).isNotNull() & F.col(right_label).isNotNull()).select(sim.alias("sim"), (F.col(left_label) == normal).alias("l"), (F.col(right_label) == normal).alias("r"))
    both, single = F.col("l") & F.col("r"), F.col("l") != F.col("r")
    terms = rows.agg(F.avg(F.when(both, 1 - F.col("sim"))).alias("a"), F.avg(F.when(single, F.greatest(F.lit(0.0), F.col("sim") - most))).alias("b"), F.count_if(both).alias("normal_pairs"), F.count_if(single).alias("unilateral_pairs"))
    there = F.array_compact(F.array("a", "b"))
    return terms.select(F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)).alias("loss"), "normal_pairs", "unilateral_pairs")
