"""Mergeable profiles: a sketch for each column and part, stored once; profiles of any parts are merged from these.

Quantiles come from KLL sketches, distinct counts from HyperLogLog, counts and extremes are exact. A part is read
once, when it is new; what is stored of it does not grow with its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: KLL size, whose rank error is under RANK_ERROR with 99 in 100 certainty for a single quantile, and the binary
#: logarithm of the HyperLogLog registers, whose standard error is 1.04 / sqrt(2 ** 12).
KLL_SIZE, RANK_ERROR = 400, 0.01
HLL_LOG, DISTINCT_ERROR = 12, 4 * 1.04 / 64


def sketches(df: DataFrame, part: Column, numeric: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """(part, column, n, nulls, total, squares, least, most, kll, hll), one row for each part and column.

    ``numeric`` columns are taken as doubles, of which infinite ones and no numbers count as null; only they have
    moments, extremes and a KLL sketch. Distinct values of all are counted as text. Partial aggregates hold the sketches,
    so a part of any size is one small row.
    """
    parts = df.select(part.cast("string").alias("part"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)], *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, _ in enumerate(numeric):
        v = finite(f"x{i}")
        cells.append(F.struct(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, KLL_SIZE).alias("kll"), F.hll_sketch_agg(v.cast("string"), HLL_LOG).alias("hll")).alias(f"s{i}"))
    none = F.lit(None).cast("double")
    for i, _ in enumerate(categories):
        v = F.col(f"c{i}")
        cells.append(F.struct(F.count(v).alias("n"), none.alias("total"), none.alias("squares"), none.alias("least"), none.alias("most"), F.lit(None).cast("binary").alias("kll"), F.hll_sketch_agg(v, HLL_LOG).alias("hll")).alias(f"t{i}"))
    rows = parts.groupBy("part").agg(*cells)
    names = [(c, f"s{i}") for i, c in enumerate(numeric)] + [(c, f"t{i}") for i, c in enumerate(categories)]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(s).alias("s")) for c, s in names])
    long = rows.select("part", "rows", F.inline(each))
    return long.select("part", "column", "s.n", (F.col("rows") - F.col("s.n")).alias("nulls"), "s.total", "s.squares", "s.least", "s.most", "s.kll", "s.hll")


def merged(stored: DataFrame, points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, nulls, mean, std_pop, min, max, p10, ..., distinct) of stored sketches, by ``column`` and ``by``.

    Quantiles are values whose rank is within RANK_ERROR of the point; a column without numbers has none.
    """
    all_ = stored.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("t"), F.sum("squares").alias("q"), F.min("least").alias("min"), F.max("most").alias("max"), F.kll_merge_agg_double(F.when(F.col("least").isNotNull(), F.col("kll"))).alias("kll"), F.hll_union_agg("hll").alias("hll"))
    mean = F.col("t") / F.col("n")
    quantile = lambda p: F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.lit(float(p))))
    return all_.select(
        *by, "column", "n", "nulls", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std_pop"), "min", "max",
        *[quantile(p).alias(f"p{round(100 * p)}") for p in points], F.hll_sketch_estimate("hll").alias("distinct"),
    )


class ProfileStore:
    """Sketches of parts in a folder; each addition is a folder of its own, which counts once it has its marker."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame | None:
        """What is stored, one row for a part and column; None without anything."""
        if not self.store.exists(self.path):
            return None
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in self.store.listStatus(self.path) if s.isDirectory()]
        whole = sorted(p.toString() for p in found if self.store.exists(child(p, "_SUCCESS")))
        # Two writers may have stored the same part: either row tells the same.
        return self.spark.read.parquet(*whole).dropDuplicates(["part", "column"]) if whole else None

    def add(self, df: DataFrame, part: str, numeric: Sequence[str] = (), categories: Sequence[str] = ()) -> int:
        """Store the parts of ``df`` that are not stored; returns how many. ``part`` is best a column of the files' folders,
        as then only new parts' files are read."""
        known = self.rows()
        listed = df.select(F.col(part).cast("string").alias("p")).distinct()
        new = [r["p"] for r in (listed if known is None else listed.join(known.select(F.col("part").alias("p")).distinct(), "p", "left_anti")).where("p IS NOT NULL").collect()]
        if new:
            kind = df.schema[part].dataType
            fresh = df.where(F.col(part).isin(*[F.lit(p).cast(kind) for p in new]))
            sketches(fresh, F.col(part), numeric, categories).write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
        return len(new)

    def profile(self, points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), by: Sequence[str] = ()) -> DataFrame:
        """The profile of all stored parts, or of each with ``by=["part"]``."""
        rows = self.rows()
        if rows is None:
            raise ValueError("nothing is stored")
        return merged(rows, points, by)
