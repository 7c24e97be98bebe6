"""A kept memo of encoded texts: an append-only table of runs, keyed by digest and encoder version.

A run is a folder of Parquet files of its own, and counts from the moment its ``_SUCCESS`` marker is there, so two
writers never touch each other's files and a run that was broken off is not read. Two writers that miss the same
text both encode it; readers take the older of the two rows.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.scratch import written


class Memo:
    """The memo in ``folder`` for one ``version`` of an encoder."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Folders of whole runs."""
        if not self.store.exists(self.path):
            return []
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in self.store.listStatus(self.path) if s.isDirectory()]
        return sorted(p.toString() for p in found if self.store.exists(child(p, "_SUCCESS")))

    def rows(self, runs: list[str] | None = None) -> DataFrame | None:
        """(digest, code, stamp) of the version, one row a digest, the oldest; None without any run."""
        runs = self.runs() if runs is None else runs
        if not runs:
            return None
        table = self.spark.read.parquet(*runs).where(F.col("version") == self.version)
        return table.groupBy("digest").agg(F.min_by(F.struct("code", "stamp"), F.struct("stamp", "run")).alias("x")).select("digest", "x.code", "x.stamp")

    def append(self, rows: DataFrame) -> None:
        """Add a run of (digest, code)."""
        run, stamp = uuid.uuid4().hex, time.time_ns()
        rows.select("digest", "code", F.lit(self.version).alias("version"), F.lit(stamp).alias("stamp"), F.lit(run).alias("run")).write.parquet(f"{self.folder}/{run}")

    def trim(self, cap: int) -> None:
        """Keep the ``cap`` newest rows of every version together, as one run; of a stamp's rows those first by digest.

        Runs that were read are deleted at the end, so what other writers add meanwhile stays. A reader that
        holds a deleted run has to read again.
        """
        old = self.runs()
        if not old:
            return
        every = self.spark.read.parquet(*old).groupBy("version", "digest").agg(F.min_by(F.struct("code", "stamp", "run"), F.struct("stamp", "run")).alias("x")).select("version", "digest", "x.*")
        every = written(every, "memo")
        sizes = every.groupBy("stamp").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are runs
        ahead = sizes.select(F.col("stamp").alias("__s"), (F.sum("n").over(Window.orderBy(F.desc("stamp"))) - F.col("n")).alias("ahead"), "n")
        joined = every.join(F.broadcast(ahead), F.col("stamp") == F.col("__s")).where(F.col("ahead") < cap)
        whole, cut = joined.where(F.col("ahead") + F.col("n") <= cap), joined.where(F.col("ahead") + F.col("n") > cap)
        # One stamp is cut: the place of a row in it comes from counts of digests' first bytes and a window inside one.
        first = F.substring("digest", 1, 3)
        counts = cut.groupBy(first.alias("__f")).agg(F.count(F.lit(1)).alias("c"))
        before = counts.select("__f", (F.sum("c").over(Window.orderBy("__f")) - F.col("c")).alias("before"))
        placed = cut.withColumn("__g", first).join(F.broadcast(before), F.col("__g") == F.col("__f"))
        inside = F.row_number().over(Window.partitionBy("__g").orderBy("digest", "version"))
        kept = placed.withColumn("place", F.col("ahead") + F.col("before") + inside).where(F.col("place") <= cap)
        columns = ["digest", "code", "version", "stamp", "run"]
        whole.select(*columns).unionByName(kept.select(*columns)).write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
        for run in old:
            self.store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(run), True)


def encode_memo(df: DataFrame, text: str, encode, folder: str, version: str, cap: int | None = None) -> DataFrame:
    """``df`` with code = encode(text), computed for texts that the memo in ``folder`` does not have.

    Texts meet their codes by SHA-256, each distinct one is encoded once, a null text has no code. ``encode`` is a
    column function whose results depend on the text and ``version`` alone. With a ``cap`` the memo keeps the
    newest that many rows afterwards; results do not depend on it.
    """
    memo = Memo(df.sparkSession, folder, version)
    tagged = written(df.withColumn("__d", F.sha2(F.col(text), 256)), "texts")
    texts = tagged.where("__d IS NOT NULL").groupBy("__d").agg(F.first(text).alias("__t"))
    known = memo.rows()
    misses = texts if known is None else texts.join(known.select(F.col("digest").alias("__d")), "__d", "left_anti")
    fresh = written(misses.select(F.col("__d").alias("digest"), encode(F.col("__t")).alias("code")), "codes")
    if not fresh.isEmpty():
        memo.append(fresh)
    codes = fresh if known is None else fresh.unionByName(known.select("digest", "code"))
    codes = written(texts.select(F.col("__d").alias("digest")).join(codes, "digest"), "codes")
    if cap is not None:
        memo.trim(cap)
    # A text may be a third of all rows: codes are dealt by digest and salt only where they are too many to send.
    small = codes.count() <= 100_000
    if small:
        return tagged.join(F.broadcast(codes), F.col("__d") == F.col("digest"), "left").drop("__d", "digest")
    salted = tagged.withColumn("__s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)))
    copies = codes.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return salted.join(copies, (F.col("__d") == F.col("digest")) & (F.col("__s") == F.col("__c")), "left").drop("__d", "digest", "__s", "__c")
