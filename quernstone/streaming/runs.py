"""Run logs as a stream: best epoch, misses and status of every run, kept in state while its log grows.

Log lines are JSON files that are added to a folder. A line waits in state until the watermark has passed it, then
lines are folded in the order of their epochs, so lines that come late within the watermark's delay give what a
batch over the whole log gives; later ones are dropped. A line that a run already has, by epoch, counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quernstone.session import ship_package

#: The schema of the state; a change of it needs a new version and a new checkpoint folder.
STATE_VERSION = 1
STATE = "version int, best double, best_epoch long, misses int, stop_epoch long, epochs long, last_epoch long"
PENDING = "epoch long, metric double"
LINES = "run string, epoch long, metric double, ts timestamp"
OUT = "run string, epochs long, best double, best_epoch long, stop_epoch long, status string"


class RunState(StatefulProcessor):
    """Folds a run's lines: only gains over ``min_delta`` count, ``patience`` misses in a row stop."""

    def __init__(self, patience: int, min_delta: float, larger: bool = True):
        self.patience, self.min_delta, self.sign = patience, min_delta, 1.0 if larger else -1.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.pending = handle.getMapState("pending", "at long", "epoch long, metric double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for epoch, metric, ts in zip(frame["epoch"], frame["metric"], frame["ts"], strict=True):
                at = int(pd.Timestamp(ts).value // 1_000_000)
                self.pending.updateValue((at * 1_000_000 + int(epoch) % 1_000_000,), (int(epoch), None if pd.isna(metric) else float(metric)))
                if at > passed:
                    self.handle.registerTimer(at + 1)
        yield from self.fold(key, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.fold(key, timerValues.getCurrentWatermarkInMs())

    def fold(self, key, passed: int) -> Iterator[pd.DataFrame]:
        ready = sorted((v[0], v[1], k[0]) for k, v in self.pending.iterator() if k[0] // 1_000_000 <= passed)
        version, best, best_epoch, misses, stop, epochs, last = self.state.get() if self.state.exists() else (STATE_VERSION, None, None, 0, None, 0, None)
        if version != STATE_VERSION:
            raise ValueError(f"state of version {version}; this code reads {STATE_VERSION}")
        for epoch, metric, at in ready:
            self.pending.removeKey((at,))
            if last is not None and epoch <= last:
                continue
            last = epoch
            if metric is None:
                continue
            epochs += 1
            if stop is not None:
                continue
            if best is None or self.sign * metric > self.sign * best + self.min_delta:
                best, best_epoch, misses = metric, epoch, 0
            else:
                misses += 1
                stop = epoch if misses >= self.patience else None
        if ready:
            self.state.update((version, best, best_epoch, misses, stop, epochs, last))
            status = "empty_metrics" if not epochs else "stopped" if stop is not None else "running"
            yield pd.DataFrame([(key[0], epochs, best, best_epoch, stop, status)], columns=["run", "epochs", "best", "best_epoch", "stop_epoch", "status"]).astype({"best_epoch": "Int64", "stop_epoch": "Int64"})

    def close(self) -> None:
        pass


def read_logs(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Lines (run, epoch, metric, ts) of the JSON files that are added to a folder, ``files`` of them a trigger."""
    read = spark.readStream.schema(LINES)
    return (read.option("maxFilesPerTrigger", files) if files else read).json(folder)


def follow_runs(lines: DataFrame, patience: int, min_delta: float = 0.0, larger: bool = True, delay: str = "10 minutes") -> DataFrame:
    """OUT for every run whose lines the watermark has passed: a row each time it changes, for output mode update.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship_package(lines.sparkSession)
    timed = lines.where("run IS NOT NULL AND epoch IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return timed.groupBy("run").transformWithStateInPandas(RunState(patience, min_delta, larger), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def latest(updates: DataFrame) -> DataFrame:
    """The last row of each run among collected updates: the one with most epochs, a stopped one first."""
    return updates.groupBy("run").agg(F.max_by(F.struct("epochs", "best", "best_epoch", "stop_epoch", "status"), F.struct("epochs", F.col("stop_epoch").isNotNull())).alias("x")).select("run", "x.*")
