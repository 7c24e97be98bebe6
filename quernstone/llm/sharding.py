"""Jump consistent hashing: keys to shards without a ring table.

Jump hashing (Lamping and Veach, 2014) draws for each key a sequence of ever larger jump targets; the
last target below the shard count is the shard. With one shard more, only keys whose next target is
the new shard move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quernstone.llm.common import rank_offsets, running_rank, sized_rows, written

#: Fixed values of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state, at, nxt = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = nxt[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        ratio = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt[live] = ((at[live] + 1) * ratio).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard by its key and number the rows of each shard.

    Returns the key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and grown_shard (the
    shard if there were one more). The law is ``key``: only the key and the shard count decide, so
    equal keys meet and a new shard takes rows only into itself. Slots run from 0 without gaps, in
    the order of the key; rows with the same key, repeated rows included, stand in any order. A null
    key counts as a key of its own; a null text has size 1 and crc 0. An empty table gives an empty
    result; other columns of the input are not read.

    One range shuffle of narrow rows (no text): the bounds hold a row number beside the key, so a key
    with a third of all rows is dealt to many tasks. Slots come from counts per (task, shard).
    """
    digest = docs.select(
        F.col(key).alias("k"),
        (sized_rows(text) + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(key)).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    )

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            keys = b["h"].to_numpy().astype(np.int64).view(np.uint64)
            shard = jump(keys, shards)
            yield pd.DataFrame({"k": b["k"], "size": b["size"], "text_crc32": b["text_crc32"], "part": part, "shard": shard, "inside": running_rank(shard, seen), "grown_shard": jump(keys, shards + 1)})

    numbered = written(
        digest.repartitionByRange("k", "row").sortWithinPartitions("k", "row").withColumn("k", F.col("k").cast("string")).mapInPandas(number, "k string, size long, text_crc32 long, part int, shard int, inside long, grown_shard int"),
        "shards",
    )
    return numbered.join(rank_offsets(numbered, "shard"), ["part", "shard"]).select(
        F.col("k").cast(docs.schema[key].dataType).alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside")).alias("slot"), "grown_shard"
    )
