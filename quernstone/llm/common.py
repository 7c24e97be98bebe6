"""What several corpus operators need: scratch tables, node labels, running ranks."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.scratch import scratch_root, written  # noqa: F401  the operators take them from here

#: The surrogate key of the registered queries on synthetic tables. It is public, so anybody can undo its
#: surrogates: a deployment sets KEY_SETTING to a secret of its own.
KEY = b"registered-query-key"
KEY_SETTING = "spark.quernstone.surrogate.key"
#: Rows of narrow columns that are broadcast at most; a table beyond it is joined by sorting both sides.
BROADCAST_ROWS = 1_000_000


def tokenizer_path(name: str) -> str:
    """Where the named vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret of KEY_SETTING; the public key, with a warning, where that is unset. An empty one raises."""
    secret = spark.conf.get(KEY_SETTING, None)
    if secret is None:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates under the public key can be undone", stacklevel=2)
        return KEY
    if not secret:
        raise ValueError(f"{KEY_SETTING} is empty")
    return secret.encode()


def as_text(docs: DataFrame, *names: str) -> list:
    """Columns as strings, for their way through pandas, where whole numbers beside a null would become floats."""
    return [F.col(f"`{n}`").cast("string").alias(n) for n in names]


def as_before(out: DataFrame, kinds: dict) -> DataFrame:
    """``out`` with the columns of ``as_text`` back in their types (name: type)."""
    return out.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in out.columns])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Parts that a hot key is dealt to when both sides of a join are sorted.
SALTS = 16


def spread_join(rows: DataFrame, row_key: str, small: DataFrame, keys: dict[str, str], limit: int | None = None) -> DataFrame:
    """``rows`` left-joined to ``small``, a written table of narrow rows with one row a key.

    ``keys`` maps columns of ``rows`` to those of ``small``. Up to ``limit`` counted rows ``small`` is
    broadcast; beyond it both sides are sorted by key and a salt, which ``row_key`` is hashed to, so rows
    that share a key are dealt to SALTS tasks.
    """
    on = [F.col(a) == F.col(b) for a, b in keys.items()]
    if small.count() <= (BROADCAST_ROWS if limit is None else limit):
        return rows.join(F.broadcast(small), on, "left").drop(*keys.values())
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(row_key), F.lit(SALTS)))
    copies = small.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*on, F.col("__salt") == F.col("__copy")], "left").drop("__salt", "__copy", *keys.values())


def sided(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, a written table of narrow rows, hinted for a join: broadcast if its counted rows fit ``limit``."""
    return small.hint("broadcast" if small.count() <= limit else "merge")


def sized_rows(col: str = "text"):
    """UTF-8 length of a string column, null as 0."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def running_rank(groups: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """0-based rank of each row among the rows of its group so far; ``seen`` (by group) is advanced."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, int)
    sizes = np.diff(np.r_[starts, len(ordered)])
    inside = np.arange(len(ordered)) - np.repeat(starts, sizes)
    rank = np.empty(len(groups), np.int64)
    rank[order] = inside + seen[ordered]
    seen[ordered[starts]] += sizes
    return rank


def rank_offsets(ranked: DataFrame, group: str) -> DataFrame:
    """Rows before each (part, group) in the order of part.

    ``ranked`` has the columns part and ``group``. Only one row per pair enters the window, so a
    group's window is as long as the table has parts, however many rows the group has.
    """
    counts = ranked.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("part", group, (F.sum("n").over(w) - F.col("n")).alias("before"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    ``edges`` has the long columns u and v. Each round maps a node to the neighbour, itself included,
    that comes first in an order drawn anew from a hash, and keeps the edges between images; a
    constant share of the nodes goes in each round, whatever the graph's diameter. Rounds are written
    tables, so lineage stays short. Self-loops are allowed; nulls are not.
    """
    spark = edges.sparkSession
    live = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    maps: list[DataFrame] = []
    for turn in range(rounds):
        if live.isEmpty():
            break
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.union(live.select("u", F.col("u").alias("v"))).union(live.select(F.col("v").alias("u"), F.col("v").alias("v")))
        first = F.min_by("v", F.struct(F.xxhash64("v", F.lit(turn)), F.col("v")))
        step = written(both.groupBy("u").agg(first.alias("to")), "step")
        maps.append(step)
        a = step.select(F.col("u"), F.col("to").alias("a"))
        b = step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        live = written(live.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    found = maps[0].select(F.col("u").alias("node"), F.col("to").alias("at"))
    for step in maps[1:]:
        nxt = step.select(F.col("u").alias("at"), "to")
        found = found.join(nxt, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    least = found.groupBy("at").agg(F.min("node").alias("component"))
    return written(found.join(least, "at").select("node", "component"), "components")


class UnionFind(dict):
    """Disjoint sets over hashable nodes; the smallest node stands for its set."""

    def find(self, x):
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, int)
    return starts, np.diff(np.r_[starts, len(values)])


def texts_of(column: Iterable) -> Iterator[bytes]:
    """Cells of a binary column as bytes, null as empty."""
    for cell in column:
        yield b"" if cell is None else bytes(cell)
