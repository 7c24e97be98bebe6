"""Exact comparison of a stated query set with all rows of a base: the base is read in place, queries go to it.

Queries are cut into blocks of a counted size, and each block is sent to the tasks that read the base; no row of the
base is shuffled. Within a task rows are ordered by their nearest pivot and cut into groups. The angle
between a query and a row is at least the difference of their angles to any pivot, so a group's range of angles
to each pivot bounds its cosines from above, and a group is compared with those queries alone that
the bound cannot rule out. Similarities of the pairs that are kept are summed in the order of the components.

Where all rows are queries (``first_match_ranks``) nothing passes through the driver: both sides are written in packed
blocks, dealt by key, and parts of them meet in tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quernstone.operators.vectors import dot, unit
from quernstone.scratch import written
from quernstone.session import ship_package

#: Bytes of query vectors that are sent to the tasks at a time, pivots, rows a group, and base rows that give first bounds.
BLOCK_BYTES, PIVOTS, GROUP, SAMPLE = 16 << 20, 16, 256, 2048
#: Queries that a group of rows is compared with at a time, and pairs whose sums are taken at a time: what a task holds beside its block.
STEP, PAIRS = 2048, 32_768
#: Bytes of vectors, as doubles, in a packed block and in a part of packed blocks.
PACK_BYTES, PART_BYTES = 2 << 20, 8 << 20
#: More than rounding to six digits and floating-point sums can change.
SLACK = 2e-6


@dataclass
class Block:
    """Unit vectors of some queries with their ids, labels or other values, and their angles to the pivots."""

    ids: list
    vectors: np.ndarray
    extra: list
    pivots: np.ndarray
    angles: np.ndarray
    short: np.ndarray


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half up in decimal, as Spark rounds a double."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x)
    step = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):  # too near to a half for floating point
        out[i] = float(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP))
    return out + 0.0


def sums(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scalar products of paired rows, component by component from the first."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * b[:, j]
    return out


def paired(queries: np.ndarray, q: np.ndarray, v: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``sums`` of the pairs (q, b) of rows of two matrices, some pairs at a time."""
    out = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        out[at : at + PAIRS] = sums(queries[q[at : at + PAIRS]], v[b[at : at + PAIRS]])
    return out


def _angles(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of directions to the pivots, and whether a vector is shorter than a unit vector."""
    length = np.sqrt((v * v).sum(1))
    direction = v / np.where(length > 0, length, 1)[:, None]
    return np.arccos(np.clip(direction @ pivots.T, -1, 1)), length < 1 - 1e-9


def groups(v: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Rows of each group with the least and the largest angle to every pivot, and whether any row is short."""
    angle, short = _angles(v, pivots)
    nearest = angle.argmin(1)
    order = np.lexsort((angle[np.arange(len(v)), nearest], nearest))
    for at in range(0, len(order), GROUP):
        rows = order[at : at + GROUP]
        yield rows, angle[rows].min(0), angle[rows].max(0), bool(short[rows].any())


def upper_bounds(block: Block, low: np.ndarray, high: np.ndarray, short: bool) -> np.ndarray:
    """For each query no cosine with a row of the group is larger. The length of a short vector only brings it nearer to 0."""
    apart = np.maximum(np.maximum(block.angles - high, low - block.angles), 0).max(1)
    cosine = np.cos(np.minimum(apart, np.pi))
    return np.where(short | block.short, np.maximum(cosine, 0), cosine)


def _reached(block: Block, live: np.ndarray, v: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the queries ``live`` that some row of the group may come up to, by their ``least``, and their products
    with all rows of it. Single precision rules out the others: unit vectors of w numbers are off by under (w + 2) / 2^24."""
    group = v[rows]
    most = (block.vectors[live].astype(np.float32) @ group.astype(np.float32).T).max(1)
    live = live[most >= least[live] - SLACK - (v.shape[1] + 2) * 2.0**-23]
    return live, block.vectors[live] @ group.T


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Null keys and vectors that are null or hold a null or no number take no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return df.where(F.col(vector).isNotNull() & sound & F.col(key).isNotNull())


def _rows(df: DataFrame, columns: dict[str, str], vector: str) -> DataFrame:
    """Named columns and the unit vector of the rows that take part."""
    out = _sound(df, next(iter(columns.values())), vector)
    return out.select(*[F.col(c).alias(n) for n, c in columns.items()], unit(F.col(vector)).alias("v"))


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """Vectors of a batch in rows; of different widths in one batch is an error."""
    col = batch.column(column)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    width = len(flat) // n if n else 0
    if n and (len(flat) != n * width or np.any(np.diff(col.offsets.to_numpy()) != width)):
        raise ValueError("vectors of different widths")
    return flat.reshape(n, width)


def _typed(batch: pa.RecordBatch, types: list) -> pa.RecordBatch:
    """Columns in the types of the result: keys pass as Python values, which do not tell their width."""
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, types, strict=True)], batch.schema.names)


def against(queries: DataFrame, base: DataFrame, q_columns: dict[str, str], b_columns: dict[str, str], q_vector: str, b_vector: str, schema: str, task: Callable[[Block, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], prepare: Callable | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What ``task`` yields of each block of queries and each part of the base.

    ``q_columns`` begins with the query's key, then what goes with it; the base has ``b_columns``, the key first,
    and ``v``. Rows of ``SAMPLE`` base vectors, any ones, give the pivots and, through ``prepare(block, ids,
    vectors)``, whatever may speed a block up; results do not depend on them. A block holds ``block_bytes`` of
    vectors at most, so the base is read once for each of them.
    """
    spark = base.sparkSession
    ship_package(spark)
    q = written(_rows(queries, q_columns, q_vector).withColumn("width", F.size("v")), "queries")
    rows = _rows(base, b_columns, b_vector)
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w")).first()
    empty = spark.createDataFrame([], schema)
    types = [to_arrow_type(f.dataType) for f in empty.schema]
    if not size["n"]:
        return empty
    sample = rows.limit(SAMPLE).collect()
    if not sample:
        return empty
    some = np.array([r["v"] for r in sample])
    pivots = spread(some, PIVOTS)
    count = -(-size["n"] * max(1, size["w"]) * 8 // block_bytes)
    tagged = q.withColumn("block", F.pmod(F.xxhash64(next(iter(q_columns))), F.lit(count)))
    out = empty
    for k in range(count):
        held = tagged.where(F.col("block") == k).drop("block", "width").collect()
        if not held:
            continue
        vectors = np.array([r["v"] for r in held])
        angle, short = _angles(vectors, pivots)
        block = Block([r[0] for r in held], vectors, [tuple(r)[1:-1] for r in held], pivots, angle, short)
        if prepare:
            prepare(block, [r[0] for r in sample], some)
        sent = spark.sparkContext.broadcast(block)
        out = out.union(rows.mapInArrow(lambda batches, sent=sent: (_typed(x, types) for x in task(sent.value, batches)), schema))
    return out


def packed(df: DataFrame, key: str, vector: str, label: str, block_bytes: int = PACK_BYTES) -> DataFrame:
    """A written table with a row for each block of rows: its number, and their keys, labels and vectors one behind another.

    Rows are dealt by key; ``once`` says which row of a key is the first. What takes no part is left out.
    """
    spark = df.sparkSession
    ship_package(spark)
    kind = "float" if df.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    rows = _sound(df, key, vector).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    parts = max(1, -(-size["n"] * (size["w"] or 0) * 8 // PART_BYTES))
    shape = f"block long, keys array<{df.schema[key].dataType.simpleString()}>, labels array<{df.schema[label].dataType.simpleString()}>, once array<boolean>, v array<{kind}>"
    types = [to_arrow_type(f.dataType) for f in spark.createDataFrame([], shape).schema]

    def pack(batches):
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        number, known = TaskContext.get().partitionId() << 32, set()
        for b in batches:
            step = max(1, block_bytes // (8 * max(1, matrix(b).shape[1])))
            for at in range(0, b.num_rows, step):
                x = b.slice(at, step)
                once = pa.array([k not in known and not known.add(k) for k in x.column("key").to_pylist()])
                block = [pa.array([number]), one(x.column("key")), one(x.column("label")), one(once), one(x.column("v").flatten())]
                yield _typed(pa.RecordBatch.from_arrays(block, ["block", "keys", "labels", "once", "v"]), types)
                number += 1

    return written(rows.repartition(parts, "key").mapInArrow(pack, shape), "blocks")


def _unpacked(keys: pa.Array, v: pa.Array) -> np.ndarray:
    """Unit vectors of some blocks, as ``unit`` makes them."""
    rows, numbers = np.diff(keys.offsets.to_numpy()), np.diff(v.offsets.to_numpy())
    n, width = rows.sum(), numbers[0] // rows[0]
    if np.any(numbers != rows * width):
        raise ValueError("vectors of different widths")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
    return x / (np.sqrt(sums(x, x)) + 1e-12)[:, None]


def crossed(queries: DataFrame, base: DataFrame, pivots: np.ndarray, schema: str, extra: Callable[[pa.RecordBatch], tuple[np.ndarray, list]], task: Callable[[int, Block, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``task`` yields of each packed block of queries and each part of the packed base.

    Parts of either side meet in a Cartesian product, so there may be as many queries as rows of the base: none passes
    through the driver. ``extra`` gives the places of a block's rows that are queries, and what goes with each.
    """
    types = [to_arrow_type(f.dataType) for f in base.sparkSession.createDataFrame([], schema).schema]

    def runs(batches):
        for b in batches:
            block = b.column("block").to_numpy()
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
            step = max(1, PART_BYTES // (8 * max(1, np.diff(b.column("b_v").offsets.to_numpy()).max(initial=0))))  # what is unpacked at a time
            for lo, hi in zip(starts, [*starts[1:], len(block)], strict=True):
                for at in range(lo, hi, step):
                    yield int(block[at]), b.slice(at, min(step, hi - at))

    def rows(b):
        keys, v = b.column("b_keys"), _unpacked(b.column("b_keys"), b.column("b_v"))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
        return pa.RecordBatch.from_arrays([keys.flatten(), b.column("b_labels").flatten(), vectors], ["key", "label", "v"])

    def meet(batches):
        for number, several in groupby(runs(batches), key=itemgetter(0)):
            _, head = next(several)
            at, values = extra(head)
            if not len(at):
                continue
            first = head.slice(0, 1)
            v = _unpacked(first.column("keys"), first.column("v"))[at]
            keys = first.column("keys").flatten().to_pylist()
            block = Block([keys[i] for i in at], v, values, pivots, *_angles(v, pivots))
            for x in task(number, block, map(rows, chain([head], (b for _, b in several)))):
                yield _typed(x, types)

    right = base.select(*[F.col(c).alias(f"b_{c}") for c in ("keys", "labels", "v")])
    return queries.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(meet, schema)


def spread(v: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` directions of ``v``, each the farthest from those before."""
    length = np.sqrt((v * v).sum(1))
    d = v[length > 0] / length[length > 0][:, None]
    if not len(d):
        return np.eye(1, v.shape[1])
    chosen, near = [0], d @ d[0]
    while len(chosen) < min(k, len(d)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, d @ d[chosen[-1]])
    return d[chosen]


class TopK:
    """The best k (similarity, id) of every query of a block so far; ``compared`` counts the pairs looked at.

    ``allowed(q, b)`` says which pairs count, by places of queries in the block and of rows in a batch.
    """

    def __init__(self, block: Block, k: int, skip_self: bool, least: np.ndarray | None = None):
        self.block, self.k, self.skip_self, self.compared = block, k, skip_self, 0
        self.best: list[list[tuple[float, object]]] = [[] for _ in block.ids]
        self.floor = np.full(len(block.ids), -np.inf) if least is None else least.copy()

    def add(self, ids: list, v: np.ndarray, allowed: Callable | None = None) -> None:
        # rows of the query's own key do not count, and may be several
        most = self.k + (max(Counter(ids).values(), default=0) if self.skip_self else 0)
        for rows, low, high, short in groups(v, self.block.pivots):
            every = np.flatnonzero(upper_bounds(self.block, low, high, short) >= self.floor - SLACK)
            self.compared += len(every) * len(rows)
            for at in range(0, len(every), STEP):
                self._meet(every[at : at + STEP], rows, ids, v, most, allowed)

    def _meet(self, live: np.ndarray, rows: np.ndarray, ids: list, v: np.ndarray, most: int, allowed: Callable | None) -> None:
        live, rough = _reached(self.block, live, v, rows, self.floor)
        least = self.floor[live]
        if allowed is None and len(rows) > most:  # so many of the group are at least as near
            least = np.maximum(least, np.partition(rough, -most, axis=1)[:, -most])
        q, b = np.nonzero(rough >= least[:, None] - SLACK)
        q, b = live[q], rows[b]
        if allowed is not None:
            ok = allowed(q, b)
            q, b = q[ok], b[ok]
        if not len(q):
            return
        sims = rounded(paired(self.block.vectors, q, v, b))
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(q)], strict=True):
            i = q[lo]
            found = [(s, ids[j]) for s, j in zip(sims[lo:hi].tolist(), b[lo:hi], strict=True) if not (self.skip_self and ids[j] == self.block.ids[i])]
            kept = sorted(self.best[i] + found, key=lambda x: (-x[0], x[1]))[: self.k]
            self.best[i] = kept
            if len(kept) == self.k:
                self.floor[i] = max(self.floor[i], kept[-1][0])

    def result(self, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.best), STEP):
            rows = [(q, i, s) for q, best in zip(self.block.ids[at : at + STEP], self.best[at : at + STEP], strict=True) for s, i in best]
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], ids), pa.array([r[2] for r in rows], pa.float64())], ["query", "neighbour", "sim"])


def neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, skip_self: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, neighbour, sim, rank): the k most similar base rows of each query by cosine, exact, the smaller id first on ties.

    Similarities are rounded to six digits before they are compared. The queries are a stated set; repeated rows
    of the base are neighbours of their own, a query that is repeated counts once. Rows without a key or
    with a vector that holds a null or no finite number take no part. Each task returns its best k of a query, less
    those that k rows of a sample beat.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    kind = base.schema[key].dataType.simpleString()
    at_least: dict[int, np.ndarray] = {}

    def prepare(block, ids, some):
        first = TopK(block, k, skip_self)
        first.add(ids, some)
        block.least = first.floor

    def task(block, batches):
        top, ids = TopK(block, k, skip_self, block.least), None
        for b in batches:
            ids = b.column("key").type
            top.add(b.column("key").to_pylist(), matrix(b))
        if ids is not None:
            yield from top.result(ids)

    found = against(queries.dropDuplicates([key]), base, {"query": key}, {"key": key}, vector, vector, _shape(queries, base, key), task, prepare, block_bytes)
    near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour"))
    return found.withColumn("rank", near).where(F.col("rank") <= k)


def _shape(queries: DataFrame, base: DataFrame, key: str) -> str:
    return f"query {queries.schema[key].dataType.simpleString()}, neighbour {base.schema[key].dataType.simpleString()}, sim double"


def _ahead(block: Block, v: np.ndarray, limit: np.ndarray, digits: int, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds to ``counts`` the rows that are more similar than a query's ``limit`` by more than the slack; pairs within
    it are returned as (q, row, similarity), for their similarity decides."""
    for rows, low, high, short in groups(v, block.pivots):
        every = np.flatnonzero(upper_bounds(block, low, high, short) >= limit - SLACK)
        for at in range(0, len(every), STEP):
            live, over = _reached(block, every[at : at + STEP], v, rows, limit)
            over -= limit[live][:, None]
            counts[live] += np.count_nonzero(over > SLACK, axis=1)
            q, b = np.nonzero(np.abs(over, out=over) <= SLACK)
            if len(q):
                q, b = live[q], rows[b]
                yield q, b, rounded(paired(block.vectors, q, v, b), digits)


def _counted(block: Block, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(counts)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array([block.ids[i] for i in some]), pa.array(counts[some], pa.int64())], ["query", "ahead"])


def _ranks(queries: DataFrame, counted: DataFrame) -> DataFrame:
    """(query, true_rank): one more than the rows ahead; ``queries`` without any have rank 1."""
    total = counted.groupBy(F.col("query").alias("__q")).agg(F.sum("ahead").alias("ahead"))
    return queries.join(total, F.col("query") == F.col("__q"), "left").select("query", (F.coalesce("ahead", F.lit(0)) + 1).alias("true_rank"))


def first_match_ranks(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, block_bytes: int = PACK_BYTES) -> DataFrame:
    """(query, true_rank): the place of the first base row with the query's label among all, by similarity.

    The queries may be all rows of the base: blocks of either side meet in tasks. The best row of the same label is found
    first, then the rows that come before it are counted; neither step ranks or keeps pairs. The smaller id is first on
    ties. Queries without a row of their label, and what ``neighbours`` leaves out, have no rank.
    """
    spark, kind = base.sparkSession, base.schema[key].dataType.simpleString()
    mine = queries.schema[key].dataType.simpleString()
    sample = _rows(base, {"key": key}, vector).limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], f"query {mine}, true_rank long")
    pivots = spread(np.array([r["v"] for r in sample]), PIVOTS)
    q = packed(queries, key, vector, label, block_bytes)
    b = q if queries is base else packed(base, key, vector, label, block_bytes)

    def labelled(block):
        at = np.flatnonzero(block.column("once")[0].values.to_numpy(zero_copy_only=False))
        labels = block.column("labels")[0].values.to_pylist()
        return at, [labels[i] for i in at]

    def best(number, block, batches):
        top = TopK(block, 1, True)
        codes = {x: i for i, x in enumerate(set(block.extra) - {None})}
        own = np.array([codes.get(x, -1) for x in block.extra])
        for r in batches:
            labels = np.array([codes.get(x, -2) for x in r.column("label").to_pylist()])
            top.add(r.column("key").to_pylist(), matrix(r), lambda i, j, labels=labels: own[i] == labels[j])
        some = [i for i, x in enumerate(top.best) if x]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(some)), pa.array(some), pa.array([top.best[i][0][0] for i in some]), pa.array([top.best[i][0][1] for i in some])], ["block", "place", "sim", "id"])

    found = crossed(q, b, pivots, f"block long, place int, sim double, id {kind}", labelled, best)
    first = found.groupBy("block", "place").agg(F.min(F.struct((-F.col("sim")).alias("far"), "id")).alias("b"))
    firsts = written(first.groupBy("block").agg(F.collect_list(F.struct("place", (-F.col("b.far")).alias("best"), F.col("b.id").alias("id"))).alias("firsts")), "best")

    def matched(block):
        at, _ = labelled(block)
        known = block.column("firsts")[0].values
        place, sim, ids = (known.field(i) for i in range(3))
        return at[place.to_numpy()], list(zip(sim.to_pylist(), ids.to_pylist(), strict=True))

    def count(number, block, batches):
        counts = np.zeros(len(block.ids), np.int64)
        limit, last = np.array([x[0] for x in block.extra]), [x[1] for x in block.extra]
        place = {x: i for i, x in enumerate(block.ids)}
        before = lambda q, r, sim: (sim > limit[q]) | np.array([s == limit[i] and ids[j] < last[i] for i, j, s in zip(q, r, sim, strict=True)], bool)
        for r in batches:
            ids, v = r.column("key").to_pylist(), matrix(r)
            for i, j, sim in _ahead(block, v, limit, 6, counts):
                np.add.at(counts, i[before(i, j, sim)], 1)
            # a row with the query's own key does not count
            own = np.array([(place[x], j) for j, x in enumerate(ids) if x in place], np.int64).reshape(-1, 2).T
            np.subtract.at(counts, own[0][before(*own, rounded(paired(block.vectors, own[0], v, own[1])))], 1)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(counts)], ["query", "ahead"])

    counted = crossed(q.join(firsts, "block"), b, pivots, f"query {mine}, ahead long", matched, count)
    return counted.groupBy("query").agg((F.sum("ahead") + 1).alias("true_rank"))


def paired_ranks(a: DataFrame, b: DataFrame, key: str, va: str, vb: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, true_rank) of the rows of ``a`` among all rows of ``b``, whose match has the same key.

    1 + the rows of ``b`` that are more similar than the match; equal ones count for the query. Called with the
    sides changed it is the other direction. ``a`` is a stated query set.
    """
    match = F.round(dot(unit(F.col(va)), unit(F.col("__mv"))), 9)
    q = written(a.join(b.select(F.col(key).alias("__k"), F.col(vb).alias("__mv")), F.col(key) == F.col("__k")).select(F.col(key).alias("query"), F.col(va).alias("qv"), match.alias("match")).where("match IS NOT NULL"), "matches")

    def count(block, batches):
        counts, limit = np.zeros(len(block.ids), np.int64), np.array([x[0] for x in block.extra])
        for r in batches:
            for i, _, sim in _ahead(block, matrix(r), limit, 9, counts):
                np.add.at(counts, i[sim > limit[i]], 1)
        yield from _counted(block, counts)

    kind = a.schema[key].dataType.simpleString()
    counted = against(q, b, {"query": "query", "match": "match"}, {"key": key}, "qv", vb, f"query {kind}, ahead long", count, block_bytes=block_bytes)
    return _ranks(q.select("query"), counted)


def contrastive_loss(a: DataFrame, b: DataFrame, key: str, va: str, vb: str, temperature: float, queries: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row: the symmetric InfoNCE loss, whose pairs have the same key.

    Every row of either side, or those that meet the condition ``queries``, is compared with all rows of the other
    side; the loss is the mean of both directions. Keys are unique on a side.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")

    def sums_of(block, batches):
        total, own = np.zeros(len(block.ids)), np.full(len(block.ids), np.nan)
        place = {k: i for i, k in enumerate(block.ids)}
        for r in batches:
            v = matrix(r)
            # Cosines are at most 1, so this shift is safe for every row.
            for at in range(0, len(v), GROUP):
                for lo in range(0, len(total), STEP):
                    total[lo : lo + STEP] += np.exp((block.vectors[lo : lo + STEP] @ v[at : at + GROUP].T - 1) / temperature).sum(1)
            for j, k in enumerate(r.column("key").to_pylist()):
                if (i := place.get(k)) is not None:
                    own[i] = sums(block.vectors[i : i + 1], v[j : j + 1])[0] / temperature
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(total), pa.array(own, from_pandas=True)], ["query", "total", "own"])

    def side(p: DataFrame, q: DataFrame, vp: str, vq: str) -> DataFrame:
        kind = p.schema[key].dataType.simpleString()
        part = against(p if queries is None else p.where(queries), q, {"query": key}, {"key": key}, vp, vq, f"query {kind}, total double, own double", sums_of, block_bytes=block_bytes)
        row = part.groupBy("query").agg((F.ln(F.sum("total")) + 1 / temperature).alias("total"), F.max("own").alias("own"))
        return row.agg(F.avg(F.col("total") - F.col("own")).alias("loss"))

    return side(a, b, va, vb).unionByName(side(b, a, vb, va)).agg(F.avg("loss").alias("loss"))


def token_similarity(queries: DataFrame, tokens: DataFrame, query: str, owner: str, vector: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, owner, sim): the largest cosine of a query with any token of each owner.

    ``queries`` are a stated set in blocks; a batch of tokens gives one value for each query and owner, and
    the largest meet in partial aggregates.
    """
    def best(block, batches):
        for r in batches:
            v, order = matrix(r), r.column("key").dictionary_encode()
            code = order.indices.to_numpy(zero_copy_only=False)
            by = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, code[by][1:] != code[by][:-1]])
            names = order.dictionary.take(pa.array(code[by][starts]))
            for i, q in enumerate(block.ids):
                x = v[by]
                sim = np.maximum.reduceat(sums(np.broadcast_to(block.vectors[i], x.shape), x), starts)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(starts)), names, pa.array(sim)], ["query", "owner", "sim"])

    shape = f"query {queries.schema[query].dataType.simpleString()}, owner {tokens.schema[owner].dataType.simpleString()}, sim double"
    found = against(queries, tokens, {"query": query}, {"key": owner}, vector, vector, shape, best, block_bytes=block_bytes)
    return found.groupBy("query", F.col("owner").alias(owner)).agg(F.max("sim").alias("sim"))
