"""Merkle manifest of a table: digest-to-children records, and proofs by descent from the root.

Rows are leaves. The leaves of one group, in the order of a key, are hashed in runs until one node, the
group's subroot, is left; the subroots, in the order of the group, likewise give the root. What is stored
of the tree is content-addressed: a record is a digest and the digests it was made from.

A proof starts at the root. The digits of a leaf's place, most significant first, say which child of a
record comes next; the children that are not taken are the siblings of that level. Leaves that share a
prefix of digits share the descent, so a level costs as many rows as it has nodes that are asked for. The
path is collected from the root downwards and reversed, which gives the order that folding needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import sided, written

FANOUT = 8


def h(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value; integers in decimal."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*values: Column) -> Column:
    """The digest of one row: each value encoded so that no two rows have the same concatenation."""
    return h(*[encoded(v) for v in values])


@dataclass
class Manifest:
    """A committed table.

    ``leaves``: tree, rank (place in its tree), n (leaves of the tree), leaf, key and what was kept beside
    them. ``trees``: tree, place among the trees, subroot and its height. ``records`` and ``upper``: tables
    with digest and children for each level of the trees and of the tree of subroots, lowest first.
    ``root`` is None for an empty table.
    """

    leaves: DataFrame
    trees: DataFrame
    records: list[DataFrame]
    upper: list[DataFrame]
    root: str | None
    fanout: int

    def store(self) -> DataFrame:
        """All records once: digest, children."""
        spark = self.leaves.sparkSession
        out = spark.createDataFrame([], "digest string, children array<string>")
        for r in [*self.records, *self.upper]:
            out = out.union(r.select("digest", "children"))
        return out.dropDuplicates(["digest"])


def _ranked(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` of a written table with rank, 0-based inside the column tree by ``order``, and n, the rows of the tree.

    One range shuffle; a row number ends the sort key, so equal rows are dealt to many tasks. Ranks come
    from the first row number and the count of each (task, tree), so no window is longer than the tasks.
    """
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    keys = ["tree", *order, "spread"]
    placed = written(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), tag)
    by_part = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy("tree")
    offsets = by_part.select("tree", "part", "first", (F.sum("held").over(w.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(w).alias("n"))
    offsets = written(offsets, f"{tag}-offsets")
    return placed.join(sided(offsets), ["tree", "part"]).withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _grow(nodes: DataFrame, fanout: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level above ``nodes`` (tree, rank, n, digest), and the trees' last nodes with their heights."""
    most, records, tops = nodes.agg(F.max("n")).first()[0] or 0, [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", "digest", F.lit(len(records)).alias("height")))
        if most <= 1:
            break
        run = nodes.where("n > 1").groupBy("tree", F.expr(f"rank div {fanout}").alias("run")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("members"))
        children = F.col("members.digest")
        nodes = written(run.select("tree", F.col("run").alias("rank"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), children.alias("children"), h(F.array_join(children, "")).alias("digest")), f"{tag}-{len(records)}")
        records.append(nodes)
        most = -(-most // fanout)
    found = tops[0]
    for t in tops[1:]:
        found = found.union(t)
    return records, found


def commit(rows: DataFrame, leaf: Column, key: str = "doc_id", group: str = "lang", keep: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """Hash ``rows`` into a manifest.

    ``leaf`` is each row's digest; ``keep`` names narrow columns that stay beside it. Groups are ordered
    bytewise, null first; rows inside a group by ``key``, null first, and rows with the same key by their
    digest, so repeated rows are leaves of their own and the root does not depend on the order of the
    input. Other columns, whatever their names, are not read. An empty table has no root.

    The rows are read once; ranks and levels then use digests only. A level is one shuffle of runs of
    ``fanout`` nodes, whatever the size of a group, and a written table.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    digests = written(rows.select(tree.alias("tree"), F.col(key).alias("key"), leaf.alias("leaf"), *[c.alias(f"keep_{n}") for n, c in (keep or {}).items()]), "leaves")
    leaves = written(_ranked(digests, ["key", "leaf"], "ranked"), "leaves")
    records, tops = _grow(leaves.select("tree", "rank", "n", F.col("leaf").alias("digest")), fanout, "level")
    tops = written(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "height"), "tops")
    placed = written(_ranked(tops, ["name"], "trees"), "trees")
    upper, root = _grow(placed.select("tree", "rank", "n", "digest"), fanout, "upper")
    first = root.first()
    trees = placed.select(F.col("name").alias("tree"), F.col("rank").alias("place"), F.col("digest").alias("subroot"), "height")
    return Manifest(leaves, trees, records, upper, first and first["digest"], fanout)


def _step(child: Column, children: Column) -> Column:
    """What stands left and right of the 0-based ``child``."""
    at = child.cast("int")
    return F.struct(F.slice(children, F.lit(1), at).alias("left"), F.slice(children, at + 2, F.size(children)).alias("right"))


def _descend(frontier: DataFrame, records: DataFrame, fanout: int, wanted: DataFrame | None) -> DataFrame:
    """One level down: ``frontier`` (tree, rank, digest, path) to the children that ``wanted`` (tree, rank) asks for."""
    once = records.groupBy("digest").agg(F.first("children").alias("children"))
    below = frontier.join(once, "digest").select("tree", "rank", "path", "children", F.posexplode("children").alias("digit", "digest"))
    below = below.select("tree", (F.col("rank") * fanout + F.col("digit")).alias("rank"), "digest", F.array_append("path", _step(F.col("digit"), F.col("children"))).alias("path"))
    return below if wanted is None else below.join(wanted, ["tree", "rank"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The columns of the leaves with subroot and ``steps``, the siblings of every level, from the leaf's run to the root.

    A step has the digests left and right of the path. ``requests`` has tree and rank of the leaves that are
    asked for; without it all are. Only records on the way to a leaf that is asked for are followed.
    """
    m, spark = manifest, manifest.leaves.sparkSession
    path = F.array().cast("array<struct<left:array<string>,right:array<string>>>")
    frontier = spark.createDataFrame([("", 0, m.root)] if m.root else [], "tree string, rank long, digest string").withColumn("path", path)
    for records in reversed(m.upper):
        frontier = _descend(frontier, records, m.fanout, None)
    at_subroot = written(m.trees.join(frontier.select(F.col("rank").alias("place"), F.col("path")), "place"), "subroots")
    asked = m.leaves if requests is None else m.leaves.join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")
    wanted: list[DataFrame | None] = [None] * len(m.records)
    if requests is not None:
        level = asked.select("tree", "rank")
        for k in range(len(m.records)):
            wanted[k] = level = written(level.select("tree", F.expr(f"rank div {m.fanout}").alias("rank")).distinct(), "wanted")

    def starts(height: int) -> DataFrame:
        return at_subroot.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("rank"), F.col("subroot").alias("digest"), "path")

    frontier = starts(len(m.records))
    for k in range(len(m.records) - 1, 0, -1):
        # nodes of height k + 1 are described by records[k]; their children have height k and are wanted[k - 1]
        frontier = _descend(frontier, m.records[k], m.fanout, wanted[k - 1]).unionByName(starts(k))
    columns = m.leaves.columns
    runs = asked.groupBy("tree", F.expr(f"rank div {m.fanout}").alias("run")).agg(F.collect_list(F.struct(*columns)).alias("asked"))
    alone = asked.where("n = 1").join(starts(0).select("tree", "path"), "tree").select(*columns, "path")
    if not m.records:
        last = alone
    else:
        once = m.records[0].groupBy("digest").agg(F.first("children").alias("children"))
        ends = frontier.join(once, "digest").select("tree", F.col("rank").alias("run"), "path", "children").join(runs, ["tree", "run"])
        ends = ends.select("path", "children", F.explode("asked").alias("row")).select("row.*", "path", "children")
        ends = ends.select(*columns, F.array_append("path", _step(F.col("rank") % m.fanout, F.col("children"))).alias("path"))
        last = ends.unionByName(alone)
    small = at_subroot.select("tree", "subroot")
    return last.join(sided(small), "tree").select(*columns, "subroot", F.reverse("path").alias("steps"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``steps``."""
    return F.aggregate(steps, leaf, lambda node, s: h(F.array_join(s["left"], ""), node, F.array_join(s["right"], "")))


def siblings(steps: Column) -> Column:
    """The digests of ``steps`` from the leaf upwards, left to right."""
    return F.flatten(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


def audit(docs: DataFrame) -> DataFrame:
    """Every document's place in the manifest, and whether a copy of it, changed or not, still gives the root.

    The copy of a document whose unsigned crc32 of the decimal doc_id is divisible by 3 has the letters A-Z
    of its text in lower case; a null text stays, and so does a document without an id. ``verified`` is
    false where that changed the text. Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and
    verified; a repeated row is a leaf, and a row of the result, of its own.
    """
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = leaf_digest(*row)
    m = commit(docs, leaf, keep={"shown": F.when(tampered & (lower != F.col("text")), leaf_digest(*row[:-1], lower))})
    shown = F.coalesce("keep_shown", "leaf")
    proven = prove(m).select("key", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), h(F.array_join(siblings(F.col("steps")), "")).alias("proof_sha256"), folded(shown, F.col("steps")).alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", "doc_id")
