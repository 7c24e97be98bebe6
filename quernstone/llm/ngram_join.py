"""N-gram Jaccard self-join by count-vector R-trees.

A document is its set of distinct word shingles. Shingles are hashed into groups, and the counts by
group are the document's point; two sets share at most the sum of the coordinates' minima, which an
R-tree over the points bounds from above for whole nodes by their largest coordinates.

One tree over a corpus would be one task, so points are first dealt to many small trees:

1. Equal sets are one document with copies (a partial aggregate).
2. Two sets that link differ in at most D shingles, D known from their sizes. If the shingles' hash
   space is cut into K > D blocks, the two sets are equal on K - D blocks at least. A document is
   entered under the content of each of its blocks. It needs K - D entries that others have too, else
   it has no link; and of those it keeps, in one order for all, rare entries first, all but the last
   K - D - 1: two linked documents still share one (a prefix filter, which sheds what dissimilar
   documents share, such as common passages and empty blocks). Documents under the same entry whose
   coarse points are near enough go to the same family; families are connected sets of such pairs.
3. A family is one R-tree, where pairs that pass the bound are verified on the sets themselves. Pairs
   that are connected already need no check. Of a family too large for one tree every document is first
   compared with a few pivots; what these connect into the largest part needs no check within itself.
   The rest is cut into leaves, each paired with every leaf of the family.

Every linked pair shares an entry, passes every bound and so meets in one tree: no link is lost.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import UnionFind, as_before, components, fresh, runs, sided, spread_join, written

#: Ratio of neighbouring block counts, and the least ratio of blocks to differences.
GRID = 1.5
SLACK = 1.25
#: Groups of the coarse point that is shuffled, four bits each.
COARSE = 16
#: Largest entry within which coarse points are compared; the rows of a larger one share a family.
ENTRY_ROWS = 2048
#: Shingles and documents of a tree; a family beyond either is cut into leaves of half of it.
TREE_SHINGLES = 2_000_000
TREE_DOCS = 2048
#: Documents that all others of a very large family are compared with first.
PIVOTS = 8
#: Documents whose entries a worker sends back at a time.
DIGEST_ROWS = 500
#: Documents in a node of an R-tree, and nodes in a node above.
FANOUT = 16

U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words longer than this are hashed one by one.
LONG = 64
_P = U(0x9E3779B97F4A7C15)
_LANE = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text, lower-cased A-Z and split at ASCII white space.

    A word's bytes are mixed eight at a time, each step over the result of the step before, so that no
    arithmetic structure of a word cancels out; words over LONG bytes are hashed by BLAKE2b.
    """
    folded = text.translate(_LOWER)
    b = np.frombuffer(folded, np.uint8)
    if not len(b):
        return np.empty(0, U)
    inside = np.r_[False, ~_SPACE[b], False]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = change[::2], change[1::2] - change[::2]
    lanes = np.ndarray((len(b),), "<u8", folded + bytes(8), strides=(1,))  # eight bytes from every place on
    h = mix(sizes.astype(U) * _P)
    live = np.flatnonzero(sizes <= LONG)
    for at in range(0, LONG, 8):
        live = live[sizes[live] > at]
        if not len(live):
            break
        h[live] = mix((h[live] ^ (lanes[starts[live] + at] & _LANE[np.minimum(sizes[live] - at, 8)])) * U(0x9FB21C651E98DF25) + U(at + 1))
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(folded[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    return h


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words are one shingle, none give none."""
    w = word_hashes(text or b"")
    n = len(w) - size + 1
    if not len(w):
        return w
    if n < 1:
        n, size = 1, len(w)
    h = np.full(n, size, U)
    for i in range(size):
        h = mix(h * U(0x9FB21C651E98DF25) + w[i : i + n])
    return np.unique(h)


@dataclass(frozen=True)
class Rule:
    """Two sets link when den * intersection >= num * union."""

    num: int
    den: int

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes sum to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def grids(self, n: int) -> list[tuple[int, int]]:
        """Block counts K under which a set of ``n`` shingles is entered, all that a partner may use, and
        the blocks at least on which it equals a linked set under K."""
        blocks = lambda d: int(SLACK * (d + 1)) + 1
        most = self.most_apart(n + n * self.den // self.num)
        low, high = blocks(self.most_apart(n + -(-n * self.num // self.den))), blocks(most)
        out, k = [], 2
        while True:
            if k >= low:
                out.append((k, max(1, k - most)))
            if k >= high:
                return out
            k = max(k + 1, int(k * GRID))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * common >= self.num * (len(a) + len(b) - common)


def entries(s: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, a hash of the content of each block for each block count K, and their tags.

    A tag is K and the number of entries that a linked document shares at least, as K * 2^32 + that.
    Empty blocks are entered as any others: linked sets may agree on them.
    """
    keys, tags = [], []
    for k, least in rule.grids(len(s)):
        block = ((s >> U(32)) * U(k) >> U(32)).astype(np.int64)  # s is sorted, so blocks are runs
        total = np.zeros(len(s) + 1, U)
        np.cumsum(mix(s), out=total[1:])
        edge = np.searchsorted(block, np.arange(k + 1))
        keys.append(mix((total[edge[1:]] - total[edge[:-1]]) + mix(np.arange(k, dtype=U) * U(0xD1B54A32D192ED03) + U(k))))
        tags.append(np.full(k, k << 32 | least, np.int64))
    return np.concatenate(keys).view(np.int64), np.concatenate(tags)


def point(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s & U(0xFFFF)).astype(np.int64) % groups, minlength=groups).astype(np.int32)


def coarse(s: np.ndarray) -> int:
    """The point over COARSE groups, each count kept modulo 16, as one signed 64-bit number."""
    packed = (point(s, COARSE).astype(U) & U(15)) << (np.arange(COARSE, dtype=U) * U(4))
    return int(np.bitwise_or.reduce(packed).astype(np.int64))


def coarse_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bound of the symmetric difference from two coarse points (signed 64-bit arrays)."""
    a, b = a.view(U), b.view(U)
    out = np.zeros(np.broadcast(a, b).shape, np.int64)
    for i in range(COARSE):
        d = ((a >> U(4 * i)) - (b >> U(4 * i)) & U(15)).astype(np.int64)
        out += np.minimum(d, 16 - d)
    return out


class RTree:
    """Bulk-loaded R-tree over count vectors of documents of known size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rule: Rule):
        self.rule, self.sizes = rule, sizes
        self.order = self._tiles(points)
        self.points = points[self.order]
        self.levels = []
        top, small = self.points, sizes[self.order]
        while len(top) > FANOUT:
            cut = np.arange(0, len(top), FANOUT)
            top, small = np.maximum.reduceat(top, cut), np.minimum.reduceat(small, cut)
            self.levels.append((top, small))

    @staticmethod
    def _tiles(points: np.ndarray) -> np.ndarray:
        """Order in tiles: by size first, then by the widest coordinates within each slab."""
        if len(points) <= FANOUT:
            return np.arange(len(points))
        wide = np.argsort(-points.var(axis=0))[:2]
        order = np.argsort(points.sum(axis=1), kind="stable")
        slabs = max(1, int(np.ceil(np.sqrt(len(points) / FANOUT))))
        out = [s[np.lexsort((points[s, wide[-1]], points[s, wide[0]]))] for s in np.array_split(order, slabs)]
        return np.concatenate(out)

    def _needed(self, n: int, others: np.ndarray) -> np.ndarray:
        """Smallest intersection of a set of ``n`` with sets of these sizes that makes a link."""
        return -(-(self.rule.num * (n + others)) // (self.rule.num + self.rule.den))

    def search(self, p: np.ndarray, n: int) -> np.ndarray:
        """Documents whose bound on the intersection with ``p`` reaches what a link needs."""
        at = None
        for top, small in reversed(self.levels):
            at = np.arange(len(top)) if at is None else (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < len(top)]
            at = at[np.minimum(top[at], p).sum(axis=1) >= self._needed(n, small[at])]
        at = np.arange(len(self.points)) if at is None else (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        at = at[at < len(self.points)]
        found = self.order[at]
        return found[np.minimum(self.points[at], p).sum(axis=1) >= self._needed(n, self.sizes[found])]


def groups_for(n: int) -> int:
    """Coordinates of the points of a tree whose sets have about ``n`` shingles."""
    return int(min(1024, max(32, 1 << int(np.ceil(np.log2(max(n, 2) / 2))))))


def link_tree(ids: np.ndarray, sets: list[np.ndarray], rule: Rule, left: np.ndarray | None = None) -> UnionFind:
    """Links among documents by an R-tree, as disjoint sets of ids.

    ``left`` marks the documents of the first of two leaves: then only pairs across the leaves count.
    """
    uf = UnionFind()
    sizes = np.asarray([len(s) for s in sets], np.int64)
    live = np.flatnonzero(sizes)
    if len(live) < 2:
        return uf
    width = groups_for(int(np.median(sizes[live])))
    points = np.stack([point(sets[i], width) for i in live])
    inside = live if left is None else live[left[live]]
    if not len(inside):
        return uf
    tree = RTree(points[np.isin(live, inside)], sizes[inside], rule)
    for row, i in enumerate(live):
        if left is not None and left[i]:
            continue
        for j in inside[tree.search(points[row], int(sizes[i]))].tolist():
            if (j < i or left is not None) and uf.find(ids[i]) != uf.find(ids[j]) and rule.linked(sets[i], sets[j]):
                uf.union(ids[i], ids[j])
    return uf


def _digests(docs: DataFrame, size: int, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """(doc, n, s1, s2, point, keys, tags): set size, 128-bit digest of the set, coarse point and entries."""

    def read(batches):
        for b in batches:
            for at in range(0, len(b), DIGEST_ROWS):
                part, rows = b.iloc[at : at + DIGEST_ROWS], []
                for cell in part["data"]:
                    s = shingles(bytes(cell) if cell is not None else None, size)
                    sig = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                    rows.append((len(s), sig[0], sig[1], coarse(s), *entries(s, rule)))
                n, s1, s2, p, keys, tags = zip(*rows)
                yield pd.DataFrame({"doc": part["doc"].reset_index(drop=True), "n": n, "s1": s1, "s2": s2, "point": p, "keys": keys, "tags": tags})

    found = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).cast("binary").alias("data")).mapInPandas(read, "doc string, n long, s1 long, s2 long, point long, keys array<long>, tags array<long>")
    return as_before(found, {"doc": "long"})


def _near(rows: pd.DataFrame, rule: Rule, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows of each entry whose coarse points allow a link.

    ``rows`` is sorted by key. ``whole`` marks the entries (by run) whose rows all share a family.
    """
    key, doc, n, p = (rows[c].to_numpy(np.int64) for c in ("key", "doc", "n", "point"))
    starts, sizes = runs(key)
    first = np.repeat(starts, sizes)
    limit = (n + n[first]) * (rule.den - rule.num) // (rule.den + rule.num)
    near = coarse_apart(p, p[first]) <= limit
    all_of = np.repeat(whole | (sizes > ENTRY_ROWS), sizes)
    star = (near | all_of) & (np.arange(len(key)) != first)
    u, v = [doc[star]], [doc[first[star]]]
    missed = np.flatnonzero(np.add.reduceat(~(near | all_of), starts)) if len(starts) else []
    for r in missed:
        a, m = starts[r], sizes[r]
        if m < 3:
            continue
        label = np.where(near[a : a + m], 0, np.arange(m))
        for i in np.flatnonzero(~near[a : a + m]).tolist():  # those not near the first row may be near any other
            d = coarse_apart(p[a + i : a + i + 1], p[a : a + m])
            ok = d <= (n[a + i] + n[a : a + m]) * (rule.den - rule.num) // (rule.den + rule.num)
            met = np.unique(label[ok & (label != label[i])])
            if len(met):
                u.append(np.full(len(met), doc[a + i]))
                v.append(doc[a + met])
                label[np.isin(label, met)] = label[i]
                low = min(int(met[0]), int(label[i]))
                label[label == label[i]] = low
    return np.concatenate(u), np.concatenate(v)


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct edges of these that connect as much as all do."""
    if not len(u):
        return u, v
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    uf = UnionFind()
    keep = [i for i, (a, b) in enumerate(pairs.tolist()) if uf.union(a, b)]
    return pairs[keep, 0], pairs[keep, 1]


def _shared_entries(digests: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, doc, tag, c) of the entries that c >= 2 documents have.

    One range shuffle, whose bounds hold the document beside the key, so that an entry of very many
    documents is dealt to many tasks; a task streams its sorted rows and holds one run of equal keys'
    count and start. Counts of runs that touch a task's ends are summed over the tasks.
    """
    rows = digests.join(sided(reps), digests.doc == F.col("rep"), "left_semi").select(F.explode(F.arrays_zip("keys", "tags")).alias("e"), "doc").select("e.keys", "doc", "e.tags")

    def count(batches):
        held, first = None, True  # rows of the last run, not yet counted to its end
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            starts, sizes = runs(b["keys"].to_numpy(np.int64))
            if len(starts) == 1 and len(b) > 64 * ENTRY_ROWS:  # one entry wider than a batch: pass on in parts
                yield b.assign(c=len(b), seam=True)
                held, first = None, True
                continue
            cut = int(starts[-1])
            c = np.repeat(sizes, sizes)[:cut]
            seam = np.zeros(cut, bool)
            if first and cut:
                seam[: sizes[0]] = True
                first = False
            keep = (c > 1) | seam
            yield b.iloc[:cut][keep].assign(c=c[keep], seam=seam[keep])
            held = b.iloc[cut:]
        if held is not None and len(held):
            yield held.assign(c=len(held), seam=True)

    ranged = rows.repartitionByRange("keys", "doc").sortWithinPartitions("keys", "doc")
    found = written(ranged.mapInPandas(count, "keys long, doc long, tags long, c long, seam boolean"), "entries")
    seams = found.where("seam").groupBy(F.col("keys").alias("at")).agg(F.count(F.lit(1)).alias("total"))
    whole = found.join(sided(written(seams, "seams")), F.col("seam") & (F.col("keys") == F.col("at")), "left")
    return whole.select(F.col("keys").alias("key"), "doc", F.col("tags").alias("tag"), F.coalesce("total", "c").alias("c")).where("c > 1")


def _families(digests: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """(node, component): documents that may be connected by links, with their family."""
    own = Window.partitionBy("doc", "tag")
    ranked = _shared_entries(digests, reps).withColumns({"r": F.row_number().over(own.orderBy("c", "key")), "w": F.count(F.lit(1)).over(own)})
    kept = ranked.where(F.col("r") <= F.col("w") - (F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF))) + 1).select("key", F.col("doc").alias("at"))
    points = written(digests.where("n > 0").join(sided(reps), digests.doc == F.col("rep"), "left_semi").groupBy("doc").agg(F.max("n").alias("n"), F.max("point").alias("point")), "points")
    rows = written(kept, "prefixes").join(sided(points), F.col("at") == F.col("doc")).select("key", "doc", "n", "point")

    def connect(batches):
        held, first, seam = None, True, False  # seam: rows of the entry that ``held`` begins with were connected before
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            last = held["key"].iloc[-1]
            cut = int(np.searchsorted(held["key"].to_numpy(), last))
            if cut == 0:
                if len(held) > 64 * ENTRY_ROWS:  # one entry, wider than a batch: connect what is here, keep one row
                    yield edges(held, np.array([True]), head=first)
                    held, first, seam = held.iloc[:1], False, True
                continue
            done = held.iloc[:cut]
            whole = np.zeros(done["key"].nunique(), bool)
            whole[0] = first or seam
            yield edges(done, whole, head=first)
            held, first, seam = held.iloc[cut:], False, False
        if held is not None and len(held):
            yield edges(held, np.array([True]), head=True)

    def edges(rows: pd.DataFrame, whole: np.ndarray, head: bool) -> pd.DataFrame:
        u, v = _spanning(*_near(rows, rule, whole))
        out = pd.DataFrame({"u": u, "v": v, "seam": pd.array([None] * len(u), "Int64")})
        if head:  # the entry may go on in a neighbouring task
            mark = pd.DataFrame({"u": [rows["doc"].iloc[0]], "v": [rows["doc"].iloc[0]], "seam": pd.array([rows["key"].iloc[0]], "Int64")})
            out = pd.concat([out, mark], ignore_index=True)
        return out

    ranged = rows.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc")
    found = written(ranged.mapInPandas(connect, "u long, v long, seam long"), "near")
    seams = found.where("seam IS NOT NULL").select("seam", "u")
    ties = seams.join(seams.groupBy("seam").agg(F.min("u").alias("v")), "seam").select("u", "v")
    return components(found.where("seam IS NULL").select("u", "v").union(ties))


def _leaf_counts() -> tuple:
    """Whether (docs, shingles) fit one tree, and the leaves that they are cut into."""
    many = F.greatest(F.ceil(F.col("shingles") * 2 / TREE_SHINGLES), F.ceil(F.col("docs") * 2 / TREE_DOCS)).cast("int")
    return (F.col("shingles") <= TREE_SHINGLES) & (F.col("docs") <= TREE_DOCS), many


def _leaves(families: DataFrame, sized: DataFrame, data: DataFrame, rule: Rule, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc, family, leaf, upto), where a document meets the leaves below ``upto``, and links found on the way.

    Families too large for one tree are cut into leaves; those of the part that pivots connect stand
    behind the others and meet only them.
    """
    members = families.join(sized.select(F.col("doc").alias("node"), "n"), "node")
    counts = members.groupBy("component").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    fits, many = _leaf_counts()
    total = written(counts.select("component", fits.alias("fits"), many.alias("many")), "families")
    small = families.join(sided(total.where("fits").select("component")), "component").select(F.col("node").alias("doc"), F.col("component").alias("family"), F.lit(0).alias("leaf"), F.lit(1).alias("upto"))
    large = total.where("NOT fits").select("component", "many")
    if large.isEmpty():
        return written(small, "leaves"), families.sparkSession.createDataFrame([], "u long, v long")
    inside = written(members.join(sided(large), "component").select(F.col("node").alias("doc"), F.col("component").alias("family"), "n", "many"), "members")
    links = written(_pivot_links(inside, data, rule, size), "pivot-links")
    labelled = inside.join(components(links), F.col("doc") == F.col("node"), "left").select("doc", "family", "n", F.coalesce("component", "doc").alias("part"))
    parts = labelled.groupBy("family", "part").agg(F.count(F.lit(1)).alias("docs"))
    main = parts.groupBy("family").agg(F.min_by("part", F.struct(-F.col("docs"), F.col("part"))).alias("main"))
    cut = written(labelled.join(sided(written(main, "main")), "family").select("doc", "family", "n", (F.col("part") == F.col("main")).alias("settled")), "cut")
    sides = cut.groupBy("family", "settled").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("docs")).withColumn("many", many)
    leaves = sides.groupBy("family").agg(F.coalesce(F.max(F.when(~F.col("settled"), F.col("many"))), F.lit(0)).alias("open"), F.coalesce(F.max(F.when(F.col("settled"), F.col("many"))), F.lit(0)).alias("closed"))
    h = F.xxhash64("doc")
    placed = cut.join(sided(written(leaves, "cuts")), "family").select(
        "doc", "family",
        F.when(F.col("settled"), F.col("open") + F.pmod(h, F.greatest("closed", F.lit(1)))).otherwise(F.pmod(h, F.greatest("open", F.lit(1)))).cast("int").alias("leaf"),
        F.when(F.col("settled"), F.col("open")).otherwise(F.col("open") + F.col("closed")).alias("upto"),
    )
    return written(small.unionByName(placed.where("upto > 0")), "leaves"), links


def _pivot_links(inside: DataFrame, data: DataFrame, rule: Rule, size: int) -> DataFrame:
    """(u, v): links of the documents of large families with their family's pivots.

    ``inside`` has doc, family and many, the parts that a family is dealt to; each part's rows come
    after a copy of the pivots, so a task holds the pivots and one batch.
    """
    picks = F.array_distinct(F.array(*[F.min_by("doc", F.struct(F.xxhash64("doc", F.lit(i)), F.col("doc"))) for i in range(PIVOTS)]))
    picked = inside.groupBy("family").agg(picks.alias("picks"), F.max("many").alias("many")).select("family", "many", F.explode("picks").alias("doc"))
    pivots = picked.select("family", "doc", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("part"), F.lit(0).alias("kind"))
    rows = inside.select("family", "doc", F.pmod(F.xxhash64("doc"), F.col("many")).cast("int").alias("part"), F.lit(1).alias("kind"))
    dealt = data.join(sided(written(pivots.unionByName(rows), "pivots")), "doc").select("family", "part", "kind", "doc", "data")

    def compare(batches):
        family, held = None, []
        for b in batches:
            u, v = [], []
            for f, p, kind, doc, cell in zip(b["family"], b["part"], b["kind"], b["doc"], b["data"]):
                if (f, p) != family:
                    family, held = (f, p), []
                s = shingles(bytes(cell) if cell is not None else None, size)
                if kind == 0:
                    held.append((doc, s))
                    continue
                for pivot, t in held:
                    if pivot != doc and rule.linked(s, t):
                        u.append(doc), v.append(pivot)
            yield pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return dealt.repartition("family", "part").sortWithinPartitions("family", "part", "kind", "doc").mapInPandas(compare, "u long, v long")


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are runs of characters other than ASCII white space, lower-cased A-Z. The set of a document
    holds its distinct ``size``-word shingles; with fewer words the whole sequence is the one shingle;
    a text without words, or null, has the empty set and is linked with nothing, not even its likes.
    Documents link when ``den`` * intersection >= ``num`` * union; component_id is the smallest doc_id
    reachable by links. Repeated rows keep a row each; rows that share a doc_id are one node; a null
    doc_id takes no part and has a null component. Ids are whole numbers; of another type they are an error. Empty tables give empty results; other columns are
    not read, whatever their names. Shingles are compared by 64-bit hashes. A very long text is one
    sorted array of eight bytes a shingle in its task.
    """
    if docs.schema[doc_id].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{doc_id} is {docs.schema[doc_id].dataType.simpleString()}; ids have to be whole numbers: number the rows, and join back")
    rule = Rule(num, den)
    digests = written(_digests(docs, size, rule, doc_id, text), "sets")
    reps = written(digests.where("n > 0 AND doc IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct-sets")
    one = written(reps.select("rep").distinct(), "representatives")
    families = _families(digests, one, rule)
    sized = digests.where("n > 0").join(sided(one), digests.doc == F.col("rep"), "left_semi").groupBy("doc").agg(F.max("n").alias("n"))
    data = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("data"))
    placed, early = _leaves(families, sized, data, rule, size)
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("upto") - 1), lambda k: F.struct(F.least("leaf", k).alias("a"), F.greatest("leaf", k).alias("b")))).alias("pair")
    dealt = data.join(sided(placed), "doc").select("family", "doc", "leaf", pairs, "data").select("family", "pair.a", "pair.b", "leaf", "doc", "data")

    def trees(batches):
        def link(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["doc"].tolist()
            sets = [shingles(bytes(x) if x is not None else None, size) for x in rows["data"]]
            a, b = rows["a"].iloc[0], rows["b"].iloc[0]
            uf = link_tree(ids, sets, rule, None if a == b else (rows["leaf"] == a).to_numpy())
            got = [(i, r) for i in dict.fromkeys(ids) if (r := uf.find(i)) != i]
            return pd.DataFrame(got, columns=["u", "v"]).astype("int64")

        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            at = held[["family", "a", "b"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
            for i, j in zip(starts[:-1], starts[1:]):
                yield link(held.iloc[i:j])
            held = held.iloc[starts[-1] :]
        if held is not None and len(held):
            yield link(held)

    dealt = dealt.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b", "doc")
    links = written(dealt.mapInPandas(trees, "u long, v long"), "links")
    found = components(links.unionByName(early))
    # Sets of one document without links are their own component and need no join back.
    joined = reps.join(found, F.col("rep") == F.col("node"), "left").where("copies > 1 OR component <> rep")
    own = written(joined.select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), F.coalesce("component", "rep").alias("component")), "classes")
    rows = spread_join(digests.select("doc", "n", "s1", "s2"), "doc", own, {"s1": "r1", "s2": "r2"})
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def one_per_component(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, all columns kept.

    Rows that repeat a kept doc_id stay, as do rows with a null doc_id and texts without words; an empty
    table stays empty; extra columns keep their names and values.
    """
    (gone,) = fresh(docs, "gone")
    out = jaccard_components(docs, size, num, den, doc_id, text).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(sided(written(out, "gone")), F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
