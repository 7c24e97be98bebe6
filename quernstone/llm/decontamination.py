"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet of the search is words, not bytes: a pattern is a window of consecutive benchmark words.
For each pattern length there is a shift table over blocks of two words. A block that no pattern holds
lets the scan skip a whole window less one word, a block inside patterns skips to its last place in any
of them, and a block that ends patterns selects a bucket of test strings by a hash of the window, which
are then compared word by word. Words are numbers, and the tables are sorted arrays.
"""

from __future__ import annotations

import uuid
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import as_before, as_text, written

#: Bytes of benchmark text that one pass broadcasts; a larger benchmark takes several passes. The tables
#: take about 12 times as much in a Python worker and 32 times while they are built: under 400 MB.
BLOCK_BYTES = 12 << 20
#: A-Z to lower case; other ASCII bytes that belong to no word to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: runs of digits, letters a to z and non-ASCII characters."""
    return bytes(text).translate(FOLD).split() if text is not None else []


MIX = np.uint64(0x9E3779B97F4A7C15)


def _block_keys(ids: np.ndarray, block: int) -> np.ndarray:
    """A number for each ``block`` neighbouring words, one or two."""
    wide = ids.astype(np.int64)
    return wide if block == 1 else (wide[:-1] << 32) | wide[1:]


def _window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` neighbouring words."""
    n = len(ids) - length + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(length if n > 0 else 0):
        h = (h ^ ids[i : i + n].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


class WuManber:
    """Search for word windows of one length; words are numbers, unknown ones -1.

    ``text`` holds the items' words, ``starts`` the windows' places in it and ``owners`` their items.
    """

    def __init__(self, length: int, text: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.length, self.block, self.text = length, min(2, length), text
        ends = length - self.block + 1  # blocks of a window
        keys = _block_keys(text, self.block)
        # A block's shift is that of its last place in any window: the windows are slices of the text.
        found, shift = [], []
        for end in range(ends):
            k = np.unique(keys[starts + end])
            found.append(k), shift.append(np.full(len(k), ends - 1 - end, np.int16))
        keys_all, shifts = np.concatenate(found), np.concatenate(shift)
        order = np.lexsort((shifts, keys_all))
        keys_all, shifts = keys_all[order], shifts[order]
        first = np.r_[True, keys_all[1:] != keys_all[:-1]]
        self.keys, self.shift = keys_all[first], shifts[first]
        # Test strings by (last block, hash of the window).
        h = _window_hashes(text, length)[starts]
        last = keys[starts + ends - 1]
        order = np.lexsort((owners, h, last))
        self.starts, self.owners, self.hashes = starts[order].astype(np.int64), owners[order], h[order]
        self.low = np.searchsorted(last[order], self.keys, "left")
        self.high = np.searchsorted(last[order], self.keys, "right")

    def search(self, ids: np.ndarray):
        """(start, owners) of every occurrence."""
        m, n = self.length, len(ids)
        if n < m:
            return
        keys = _block_keys(ids, self.block)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        steps = np.where(self.keys[at] == keys, self.shift[at], m - self.block + 1)
        if steps.all():
            return
        jump, i, end = steps.tolist(), m - self.block, n - self.block + 1  # i is the place of a window's last block
        hashes = None
        while i < end:
            if jump[i]:
                i += jump[i]
                continue
            hashes = _window_hashes(ids, m) if hashes is None else hashes
            start, row = i + self.block - m, at[i]
            lo, hi = self.low[row], self.high[row]
            a = lo + np.searchsorted(self.hashes[lo:hi], hashes[start], "left")
            b = lo + np.searchsorted(self.hashes[lo:hi], hashes[start], "right")
            window = ids[start : start + m]
            owners = [self.owners[k] for k in range(a, b) if np.array_equal(self.text[self.starts[k] : self.starts[k] + m], window)]
            if owners:
                yield start, owners
            i += 1


class Patterns:
    """All windows of some benchmark items, ready to search; an item of few words is one window."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        place, number = {item: i for i, item in enumerate(self.items)}, self.vocabulary.setdefault
        texts, rows, at = [], {}, 0
        for item, text in items:
            w = words(text)
            size = min(window, len(w))
            if size:
                texts.append(np.fromiter((number(x, len(self.vocabulary)) for x in w), np.int32, len(w)))
                rows.setdefault(size, []).append((at, len(w) - size + 1, place[item]))
                at += len(w)
        text = np.concatenate(texts) if texts else np.empty(0, np.int32)
        self.searches = []
        for size, found in sorted(rows.items()):
            starts = np.concatenate([np.arange(a, a + n, dtype=np.int64) for a, n, _ in found])
            owners = np.concatenate([np.full(n, owner, np.int32) for _, n, owner in found])
            self.searches.append(WuManber(size, text, starts, owners))

    def numbers(self, text: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, text, repeat(-1)), np.int64, len(text))

    def found(self, text: list[bytes]) -> bool:
        """Whether any window occurs."""
        ids = self.numbers(text)
        return next(chain.from_iterable(s.search(ids) for s in self.searches), None) is not None

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans [start, end) inside any occurrence, and the items that occur."""
        spans, items, ids = [], set(), self.numbers(text)
        for s in self.searches:
            for start, owners in s.search(ids):
                spans.append((start, start + s.length))
                items.update(owners)
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged], {self.items[i] for i in items}


_READY: dict = {}


def patterns(name: str, shared, window: int) -> Patterns:
    """The tables of broadcast items, built once in a Python worker and kept for its next tasks."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Patterns(shared.value, window)
    return _READY[name]


def _scan(docs: DataFrame, items: list[tuple], window: int, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    shared, name = sc.broadcast(items), uuid.uuid4().hex
    fields = [docs.schema[c] for c in dict.fromkeys([doc_id, *keep])]

    def scan(batches):
        find = patterns(name, shared, window).hits
        for b in batches:
            n, spans, ids = [], [], []
            for cell in b["__data"]:
                w = words(cell)
                got, found = find(w)
                n.append(len(w))
                spans.append([x for s in got for x in s])
                ids.append(sorted(found))
            yield b.drop(columns="__data").assign(__n=n, __spans=spans, __items=ids)

    schema = ", ".join(f"`{f.name}` string" for f in fields) + ", __n long, __spans array<long>, __items array<string>"
    found = docs.select(*as_text(docs, *[f.name for f in fields]), F.col(text).cast("binary").alias("__data")).mapInPandas(scan, schema)
    return as_before(found, {f.name: f.dataType for f in fields})


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about ``limit`` bytes at most, by hash; one item is never cut."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("data")).where(F.col("item").isNotNull())
    total = items.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = -(-2 * total // limit) if total > limit else 1
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, items that occur, hit word spans, contaminated.

    A window is ``window`` consecutive item words, an item of fewer words but some is one window; a
    document word inside any occurrence of a window is hit. Words are lower-cased A-Z and split at
    ASCII characters that are neither letters nor digits. Null or empty texts have no words and no
    hits; items without words or id never occur; rows that repeat an item_id are one item with all
    their windows; repeated documents give repeated rows; an empty benchmark leaves all clean.

    The benchmark is broadcast only up to ``block_bytes``, which its summed size is checked against; a
    larger one is searched in blocks, one pass over the documents each, whose hits are merged by row.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        found = _scan(docs, [tuple(r) for r in blocks[0].collect()], window, doc_id, text, [])
    else:
        rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("__row", F.monotonically_increasing_id()), "documents")
        parts = [written(_scan(rows, [tuple(r) for r in b.collect()], window, "doc_id", "text", ["__row"]), "hits") for b in blocks]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("__row").agg(F.first("doc_id").alias(doc_id), F.first("__n").alias("__n"), F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    return _merged(found, doc_id) if len(blocks) > 1 else _finish(found, doc_id)


def _finish(found: DataFrame, doc_id: str) -> DataFrame:
    hit = F.aggregate(F.transform("__spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col(doc_id).alias("doc_id"), F.col("__n").alias("n_words"), hit.alias("n_hit"), F.col("__items").alias("items"), F.col("__spans").alias("spans"), (F.size("__spans") > 0).alias("contaminated"))


def _merged(found: DataFrame, doc_id: str) -> DataFrame:
    @F.pandas_udf("array<long>")
    def merge(column: pd.Series) -> pd.Series:
        out = []
        for flat in column:
            pairs = sorted(np.asarray(flat, dtype=np.int64).reshape(-1, 2).tolist())
            merged: list[int] = []
            for a, b in pairs:
                if merged and a <= merged[-1]:
                    merged[-1] = max(b, merged[-1])
                else:
                    merged += [a, b]
            out.append(merged)
        return pd.Series(out)

    return _finish(found.withColumn("__spans", merge("__spans")), doc_id)


def digest(found: DataFrame) -> DataFrame:
    """The columns that a report compares: items as a count and a hash of their sorted ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns kept, without a shuffle.

    Rows with null or empty texts stay, as do repeated rows and null ids; an empty table stays empty, and
    an empty benchmark leaves all rows; extra columns keep their names and values. A benchmark over
    BLOCK_BYTES is searched block by block, each pass over the rows the last one kept.
    """
    for block in _blocks(benchmark, "item_id", "text", BLOCK_BYTES):
        names = docs.columns
        mark = _marker(docs, [tuple(r) for r in block.collect()], window)
        docs = docs.where(~mark(F.col(text).cast("binary"))).select(*[F.col(f"`{n}`") for n in names])
    return docs


def _marker(docs: DataFrame, items: list[tuple], window: int):
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def hit(column: pd.Series) -> pd.Series:
        found = patterns(name, shared, window).found
        return pd.Series([found(words(cell)) for cell in column], dtype=bool)

    return hit
