"""Lexicons of any size: all patterns are found in one pass over a text, by an automaton that every task builds once.

The lexicon is a table. Its patterns are sent to the tasks in blocks of counted size; the plan does not grow with
them, and a text is read once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.text import Lexicon, clauses, location, nearest_entity
from quernstone.session import ship_package

#: Bytes of patterns that are sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
_BUILT: dict = {}


class Automaton:
    """Patterns with the (kind, canonical) pairs that each stands for."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.patterns: dict[str, list[tuple[int, str]]] = {}
        for kind, canonical, pattern in rows:
            self.patterns.setdefault(pattern, []).append((kind, canonical))
        self.machine = ahocorasick.Automaton()
        for pattern, named in self.patterns.items():
            self.machine.add_word(pattern, (pattern, named))
        if self.patterns:
            self.machine.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, str, list[tuple[int, str]]]]:
        """(1-based start, pattern, its names) of occurrences; those of one pattern do not overlap, the first counts."""
        if not self.patterns or not text:
            return
        free: dict[str, int] = {}
        for end, (pattern, named) in self.machine.iter(text):
            start = end + 1 - len(pattern)
            if start >= free.get(pattern, 0):
                free[pattern] = end + 1
                yield start + 1, pattern, named


def blocks(lexicon: DataFrame, canonical: str, pattern: str, kind: Column, block_bytes: int = BLOCK_BYTES) -> list[list[tuple]]:
    """(kind, canonical, pattern) of a lexicon in blocks of at most ``block_bytes`` or one pattern; null and empty patterns are dropped."""
    rows = lexicon.select(kind.cast("int"), F.col(canonical).cast("string"), F.col(pattern).cast("string").alias("__p")).where("__p <> ''").distinct()
    out: list[list[tuple]] = []
    size = block_bytes + 1
    for r in rows.orderBy("__p").toLocalIterator():
        held = len(r[2].encode()) + 64
        if size + held > block_bytes:
            out.append([])
            size = 0
        out[-1].append(tuple(r))
        size += held
    return out


def _automaton(sent) -> Automaton:
    """The automaton of a broadcast block, built once a worker; a worker keeps the last one."""
    if sent.id not in _BUILT:
        _BUILT.clear()
        _BUILT[sent.id] = Automaton(sent.value)
    return _BUILT[sent.id]


class Sent:
    """A block on its way to the tasks, with a name that is its own."""

    def __init__(self, spark, rows: list[tuple]):
        self.handle = spark.sparkContext.broadcast(rows)
        self.id = (spark.sparkContext.applicationId, self.handle._jbroadcast.id())

    def __getstate__(self):
        return {"handle": self.handle, "id": self.id}

    @property
    def value(self):
        return self.handle.value


def found(spark, block: list[tuple]) -> callable:
    """A column function: array of (start, back, canonical, kind, pattern) of a text, by start, the longer first."""
    sent = Sent(spark, block)

    @F.pandas_udf("array<struct<start:int,back:int,canonical:string,kind:int,pattern:string>>")
    def look(texts: pd.Series) -> pd.Series:
        machine, out = _automaton(sent), []
        for t in texts:
            rows = [(start, -len(p), canonical, kind, p) for start, p, named in machine.hits(t) for kind, canonical in named]
            out.append([dict(zip(("start", "back", "canonical", "kind", "pattern"), r, strict=True)) for r in sorted(rows)])
        return pd.Series(out, dtype=object)

    return look


def hits(df: DataFrame, key: str, text: str, lexicon: DataFrame, canonical: str = "canonical", pattern: str = "pattern", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, start, length, canonical, pattern) of all occurrences of a lexicon's patterns, case as it is.

    Occurrences of one pattern do not overlap; those of different patterns may. Starts count characters from 1.
    A null text has none; an empty lexicon finds none; repeated rows give repeated hits.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    out = None
    for block in blocks(lexicon, canonical, pattern, F.lit(0), block_bytes) or [[]]:
        part = rows.select("__k", F.inline(found(spark, block)(F.col("__t"))))
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("__k").alias(key), "start", (-F.col("back")).alias("length"), "canonical", "pattern")


def triplets(df: DataFrame, key: str, text: str, lexicon: DataFrame, marks: Lexicon, canonical: str = "canonical", pattern: str = "pattern", kind: str = "kind") -> DataFrame:
    """What ``text.triplets`` gives, for a table of patterns whose ``kind`` is entity or attribute.

    The lexicon has to fit one block, as a clause needs all its mentions together; ``marks`` has the words of side
    and negation.
    """
    spark = df.sparkSession
    ship_package(spark)
    some = blocks(lexicon.where(F.col(kind).isin("entity", "attribute")), canonical, pattern, (F.col(kind) == "attribute").cast("int"))
    if len(some) > 1:
        raise ValueError(f"the lexicon has more than {BLOCK_BYTES} bytes")
    rows = df.select(key, F.posexplode(clauses(F.col(text))).alias("clause_no", "clause"))
    rows = rows.withColumn("m", found(spark, some[0] if some else [])(F.col("clause"))).where("size(m) > 1")
    of = lambda k: F.filter("m", lambda x: x["kind"] == k)
    rows = rows.select(key, "clause_no", "clause", of(0).alias("es"), of(1).alias("attrs")).where("size(es) > 0")
    rows = rows.select(key, "clause_no", "clause", "es", F.explode("attrs").alias("a")).withColumn("e", nearest_entity(F.col("es"), F.col("a"))).where("e IS NOT NULL")
    before = F.substring(F.col("clause"), F.greatest(F.lit(1), F.col("a.start") - 6), F.least(F.lit(6), F.col("a.start") - 1))
    negated = F.exists(F.array(*[F.lit(n) for n in marks.negations]), lambda n: F.contains(before, n)) if marks.negations else F.lit(False)
    return rows.select(key, "clause_no", location(F.col("clause"), marks).alias("location"), F.col("e.canonical").alias("entity"), F.col("a.canonical").alias("attribute"), negated.alias("negated"), F.col("e.start").alias("entity_start"), F.col("a.start").alias("attribute_start"))
