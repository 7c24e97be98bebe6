"""Report text: clauses, lexicon triplets, n-gram vectors and weights."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quernstone.functions.scalar import non_empty
from quernstone.scratch import sided, written
from quernstone.session import ship_package

OUTER = "^[ \\t\\n\\r\\f\\x{3000}]+|[ \\t\\n\\r\\f\\x{3000}]+$"


def normalise(x: Column) -> Column:
    """Line ends to newlines, runs of spaces, tabs and wide spaces to one space, trimmed; null is empty."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "[ \\t\\x{3000}]+", " "), OUTER, "")


def clauses(x: Column, breaks: str = "[。；;\\n]+") -> Column:
    """Trimmed parts between clause marks, blanks dropped."""
    parts = F.transform(F.split(normalise(x), breaks), lambda s: F.regexp_replace(s, OUTER, ""))
    return F.filter(parts, lambda s: s != "")


@dataclass(frozen=True)
class Lexicon:
    """Patterns by canonical name, for entities and attributes; marks of side and negation."""

    entities: dict[str, tuple[str, ...]]
    attributes: dict[str, tuple[str, ...]]
    negations: tuple[str, ...]
    left: tuple[str, ...] = ()
    right: tuple[str, ...] = ()
    both: tuple[str, ...] = ()


def location(clause: Column, lexicon: Lexicon) -> Column:
    """B for words of both sides, else LR for words of each, L or R for one, U for none."""

    def holds(words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(clause, F.lit(w))
        return out

    left, right = holds(lexicon.left), holds(lexicon.right)
    return F.when(holds(lexicon.both), "B").when(left & right, "LR").when(left, "L").when(right, "R").otherwise("U")


def occurrences(text: Column, pattern: str) -> Column:
    """1-based starts of all non-overlapping occurrences of a literal, from the left, in time linear in the text.

    The text is split at the literal; each part is replaced by itself with a mark in front, so that a second
    split by length gives running places without a fold that copies an array at each hit.
    """
    parts = F.split(text, "\\Q" + pattern + "\\E", -1)
    before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    lengths = F.transform(before, lambda p: F.length(p) + len(pattern))
    return F.transform(_running(lengths), lambda end: (end - len(pattern) + 1).cast("int"))


#: Elements of an array that are summed at a time.
_RUN = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    """Running sums of an array of whole numbers: sums of runs of _RUN first, then inside each run."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / _RUN).cast("int") - 1, F.lit(0))), lambda r: F.slice(v, r * _RUN + 1, F.lit(_RUN)))
    ahead = lambda sums: F.transform(sums, lambda _, r: total(F.slice(sums, F.lit(1), r)))
    inside = lambda part, base: F.transform(part, lambda x, i: base + total(F.slice(part, F.lit(1), i + 1)))
    return _let(values, lambda v: _let(cut(v), lambda runs: _let(F.transform(runs, total), lambda sums: F.flatten(F.zip_with(runs, ahead(sums), inside)))))


def mentions(clause: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """Array of (start, length, canonical) of all patterns, by start, the longer first."""
    found = [_tagged(clause, canonical, p) for canonical, ps in patterns.items() for p in ps]
    return F.array_sort(F.concat(*found))


def _tagged(clause: Column, canonical: str, pattern: str) -> Column:
    return F.transform(occurrences(clause, pattern), lambda s: F.struct(s.alias("start"), F.lit(-len(pattern)).alias("back"), F.lit(canonical).alias("canonical")))


def nearest_entity(entities: Column, attribute: Column) -> Column:
    """The entity of an attribute, entities in order of (start, longest first); null if there is none.

    Of those that end before it within 16 characters the one with the largest end; else of those that start
    after it within 16 the one with the smallest start; else the one whose start or end is nearest to the
    attribute's start, within 32. The first in order wins ties.
    """
    a0, a1 = attribute["start"], attribute["start"] - attribute["back"]
    end = lambda e: e["start"] - e["back"]
    before = lambda e: (end(e) <= a0) & (a0 - end(e) <= 16)
    after = lambda e: (e["start"] >= a1) & (e["start"] - a1 <= 16)
    apart = lambda e: F.least(F.abs(a0 - e["start"]), F.abs(a0 - end(e)))
    tagged = F.transform(
        entities,
        lambda e, i: F.struct(
            F.when(before(e), 0).when(after(e), 1).when(apart(e) <= 32, 2).otherwise(3).alias("tier"),
            F.when(before(e), -end(e)).when(after(e), e["start"]).otherwise(apart(e)).alias("far"),
            i.alias("i"),
            e.alias("e"),
        ),
    )
    best = F.array_min(F.filter(tagged, lambda t: t["tier"] < 3))
    return best["e"]


def triplets(df: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(key, clause_no, location, entity, attribute, negated, entity_start, attribute_start), long.

    A clause's attributes each choose their entity; a negation counts within six characters before.
    """
    rows = df.select(key, F.posexplode(clauses(F.col(text))).alias("clause_no", "clause"))
    likely = F.lit(False)
    for ps in lexicon.attributes.values():
        for p in ps:
            likely = likely | F.contains(F.col("clause"), F.lit(p))
    rows = rows.where(likely).select(key, "clause_no", "clause", mentions(F.col("clause"), lexicon.entities).alias("es"), mentions(F.col("clause"), lexicon.attributes).alias("attrs"))
    rows = rows.where("size(es) > 0").select(key, "clause_no", "clause", "es", F.explode("attrs").alias("a")).withColumn("e", nearest_entity(F.col("es"), F.col("a"))).where("e IS NOT NULL")
    before = F.substring(F.col("clause"), F.greatest(F.lit(1), F.col("a.start") - 6), F.least(F.lit(6), F.col("a.start") - 1))
    negated = F.lit(False)
    for n in lexicon.negations:
        negated = negated | F.contains(before, F.lit(n))
    return rows.select(key, "clause_no", location(F.col("clause"), lexicon).alias("location"), F.col("e.canonical").alias("entity"), F.col("a.canonical").alias("attribute"), negated.alias("negated"), F.col("e.start").alias("entity_start"), F.col("a.start").alias("attribute_start"))


def compact(location: Column, entity: Column, attribute: Column, negated: Column) -> Column:
    """location:entity:attribute, with NEG: before a negated attribute."""
    return F.concat(location, F.lit(":"), entity, F.lit(":"), F.when(negated, "NEG:").otherwise(""), attribute)


def triplet_report(docs: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """One row: rows, rows with a text, rows with triplets, triplets."""
    found = triplets(docs, key, text, lexicon).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    counted = docs.select(key, F.col(text).alias("__t")).join(found, key, "left")
    return counted.agg(F.count(F.lit(1)).alias("rows"), F.count_if(non_empty(F.col("__t"))).alias("with_text"), F.count_if(F.col("__n") > 0).alias("with_triplets"), F.coalesce(F.sum("__n"), F.lit(0)).alias("triplets"))


#: Words before a query by side, and before a negated attribute.
SIDE_PREFIX = {"left": "左侧", "right": "右侧"}
NEGATED_PREFIX = "无"


def side_queries(found: DataFrame, key: str, most: int, drop_negated: bool = False) -> DataFrame:
    """(key, side, place, query): texts of triplets for each side they speak of, the first ``most`` a side.

    L and R are one side, all other locations both; order is that of clause and attribute.
    """
    rows = found.where("NOT negated") if drop_negated else found
    sides = F.when(F.col("location") == "L", F.array(F.lit("left"))).when(F.col("location") == "R", F.array(F.lit("right"))).otherwise(F.array(F.lit("left"), F.lit("right")))
    prefix = F.when(F.col("side") == "left", SIDE_PREFIX["left"]).otherwise(SIDE_PREFIX["right"])
    text = F.concat(prefix, F.lit(" "), F.col("entity"), F.lit(" "), F.when(F.col("negated"), NEGATED_PREFIX).otherwise(""), F.col("attribute"))
    w = Window.partitionBy(key, "side").orderBy("clause_no", "attribute_start", "attribute")
    out = rows.withColumn("side", F.explode(sides)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return out.select(key, "side", "place", text.alias("query"))


#: Names of the six classes, and a sentence that stands for a class without a prompt.
CLASS_NAMES = {0: "慢性化脓性中耳炎", 1: "中耳胆脂瘤", 2: "分泌性中耳炎", 3: "胆固醇肉芽肿", 4: "正常", 5: "其他"}
CONCLUSION = "检查结论：{name}。"


def class_prompts(spark, prompts: dict[int, str] | None = None) -> DataFrame:
    """(class_id, name, prompt) of the six classes; a class without a prompt has the sentence with its name."""
    given = prompts or {}
    rows = [(k, name, given.get(k) or CONCLUSION.format(name=name)) for k, name in CLASS_NAMES.items()]
    return spark.createDataFrame(rows, "class_id int, name string, prompt string")


def view_prompts(prompts: DataFrame, views: DataFrame) -> DataFrame:
    """(view, y, prompt): prompts of the classes of each side of a view, joined by newlines in order of class."""
    joined = views.join(F.broadcast(prompts), views.code - 1 == prompts.class_id)
    ordered = F.array_sort(F.collect_list(F.struct("class_id", F.trim("prompt").alias("p"))))
    return joined.groupBy("view", "y").agg(F.array_join(F.transform(ordered, lambda s: s["p"]), "\n").alias("prompt"))


def encode_distinct(df: DataFrame, text: str, encode) -> DataFrame:
    """``df`` with code = encode(text), computed once for each distinct text, which meets its rows by digest.

    A null text has its own code; rows stay as many as they were.
    """
    tagged = df.withColumn("__d", F.sha2(F.col(text), 256))
    codes = tagged.groupBy("__d").agg(F.first(text).alias("__t")).select(F.col("__d").alias("__e"), encode(F.col("__t")).alias("code"))
    return tagged.join(codes, F.col("__d").eqNullSafe(F.col("__e"))).drop("__d", "__e")


def char_ngrams(text: Column, sizes=(1, 2)) -> Column:
    """All character n-grams of the given sizes, in order of size; the text is cut into characters once."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    grams = lambda cs, n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(cs), F.lit(1))), lambda i: i <= F.size(cs) - (n - 1)), lambda i: F.array_join(F.slice(cs, i, F.lit(n)), ""))
    whole = lambda cs: F.concat(*[cs if n == 1 else grams(cs, n) for n in sizes])
    return _let(chars, whole)


def bucket(gram: Column, width: int) -> Column:
    """Bucket of an n-gram: the first eight hexadecimal digits of its md5, modulo the width."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")


#: n-grams up to this size are numbers of 21 bits a character in tasks; distinct ones that a task keeps, and labels whose sums it keeps.
PACKED, KEPT, LABELS = 3, 500_000, 16


def packed_ngrams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct character n-grams of a text as numbers, and their counts."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    m = max(0, len(c) - n + 1)
    code = np.zeros(m, np.int64)
    for i in range(n):
        code = code << 21 | c[i : i + m]
    return np.unique(code, return_counts=True)


def unpacked(code: int, n: int) -> str:
    return "".join(chr(code >> 21 * i & 0x1FFFFF) for i in reversed(range(n)))


def _texts(batch: pa.RecordBatch):
    return ((i, t) for i, t in enumerate(batch.column("__t").to_pylist()) if t)


def _row_counts(df: DataFrame, columns: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """(columns, gram, tf): counts of n-grams of every row's text ``__t``."""
    if max(sizes) > PACKED:
        counted = df.withColumn("__r", F.monotonically_increasing_id()).select(*columns, "__r", F.explode(char_ngrams(F.col("__t"), sizes)).alias("gram"))
        return counted.groupBy(*columns, "__r", "gram").agg(F.count(F.lit(1)).alias("tf")).drop("__r")

    ship_package(df.sparkSession)

    def count(batches):
        for b in batches:
            for i, t in _texts(b):
                for n in sizes:
                    codes, tf = packed_ngrams(t, n)
                    row = pa.array(np.full(len(codes), i))
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(row) for c in columns], pa.array([unpacked(c, n) for c in codes.tolist()], pa.string()), pa.array(tf)], [*columns, "gram", "tf"])

    return df.select(*columns, "__t").mapInArrow(count, StructType([*[df.schema[c] for c in columns], StructField("gram", StringType()), StructField("tf", LongType())]))


def _totals(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(gram, df, total) by task: rows of text ``__t`` that hold an n-gram, and its occurrences."""
    if max(sizes) > PACKED:
        return _row_counts(df, [], sizes).groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))

    ship_package(df.sparkSession)

    def count(batches):
        held: dict = {n: [] for n in sizes}
        waiting = dict.fromkeys(sizes, 0)

        def merge(n):
            code, at = np.unique(np.concatenate([x[0] for x in held[n]]), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([x[k] for x in held[n]]), len(code)).astype(np.int64) for k in (1, 2)]
            held[n], waiting[n] = [(code, *sums)], 0
            return code, *sums

        def told(n):
            code, rows, total = merge(n)
            held[n] = []
            for at in range(0, len(code), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([unpacked(c, n) for c in code[at : at + 10_000].tolist()], pa.string()), pa.array(rows[at : at + 10_000]), pa.array(total[at : at + 10_000])], ["gram", "df", "total"])

        for b in batches:
            for _, t in _texts(b):
                for n in sizes:
                    codes, tf = packed_ngrams(t, n)
                    held[n].append((codes, np.ones(len(codes), np.int64), tf))
                    waiting[n] += len(codes)
                    if waiting[n] > KEPT and len(merge(n)[0]) > KEPT:
                        yield from told(n)
        for n in sizes:
            if held[n]:
                yield from told(n)

    return df.select("__t").mapInArrow(count, "gram string, df long, total long")


def hash_vector(df: DataFrame, key: str, text: str, width: int, sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """(key, bucket, weight): counts of n-grams by bucket, L2-normalised over each text; empty texts have none.

    A row leaves its task as counts by bucket; rows of one key are one text.
    """
    ship_package(df.sparkSession)
    rows = df.select(key, F.col(text).alias("__t"))

    def count(batches):
        memo: dict = {}
        for b in batches:
            at, buckets, counts = [], [], []
            for i, t in _texts(b):
                total = np.zeros(width, np.int64)
                for n in sizes:
                    codes, tf = packed_ngrams(t, n)
                    if len(memo) > KEPT:
                        memo.clear()
                    of = []
                    for c in codes.tolist():
                        k = memo.get((n, c))
                        if k is None:
                            k = memo[n, c] = int(hashlib.md5(unpacked(c, n).encode()).hexdigest()[:8], 16) % width
                        of.append(k)
                    np.add.at(total, of, tf)
                some = np.flatnonzero(total)
                at.append(np.full(len(some), i)), buckets.append(some), counts.append(total[some])
            if at:
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(buckets), pa.int32()), pa.array(np.concatenate(counts))], [key, "bucket", "n"])

    if max(sizes) > PACKED:
        counted = _row_counts(rows, [key], sizes).select(key, bucket(F.col("gram"), width).alias("bucket"), F.col("tf").alias("n"))
    else:
        counted = rows.mapInArrow(count, StructType([df.schema[key], StructField("bucket", IntegerType()), StructField("n", LongType())]))
    grams = counted.groupBy(key, "bucket").agg(F.sum("n").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return grams.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def document_frequencies(df: DataFrame, key: str, text: Column, sizes=(1, 2)) -> DataFrame:
    """(gram, df): documents that hold each n-gram; a task returns one row for each n-gram that it met."""
    return _totals(df.select(text.alias("__t")), sizes).groupBy("gram").agg(F.sum("df").alias("df"))


def tfidf_class_means(df: DataFrame, key: str, text: Column, label: str, vocabulary: int = 20_000, sizes=(1, 2)) -> DataFrame:
    """(label, gram, weight): class means of L2-normalised smoothed TF-IDF over the most frequent n-grams.

    Rows without a label or a key count for the frequencies alone, as in the query's SQL; ``vocabulary`` is the operator's size of the table of n-grams, which every
    task gets. A document is weighed in one task, which returns sums by label and n-gram. Documents whose key is on
    several rows are put together first, by key and n-gram.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(key, label, text.alias("__t"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    apart = F.lit(max(sizes) > PACKED) | (F.col("c") > 1) | F.col("__k").isNull()
    several = written(docs.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("c")).where(apart).select("__k"), "several")
    at = F.col(key).eqNullSafe(F.col("__k"))
    single = docs.join(sided(several, 1_000_000), at, "left_anti")
    grams = written(_row_counts(docs.join(sided(several, 1_000_000), at, "left_semi"), [key, label], sizes).groupBy(key, label, "gram").agg(F.sum("tf").alias("tf")), "grams")
    freq = _totals(single, sizes).unionByName(grams.select("gram", F.lit(1).cast("long").alias("df"), F.col("tf").alias("total")))
    freq = freq.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).orderBy(F.desc("total"), "gram").limit(vocabulary)
    idf = written(freq.withColumn("n", n.scalar()).select("gram", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")

    weighted = grams.join(F.broadcast(idf), "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sums = weighted.join(norms, key).groupBy(label, "gram").agg(F.sum(F.col("w") / F.col("norm")).alias("s"))
    table = [(r["gram"], r["idf"]) for r in idf.collect()]
    sent = spark.sparkContext.broadcast(table)

    def weigh(batches):
        names, of = [g for g, _ in sent.value], np.array([x for _, x in sent.value])
        codes = {}
        for n in sizes if max(sizes) <= PACKED else ():
            mine = [i for i, g in enumerate(names) if len(g) == n]
            code = np.array([sum(ord(c) << 21 * (n - 1 - j) for j, c in enumerate(names[i])) for i in mine], np.int64)
            order = np.argsort(code)
            codes[n] = code[order], np.array(mine, np.int64)[order]
        held: dict = {}

        def told():
            for x, total in held.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), kind), pa.array([names[i] for i in some], pa.string()), pa.array(total[some])], [label, "gram", "s"])
            held.clear()

        for b in batches:
            kind, labels = b.column(label).type, b.column(label).to_pylist()
            for i, t in _texts(b):
                places, counts = [], []
                for n, (known, place) in codes.items():
                    code, tf = packed_ngrams(t, n)
                    if len(known) and len(code):
                        spot = np.minimum(np.searchsorted(known, code), len(known) - 1)
                        hit = known[spot] == code
                        places.append(place[spot[hit]]), counts.append(tf[hit])
                if not places:
                    continue
                place = np.concatenate(places)
                w = np.concatenate(counts) * of[place]
                if len(held) >= LABELS and labels[i] not in held:
                    yield from told()
                if len(w):
                    held.setdefault(labels[i], np.zeros(len(of)))[place] += w / np.sqrt((w * w).sum())
        if held:
            yield from told()

    mine = single.select(label, "__t").mapInArrow(weigh, StructType([docs.schema[label], StructField("gram", StringType()), StructField("s", DoubleType())]))
    sums = mine.unionByName(sums).groupBy(label, "gram").agg(F.sum("s").alias("s"))
    sizes_ = docs.groupBy(label).agg(F.count(F.lit(1)).alias("members"))
    return sums.join(F.broadcast(sizes_), label).select(label, "gram", (F.col("s") / F.col("members")).alias("weight"))


def class_texts(df: DataFrame, label: str, text: str, prompts: DataFrame, least: int = 20) -> DataFrame:
    """(class_id, text, source): texts of the classes with ``least`` of them, else the class's prompt alone."""
    rows = df.where(F.col(label).isNotNull() & non_empty(F.col(text))).select(F.col(label).cast("int").alias("class_id"), F.col(text).alias("text"))
    enough = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("class_id")
    few = prompts.join(F.broadcast(enough), "class_id", "left_anti").select("class_id", F.col("prompt").alias("text"), F.lit("prompt").alias("source"))
    return rows.join(F.broadcast(enough), "class_id", "left_semi").select("class_id", "text", F.lit("texts").alias("source")).unionByName(few)
