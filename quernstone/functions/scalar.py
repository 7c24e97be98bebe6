"""Row expressions: lenient casts, labels, keys, losses, schedules, arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy")


def lenient_double(x: Column) -> Column:
    """A number, or null for what is none."""
    return F.trim(x.cast("string")).try_cast("double")


def lenient_int(x: Column) -> Column:
    """A whole number, by way of a double so that ``3.0`` counts; otherwise null."""
    return lenient_double(x).try_cast("int")


def lenient_date(x: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The date in the first format that fits, as ``yyyy-MM-dd``; otherwise null."""
    return F.date_format(F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(f)) for f in formats]), "yyyy-MM-dd")


def parse_code_name(cell: Column) -> tuple[Column, Column]:
    """Code and name of a ``code : name`` cell, with either colon; a cell that does not fit is all name."""
    pattern = "^\\s*(\\d+)\\s*[:：]\\s*(.*?)\\s*$"
    fits = cell.rlike(pattern)
    return F.when(fits, F.regexp_extract(cell, pattern, 1).try_cast("int")), F.when(fits, F.regexp_extract(cell, pattern, 2)).otherwise(F.trim(cell))


def clean_text(x: Column) -> Column:
    """Null to empty, line ends to newlines, outer white space off."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "^\\s+|\\s+$", "")


def join_text(a: Column, b: Column) -> Column:
    """Two cleaned parts with a newline between, trimmed."""
    return F.regexp_replace(F.concat(clean_text(a), F.lit("\n"), clean_text(b)), "^\\s+|\\s+$", "")


def class_id(code: Column, classes: int = 6) -> Column:
    """Code 1..classes to 0..classes-1, otherwise null."""
    return F.when(code.between(1, classes), code - 1)


def stratum_key(left: Column, right: Column) -> Column:
    return F.concat(F.lit("L"), F.coalesce(left.cast("string"), F.lit("NA")), F.lit("_R"), F.coalesce(right.cast("string"), F.lit("NA")))


def primary_label(left: Column, right: Column) -> Column:
    return F.coalesce(left, right, F.lit(-1))


def pair_key(left: Column, right: Column) -> Column:
    return F.concat_ws("_", F.coalesce(left, F.lit(-1)), F.coalesce(right, F.lit(-1)))


def pseudonym(salt: str, *candidates: Column) -> Column:
    """Salted SHA-1 of the first candidate that is neither null nor empty; a salt is required."""
    if not salt:
        raise ValueError("a salt is required")
    first = F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates])
    return F.sha1(F.concat(F.lit(salt), first))


def first_number(x: Column, separator: str = "\\\\") -> Column:
    """The first of several numbers in a text."""
    return lenient_double(F.get(F.split(x, separator), F.lit(0)))


def merge_codes(code: Column, merged: dict[int, int], order: Sequence[int]) -> Column:
    """Merged code to a dense id by its place in ``order``; a code that is not listed becomes null."""
    out = code
    for old, new in merged.items():
        out = F.when(code == old, new).otherwise(out)
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), out.cast("int")), F.lit(0)) - 1


def two_stage(p: Column, threshold: float, second: Column, negative: int) -> Column:
    """The second stage's code where the first stage's probability reaches the threshold."""
    return F.when(p >= threshold, second).otherwise(F.lit(negative))


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-x / max(1e-6, temperature)))


def cross_entropy(y: Column, p: Column, eps: float = 1e-6) -> Column:
    """Binary cross-entropy with clipped probabilities."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def focal_loss(y: Column, p: Column, gamma: float = 2.0, smoothing: float = 0.0, positive_weight: float = 1.0, eps: float = 1e-6) -> Column:
    """Binary focal loss; labels move towards a half by the smoothing."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    t = y * (1 - smoothing) + 0.5 * smoothing
    ce = -(positive_weight * t * F.ln(q) + (1 - t) * F.ln(1 - q))
    return F.pow(1 - (q * t + (1 - q) * (1 - t)), F.lit(gamma)) * ce


def smoothed_cross_entropy(probabilities: Column, label: Column, classes: int, smoothing: float = 0.0, eps: float = 1e-12) -> Column:
    """Cross-entropy of a probability array against a smoothed one-hot label."""
    logs = F.transform(probabilities, lambda p: F.ln(F.greatest(p, F.lit(eps))))
    return -((1 - smoothing) * F.get(logs, label) + smoothing / classes * F.aggregate(logs, F.lit(0.0), lambda a, x: a + x))


def high_confidence_wrong(y: Column, p: Column, high: float = 0.9, low: float = 0.1) -> Column:
    return ((y == 0) & (p >= high)) | ((y == 1) & (p <= low))


def window_unit(x: Column, low: float, high: float) -> Column:
    """Clip to a window and scale it to 0..1."""
    return (F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / (high - low + 1e-6)


def safe_div(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def percent(n: float, d: float) -> str:
    return f"{100 * n / d:.1f}%" if d else "0.0%"


def parse_list(text: str | None, kind=int) -> list:
    """Parts of a comma list, blanks dropped."""
    return [kind(x) for x in (text or "").split(",") if x.strip()]


def learning_rate(epoch: Column, base: float, warmup: int, epochs: int, floor: float = 0.0) -> Column:
    """Linear warm-up to ``base``, then a cosine down to ``floor``."""
    progress = F.least(F.lit(1.0), (epoch - warmup) / float(max(1, epochs - warmup)))
    return F.when(epoch < warmup, base * (epoch + 1) / float(max(1, warmup))).otherwise(floor + (base - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.element_at(F.transform(F.array(total), lambda s: F.transform(e, lambda x: x / s)), 1)  # the sum is taken once


def even_index(n: Column, k: int) -> Column:
    """k evenly spaced places of 0..n-1, truncated; the last is repeated where n is below k."""
    if k < 2:
        return F.array(F.lit(0))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(float(k - 1))).cast("int"))
    short = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(i, n - 1).cast("int"))
    return F.when(n >= k, spaced).otherwise(short)


def first_of(*columns: Column) -> Column:
    """The first of several numbers that is there, as a double: spacing between slices, else their thickness."""
    return F.coalesce(*[c.cast("double") for c in columns])


def six_digits(values: Column) -> Column:
    """Numbers of an array with six significant digits, as the format %g writes them, comma-joined.

    Nulls are left out; null alone gives null, no number an empty text. In Python, as formats of the JVM round a
    tie half up, and take a double's shortest decimal form for its value.
    """
    written = lambda x: "%g" % x if x == x else "-nan" if math.copysign(1, x) < 0 else "nan"

    @F.arrow_udf("string")
    def joined(arrays: pa.Array) -> pa.Array:
        return pa.array([None if v is None or (v and not any(x is not None for x in v)) else ",".join(written(x) for x in v if x is not None) for v in arrays.to_pylist()], pa.string())

    return joined(values.cast("array<double>"))


def six_numbers(values: Column, most: int = 6) -> Column:
    """The first numbers of an array with six significant digits, comma-joined; null if there are fewer."""
    return F.when(F.size(values) >= most, six_digits(F.slice(values, 1, most)))


def multiclass_focal_loss(logits: Column, label: Column, gamma: float = 2.0, alpha: Sequence[float] | None = None) -> Column:
    """-alpha_t * (1 - p_t)^gamma * ln(p_t) with p_t the softmax at the label."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    logp = F.get(logits, label) - top - F.ln(total)
    p = F.least(F.greatest(F.exp(logp), F.lit(1e-8)), F.lit(1.0))
    weight = F.lit(1.0) if alpha is None else F.get(F.array(*[F.lit(float(a)) for a in alpha]), label)
    return -weight * F.pow(1 - p, F.lit(float(gamma))) * logp


def rescaled(pixels: Column, slope: Column, intercept: Column) -> Column:
    """pixels * slope + intercept; a slope that is null or 0 counts as 1, a null intercept as 0."""
    return pixels * F.coalesce(F.nullif(slope.cast("double"), F.lit(0.0)), F.lit(1.0)) + F.coalesce(intercept.cast("double"), F.lit(0.0))


def window_bounds(centre: Column, width: Column, default: tuple[float, float] = (500.0, 3000.0)) -> tuple[Column, Column]:
    """Lower and upper bound of a window, the default one where centre or width is null or the width is not positive."""
    given = centre.isNotNull() & (F.coalesce(width, F.lit(0)) > 0)
    c, w = F.when(given, centre).otherwise(F.lit(default[0])), F.when(given, width).otherwise(F.lit(default[1]))
    return c - w / 2, c + w / 2


def file_number(path: Column) -> Column:
    """The last number between dots of a file's name without its extension; 0 if it is none."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.coalesce(F.substring_index(stem, ".", -1).try_cast("long"), F.lit(0).cast("long"))


def non_empty(text: Column) -> Column:
    """Whether a text has more than white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")) > 0
