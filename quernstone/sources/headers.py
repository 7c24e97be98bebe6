"""Slices of imaging files: header fields and pixels, read in tasks from binary files.

Files with explicit or implicit types, big-endian and deflated ones are read, with or without the preamble, and pixels
that are plain or run-length coded; other codecs, and damaged files, give a row with ``meta_ok`` false. To read
header fields alone, without the pixels' bytes, use ``ranged.header_files``.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import scalar as S
from quernstone.operators.slices import VolumeSpec, canonical, slice_order, volumes
from quernstone.sources.ranged import FIELDS, LONG_TYPES, NUMBERS, PIXELS, RUN_LENGTH, fields, header_files, of_bytes, store_of, unpacked  # noqa: F401
from quernstone.session import ship_package

def parse(data: bytes, pixels: bool = False) -> dict:
    """Fields of a file held in memory, with ``pixels`` their bytes too; see ``ranged.fields``."""
    return fields(of_bytes(data), set(FIELDS.values()), pixels)


HEADER = "path string, meta_ok boolean, " + ", ".join(f"{n} {'int' if n in NUMBERS else 'string'}" for n in FIELDS.values())


def read_headers(files: DataFrame) -> DataFrame:
    """(path, meta_ok, fields) of files (path, content), as of a binaryFile scan; pixels are not decoded."""

    def read(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows.append({"path": path, "meta_ok": True, **parse(bytes(content))})
                except (ValueError, struct.error, zlib.error, TypeError):
                    rows.append({"path": path, "meta_ok": False})
            out = pd.DataFrame(rows, columns=["path", "meta_ok", *FIELDS.values()])
            for name in FIELDS.values():
                out[name] = out[name].astype("Int32") if name in NUMBERS else out[name].astype(object).where(out[name].notna(), None)
            yield out

    return files.select("path", "content").mapInPandas(read, HEADER)


def series_meta(headers: DataFrame, salt: str, keep_identity: bool = False) -> DataFrame:
    """One row for each file's header: pseudonyms, scanner, sizes and spacings as a manifest has them.

    The owner key is the salted hash of the patient id, else of the name, else of the study. The slice spacing
    is that between slices, else their thickness; the orientation is six numbers of six digits.
    """
    part = lambda c, i: S.lenient_double(F.get(F.split(c, "\\\\"), F.lit(i)))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    between, thick = S.first_number(F.col("spacing_between_slices")), S.first_number(F.col("slice_thickness"))
    cosines = F.transform(F.split("orientation", "\\\\"), lambda x: F.trim(x).try_cast("double"))
    whole = F.when(F.forall(cosines, lambda x: x.isNotNull()), S.six_numbers(cosines))
    identity = ["patient_id", "patient_name"] if keep_identity else []
    return headers.select(
        "path", "meta_ok", "study_uid", "series_uid",
        S.pseudonym(salt, F.col("patient_id")).alias("patient_id_hash"), S.pseudonym(salt, F.col("patient_name")).alias("patient_name_hash"),
        S.pseudonym(salt, F.col("patient_id"), F.col("patient_name"), F.col("study_uid")).alias("patient_key_hash"),
        *[blank(F.col(c)).alias(c) for c in ("manufacturer", "manufacturer_model", "convolution_kernel", "modality", "body_part")],
        "rows", "cols", part(F.col("pixel_spacing"), 1).alias("spacing_x"), part(F.col("pixel_spacing"), 0).alias("spacing_y"),
        S.first_of(between, thick).alias("spacing_z"), thick.alias("slice_thickness"), between.alias("spacing_between_slices"), whole.alias("image_orientation"), *identity,
    )


SLICES = "path string, meta_ok boolean, h int, w int, pixels array<float>, z double, instance long, spacing_y double, spacing_x double"


def _numbers(text: str | None) -> list[float]:
    try:
        return [float(x) for x in (text or "").split("\\") if x.strip()]
    except ValueError:
        return []


def slice_of(data: bytes) -> dict:
    """Pixels of a file in rescaled units, upright, with z, instance and spacings.

    A slope of 0 counts as 1; MONOCHROME1 is inverted within the slice's range before the rescaling.
    """
    f = parse(data, pixels=True)
    h, w, bits = f["rows"], f["cols"], f.get("bits", 16)
    kind = {(8, 0): "u1", (8, 1): "i1", (16, 0): "u2", (16, 1): "i2", (32, 0): "u4", (32, 1): "i4"}[bits, f.get("signed", 0)]
    if f.get("samples", 1) != 1:
        raise ValueError("several samples a pixel")
    packed = isinstance(f["data"], list)
    if packed and f["syntax"] != RUN_LENGTH:
        raise ValueError(f"pixels in a codec that is not read: {f['syntax']}")
    raw = unpacked(f["data"], h * w, bits // 8) if packed else f["data"]
    img = np.frombuffer(raw, ("<" if packed else f["order"]) + kind, h * w).reshape(h, w).astype(np.float32)
    if f.get("photometric") == "MONOCHROME1":
        img = img.max() + img.min() - img
    first = lambda name, default: next(iter(_numbers(f.get(name))), default)
    img = img * (first("slope", 1.0) or 1.0) + first("intercept", 0.0)
    spacing = (*_numbers(f.get("pixel_spacing")), None, None)[:2]
    img, (sy, sx) = canonical(img, _numbers(f.get("orientation")) or None, spacing)
    place = _numbers(f.get("position"))
    number = f.get("instance", "")
    return {"h": img.shape[0], "w": img.shape[1], "pixels": np.ascontiguousarray(img, np.float32).ravel(), "z": place[2] if len(place) > 2 and math.isfinite(place[2]) else None, "instance": int(number) if number.lstrip("-").isdigit() else None, "spacing_y": sy, "spacing_x": sx}


def _slice_frame(rows: list[dict]) -> pd.DataFrame:
    """Rows as SLICES, with nulls in what a broken file lacks."""
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in SLICES.split(", ")])
    for c, t in (("h", "Int32"), ("w", "Int32"), ("instance", "Int64")):
        out[c] = out[c].astype(t)
    for c in ("z", "spacing_y", "spacing_x"):
        out[c] = out[c].astype("Float64")
    out["pixels"] = out["pixels"].astype(object).where(out["pixels"].notna(), None)
    return out


def read_slices(files: DataFrame) -> DataFrame:
    """SLICES of files (path, content); a file that cannot be read has meta_ok false and nulls."""

    def read(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows.append({"path": path, "meta_ok": True, **slice_of(bytes(content))})
                except (ValueError, KeyError, struct.error, zlib.error, TypeError):
                    rows.append({"path": path, "meta_ok": False})
            yield _slice_frame(rows)

    return files.select("path", "content").mapInPandas(read, SLICES)


def even_slices(headers: DataFrame, series: str, slices: int) -> DataFrame:
    """(series, path) of the evenly spaced slices that a volume of ``slices`` needs of each series, from header rows alone.

    Slices are in the order of ``slice_order``; of a series with fewer all are taken. Files that cannot be read or
    tell no series take no part.
    """
    text = F.split("position", "\\\\")
    z = F.when(F.size(text) > 2, F.get(text, F.lit(2)).try_cast("double"))
    number = F.when(F.trim("instance").rlike("^-?[0-9]+$"), F.trim("instance").try_cast("long"))
    rows = headers.where(F.col("meta_ok") & F.col(series).isNotNull()).select(series, "path", slice_order(z, number, F.col("path")).alias("__o"))
    w = Window.partitionBy(series)
    placed = rows.withColumns({"__at": F.row_number().over(w.orderBy("__o", "path")) - 1, "__n": F.count(F.lit(1)).over(w)})
    return placed.where(F.array_contains(S.even_index(F.col("__n").cast("int"), slices), F.col("__at"))).select(series, "path")


def read_paths(paths: DataFrame, root: str) -> DataFrame:
    """The columns of ``paths`` and SLICES of the file of each row, opened in tasks through the file system of ``root``."""
    ship_package(paths.sparkSession)
    others = [f for f in paths.schema if f.name != "path"]

    def read(batches):
        store = store_of(root)[0]
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    with store.open_input_file(path) as f:
                        rows.append({"path": path, "meta_ok": True, **slice_of(f.read())})
                except (ValueError, KeyError, struct.error, zlib.error, TypeError, OSError):
                    rows.append({"path": path, "meta_ok": False})
            out = _slice_frame(rows)
            for f in others:
                out[f.name] = b[f.name].to_numpy()
            yield out

    # keys as text, for numbers beside a null; a series is dealt to many tasks
    texts = paths.select("path", *[F.col(f.name).cast("string").alias(f.name) for f in others])
    found = texts.repartition(F.xxhash64("path")).mapInPandas(read, SLICES + "".join(f", `{f.name}` string" for f in others))
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in others], *[x.split()[0] for x in SLICES.split(", ")])


def even_volumes(spark: SparkSession, root: str, spec: VolumeSpec, series: str = "series_uid", suffix: str = ".dcm", whole_units: bool = False) -> DataFrame:
    """What ``slices.volumes`` gives for the files below ``root``, in two passes: headers first, then the pixels of the
    slices that the volumes hold alone, so no task has more than these of a series.

    For even sampling: a block around the best score, or slices interpolated between others, need all pixels.
    """
    if spec.block or spec.z_spacing > 0:
        raise ValueError("a block or a target spacing of slices needs all slices: use volumes")
    wanted = even_slices(header_files(spark, root, [series, "instance", "position"], suffix), series, spec.slices)
    return volumes(read_paths(wanted, root).where("meta_ok"), series, spec, whole_units)


def slice_files(spark: SparkSession, root: str, pattern: str = "*.dcm") -> DataFrame:
    """(path, content) of all slice files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")
