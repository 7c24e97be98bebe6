"""Header fields of imaging files by ranged reads: a Spark data source that stops before the pixels.

A file is opened where it lies, through Arrow's file systems (local, HDFS, S3, GCS), and read in steps of some
kilobytes at the places that its elements name: values that nobody asked for are stepped over, and reading ends
behind the last wanted tag. Little-endian files with explicit or implicit types, big-endian and deflated ones are
read, as are the headers of files with compressed pixels. A file that breaks the format gives a row with
``meta_ok`` false and what it cost to find out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quernstone.session import ship_package

#: Fields by group and element, which of them are numbers, the pixels' tag, types with a long size, and
#: the ways of writing that differ from explicit little-endian.
FIELDS = {
    (0x0008, 0x0060): "modality",
    (0x0008, 0x0070): "manufacturer",
    (0x0008, 0x1090): "manufacturer_model",
    (0x0010, 0x0010): "patient_name",
    (0x0010, 0x0020): "patient_id",
    (0x0018, 0x0015): "body_part",
    (0x0018, 0x0050): "slice_thickness",
    (0x0018, 0x0088): "spacing_between_slices",
    (0x0018, 0x1210): "convolution_kernel",
    (0x0020, 0x000D): "study_uid",
    (0x0020, 0x000E): "series_uid",
    (0x0020, 0x0013): "instance",
    (0x0020, 0x0032): "position",
    (0x0020, 0x0037): "orientation",
    (0x0028, 0x0002): "samples",
    (0x0028, 0x0004): "photometric",
    (0x0028, 0x0010): "rows",
    (0x0028, 0x0011): "cols",
    (0x0028, 0x0030): "pixel_spacing",
    (0x0028, 0x0100): "bits",
    (0x0028, 0x0103): "signed",
    (0x0028, 0x1050): "window_centre",
    (0x0028, 0x1051): "window_width",
    (0x0028, 0x1052): "intercept",
    (0x0028, 0x1053): "slope",
}
NUMBERS = {"samples", "rows", "cols", "bits", "signed"}
PIXELS = (0x7FE0, 0x0010)
LONG_TYPES = {b"OB", b"OW", b"OF", b"OD", b"OL", b"OV", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}
IMPLICIT, BIG, DEFLATED, RUN_LENGTH = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
UNKNOWN = 0xFFFFFFFF

#: Bytes a read, and the longest text that is taken for a field's value.
STEP, LONGEST = 4096, 1 << 16


class Reader:
    """Bytes of something by place; ``fetch(at, n)`` gives up to n of them, ``size`` is None where it is unknown."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int | None, step: int = STEP):
        self.fetch, self.size, self.step, self.taken = fetch, size, step, 0
        self.at, self.held = 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``, fewer at the end."""
        if not self.at <= at or at + n > self.at + len(self.held):
            self.held = self.fetch(at, max(n, self.step))
            self.at = at
            self.taken += len(self.held)
        return self.held[at - self.at : at - self.at + n]


def inflated(source: Reader, start: int) -> Reader:
    """The deflated bytes behind ``start``, unpacked as far as they are asked for."""
    unpack = zlib.decompressobj(-15)
    state = {"from": start, "at": 0, "held": b""}

    def fetch(at: int, n: int) -> bytes:
        while state["at"] + len(state["held"]) < at + n and not unpack.eof:
            packed = unpack.unconsumed_tail or source(state["from"], source.step)
            if not unpack.unconsumed_tail:
                state["from"] += len(packed)
            if not packed:
                break
            state["held"] += unpack.decompress(packed, max(n, STEP))
            drop = min(at - state["at"], len(state["held"]))  # what lies before is not asked for again
            if drop > 0:
                state["at"], state["held"] = state["at"] + drop, state["held"][drop:]
        return state["held"][at - state["at"] : at - state["at"] + n]

    return Reader(fetch, None)


def element(read: Reader, at: int, order: str, explicit: bool) -> tuple[tuple[int, int], int, int] | None:
    """(tag, value start, size) of the element at a place; None at the end."""
    head = read(at, 12)
    if len(head) < 8:
        return None
    tag = struct.unpack_from(order + "HH", head)
    if not explicit or tag[0] == 0xFFFE:
        return tag, at + 8, struct.unpack_from(order + "I", head, 4)[0]
    if head[4:6] not in LONG_TYPES:
        return tag, at + 8, struct.unpack_from(order + "H", head, 6)[0]
    if len(head) < 12:
        raise ValueError("an element is cut off")
    return tag, at + 12, struct.unpack_from(order + "I", head, 8)[0]


def passed(read: Reader, at: int, order: str, explicit: bool) -> int:
    """The place behind a sequence or item of unknown size whose content begins at ``at``."""
    depth = 1
    while depth:
        found = element(read, at, order, explicit)
        if found is None:
            raise ValueError("a sequence is cut off")
        tag, body, size = found
        if tag in (ITEM_END, SEQUENCE_END):
            depth, at = depth - 1, body
        elif size == UNKNOWN:
            depth, at = depth + 1, body
        else:
            at = body + size
    return at


def opened(read: Reader) -> tuple[Reader, int, str, bool, str]:
    """(reader, start, byte order, whether types are explicit, way of writing) of the data set behind the preamble."""
    if read(128, 4) != b"DICM":
        return read, 0, "<", read(4, 2).isalpha(), "" if read(4, 2).isalpha() else IMPLICIT
    at, syntax = 132, IMPLICIT
    while (found := element(read, at, "<", True)) and found[0][0] == 2:
        tag, body, size = found
        if size == UNKNOWN:
            raise ValueError("a preamble of unknown size")
        if tag == (2, 0x10):
            syntax = read(body, size).rstrip(b"\0 ").decode("ascii", "replace")
        at = body + size
    if syntax == DEFLATED:
        return inflated(read, at), 0, "<", True, syntax
    return read, at, ">" if syntax == BIG else "<", syntax != IMPLICIT, syntax


def fields(read: Reader, wanted: set[str], pixels: bool = False) -> dict:
    """Values of the wanted fields; texts are stripped, several values stay joined by a backslash.

    With ``pixels`` also ``data``, the pixels' bytes, ``order`` and ``syntax``. Elements ascend by tag, so nothing
    behind the last wanted one is read. Raises ValueError where the format is broken or none of the usual fields is there.
    """
    tags = {t: n for t, n in FIELDS.items() if n in wanted}
    last = PIXELS if pixels else max([*tags, (0x0028, 0x0011)])
    read, at, order, explicit, syntax = opened(read)
    out: dict = {}
    seen = False
    while (found := element(read, at, order, explicit)) and found[0] <= last:
        tag, body, size = found
        if tag == PIXELS:
            out |= {"data": encapsulated(read, body, order) if size == UNKNOWN else read(body, size), "order": order, "syntax": syntax}
            if size != UNKNOWN and len(out["data"]) < size:
                raise ValueError("the pixels are cut off")
            break
        seen = seen or FIELDS.get(tag) in {"rows", "cols", "modality", "series_uid", "instance"}
        if size == UNKNOWN:
            at = passed(read, body, order, explicit)
            continue
        if read.size is not None and body + size > read.size:
            raise ValueError("an element is cut off")
        if name := tags.get(tag):
            raw = read(body, min(size, LONGEST))
            if len(raw) < min(size, LONGEST):
                raise ValueError("an element is cut off")
            out[name] = struct.unpack(order + "H", raw[:2])[0] if name in NUMBERS and len(raw) >= 2 else raw.rstrip(b"\0 ").decode("utf-8", "replace").strip()
        at = body + size
    if not seen:
        raise ValueError("no known field")
    return out


def encapsulated(read: Reader, at: int, order: str) -> list[bytes]:
    """The fragments of pixels of unknown size, without the table of offsets that comes first."""
    out = []
    while True:
        found = element(read, at, order, True)
        if found is None or found[0] not in (ITEM, SEQUENCE_END) or found[2] == UNKNOWN:
            raise ValueError("the pixels are cut off")
        if found[0] == SEQUENCE_END:
            return out[1:]
        part = read(found[1], found[2])
        if len(part) < found[2]:
            raise ValueError("the pixels are cut off")
        out.append(part)
        at = found[1] + found[2]


def of_bytes(data: bytes) -> Reader:
    return Reader(lambda at, n: data[at : at + n], len(data), max(1, len(data)))


def run_lengths(data: bytes, size: int) -> bytes:
    """One segment of run-length coded bytes: a count of literal bytes, or of copies of one byte."""
    out, at = bytearray(), 0
    while at + 1 < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    if len(out) < size:
        raise ValueError("a run-length segment is too short")
    return bytes(out[:size])


def unpacked(fragments: list[bytes], pixels: int, width: int) -> bytes:
    """Little-endian samples of a run-length coded frame: a segment for each byte of a sample, the highest first."""
    data = b"".join(fragments)
    if len(data) < 64:
        raise ValueError("no table of segments")
    count, *starts = struct.unpack_from("<16I", data)
    if count != width:
        raise ValueError(f"{count} segments for samples of {width} bytes")
    ends = [*starts[1:count], len(data)]
    planes = [run_lengths(data[a:b], pixels) for a, b in zip(starts[:count], ends, strict=True)]
    out = bytearray(pixels * width)
    for k, plane in enumerate(planes):
        out[width - 1 - k :: width] = plane
    return bytes(out)


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI or local path, and the folder's path in it."""
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


class Folder(InputPartition):
    """Some folders, each with whether what lies below it belongs to it."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class Headers(DataSource):
    """``spark.read.format("imaging_headers").load(folder)``: path, meta_ok, fields and bytes_read of every file.

    Options: ``columns`` (comma separated; all fields), ``suffix`` (of names, any case; none), ``partitions`` (64),
    ``step`` (bytes a read). Only wanted columns are read for; the driver lists two levels of folders, tasks the rest.
    """

    @classmethod
    def name(cls) -> str:
        return "imaging_headers"

    def columns(self) -> list[str]:
        known = list(FIELDS.values())
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or known
        if unknown := [c for c in asked if c not in known]:
            raise ValueError(f"no fields: {unknown}; known are {known}")
        return asked

    def schema(self) -> str:
        return ", ".join(["path string", "meta_ok boolean", *[f"{c} {'int' if c in NUMBERS else 'string'}" for c in self.columns()], "bytes_read long"])

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options, self.columns())


class HeaderReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.columns, self.root, self.suffix = columns, options["path"], options.get("suffix", "").lower()
        self.parts, self.step = int(options.get("partitions", 64)), int(options.get("step", STEP))

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.root)
        folders, level = [(root, False)], [root]
        for depth in (1, 2):
            level = [i.path for f in level for i in store.get_file_info(fs.FileSelector(f)) if i.type == fs.FileType.Directory]
            folders += [(f, depth == 2) for f in sorted(level)]
        return [Folder(folders[k :: self.parts]) for k in range(min(self.parts, len(folders)))]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store = store_of(self.root)[0]
        rows: list[tuple] = []
        for folder, below in partition.folders:
            for info in store.get_file_info(fs.FileSelector(folder, recursive=below)):
                if info.type == fs.FileType.File and info.path.lower().endswith(self.suffix):
                    rows.append(self.row(store, info))
                if len(rows) >= 1000:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    def row(self, store, info) -> tuple:
        taken = 0
        try:
            with store.open_input_file(info.path) as f:
                read = Reader(lambda at, n: f.read_at(n, at), info.size, self.step)
                try:
                    got, ok = fields(read, set(self.columns)), True
                except (ValueError, struct.error, zlib.error):
                    got, ok = {}, False
                taken = read.taken
        except OSError:
            got, ok = {}, False
        return (info.path, ok, *[got.get(c) for c in self.columns], taken)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.bool_(), *[pa.int32() if c in NUMBERS else pa.string() for c in self.columns], pa.int64()]
        names = ["path", "meta_ok", *self.columns, "bytes_read"]
        # a number that is written as text, or one as several, is none
        clean = lambda x, k: x if k != pa.int32() or isinstance(x, int) else None
        return pa.RecordBatch.from_arrays([pa.array([clean(x, k) for x in col], k) for col, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def header_files(spark: SparkSession, root: str, columns: list[str] | None = None, suffix: str = "", partitions: int = 64, step: int = STEP) -> DataFrame:
    """Header rows of all files below ``root``, as the data source ``imaging_headers`` gives them."""
    ship_package(spark)
    spark.dataSource.register(Headers)
    read = spark.read.format("imaging_headers").option("suffix", suffix).option("partitions", partitions).option("step", step)
    return (read.option("columns", ",".join(columns)) if columns else read).load(root)
