"""ISO base media containers: write samples, walk boxes, decode sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import as_before

#: Boxes that hold boxes; payload boxes such as mdat are never entered.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Levels of boxes that are entered; files nest about six.
LEVELS = 16
UNIT = 576
RATE = 8000
KEY_EVERY = 16
SAMPLES_PER_CHUNK = 64
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return data + b"\xff" * (-len(data) % unit or (unit if not data else 0))


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """An ISO media file with one sound track of raw 8-bit samples.

    A sample of the track is ``unit`` bytes, the last may be shorter; one in KEY_EVERY is a sync
    sample. The movie box stands before the data.
    """
    n, rest = divmod(len(payload), unit)
    total = n + bool(rest)
    ticks = len(payload)
    starts = np.arange(0, total, SAMPLES_PER_CHUNK, dtype=np.int64) * unit
    keys = np.arange(1, total + 1, KEY_EVERY, dtype=">u4")
    tail = total - (len(starts) - 1) * SAMPLES_PER_CHUNK if total else 0
    chunks = [(1, SAMPLES_PER_CHUNK if len(starts) > 1 else tail)] if total else []
    if len(starts) > 1 and tail != SAMPLES_PER_CHUNK:
        chunks.append((len(starts), tail))
    times = [x for x in ((n, unit), (1, rest)) if x[0] and x[1]]
    sizes = struct.pack(">II", 0 if rest else unit, total) + (np.r_[np.full(n, unit), rest].astype(">u4").tobytes() if rest else b"")
    wide = len(payload) >= (1 << 32) - (1 << 24)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(base: int) -> bytes:
        offsets = (starts + base).astype(">u8" if wide else ">u4").tobytes()
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">I", len(times)), *(struct.pack(">II", *x) for x in times)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(chunks)), *(struct.pack(">III", first, per, 1) for first, per in chunks)),
            _full(b"stsz", sizes),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(starts)), offsets),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        long = lambda *x: struct.pack(">QQ", 0, 0) + b"".join(x)  # noqa: E731  times of creation and change
        mdia = _box(b"mdia", _full(b"mdhd", long(struct.pack(">IQ", RATE, ticks)), struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = _full(b"tkhd", long(struct.pack(">IIQ", 1, 0, ticks)), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", long(struct.pack(">IQ", RATE, ticks)), struct.pack(">ih", 0x10000, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + _box(b"mdat", payload)


@dataclass
class Track:
    """What the tables of one track say; ``offsets``, ``sizes`` and ``times`` (ticks) have an entry for each sample."""

    codec: str
    handler: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    sync: np.ndarray
    times: np.ndarray

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, body start, body end) of every box, to LEVELS of depth; boxes with impossible sizes end their level."""
    levels = [(start, len(data) if end is None else end, path)]
    while levels:
        at, end, path = levels.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            continue
        yield (*path, kind), body, at + size
        levels.append((at + size, end, path))
        if kind in CONTAINERS and len(path) < LEVELS:
            levels.append((body, at + size, (*path, kind)))


def _table(data, body: int, end: int, width: int, kind: str) -> np.ndarray:
    """Entries of a table box: version and flags, a count, then rows of ``width`` numbers."""
    n = min(struct.unpack_from(">I", data, body + 4)[0], (end - body - 8) // (width * np.dtype(kind).itemsize))
    return np.frombuffer(data, kind, n * width, body + 8).reshape(n, width).astype(np.int64)


def _sample_sizes(data, boxes: dict) -> np.ndarray:
    """Sizes by stsz or stz2; a count that the box or the file cannot hold is an error."""
    if b"stz2" in boxes:
        a, b = boxes[b"stz2"]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16) or n * bits > 8 * (b - a - 12):
            raise ValueError("a size table is cut off")
        if bits == 16:
            return np.frombuffer(data, ">u2", n, a + 12).astype(np.int64)
        raw = np.frombuffer(data, np.uint8, (n * bits + 7) // 8, a + 12)
        return (raw if bits == 8 else np.stack([raw >> 4, raw & 15], 1).ravel()[:n]).astype(np.int64)
    a, b = boxes[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    if n * (fixed or 4) > (len(data) if fixed else b - a - 12):
        raise ValueError("more samples than bytes")
    return np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)


def _sample_times(data, boxes: dict, n: int) -> tuple[np.ndarray, int]:
    """Start of each sample and the end of the last, in ticks, by stts; it must tell of every sample."""
    rows = _table(data, *boxes[b"stts"], 2, ">u4")
    if int(rows[:, 0].sum()) != n:
        raise ValueError("the time table is of another number of samples")
    lasts = np.repeat(rows[:, 1], rows[:, 0])
    return np.cumsum(lasts) - lasts, int(lasts.sum())


def _sample_offsets(data, boxes: dict, sizes: np.ndarray) -> np.ndarray:
    chunk = _table(data, *boxes[b"co64"], 1, ">u8")[:, 0] if b"co64" in boxes else _table(data, *boxes[b"stco"], 1, ">u4")[:, 0]
    spread, n = _table(data, *boxes[b"stsc"], 3, ">u4"), len(sizes)
    lengths = np.diff(np.r_[spread[:, 0] - 1, len(chunk)])
    if (lengths < 0).any() or (spread[:, 1] > max(n, 1)).any():
        raise ValueError("chunks out of order")
    per = np.repeat(spread[:, 1], lengths)
    if per.sum() < n:
        raise ValueError("samples without a chunk")
    in_chunk = np.repeat(np.arange(len(per)), np.minimum(per, n))[:n]
    before, first = np.cumsum(sizes) - sizes, np.cumsum(per) - per
    return chunk[in_chunk] + before - before[first[in_chunk]] if n else np.empty(0, np.int64)


def _fragment(data, moof: int, boxes: dict, runs: list, defaults: tuple, at: int):
    """(offsets, sizes, sync marks, lengths) of one movie fragment's samples of a track, from time ``at`` on."""
    a, _ = boxes[b"tfhd"]
    flags, p = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, a + 8
    base, (length, size, mark) = moof, defaults
    if flags & 1:
        base, p = struct.unpack_from(">Q", data, p)[0], p + 8
    p += 4 * bool(flags & 2)
    if flags & 8:
        length, p = struct.unpack_from(">I", data, p)[0], p + 4
    if flags & 16:
        size, p = struct.unpack_from(">I", data, p)[0], p + 4
    if flags & 32:
        mark = struct.unpack_from(">I", data, p)[0]
    out = []
    for a, b in runs:
        flags, n = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
        p, first = a + 8, None
        if flags & 1:
            base_at, p = base + struct.unpack_from(">i", data, p)[0], p + 4
        else:
            base_at = int(out[-1][0][-1] + out[-1][1][-1]) if out and len(out[-1][0]) else base
        if flags & 4:
            first, p = struct.unpack_from(">I", data, p)[0], p + 4
        fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
        if n * (4 * len(fields) or max(size, 1)) > (b - p if fields else len(data)):
            raise ValueError("more samples than bytes")
        rows = np.frombuffer(data, ">u4", n * len(fields), p).reshape(n, len(fields)).astype(np.int64)
        of = lambda f, default: rows[:, fields.index(f)] if f in fields else np.full(n, default, np.int64)
        sizes, marks = of(0x200, size), of(0x400, mark)
        if first is not None and n and 0x400 not in fields:
            marks[0] = first
        out.append((base_at + np.cumsum(sizes) - sizes, sizes, (marks & 0x10000) == 0, of(0x100, length)))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def tracks(data) -> list[Track]:
    """Tracks of an ISO media file, of sample tables and of movie fragments; sample payloads are not read.

    A track whose tables are missing, cut off or at odds with each other or the file is left out; a file
    without any readable track gives none.
    """
    found, extends, fragments, ids = [], {}, [], {}
    for path, a, b in walk(data):
        kind = path[-1]
        try:
            if kind == b"trak":
                found.append({})
            elif kind == b"moof":
                fragments.append((a - 8, []))
            elif kind == b"traf" and fragments:
                fragments[-1][1].append(({}, []))
            elif kind == b"trex":
                extends[struct.unpack_from(">I", data, a + 4)[0]] = struct.unpack_from(">III", data, a + 12)
            elif b"traf" in path and fragments and fragments[-1][1]:
                (boxes, trun) = fragments[-1][1][-1]
                trun.append((a, b)) if kind == b"trun" else boxes.setdefault(kind, (a, b))
            elif found and b"trak" in path:
                found[-1].setdefault(kind, (a, b))
        except struct.error:
            continue
    for boxes in found:
        if b"tkhd" in boxes:
            a, b = boxes[b"tkhd"]
            at = a + (20 if data[a : a + 1] == b"\x01" else 12)
            if at + 4 <= b:
                ids[id(boxes)] = struct.unpack_from(">I", data, at)[0]
    out = []
    for boxes in found:
        try:
            a, _ = boxes[b"mdhd"]
            timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
            a, _ = boxes[b"stsd"]
            codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
            handler = bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1")
            sizes = _sample_sizes(data, boxes)
            times, ticks = _sample_times(data, boxes, len(sizes))
            offsets = _sample_offsets(data, boxes, sizes)
            sync = _table(data, *boxes[b"stss"], 1, ">u4")[:, 0] - 1 if b"stss" in boxes else np.arange(len(sizes))
            mine = ids.get(id(boxes))
            for moof, trafs in fragments:
                for parts, trun in trafs:
                    if b"tfhd" not in parts or struct.unpack_from(">I", data, parts[b"tfhd"][0] + 4)[0] != mine:
                        continue
                    if (got := _fragment(data, moof, parts, trun, extends.get(mine, (0, 0, 0)), ticks)) is not None:
                        sync = np.r_[sync, len(sizes) + np.flatnonzero(got[2])]
                        times = np.r_[times, ticks + np.cumsum(got[3]) - got[3]]
                        offsets, sizes, ticks = np.r_[offsets, got[0]], np.r_[sizes, got[1]], ticks + int(got[3].sum())
            if len(sizes) and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
                raise ValueError("samples outside the file")
            good = sync[(sync >= 0) & (sync < len(sizes))]
            out.append(Track(codec, handler, timescale, duration or ticks, offsets, sizes, good, times))
        except (KeyError, struct.error, ValueError, IndexError, OverflowError, MemoryError):
            continue
    return out


def read_back(data, track: Track) -> bytes:
    """The bytes of a track's samples, in order; neighbours are joined before they are cut out."""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(np.r_[True, track.offsets[1:] != ends[:-1]]) if len(ends) else np.empty(0, int)
    return b"".join(bytes(data[track.offsets[i] : ends[j - 1]]) for i, j in zip(cut, np.r_[cut[1:], len(ends)]))


def describe(track: Track) -> str:
    """Codec, duration and a digest of the keyframes' byte ranges, as one string."""
    ranges = np.stack([track.offsets[track.sync], track.sizes[track.sync]], 1).astype("<i8") if len(track.sync) else np.empty((0, 2), "<i8")
    return f"codec={track.codec};handler={track.handler};duration={track.duration}/{track.timescale};samples={len(track.sizes)};keyframes={len(ranges)};keyframe_bytes={ranges[:, 1].sum()};ranges_crc32={zlib.crc32(ranges.tobytes())}"


def media_columns(media: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Codec, duration and keyframe byte ranges of each file in a binary column, beside ``keep``.

    Adds codec, handler, seconds, n_samples, keyframe_offsets, keyframe_sizes and keyframe_seconds of the
    first readable track. A null, empty or broken file has null codec and no keyframes. One row in, one row
    out, repeated rows too; an empty table gives an empty one. No shuffle.
    """

    @F.pandas_udf("codec string, handler string, seconds double, n_samples long, keyframe_offsets array<long>, keyframe_sizes array<long>, keyframe_seconds array<double>")
    def columns(files: pd.Series) -> pd.DataFrame:
        rows = []
        for f in files:
            t = next(iter(tracks(bytes(f))), None) if f is not None else None
            rows.append((t.codec, t.handler, t.seconds, len(t.sizes), t.offsets[t.sync].tolist(), t.sizes[t.sync].tolist(), (t.times[t.sync] / max(1, t.timescale)).tolist()) if t else (None, None, None, 0, [], [], []))
        return pd.DataFrame(rows, columns=["codec", "handler", "seconds", "n_samples", "keyframe_offsets", "keyframe_sizes", "keyframe_seconds"])

    return media.select(*(keep or []), columns(F.col(content)).alias("m")).select(*(keep or []), "m.*")


def store_texts(docs: DataFrame, unit: int = UNIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text as an ISO media file, read back through its own sample tables.

    Null text is empty and becomes one unit of padding. Equal texts give equal values; repeated rows
    stay; nulls in doc_id pass through; an empty table gives an empty one; other columns are not read. Raises if a stored payload reads back changed. No shuffle; a
    task holds a batch of documents and their files.
    """
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframe_offsets array<long>, keyframe_sizes array<long>"

    def store(batches):
        for b in batches:
            rows = []
            for key, cell in zip(b["doc_id"], b["data"]):
                data = b"" if cell is None else bytes(cell)
                payload = padded(data, unit)
                media = mux(payload, unit)
                (track,) = tracks(media)
                back = read_back(media, track)
                if back != payload:
                    raise ValueError("a stored payload reads back changed")
                rows.append((key, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(track), track.offsets[track.sync].tolist(), track.sizes[track.sync].tolist()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframe_offsets", "keyframe_sizes"])
            out["doc_id"] = b["doc_id"].to_numpy()
            yield out

    stored = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInPandas(store, schema)
    return as_before(stored, {"doc_id": docs.schema[doc_id].dataType})
