"""Packing by best-fit decreasing over the whole corpus.

Pieces of the same length are interchangeable, so best-fit decreasing depends on the histogram of
lengths alone. It is computed once over at most ``window`` lengths; windows with the same remaining
capacity are handled as intervals of sequence numbers. The pieces, distributed, then look up the place
that their rank within their length was given.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quernstone.llm.common import as_before, rank_offsets, running_rank, written

#: Entries of the caches of a Python worker, of chunks and of runs; a full cache is emptied. Runs are fewer than chunks, as
#: they share their entries whatever the case and the marks around them, and it is they that the library is called for.
CHUNKS, HELD = 100_000, 250_000
#: White space to str.split() but not to the tokenizers' patterns.
ODD = re.compile("[\x1c-\x1f]")
#: Latin letters whose normal form and lower case stay within one run of letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
PLAIN = re.compile(f"[\x21-\x26\x28-\x7e{LETTERS}]+")
RUNS = re.compile(f"[{LETTERS}]+|[^{LETTERS}]+")
LETTER = re.compile(f"[{LETTERS}]")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    out = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


BYTES = byte_letters()


class WordIds:
    """Ids of a tokenizer that drops white space, as little-endian unsigned 32-bit bytes.

    No token of such a tokenizer spans white space, so the ids of a text are those of its chunks
    between white space; chunks of plain characters split further where letters meet others. A run of
    letters is one word to the tokenizer, so the library's merges alone give its ids; all else goes
    through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.merge = whole.encode, whole.model.tokenize
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        ids = self.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) >= HELD:
                self.runs.clear()
            if LETTER.match(run):
                word = run.lower() if run.isascii() else "".join([BYTES[b] for b in unicodedata.normalize("NFC", run).lower().encode()])
                ids = [t.id for t in self.merge(word)]
                got = struct.pack(f"<{len(ids)}I", *ids)
            else:
                got = self.library(run)
            if len(run) < 48:
                self.runs[run] = got
        return got

    def chunk(self, chunk: str) -> bytes:
        ascii_ = chunk.isascii()
        if ascii_ and chunk.isalpha():
            got = self.run(chunk.lower())
        elif PLAIN.fullmatch(chunk) and "<|" not in chunk:  # ASCII runs share their entries whatever their case
            got = b"".join(map(self.run, RUNS.findall(chunk.lower() if ascii_ else chunk)))
        else:
            got = self.library(chunk)
        if len(self.chunks) >= CHUNKS:
            self.chunks.clear()
        if len(chunk) < 48:
            self.chunks[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        if ODD.search(text):
            return self.library(text)
        known, out = self.chunks.get, []
        for c in text.split():
            got = known(c)
            out.append(self.chunk(c) if got is None else got)
        return b"".join(out)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class OpenWindows:
    """Segment tree over remaining capacities; a leaf counts the open windows that have it."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.at: list[deque] = [deque() for _ in range(capacity + 1)]

    def push(self, capacity: int, first: int, n: int) -> None:
        """Windows ``first`` to ``first + n`` have ``capacity`` left."""
        self.at[capacity].append((first, n))
        self._add(capacity, n)

    def pop(self, capacity: int, most: int) -> tuple[int, int]:
        first, n = self.at[capacity].popleft()
        if n > most:
            self.at[capacity].appendleft((first + most, n - most))
            n = most
        self._add(capacity, -n)
        return first, n

    def _add(self, capacity: int, n: int) -> None:
        i = self.base + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """Smallest remaining capacity of at least ``size`` that an open window has."""
        i = self.base + size
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Places for pieces by length, and the number of windows.

    A row (length, first rank, windows, first window, offset, pieces) says that pieces of this length
    from this rank on go round these windows: the k-th to window k mod windows, at the offset plus
    (k div windows) times the length. That is best-fit decreasing: a window just filled and still wide
    enough is the tightest for the next piece of the same length.
    """
    tree, rows, opened = OpenWindows(window), [], 0
    for length in sorted((x for x, n in histogram.items() if n and x > 0), reverse=True):
        total, rank = histogram[length], 0
        while rank < total:
            left = tree.tightest(length)
            room = window if left is None else left
            each = room // length
            full, rest = divmod(total - rank, each)
            if left is None:
                for n, per in ((full, each), (1, rest)):
                    if n and per:
                        rows.append((length, rank, n, opened, 0, n * per))
                        if room > per * length:
                            tree.push(room - per * length, opened, n)
                        opened, rank = opened + n, rank + n * per
                continue
            per, most = (each, full) if full else (rest, 1)
            first, n = tree.pop(left, most)
            rows.append((length, rank, n, first, window - left, n * per))
            if room > per * length:
                tree.push(room - per * length, first, n)
            rank += n * per
    return np.asarray(rows, np.int64).reshape(-1, 6), opened


def cut(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text: full windows, then what remains, with their rank by length in a task."""
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        ids = word_ids(tokenizer).ids
        for b in batches:
            row, start, length, crc, total, raw = [], [], [], [], [], []
            for k, cell in enumerate(b["data"]):
                data = ids(bytes(cell).decode("utf-8", "replace") if cell is not None else "") + end
                n = len(data) // 4
                for a in range(0, n, window):
                    piece = data[4 * a : 4 * (a + window)]
                    row.append(k), start.append(a), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                    if with_ids:
                        raw.append(piece)
            out = pd.DataFrame({"doc_id": b["doc_id"].take(row).reset_index(drop=True), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "part": part})
            out["inside"] = running_rank(out["length"].to_numpy(np.int64), seen)
            yield out.assign(ids=raw) if with_ids else out

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, part int, inside long" + ", ids binary" * with_ids
    return as_before(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInPandas(pieces, schema), {"doc_id": docs.schema[doc_id].dataType})


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``with_ids`` the ids (little-endian unsigned 32-bit) of the piece. A document is its token
    ids and ``end_id``; a null or empty text is that id alone. Overlong documents are first cut into
    full windows. Repeated rows are packed each by itself; null doc_ids stay null; an empty table has
    no pieces. Every sequence is padded to ``window``.

    Texts are read once: pieces (without text) become a written table with ranks by length and task.
    Only the histogram of lengths, at most ``window`` rows, reaches the driver, and the places sent
    back are bounded by the window too, not by the input.
    """
    pieces = written(cut(docs, tokenizer, window, end_id, doc_id, text, with_ids), "pieces")
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    rows, _ = best_fit_decreasing(histogram, window)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(rows[order])
    fields = [f for f in pieces.schema if f.name not in ("part", "inside")]

    def place(batches):
        length, rank, n, first, offset, _ = shared.value.T
        scale = int(rank.max(initial=0)) + 1
        for b in batches:
            size, at = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            # ranks of one length are below scale, except past the last run's start
            i = np.searchsorted(length * scale + rank, size * scale + np.minimum(at, scale - 1), "right") - 1
            k = at - rank[i]
            yield b.drop(columns="rank").assign(sequence_id=first[i] + k % n[i], offset=offset[i] + k // n[i] * size)

    schema = ", ".join(f"{f.name} {'string' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    ranked = pieces.join(rank_offsets(pieces, "length"), ["part", "length"])
    placed = ranked.select(*[f.name for f in fields], (F.col("before") + F.col("inside")).alias("rank")).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, schema)
    return as_before(placed, {"doc_id": docs.schema[doc_id].dataType})
