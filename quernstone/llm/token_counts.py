"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import sized_rows

#: Entries of each word cache of a Python worker; a full cache is emptied.
CACHE = 600_000
SPACE = "▁"


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[wire]
            yield number, data[at : at + size]
            at += size


class PieceModel:
    """Merge order of a byte-pair piece model with byte fallback, read from its model file."""

    def __init__(self, path: str):
        self.rank: dict[str, float] = {}
        norm: dict[int, object] = {}
        fallback = False
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    kind = piece.get(3, 1)
                    if kind in (4, 5):
                        raise ValueError("models with user-defined or unused pieces are not supported")
                    if kind == 1:
                        self.rank[piece[1].decode()] = -struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                elif number == 2:
                    fallback = bool(dict(_fields(value)).get(35, 0))
                elif number == 3:
                    norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1) or not fallback:
            raise ValueError("only identity normalisation with a leading space, kept white space and byte fallback is supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("a piece spans words")
        self.newline_alone = not any("\n" in p for p in self.rank)
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merge(self, word: str) -> int:
        """Pieces of one word: initial symbols minus merges.

        The heap holds adjacent pairs whose union is a piece, lowest rank first, then leftmost; a
        linked list holds the symbols. A symbol left over that is no piece costs its UTF-8 bytes.
        """
        rank, n = self.rank, len(word)
        if n == 1:
            return 1 if word in rank else len(word.encode("utf-8", "surrogatepass"))
        end = list(range(1, n + 1))  # a symbol is word[i:end[i]]; end 0 marks one that is merged away
        back = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, 0
            merges += 1
            if to < n:
                back[to] = i
                if (r := rank.get(word[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (h := back[i]) >= 0 and (r := rank.get(word[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        count, i = n - merges, 0
        while i < n:
            if end[i] == i + 1 and word[i] not in rank:
                count += len(word[i].encode("utf-8", "surrogatepass")) - 1
            i = end[i]
        return count

    def word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            got = self.merge(word)
            if len(word) < 64:
                self.words[word] = got
        return got

    def _segments(self, text: str) -> int:
        """``text`` has its spaces written as the space symbol; no merge crosses a segment's ends."""
        pattern = rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.newline_alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return sum(map(self.word, re.findall(pattern, text)))

    def chunk(self, chunk: str) -> int:
        """Pieces of what stands after one space, up to the next."""
        got = self._segments(SPACE + chunk)
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        if len(chunk) < 64:
            self.chunks[chunk] = got
        return got

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return self._segments(SPACE + text.replace(" ", SPACE))
        known, total = self.chunks.get, 0
        for c in text.split(" "):
            got = known(c)
            total += self.chunk(c) if got is None else got
        return total


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; no shuffle.

    Null and empty texts have 0 tokens. Repeated rows give repeated results, an empty table an empty
    one; nulls in doc_id pass through and other columns are not read. Words never merge across a
    space, so counts of words are kept in a bounded cache by worker; a very long text needs memory in
    proportion to itself only.
    """

    @F.pandas_udf("long")
    def tokens(column: pd.Series) -> pd.Series:
        count = piece_model(model_path).count
        return pd.Series([count(bytes(x).decode("utf-8", "replace")) if x is not None else 0 for x in column], dtype="int64")

    counted = docs.select(F.col(doc_id).alias("doc_id"), sized_rows(text).alias("n_bytes"), tokens(F.col(text).cast("binary")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
