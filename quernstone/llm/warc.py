"""WARC archives: writing with revisit records, and a reader that salvages what is left."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quernstone.llm.common import BROADCAST_ROWS, as_text, spread_join, written

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of records after which a writer begins its next archive.
ARCHIVE_BYTES = 8 << 20
VERSION_BYTES = len(b"WARC/1.0\r\n")
#: Bytes of an archive that are inflated at a time.
WINDOW = 1 << 15
DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head alone and the payload's length in a header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace")
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member of its own, the same bytes at any time."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("content-type", "") else self.block


@dataclass
class Salvage:
    """Records that passed their checks, and the byte gaps (start, end, reason) that did not."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _one(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record whose version line stands at ``at``, where it ends, and what failed."""
    if not (m := VERSION.match(data, at)):
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        return None, at, "headers have no end"
    if VERSION.search(data, m.end(), stop):
        return None, at, "another record begins inside the headers"
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon and line:
            return None, at, "a header line has no colon"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        return None, at, "no content length"
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "the block does not end where its length says"
    found = Record(headers, data[begin:end], at)
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:") and digest[5:] != payload_digest(found.payload):
        return None, at, "the payload does not match its digest"
    return found, end + 4, ""


def _plain(data: bytes, base: int, out: Salvage, compressed: bool) -> None:
    """Records of a member's bytes; after a failed check the next version line is searched for."""
    at = 0
    while at < len(data):
        found, end, why = _one(data, at)
        if found:
            found.offset = base if compressed else at
            out.records.append(found)
            at = end
            continue
        nxt = VERSION.search(data, at + 1)
        end = nxt.start() if nxt else len(data)
        out.gaps.append((base, base, f"inside the member, bytes {at} to {end}: {why}") if compressed else (at, end, why))
        at = end


def _inflate(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The gzip member at ``at`` and its end; nothing if it is broken or does not begin with a version line.

    Members of any size are taken; one without a version line is left at its first bytes.
    """
    if data[at : at + len(MAGIC)] != MAGIC:
        return None, at
    z, parts, pos, head = zlib.decompressobj(31), [], at, b""
    try:
        while not z.eof and pos < len(data):
            parts.append(z.decompress(data[pos : pos + WINDOW]))
            pos += WINDOW
            if len(head) < VERSION_BYTES:
                head += parts[-1][:VERSION_BYTES]
                if len(head) >= VERSION_BYTES and not VERSION.match(head):
                    return None, at
    except zlib.error:
        return None, at
    whole = z.eof and VERSION.match(head)
    return (b"".join(parts), min(pos, len(data)) - len(z.unused_data)) if whole else (None, at)


def salvage(data: bytes) -> Salvage:
    """All records of an archive that pass their checks, and the gaps.

    At each place stands a gzip member that inflates whole and begins with a version line, or a plain
    record. After a failed check the nearer of the next such member and the next plain record that passes
    its checks is searched for in all remaining data, and the bytes between are a gap; inside of members
    the next version line. Checks: version line, headers, content length, end of block, payload digest.
    Empty input has neither records nor gaps.
    """
    out, at = Salvage(), 0
    gap, why, magic, line = None, "", 0, 0

    def after(x: int, find) -> int:
        """The place found before, if it is still ahead; the end of the data if there is none."""
        if x > at:
            return x
        x = find(at + 1)
        return x if x >= 0 else len(data)

    def close(end: int) -> None:
        nonlocal gap
        if gap is not None:
            out.gaps.append((gap, end, why))
            gap = None

    while at < len(data):
        got, end = _inflate(data, at)
        if got is not None:
            close(at)
            _plain(got, at, out, True)
            at = end
            continue
        found, end, failed = _one(data, at)
        if found:
            close(at)
            out.records.append(found)
            at = end
            continue
        version = failed != "no version line"
        if gap is not None and version:
            close(at)
        if gap is None:
            gap, why = at, failed if version else "no whole member"
        magic = after(magic, lambda x: data.find(MAGIC, x))
        line = after(line, lambda x: m.start() if (m := VERSION.search(data, x)) else -1)
        at = min(magic, line)
    close(len(data))
    return out


def _urn(page_id) -> str:
    return f"urn:page:{'' if pd.isna(page_id) else page_id}"


def _page(urn: str | None) -> int | None:
    """The page of a record's id; none for other ids and numbers that no long holds."""
    tail = (urn or "").strip("<>").removeprefix("urn:page:")
    return number if re.fullmatch(r"-?[0-9]{1,19}", tail) and -(1 << 63) <= (number := int(tail)) < 1 << 63 else None


def _length(value: str | None) -> int | None:
    """A header's count of bytes, or nothing if it is none."""
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value or "") else None


def archive_pages(pages: DataFrame, least: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pages as archives: a table (archive, content) of compressed WARC files of bounded size.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is a
    response and the others are revisits; smaller ones are all responses. Null html is an empty
    payload. Rows equal in page_id and payload are all responses, and so are pages whose digest has
    only null ids. Page ids are whole numbers; of another type they are an error. An empty table gives no archives; other columns are not read.

    Bodies are not shuffled: the first page of each repeated digest is found by a partial aggregate over
    (page_id, digest, size) and looked up where the bodies are read, by a broadcast up to a counted bound.
    Beyond it bodies are dealt by digest and a salt, so a payload of a third of the pages is cut too.
    """
    if pages.schema["page_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"page_id is {pages.schema['page_id'].dataType.simpleString()}; record ids have to be whole numbers: number the rows, and join back")
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), body.alias("body"))
    digests = pages.select("page_id", F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("size"))
    first = digests.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("seen"), "first_id")
    joined = spread_join(rows.withColumn("digest", F.unhex(F.sha1("body"))), "page_id", written(first, "warc-first"), {"digest": "seen"}, broadcast_rows)

    def write(batches):
        part, n, size, out = TaskContext.get().partitionId(), 0, 0, []

        def flush():
            nonlocal n, size, out
            done = pd.DataFrame({"archive": [f"pages-{part:06d}-{n:06d}.warc.gz"], "content": [b"".join(out)]})
            n, size, out = n + 1, 0, []
            return done

        for b in batches:
            for page_id, url, payload, first_id in zip(b["page_id"], b["url"], b["body"], b["first_id"]):
                payload = bytes(payload)
                page_id, first_id = (None if x is None else int(x) for x in (page_id, first_id))
                again = first_id is not None and page_id != first_id
                out.append(member(record("revisit" if again else "response", _urn(page_id), url.replace("\r", " ").replace("\n", " "), payload, payload_digest(payload), _urn(first_id) if again else None)))
                size += len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if out:
            yield flush()

    return joined.select(*as_text(joined, "page_id"), "url", "body", *as_text(joined, "first_id")).mapInPandas(write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives (archive, content), as of a binaryFile scan, salvaged; gaps as rows too.

    record_type is the WARC type, or ``gap`` for quarantined bytes, whose start, end and reason stand
    in gap_start, gap_end and gap_reason. Empty and null contents give no rows. Page ids and lengths that
    are no numbers of 64 bits are null.
    """
    schema = "archive string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, gap_start long, gap_end long, gap_reason string"

    def read(batches):
        for b in batches:
            for name, content in zip(b["archive"], b["content"]):
                got, rows = salvage(b"" if content is None else bytes(content)), []
                for r in got.records:
                    h, kind = r.headers, r.headers.get("warc-type")
                    if kind == "revisit":
                        size, digest = _length(h.get("warc-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    else:
                        size, digest = len(r.payload), payload_digest(r.payload)
                    rows.append((name, kind, _page(h.get("warc-record-id")), h.get("warc-target-uri"), size, digest, _page(h.get("warc-refers-to")), None, None, None))
                rows += [(name, "gap", None, None, None, None, None, *gap) for gap in got.gaps]
                names = [x.split() for x in schema.split(", ")]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pd.DataFrame({n: pd.array(c, "Int64") if t == "long" else pd.Series(c, dtype=object) for (n, t), c in zip(names, columns, strict=True)})

    return archives.select("archive", "content").mapInPandas(read, schema)


def round_trip(pages: DataFrame, least: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back, a row per page.

    Records are written as a table, gaps too; bytes that the reader quarantined are an error, as nothing
    that was just written may be lost.
    """
    archives = written(archive_pages(pages, least, broadcast_rows), "warc")
    read = read_archives(archives)
    lost = F.raise_error(F.concat(F.lit("quarantined bytes in "), "archive", F.lit(": "), "gap_reason"))
    kind = F.when(F.col("record_type") == "gap", lost.cast("string")).otherwise(F.col("record_type"))
    return read.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")
