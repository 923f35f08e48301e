"""Web archives: pages are written as WARC records and read back, long ones in segments.

A payload travels as a chunked HTTP response. A block longer than a segment is cut: the first piece is the response record,
the others are continuation records that name it as their origin, and the last tells the total length. Reading groups
continuations by origin, orders them by segment number, checks the total length and takes the chunk framing off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import materialise, scratch_path

#: Bytes of a block per record, and of a payload per chunk.
SEGMENT, CHUNK = 32 << 10, 8 << 10
#: Records per archive file, which is read as a whole: 32 MB at most, and headers.
RECORDS = 1000
#: Payloads from this size on are written once.
LEAST = 100
# Names of the archive format.
VERSION, NEWLINE = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes that do not cut through a character."""
    at = 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[at:stop]
        at = stop


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cuts(payload, size)) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are dropped, a broken frame is an error."""
    out, at = [], 0
    while True:
        line = framed.index(NEWLINE, at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        out.append(framed[at:at + size])
        if framed[at + size:at + size + 2] != NEWLINE:
            raise ValueError("chunk is not closed")
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record up to its block; the two line ends that follow it are the writer's."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None), b"Content-Length: %d" % len(block)]
    return NEWLINE.join(lines) + NEWLINE * 2 + block


def page_records(name: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    def http(extra: str) -> bytes:
        return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{extra}\r\n\r\n".encode()

    common = [("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe=":/?&=#%+,;@~!$'()*[]"))]
    about = [*common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("X-Page-ID", page)]
    if refers is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", PROFILE),
                      ("WARC-Refers-To", f"<urn:page:{refers}>"), *about], http(f"Content-Length: {len(payload)}"))
        return
    block = http("Transfer-Encoding: chunked") + chunked(payload)
    parts = list(cuts(block, SEGMENT))
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about,
                  ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{i}>"), *common, ("WARC-Segment-Origin-ID", name),
                      ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            out = []
            for row in batch.slice(at, 500).to_pylist():
                payload = (row["html"] or "").encode()
                name = f"<urn:record:{task}-{n}>"
                n += 1
                out += page_records(name, row["page_id"], row["url"], payload, row["digest"], row["refers_to"])
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``(page_id, url, html)`` as archives below ``path``, a table folder that driver and executors share.

    Of rows with equal payloads of at least ``LEAST`` bytes those with the smallest page_id are responses, the others
    revisits of it; a row without page_id is never referred to. A null html is an empty payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).alias("size"))
    copies = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(
        F.count("*").alias("times"), F.min("page_id").alias("first")).where("times > 1").select("digest", "first")
    typed = rows.join(materialise(copies, "warc-copies"), "digest", "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    (typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write, "value string")
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).text(path))


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def number(self, name: str) -> int | None:
        value = self.headers.get(name, "")
        return int(value) if value.lstrip("-").isdigit() else None


def records(data: bytes) -> Iterator[Record]:
    """The records of one archive file, by their own lengths; header names are lower case."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(headers["content-length"])
        yield Record(headers, data[stop + 4:stop + 4 + length])
        at = stop + 4 + length + 4


PIECES = ("origin string, segment bigint, total bigint, type string, page_id bigint, digest string, refers_to bigint, block binary, "
          "payload_bytes bigint, complete boolean")
PIECE_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(),
               pa.bool_()]


def _read(payloads: bool):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, PIECE_KINDS)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for r in records(content.as_buffer().to_pybytes()):
                    refers = r.headers.get("warc-refers-to", "")[len("<urn:page:"):-1]
                    piece = {"origin": r.headers.get("warc-segment-origin-id", r.headers["warc-record-id"]),
                             "segment": r.number("warc-segment-number"), "total": r.number("warc-segment-total-length"),
                             "type": r.headers["warc-type"], "page_id": r.number("x-page-id"),
                             "digest": r.headers.get("warc-payload-digest", "").removeprefix("sha256:"),
                             "refers_to": int(refers) if refers else None, "block": r.block}
                    if piece["segment"] is None:
                        done = assemble([piece | {"segment": 1}])
                        piece |= {"block": done["payload"] if payloads else None, "payload_bytes": done["payload_bytes"],
                                  "complete": done["complete"]}
                    rows.append(piece)
                    if len(rows) >= 200:
                        yield packed(rows)
                        rows = []
                yield packed(rows)

    return read


def decode(block: bytes) -> tuple[bytes | None, int]:
    """Payload and its length from an HTTP response; without a body only the length its headers give."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(NEWLINE)[1:])}
    if headers.get(b"transfer-encoding") == b"chunked":
        payload = dechunked(body)
        return payload, len(payload)
    if body or headers.get(b"content-length") in (None, b"0"):
        return body, len(body)
    return None, int(headers[b"content-length"])


def assemble(pieces: list[dict]) -> dict:
    """A page from its records in order of segment number; ``complete`` is false if some are missing or do not add up."""
    first = pieces[0]
    out = {k: first[k] for k in ("page_id", "digest", "refers_to")} | {"record_type": first["type"], "payload": None, "payload_bytes": None}
    block = b"".join(p["block"] for p in pieces)
    whole = [p["segment"] for p in pieces] == list(range(1, len(pieces) + 1)) and first["type"] != "continuation"
    whole = whole and (len(pieces) == 1 or pieces[-1]["total"] == len(block))
    if whole:
        try:
            out["payload"], out["payload_bytes"] = decode(block)
        except ValueError:
            whole = False
    if out["payload"] is not None:
        whole = whole and hashlib.sha256(out["payload"]).hexdigest() == out["digest"]
    return out | {"complete": whole}


PAGES = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, complete boolean, "
         "payload binary")


def _assemble(payloads: bool):
    names = [x.split()[0] for x in PAGES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def page(pieces: list[dict]) -> dict:
        first = pieces[0]
        if first["segment"] is None:
            return first | {"record_type": first["type"], "payload_digest": first["digest"], "payload": first["block"]}
        done = assemble(pieces)
        return done | {"payload_digest": done["digest"], "payload": done["payload"] if payloads else None}

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                done = []
                for row in batch.slice(at, 500).to_pylist():
                    if held and held[0]["origin"] != row["origin"]:
                        done.append(page(held))
                        held = []
                    held.append(row)
                yield packed(done)
        if held:
            yield packed([page(held)])

    return gather


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All pages of the archives below ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, complete, payload``.

    Pages of one record are decoded where they are read; segments are brought together by origin and put in order.
    A revisit has no payload, and its length is the one its HTTP headers give. Without ``payloads`` that column is null and bytes
    that have been checked are not carried on. Folders without archives give an empty result.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    pieces = files.select("content").mapInArrow(_read(payloads), PIECES)
    return pieces.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_assemble(payloads), PAGES)


def round_trip(pages: DataFrame, path: str | None = None, payloads: bool = True) -> DataFrame:
    """Write pages as archives, in the session's scratch folder if no path is given, and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads)
