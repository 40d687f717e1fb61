"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes``; each frame is compressed on its own. A bundle ends
with the seek table of the Zstandard seekable format (a skippable frame with the sizes of all frames), so any
frame is found from the end of the file, and plain Zstandard tools read the bundle as one stream. The index, a
table, maps each record to its bundle, frame and offset in the frame.

A record whose payload (of at least ``least_bytes``) equals that of a page with a smaller id is a ``revisit`` of that page: it
carries the HTTP head, with the length of the payload, and the digest, but no payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkaudit.llm.common import shared_folder, stored
from linkaudit.llm.files import new_file, open_file

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:linkaudit:warc")
INDEX = "page_id long, folder string, file string, frame int, offset long, length long"


def record_id(page_id: int | None) -> str:
    """The record id of a page, always the same."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def clean_url(url: str | None, page_id: int | None) -> str:
    """A target that fits in a header line; a page without address gets a name."""
    kept = re.sub(r"[\x00-\x20\x7F-\x9F  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    return kept or f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {clean_url(url, page_id)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, the declared length of the payload, and the payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    http, _, body = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return {"fields": fields, "declared": declared, "payload": body if fields["WARC-Type"] == "response" else None}


class BundleWriter:
    """Groups records into frames of a bundle; memory holds one frame and the frame sizes."""

    def __init__(self, stream, frame_bytes: int, level: int):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.waiting, self.n_waiting = [], 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """Returns the frame and the offset in it; a frame is closed before a record that would take it beyond its size."""
        if self.waiting and self.n_waiting + len(data) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.n_waiting
        self.waiting.append(data)
        self.n_waiting += len(data)
        return place

    def _flush(self) -> None:
        packed = self.pack(b"".join(self.waiting))
        self.stream.write(packed)
        self.frames.append((len(packed), self.n_waiting))
        self.waiting, self.n_waiting = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(foot)) + entries + foot)
        self.stream.close()


class BundleReader:
    """Reads frames of a bundle by its seek table; the last frame is kept."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE or flags:
            raise ValueError("not a seekable bundle")
        source.seek(size - 9 - 8 * n)
        self.places, at = [], 0
        for packed, plain in struct.iter_unpack("<II", source.read(8 * n)):
            self.places.append((at, packed, plain))
            at += packed
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, plain = self.places[k]
            self.source.seek(at)
            self.last = k, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def with_first_pages(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``first``: the smallest id with an equal payload, if that is another page.

    Two rows with that smallest id are both the first; a null id is first only where there is no other. Payloads
    that occur once, and short ones, take no part in the join.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    # the first column of that name, whatever its case and type
    named = [c for c in pages.columns if c.lower() == "url"]
    url = F.col(f"`{named[0]}`").cast("string") if named else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("long", F.length("payload") >= least_bytes)
    groups = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").select("digest", "first", F.lit(True).alias("long")), "copies")
    first = F.when(F.col("first") != F.coalesce("page_id", F.lit(-1).cast("long") + F.col("first") + 2), F.col("first"))
    return rows.join(groups, ["digest", "long"], "left").select("page_id", "url", "payload", "digest", first.alias("first"))


def write_bundles(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100,
    frame_bytes: int = 1 << 18, level: int = 3, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for each page and return the index: page id, folder, bundle, frame, offset and length.

    Each task writes one bundle. The index keeps the bundles of successful attempts only.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = with_first_pages(pages, id_col, html_col, least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, ""
        for batch in batches:
            out = []
            for page_id, url, payload, digest, first in zip(*(c for c in batch.columns)):
                if writer is None:
                    name, stream = new_file(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst")
                    writer = BundleWriter(stream, frame_bytes, level)
                page = page_id.as_py()
                data = record(page, url.as_py(), payload.as_py(), digest.as_py(), first.as_py(), date)
                out.append((page, folder, name, *writer.add(data), len(data)))
            if out:
                types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "folder", "file", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return stored(rows.mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """One row per record of the index, from the bundles: page id, length and SHA-256 of the full payload, type and referred page.

    A response's length and digest are those of the payload that is read; a revisit's are in its heads.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, source = None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at != (row["folder"], row["file"]):
                    if source is not None:
                        source.close()
                    at = row["folder"], row["file"]
                    source = open_file(*at)
                    reader = BundleReader(source)
                found = parse(reader.record(row["frame"], row["offset"], row["length"]))
                fields, body = found["fields"], found["payload"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if body is not None:
                    digest = hashlib.sha256(body).hexdigest()
                size = found["declared"] if body is None else len(body)
                page, other = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                out.append((int(page) if page else None, size, digest, fields["WARC-Type"], int(other) if other else None))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    # a frame's records stay together and in order; a bundle is spread over tasks by frame
    spread = index.repartition(F.col("file"), F.floor(F.col("frame") / 16)).sortWithinPartitions("file", "frame", "offset")
    return spread.mapInArrow(read, schema)


def written_and_read(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """One row per page, read back from the bundles: its id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A null page is an empty payload; empty and short payloads are always responses; rows that repeat the smallest id of a payload are
    all responses; null addresses get a name; an empty table writes nothing and gives an empty result. Further
    columns are ignored. Ids are whole numbers.
    """
    return read_records(write_bundles(pages, id_col=id_col, **options)).withColumnRenamed("page_id", id_col)
