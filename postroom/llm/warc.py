"""WARC archives as seekable Zstandard bundles (operator 3).

Records are grouped into frames that can be decompressed alone.  A bundle is a row of such frames
and, in a skippable frame at its end, a seek table of all frame sizes.  The record index, a
Parquet table, maps every record to its bundle, its frame and its offset within that frame.
Any Zstandard reader can read a bundle from start to end, and any WARC reader what comes out.

Bundles lie in the cluster's shared folder.  A task writes to names of its own attempt, and only
the index rows of the attempt that succeeded are kept, so what a lost executor leaves behind is
never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.registry import prepare, query, table, written
from postroom.session import new_work_dir

#: Uncompressed bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: The given pages carry no fetch time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id bigint, bundle string, frame int, place bigint, size bigint"


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda uri: None if uri == "<urn:x-page:none>" else int(uri[len("<urn:x-page:") : -1])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
        "url": fields["WARC-Target-URI"],
    }


@dataclass
class BundleWriter:
    """Writes records to one seekable bundle; holds one frame at a time."""

    out: object
    frame_bytes: int = FRAME_BYTES
    waiting: list[bytes] = field(default_factory=list)
    size: int = 0
    written: int = 0
    frames: list[tuple[int, int]] = field(default_factory=list)

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset within the frame."""
        if self.waiting and self.size + len(record) > self.frame_bytes:
            self.close_frame()
        place = (len(self.frames), self.size)
        self.waiting.append(record)
        self.size += len(record)
        return place

    def close_frame(self) -> None:
        import zstandard

        packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(b"".join(self.waiting))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.waiting:
            self.close_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Reads single frames by the seek table; keeps the last frame."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        source.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", source.read(8 * n)))
        self.sizes, self.starts, at = sizes, [], 0
        for packed, _ in sizes:
            self.starts.append(at)
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, place: int, size: int) -> bytes:
        import zstandard

        if self.last[0] != frame:
            self.source.seek(self.starts[frame])
            packed = self.source.read(self.sizes[frame][0])
            self.last = (frame, zstandard.ZstdDecompressor().decompress(packed))
        return self.last[1][place : place + size]


def _open(path: str):
    """File system and path, for any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload (binary), digest (hex), refers_to and revisit.

    Only ids and digests are grouped and joined; the least id of a digest is counted in the tasks
    first.  Revisits are then matched to their pages by id and digest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    narrow = own.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= least_bytes)
    least = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
    least = written(least.where("copies > 1 and refers_to is not null").select("digest", "refers_to"), "payloads")
    # Not equal also where the id is null; of repeated rows with the least id each is a response.
    revisits = narrow.join(least, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = written(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct(), "revisits")
    own = own.withColumn("digest", F.sha1("payload"))
    joined = own.join(revisits, own["page_id"].eqNullSafe(revisits["p"]) & (own["digest"] == revisits["d"]), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to", F.col("d").isNotNull().alias("revisit"))


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder`` and return the record index, itself written.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the least page_id
    is a response and the others are revisits of it; smaller ones are all responses.  Null html is
    an empty payload.  Rows whose id is null follow all others; if all of them are null they are all
    responses, as are repeated rows of the least id.  No rows write nothing; other columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        writer, name, opened = None, "", 0
        for batch in batches:
            out: list[tuple] = []
            for i, url, payload, digest, refers, revisit in zip(*(batch.column(c) for c in range(6)), strict=True):
                if writer is None or writer.written >= bundle_bytes:
                    if writer is not None:
                        writer.close()
                    name = f"bundle-{context.partitionId():06d}-{context.taskAttemptId()}-{opened}.warc.zst"
                    writer, opened = BundleWriter(system.open_output_stream(f"{base}/{name}", compression=None), frame_bytes), opened + 1
                page_id, digest = i.as_py(), base32_digest(digest.as_py())
                record = record_bytes(page_id, url.as_py(), payload.as_py(), digest, refers.as_py(), revisit.as_py())
                out.append((page_id, name, *writer.add(record), len(record)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            names = ["page_id", "bundle", "frame", "place", "size"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        if writer is not None:
            writer.close()

    marked = mark_revisits(pages, least_bytes)
    return written(marked.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, _INDEX), "record-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of the index rows: fields of ``parse_record``; the payload only if asked for.

    A response's length and digest come from the payload read back, and must equal its header's.
    Rows next to each other share the decompressed frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        name, reader = None, None
        for batch in batches:
            out = []
            for bundle, frame, place, size in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if bundle != name:
                    name, reader = bundle, BundleReader(system.open_input_file(f"{base}/{bundle}"))
                r = parse_record(reader.record(frame, place, size))
                if r["payload"] is not None:
                    digest = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                    if (digest, len(r["payload"])) != (r["payload_digest"], r["payload_bytes"]):
                        raise ValueError(f"payload of {r['page_id']} in {bundle} differs from its header")
                out.append(r)
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
            kinds |= {"url": pa.string(), "payload": pa.binary()} if with_payload else {}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in kinds.items()], list(kinds))

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return index.select("bundle", "frame", "place", "size").mapInArrow(run, ddl + ", url string, payload binary" * with_payload)


_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast((cast('0x' || h[5 * (i // 4) + 1:5 * (i // 4) + 5] as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31 as integer) + 1]), '')"""
ORACLE = f"""with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h,
    min(page_id) over (partition by coalesce(html, '')) as least
  from pages
)
select page_id, payload_bytes, {_BASE32} as payload_digest,
  case when least is null or page_id = least then 'response' else 'revisit' end as record_type,
  case when least is null or page_id = least then null else least end as refers_to
from p"""


@query("op3_warc", ORACLE)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_work_dir(spark, "warc")
    return read_records(write_bundles(table(spark, sf_dir, "pages"), folder), folder)
