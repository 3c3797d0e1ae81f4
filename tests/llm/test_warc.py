from __future__ import annotations

import base64
import hashlib
import io
from pathlib import Path

import pyarrow as pa
import zstandard

from postroom.llm import warc
from postroom.llm.registry import QUERIES


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(pages) -> list[tuple]:
    least: dict = {}
    for i, html in pages:
        p = (html or "").encode()
        if i is not None:
            least[p] = min(i, least.get(p, i))
    out = []
    for i, html in pages:
        p = (html or "").encode()
        first = least.get(p)
        revisit = first is not None and i != first
        out.append((i, len(p), digest(p), "revisit" if revisit else "response", first if revisit else None))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v) for v in r[:1]) + tuple(map(str, r)))


def test_query_matches_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert ordered(QUERIES["op3_warc"](spark, sf).collect()) == ordered(plain(pages))


def test_nulls_copies_repeats_and_round_trip(spark, tmp_path):
    pages = [
        (5, "same"), (3, "same"), (9, "same"), (3, "same"), (None, "same"), (1, None), (2, ""), (None, "alone"), (None, "alone"),
        (7, "é\r\n\r\n\0😀"), (8, "x" * 3_000_000), (-4, "minus"), (4, "minus"),
    ]
    rows = [(i, f"http://a/{i}\r\nInjected: 1 é" if i else None, h, "c", 1) for i, h in pages]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, frame int")
    index = warc.write_bundles(df, str(tmp_path), frame_bytes=300)
    got = warc.read_records(index, str(tmp_path), with_payload=True).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert ordered([r[f] for f in fields] for r in got) == ordered(plain(pages))
    texts = {h.encode() for _, h in pages if h}
    assert {bytes(r.payload) for r in got if r.payload} == texts
    larger = warc.read_records(warc.write_bundles(df, str(tmp_path), least_bytes=5), str(tmp_path)).collect()
    assert all(r.record_type == "response" for r in larger if r.payload_bytes < 5)
    assert sum(r.record_type == "revisit" for r in larger) == 1
    assert warc.read_records(warc.write_bundles(df.limit(0), str(tmp_path)), str(tmp_path)).collect() == []


def test_any_reader_can_read_a_bundle_and_any_frame_alone(tmp_path):
    path = tmp_path / "b.warc.zst"
    records = [warc.record_bytes(i, f"http://h/{i}", b"body %d" % i * i, digest(b"body %d" % i * i), None, False) for i in range(40)]
    writer = warc.BundleWriter(path.open("wb"), frame_bytes=2000)
    places = [writer.add(r) for r in records]
    writer.close()
    assert len({f for f, _ in places}) > 3
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
    assert whole == b"".join(records)
    reader = warc.BundleReader(pa.OSFile(str(path)))
    assert sum(n for _, n in reader.sizes) == len(whole)
    for (frame, place), record in reversed(list(zip(places, records, strict=True))):
        assert reader.record(frame, place, len(record)) == record


def test_bundles_roll_over(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write_bundles(pages, str(tmp_path), frame_bytes=4096, bundle_bytes=20_000)
    assert len(list(Path(tmp_path).glob("*.warc.zst"))) > 2
    assert warc.read_records(index, str(tmp_path)).count() == pages.count()
