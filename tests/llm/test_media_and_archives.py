import gzip
import hashlib
import io
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import gif, warc

DOCS = "doc_id long, text string, feature string, id string, error string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOCS)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 4000, 70_000])
@pytest.mark.parametrize("kinds", [1, 3, 256])
def test_lzw_round_trip(n, kinds):
    draw = random.Random(n + kinds)
    data = bytes(draw.randrange(kinds) for _ in range(n))
    assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def test_lzw_small_code_sizes():
    for minimum in (2, 3, 5):
        data = bytes(k * 7 % (1 << minimum) for k in range(9000))
        assert gif.lzw_decode(gif.lzw_encode(data, minimum), minimum, len(data)) == data


def test_lzw_known_stream():
    # the 10 x 10 sample image of the format's usual description
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    rows = [1] * 5 + [2] * 5
    assert list(gif.lzw_decode(stream, 2, 100)[:10]) == rows


def frame(left, top, w, h, samples, control=b"", flags=0, minimum=2):
    body = gif.chain(gif.lzw_encode(bytes(samples), minimum))
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + bytes([minimum]) + body


def control(disposal=0, transparent=None, delay=5):
    return b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + struct.pack("<HBB", delay, transparent or 0, 0)


def file(*frames, w=2, h=2, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes(sum(map(list, palette), [])) + b"".join(frames) + b"\x3b"


def test_disposal_and_transparency():
    data = file(
        frame(0, 0, 2, 2, [1, 1, 1, 1], control()),
        frame(0, 0, 1, 1, [2], control(disposal=3)),
        frame(1, 1, 1, 1, [3], control(disposal=2)),
        frame(0, 0, 2, 2, [0, 2, 0, 0], control(transparent=0)),
    )
    width, height, frames = gif.decode(data)
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    shown = [[tuple(map(int, p)) for row in canvas for p in row] for canvas in gif.painted(width, height, frames)]
    assert shown == [[red] * 4, [green, red, red, red], [red, red, red, blue], [red, green, red, none]]
    assert [f.delay_ms for f in frames] == [50] * 4


def test_interlaced_rows_come_back_in_order():
    rows = gif.row_order(10, True)
    stored = bytes(int(r) % 4 for r in rows for _ in range(2))
    _, _, frames = gif.decode(file(frame(0, 0, 2, 10, stored, flags=0x40), h=10))
    assert frames[0].samples == bytes(r % 4 for r in range(10) for _ in range(2))


def test_gif_frames_table(spark):
    good = file(frame(0, 0, 2, 2, [1, 1, 2, 0], control(delay=7)), frame(0, 0, 1, 1, [3], control(delay=2)))
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"GIF89a")), (3, bytearray(good[:40])), (4, bytearray(good[:-1]))], "k long, gif binary")
    out = gif.gif_frames(rows, "k", "gif").orderBy("k", "frame").collect()
    assert [(r.k, r.frame, r.start_ms, r.delay_ms) for r in out if r.error is None] == [(1, 0, 0, 70), (1, 1, 70, 20)]
    assert sorted(r.k for r in out if r.error) == [2, 3, 3, 4]
    assert sum(out[0].histogram) == 4 and out[0].histogram[0b110000] == 2
    assert gif.gif_frames(rows.limit(0), "k", "gif").count() == 0
    huge = [b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b", file(frame(0, 0, 65535, 65535, [1]))]
    out = gif.gif_frames(spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(huge)], "k long, gif binary"), "k", "gif").collect()
    assert [r.frame for r in out] == [None, None] and all("65535 x 65535 pixels" in r.error for r in out)


def test_stored_texts(spark):
    texts = {1: "plain", 2: "", 3: None, 4: "é" * 70_000, 5: "plain", 6: "x" * 64}
    rows = gif.stored_texts(docs(spark, [*texts.items(), (None, "y"), (1, "plain")])).collect()
    assert len(rows) == 8
    for r in rows:
        data = (texts.get(r.doc_id, "y") or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        frames = -(-len(payload) // (64 * 512))
        parts = r.feature.split("|")
        assert parts[0].startswith("64x") and parts[0].endswith(f"x{frames}") and [p.split(";")[0] for p in parts[1:]] == [f"{100 * k}+100ms" for k in range(frames)]
        levels = Counter((b >> 5) * 255 // 7 // 64 * 16 + (b >> 2 & 7) * 255 // 7 // 64 * 4 + (b & 3) * 255 // 3 // 64 for b in payload[: 64 * 512])
        assert parts[1].split(";")[1] == ",".join(f"{k}:{n}" for k, n in sorted(levels.items()))
    same = [r for r in rows if r.doc_id in (1, 5)]
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in same}) == 1
    assert gif.stored_texts(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_histogram_counts_opaque_pixels():
    canvas = np.zeros((2, 2, 4), np.uint8)
    canvas[0, 0] = (255, 64, 0, 255)
    assert gif.histogram(canvas)[3 * 16 + 1 * 4] == 1 and gif.histogram(canvas).sum() == 1


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], "page_id long, url string, html string, path string, digest string")


def test_archives_round_trip(spark):
    long = "<p>ä</p>" * 90_000
    rows = [(5, "http://a/x y", "same"), (2, "http://a", "same"), (2, "http://a", "same"), (9, None, None), (8, "u\r\nv", ""), (7, "http://b", long), (None, "n", "same"), (4, "r", "A\r\n\r\nB")]
    manifest, folder = warc.archive_pages(pages(spark, rows), roll_bytes=300)
    assert manifest.count() > 1
    out = warc.read_archives(manifest, folder, with_payload=True).collect()
    assert len(out) == len(rows) and all(r.verified for r in out)
    kinds = sorted((r.record_id.removeprefix("urn:x-page:"), r.record_type, (r.refers_to or "").rpartition(":")[2], r.payload_bytes) for r in out)
    assert kinds == sorted([
        ("5", "revisit", "2", 4), ("2", "response", "", 4), ("2", "response", "", 4), ("urn:x-null-page", "revisit", "2", 4),
        ("9", "revisit", "8", 0), ("8", "response", "", 0), ("7", "response", "", len(long.encode())), ("4", "response", "", 6),
    ])
    assert {bytes(r.payload) for r in out if r.payload is not None} == {b"same", b"", long.encode(), b"A\r\n\r\nB"}
    empty, where = warc.archive_pages(pages(spark, rows).limit(0))
    assert warc.read_archives(empty, where).count() == 0


def test_odd_page_ids(spark):
    ids = ["a b", "null", None, "x\r\ny", "é%41", ""]
    rows = spark.createDataFrame([(i, "u", f"text {k % 2}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    out = warc.read_archives(*warc.archive_pages(rows))
    found = out.select(warc.page_of(F.col("record_id"), "string").alias("i"), warc.page_of(F.col("refers_to"), "string").alias("f")).collect()
    assert Counter((r.i, r.f) for r in found) == Counter((i, want(ids, k)) for k, i in enumerate(ids))


def want(ids, k):
    least = min(i for i in ids[k % 2 :: 2] if i is not None)
    return None if ids[k] == least else least


def test_many_equal_empty_pages(spark):
    """A payload that most pages share is neither shuffled nor met in one task."""
    rows = spark.range(200_000, numPartitions=8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 1000 == 1, F.concat(F.lit("p"), "id")).alias("html"))
    for firsts in (warc.BROADCAST_FIRSTS, 0):
        out = warc.read_archives(*warc.archive_pages(rows, broadcast_firsts=firsts))
        kinds = {(r.record_type, r.refers_to, r.payload_bytes > 0): r["count"] for r in out.groupBy("record_type", "refers_to", "payload_bytes").count().groupBy("record_type", "refers_to", (F.col("payload_bytes") > 0).alias("payload_bytes")).agg(F.sum("count").alias("count")).collect()}
        assert kinds == {("response", None, False): 1, ("revisit", "urn:x-page:0", False): 199_799, ("response", None, True): 200}


def test_each_record_is_one_gzip_member():
    parts = [warc.record_member(k, "u", b"body%d" % k, None, "2024-01-01T00:00:00Z", 6) for k in range(3)]
    assert [warc.parse_record(m)["payload"] for m in warc.members(io.BytesIO(b"".join(parts)))] == [b"body0", b"body1", b"body2"]
    assert gzip.decompress(b"".join(parts)).count(b"WARC/1.1") == 3


def test_broken_archives_are_told():
    member = warc.record_member(1, "u", b"body", None, "2024-01-01T00:00:00Z", 6)
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(member[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(b"not gzip")))
    text = gzip.decompress(member)
    assert not warc.parse_record(text.replace(b"body", b"bodY"))["verified"]
    with pytest.raises(warc.WarcError):
        warc.parse_record(text + b"x")


def test_least_bytes_keeps_small_payloads(spark):
    manifest, folder = warc.archive_pages(pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long one"), (4, "d", "long one")]), least_bytes=5)
    out = warc.read_archives(manifest, folder).groupBy("record_type").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.record_type: r.n for r in out} == {"response": 3, "revisit": 1}
