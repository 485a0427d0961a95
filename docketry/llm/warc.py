"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader decompresses incrementally with zlib, takes one gzip member per record, frames the block by
Content-Length and verifies block and payload digests. Archives are files under ``spark.checkpoint.dir``
(any file system that pyarrow opens); a manifest written by Spark names the files of the task attempts that
succeeded, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import bounded_batches, scratch, stash, table

CRLF = b"\r\n"
CHUNK = 1 << 16
#: Tasks that read archives, at most.
READ_TASKS = 100_000
RECORD_ID, NULL_ID = "urn:x-page:", "urn:x-null-page"
#: Payloads held by several pages whose first pages are broadcast; more are joined by shuffle.
BROADCAST_FIRSTS = 200_000


class WarcError(ValueError):
    """An archive that breaks the format; the message says where."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record_member(page_id: object, url: object, payload: bytes, refers_to: object, date: str, level: int) -> bytes:
    """One WARC record as one gzip member. A revisit holds the HTTP head only; its payload is the other record's."""
    head = http_head(len(payload))
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "revisit" if refers_to is not None else "response",
        "WARC-Record-ID": f"<{NULL_ID if page_id is None else RECORD_ID + quote(str(page_id), safe='')}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(str(url), safe="%/:=&?~#+!$,;'@()*[]")
    if refers_to is not None:
        fields["WARC-Refers-To"] = f"<{RECORD_ID}{quote(str(refers_to), safe='')}>"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields["Content-Length"] = str(len(block))
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(top.encode()) + packer.compress(block) + packer.compress(CRLF * 2) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of ``stream`` (a file object), one after the other, read in chunks."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise WarcError("the archive ends within a gzip member")
            try:
                parts.append(unpacker.decompress(rest))
            except zlib.error as error:
                raise WarcError(f"broken gzip member: {error}") from error
            rest = b""
        rest = unpacker.unused_data
        yield b"".join(parts)


def parse_fields(lines: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines.split(CRLF):
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no colon in header line {line[:60]!r}")
        found[name.decode().strip().lower()] = value.decode().strip()
    return found


def parse_record(member: bytes) -> dict:
    """Fields of one record; ``verified`` is false if a digest does not fit what was read."""
    head, found, rest = member.partition(CRLF * 2)
    version, _, lines = head.partition(CRLF)
    if not found or not version.startswith(b"WARC/1."):
        raise WarcError(f"not a WARC record: {member[:40]!r}")
    fields = parse_fields(lines)
    length = int(fields["content-length"])
    if rest[length:] != CRLF * 2:
        raise WarcError(f"Content-Length {length} does not frame a block of {len(rest) - 4} bytes")
    block = rest[:length]
    http, _, payload = block.partition(CRLF * 2)
    declared = fields["warc-payload-digest"].removeprefix("sha1:")
    verified = fields["warc-block-digest"] == f"sha1:{sha1_base32(block)}"
    revisit = fields["warc-type"] == "revisit"
    if not revisit:
        verified = verified and declared == sha1_base32(payload)
    size = int(parse_fields(http.partition(CRLF)[2])["content-length"]) if revisit else len(payload)
    return {"fields": fields, "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": declared, "verified": verified}


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to) as .warc.gz files of about ``roll_bytes`` in ``folder``, a URI; returns (path, records, bytes)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        out = path = None
        records = size = 0
        for pdf in batches:
            for page_id, url, payload, refers_to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                if out is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                member = record_member(page_id, url, bytes(payload), refers_to, date, level)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})

    bounded_batches(pages.sparkSession)
    ids = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", F.col("refers_to").cast("string"))
    return ids.mapInPandas(write, "path string, records long, bytes long")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Rows of the archives named in ``manifest``, each file read from its start to its end by one task.

    Files are dealt to as many tasks as there are files (READ_TASKS at most): the manifest itself is far too small to be split by size.
    """
    schema = "path string, record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, verified boolean"
    schema += ", payload binary" * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        ident = lambda x: x and x.strip("<>")
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        record = parse_record(member)
                        fields = record["fields"]
                        row = (path, ident(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"), ident(fields.get("warc-refers-to")),
                               record["payload_bytes"], record["payload_digest"], record["verified"])
                        rows.append(row + (record["payload"],) * with_payload)
                        held += len(member) if with_payload else 200
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    tasks = min(max(1, manifest.count()), READ_TASKS)
    return manifest.select("path").repartition(tasks).mapInPandas(read, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, broadcast_firsts: int = BROADCAST_FIRSTS, **options) -> tuple[DataFrame, str]:
    """Write ``pages`` as archives; returns the manifest and the folder.

    Of records with equal payloads of at least ``least_bytes``, that with the smallest id is a response and the
    others revisit it; where rows repeat the smallest id, each is a response. Null html is an empty payload; a
    null id comes after all others (a group of null ids only is all responses); a null url leaves the field out.
    Payloads are not shuffled, unless more than ``broadcast_firsts`` different ones are held by several pages. Other columns are not read. An empty table gives an empty manifest.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.concat(F.sha1("payload"), F.lit(":"), F.octet_length("payload").cast("string")))
    # digests and ids alone find the payloads that several pages have; those of one page need no join
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = stash(firsts, "warc-firsts")
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= broadcast_firsts else firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least_bytes)
    rows = rows.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))
    folder = scratch(pages.sparkSession, "warc")
    return stash(write_archives(rows, folder, **options), "warc-manifest"), folder


def page_of(record: Column, kind: str) -> Column:
    """The page id in a record id; null for the record of a null id."""
    return F.when(record.startswith(RECORD_ID), F.expr(f"try_cast(try_url_decode(substring({record._jc.toString()}, {len(RECORD_ID) + 1})) AS {kind})"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest, folder = archive_pages(pages)
    records = read_archives(manifest, folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: page_of(F.col(c), kind).alias(c)
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to"), "verified")


def _base32_sql(digest: str) -> str:
    """SQL for the base32 text of a 40-digit hex string: each five hex digits are four characters."""
    parts = []
    for k in range(0, 40, 5):
        number = f"('0x' || substr({digest}, {k + 1}, 5))::INT"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({number} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f, count(*) OVER (PARTITION BY h) AS n FROM p)
SELECT page_id, payload_bytes, {_base32_sql("h")} AS payload_digest,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to, true AS verified
FROM g
"""
