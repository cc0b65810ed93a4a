"""Operator 3, WARC archives compressed with a dictionary.

An archive is a skippable Zstandard frame holding the dictionary and then one
frame for each record, so any record can be read alone. Archives are kept as
rows (archive, content) of a Parquet table in a shared folder: executors only
have Spark's own writers for a store that need not be a local path. Their
content is that of a .warc.zst file, which `export` writes out as such.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BATCH_ROWS, by_bytes, freeing, stash

#: Fixed values of the format: the magic number of a dictionary's skippable frame and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Bytes of payload after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Records, and bytes of each, that the dictionary is built from; its own size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 64 << 10
LEVEL = 6


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, record_id: str, date: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its digest and length are the full payload's."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; with too few of them to train on, their raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


class Writer:
    """Archive bytes, record by record."""

    def __init__(self, dictionary: bytes):
        self.parts = [dictionary_frame(dictionary)]
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def add(self, raw: bytes) -> None:
        self.parts.append(self.compressor.compress(raw))

    def close(self) -> bytes:
        return b"".join(self.parts)


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, each decompressed by itself with the leading frame's dictionary."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    dictionary = content[8 : 8 + size]
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = memoryview(content)[8 + size :]
    while len(rest):
        one = d.decompressobj()
        raw = one.decompress(rest)
        yield parse(raw)
        rest = rest[len(rest) - len(one.unused_data) :] if one.unused_data else rest[:0]


def _key(page_id) -> str:
    return "null" if pd.isna(page_id) else str(int(page_id))


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(payload_digest, payload_bytes, first) of payloads that several page ids share: first is the smallest page_id."""
    shared = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return shared.where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives (archive, content) of all pages, already written to the shared folder.

    pages: page_id, url, html; other columns are not read. Null html is an
    empty payload, a null url an empty URI. Among equal payloads of at least
    `least` bytes the smallest page_id is the response and the others revisit
    it; rows that share that smallest page_id are all responses, rows without
    a page_id revisit it, or are responses if none of their group has one.
    An empty table gives no archives. Only (page_id, digest, size) meet in a
    group, so a payload that a third of the pages share is no hot task: the
    join's large side is split by Spark.
    """
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    slim = stash(own.select("page_id", F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"), F.xxhash64("page_id", "url").alias("order")))
    firsts = stash(revisits(slim, least))
    again = slim.join(firsts, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select("payload_digest", "page_id", "first").distinct()
    # sampled records are bounded in number and size
    sample = own.join(slim.orderBy("order").limit(SAMPLE_RECORDS).select("page_id"), "page_id", "left_semi").select(F.substring("payload", 1, SAMPLE_BYTES).alias("p")).limit(2 * SAMPLE_RECORDS).collect()
    dictionary = train([record("response", "https://example.com/", "<urn:page:0>", "2024-01-01T00:00:00Z", bytes(r.p), sha1_base32(b""), len(r.p)) for r in sample])
    date = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held = None, 0
        for b in by_bytes(batches, 2):
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = w or Writer(dictionary)
                uri = url.replace("\r", "%0D").replace("\n", "%0A")
                args = (uri, f"<urn:page:{_key(page_id)}>", date)
                digest, size = sha1_base32(payload), len(payload)
                w.add(record("response", *args, payload, digest, size) if first is None else record("revisit", *args, b"", digest, size, f"<urn:page:{first}>"))
                held += size
                if held >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([w.close()], pa.binary())], names=["content"])
                    w, held = None, 0
        if w:
            yield pa.RecordBatch.from_arrays([pa.array([w.close()], pa.binary())], names=["content"])

    keyed = own.withColumn("payload_digest", F.sha1("payload"))
    a, b = keyed.alias("a"), again.alias("b")
    marked = a.join(b, (F.col("a.payload_digest") == F.col("b.payload_digest")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id")), "left").select("a.page_id", "a.url", "a.payload", "b.first")
    return stash(marked.mapInArrow(freeing(archive), "content binary").select(F.format_string("crawl-%012d.warc.zst", F.monotonically_increasing_id()).alias("archive"), "content"), "none", BATCH_ROWS)


def read(archives: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    A response's size and digest are computed from the payload as read; a
    revisit has them in its headers.
    """
    ident = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            for content in b.column(0).to_pylist():
                rows = []
                for h, payload in read_archive(content):
                    full = h["warc-type"] == "response"
                    digest = sha1_base32(payload) if full else h["warc-payload-digest"].removeprefix("sha1:")
                    if full and f"sha1:{digest}" != h["warc-payload-digest"]:
                        raise ValueError("a payload does not match its digest")
                    rows.append((ident(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], len(payload) if full else int(h["warc-payload-length"]), digest, ident(h.get("warc-refers-to"))))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    return stash(archives.select("content").mapInArrow(freeing(records), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"), batch_rows=1)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write the archives as .warc.zst files to a folder that the driver sees, one at a time."""
    from pathlib import Path

    out = []
    for r in archives.toLocalIterator():
        p = Path(folder) / r.archive
        p.write_bytes(r.content)
        out.append(str(p))
    return out


def roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives, read the archives back."""
    return read(write(pages, least))


__all__ = ["Writer", "export", "parse", "read", "read_archive", "record", "roundtrip", "train", "write"]
