"""WARC archives with a Zstandard dictionary made from the archived records themselves.

A file starts with a skippable frame (magic 0x184D2A5D) that embeds the dictionary; each record follows
as a frame of its own, compressed with it. Equal payloads from ``min_revisit`` bytes on are stored once,
under the largest page_id; the others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch, partitions
from tarnlake.llm.storage import new_file, open_file

SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "uri string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def mark_revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that become revisits.

    Only ids and digests move. Copies meet in a partial aggregate; the join back is an equi-join whose
    hot digests adaptive execution can split. Rows that repeat the largest page_id are all responses.
    """
    long_ones = pages.select("page_id", F.sha1(payload().cast("binary")).alias("digest"), F.octet_length(payload()).alias("bytes")).filter(F.col("bytes") >= min_revisit)
    first = long_ones.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = long_ones.join(first, ["digest", "bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return found.select("page_id", "digest", "refers_to").distinct()


def train_dictionary(pages: DataFrame, samples: int = 1000, sample_bytes: int = 16_384, size: int = 112_640) -> bytes:
    """A dictionary from at most ``samples`` records of at most ``sample_bytes`` each: the bound on what
    reaches the driver. They are those of lowest id hash, so any order of rows gives the same. Empty if
    there is too little to learn from."""
    picked = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(samples)
    texts = pages.join(F.broadcast(picked), "page_id", "left_semi").select("page_id", "url", F.substring(payload(), 1, sample_bytes // 4).alias("html"))
    rows = texts.orderBy(F.xxhash64("page_id"), "page_id", F.length("html"), "html").limit(samples).collect()
    records = [render(r.page_id, r.url, r.html.encode(), None, "")[0] for r in rows]
    try:
        return zstandard.train_dictionary(size, records).as_bytes() if len(records) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def page_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def render(page_id: int | None, url: str | None, body: bytes, refers_to: int | None, date: str) -> tuple[bytes, bytes]:
    """(record, SHA-1 of the payload); a revisit holds the HTTP head only."""
    sha = hashlib.sha1(body).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {page_uri(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {page_uri(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", sha


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, min_revisit: int = 1000, date: str = "") -> DataFrame:
    """Write every row as a record; returns the files' manifest (lazy). Payloads move once, by page_id.

    ``date`` is that of all records; unless given, the time of this call. A null html is an empty payload, a null url
    about:blank. Record ids come from page_ids, so rows that repeat a page_id share theirs; null ones are named none.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    digest = F.sha1(payload().cast("binary"))
    marked = mark_revisits(pages, min_revisit).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload().alias("html"), digest.alias("digest"))
    joined = rows.join(marked, rows["page_id"].eqNullSafe(marked["_page"]) & (rows["digest"] == marked["_digest"]), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, uri, n = None, "", 0
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        frames = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if stream is None:
                    uri, stream = new_file(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst")
                    if dictionary:
                        stream.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                record, _ = render(page_id, url, html.as_py().encode(), refers_to, date)
                stream.write(frames.compress(record))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [n]})

    return joined.mapInArrow(write, MANIFEST)


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one file."""
    with open_file(uri) as f:
        magic, size = struct.unpack("<II", f.read(8))
        trained = zstandard.ZstdCompressionDict(f.read(size)) if magic == SKIPPABLE else None
        if trained is None:
            f.seek(0)
        with io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(f, read_across_frames=True), 1 << 18) as s:
            while line := s.readline():
                if line != b"WARC/1.1\r\n":
                    raise ValueError(f"{uri}: a record starts with {line[:40]!r}")
                fields = {}
                while (line := s.readline()) not in (b"\r\n", b""):
                    name, _, value = line.decode().partition(":")
                    fields[name.lower()] = value.strip()
                block = s.read(int(fields["content-length"]))
                if s.read(4) != b"\r\n\r\n":
                    raise ValueError(f"{uri}: a record is cut off")
                yield fields, block


def record_row(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a response's digest is verified."""
    head, _, body = block.partition(b"\r\n\r\n")
    sha = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
    kind = fields["warc-type"]
    if kind == "response" and (hashlib.sha1(body).digest() != sha or len(body) != size):
        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return page_of(fields["warc-record-id"]), size, sha.hex(), kind, refers


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record of the files in the manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = [record_row(*r) for r in read_archive(uri)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("uri").repartition(partitions(manifest.sparkSession), "uri").mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write, then read back: a row for each page, repeated rows and rows without an id too.

    A null html counts as an empty payload; payloads of any length are written whole, each as one frame. An empty table writes
    no file and gives no rows. Other columns take no part.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    dictionary = train_dictionary(pages)
    manifest = scratch.table(write_archives(pages, scratch.path("files"), dictionary, min_revisit), "manifest", keep=True)
    return read_archives(manifest)
