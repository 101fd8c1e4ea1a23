"""Token ids in patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending doc_id order, as segments of whole documents:

    "TKPF", version u16, block length u16
    segments, each
        blocks: minimum u32, width u8, exceptions u16, ids u16 | packed u64 words | positions u16 | offsets u32
        document table: doc_id i64, null flag u8, first id in the file u64, for each document
        index: start of each block u64
    directory, for each segment: blocks u64, documents u64, first id u64, start of blocks u64, of table u64, of index u64
    segments u64, ids u64, documents u64, start of directory u64, "TKPF"

A block stores each id's offset from the block's minimum in ``width`` bits. The width is that one of a few percentiles
of the offsets' bit lengths which takes the fewest bytes; offsets above it go whole into the exception list. All values
little-endian.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch, partitions
from tarnlake.llm.storage import new_file, open_file
from tarnlake.llm.tokens import ByteEncoder, encoder, little

MAGIC, VERSION = b"TKPF", 2
HEAD, BLOCK, FOOT = struct.Struct("<4sHH"), struct.Struct("<IBHH"), struct.Struct("<QQQQ4s")
DOCUMENT = np.dtype([("id", "<i8"), ("null", "u1"), ("first", "<u8")])
SEGMENT = np.dtype([(name, "<u8") for name in ("blocks", "docs", "first", "at", "table", "index")])
GROUP = 1024  # blocks that are packed or unpacked together
SEGMENT_DOCS, SEGMENT_IDS = 1 << 16, 1 << 22  # a segment ends with the document that reaches either


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, length) values under 2**width to (n, words) u64."""
    n, length = values.shape
    words = -(-length * width // 64)
    out = np.zeros((words + 1, n), dtype=np.uint64)
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    for k in range(length if width else 0):
        word, shift = divmod(k * width, 64)
        out[word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:words].T)


def unpack(words: np.ndarray, width: int, length: int) -> np.ndarray:
    """(n, words) u64 to (n, length) values."""
    n = len(words)
    out = np.zeros((length, n), dtype=np.uint64)
    rows, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for k in range(length if width else 0):
        word, shift = divmod(k * width, 64)
        v = rows[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | rows[word + 1] << np.uint64(64 - shift)
        out[k] = v & mask
    return out.T


class TokenWriter:
    """Streams documents into one file. Memory holds GROUP blocks, one segment's tables and the directory."""

    def __init__(self, stream, length: int = 256, percentiles: tuple[float, ...] = (0.75, 0.9, 0.95, 0.98, 1.0)):
        self._out, self._length, self._ks = stream, length, [int(p * (length - 1)) for p in percentiles]
        self._at, self.ids, self.docs = HEAD.size, 0, 0
        self._segments: list[tuple[int, ...]] = []
        stream.write(HEAD.pack(MAGIC, VERSION, length))
        self._open_segment()

    def _open_segment(self) -> None:
        self._start, self._first = self._at, self.ids
        self._doc_ids, self._nulls, self._firsts, self._index = array("q"), array("B"), array("Q"), array("Q")
        self._held: list[bytes] = []
        self._held_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._doc_ids.append(doc_id or 0)
        self._nulls.append(doc_id is None)
        self._firsts.append(self.ids)
        self.docs += 1
        self.ids += len(ids) // 4
        self._held.append(ids)
        self._held_bytes += len(ids)
        if self._held_bytes >= 4 * self._length * GROUP:
            self._flush(False)
        if len(self._doc_ids) >= SEGMENT_DOCS or self.ids - self._first >= SEGMENT_IDS:
            self._close_segment()

    def _close_segment(self) -> None:
        self._flush(True)
        docs = np.empty(len(self._doc_ids), dtype=DOCUMENT)
        docs["id"], docs["null"], docs["first"] = self._doc_ids, self._nulls, self._firsts
        index = np.array(self._index, dtype="<u8")
        table = self._at
        self._out.write(docs.tobytes())
        self._out.write(index.tobytes())
        self._at += docs.nbytes + index.nbytes
        self._segments.append((len(index), len(docs), self._first, self._start, table, table + docs.nbytes))
        self._open_segment()

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self._held), dtype="<u4")
        whole = len(flat) if last else len(flat) // self._length * self._length
        self._held, self._held_bytes = [flat[whole:].tobytes()], 4 * (len(flat) - whole)
        for k in range(0, whole, self._length * GROUP):
            self._write(flat[k : min(whole, k + self._length * GROUP)])

    def _widths(self, bits: np.ndarray) -> np.ndarray:
        """Of each block's percentile widths the one with the fewest bytes of words and exceptions."""
        ordered = np.partition(bits, self._ks, axis=1)
        widths = ordered[:, self._ks]
        cost = np.empty(widths.shape, dtype=np.int64)
        for k in range(len(self._ks)):
            w = widths[:, k]
            cost[:, k] = 8 * -(-self._length * w.astype(np.int64) // 64) + 6 * np.count_nonzero(bits > w[:, None], axis=1)
        return widths[np.arange(len(bits)), cost.argmin(axis=1)]

    def _write(self, flat: np.ndarray) -> None:
        short = -len(flat) % self._length
        rows = np.concatenate([flat, np.repeat(flat[-1:], short)]).reshape(-1, self._length)
        lowest = rows.min(axis=1)
        offsets = rows - lowest[:, None]
        bits = bit_lengths(offsets)
        widths = self._widths(bits)
        packed: list[bytes] = [b""] * len(rows)
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            kept = np.where(bits[own] > w, 0, offsets[own])
            for k, words in zip(own.tolist(), pack(kept, int(w)), strict=True):
                packed[k] = words.tobytes()
        odd = bits > widths[:, None]
        any_odd, none = odd.any(axis=1), np.empty(0, dtype=np.int64)
        for k, words in enumerate(packed):
            at = np.flatnonzero(odd[k]) if any_odd[k] else none
            n = self._length - (short if k == len(rows) - 1 else 0)
            block = BLOCK.pack(int(lowest[k]), int(widths[k]), len(at), n) + words + at.astype("<u2").tobytes() + offsets[k, at].astype("<u4").tobytes()
            self._index.append(self._at)
            self._at += len(block)
            self._out.write(block)

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        if self._doc_ids:
            self._close_segment()
        self._out.write(np.array(self._segments, dtype=SEGMENT).tobytes())
        self._out.write(FOOT.pack(len(self._segments), self.ids, self.docs, self._at, MAGIC))
        self._out.close()
        return self.docs, self.ids


def read_documents(uri: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, first id in the file, number of ids, crc32 of the ids) in file order, a segment's tables and GROUP
    blocks at a time."""
    with open_file(uri) as f:
        size = f.size()
        n_segments, n_ids, _, at, magic = FOOT.unpack(f.read_at(FOOT.size, size - FOOT.size))
        head, version, length = HEAD.unpack(f.read_at(HEAD.size, 0))
        if magic != MAGIC or head != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is not a token file of version {VERSION}")
        segments = np.frombuffer(f.read_at(SEGMENT.itemsize * n_segments, at), dtype=SEGMENT)
        ends = [*segments["first"].tolist()[1:], n_ids]
        for segment, end in zip(segments.tolist(), ends, strict=True):
            yield from _segment(f, segment, end, length)


def _segment(f, segment: tuple[int, ...], last: int, length: int) -> Iterator[tuple[int | None, int, int, int]]:
    n_blocks, n_docs, done, _, table, index_at = segment
    docs = np.frombuffer(f.read_at(index_at - table, table), dtype=DOCUMENT)
    index = np.frombuffer(f.read_at(8 * n_blocks, index_at), dtype="<u8").tolist() + [table]
    firsts = [*docs["first"].tolist(), last]
    doc_ids, nulls = docs["id"].tolist(), docs["null"].tolist()
    doc, crc = 0, 0
    for b in range(0, n_blocks, GROUP):
        until = min(n_blocks, b + GROUP)
        ids = _blocks(f.read_at(index[until] - index[b], index[b]), [x - index[b] for x in index[b:until]], length)
        upto, raw = done + len(ids), little(ids)
        while doc < n_docs and firsts[doc] < upto:
            start, end = firsts[doc], firsts[doc + 1]
            crc = zlib.crc32(raw[4 * (max(start, done) - done) : 4 * (min(end, upto) - done)], crc)
            if end > upto:
                break
            yield None if nulls[doc] else doc_ids[doc], start, end - start, crc
            doc, crc = doc + 1, 0
        done = upto
    for k in range(doc, n_docs):  # documents without ids behind the last block
        yield None if nulls[k] else doc_ids[k], firsts[k], 0, 0


def _blocks(raw: bytes, starts: list[int], length: int) -> np.ndarray:
    heads = [BLOCK.unpack_from(raw, s) for s in starts]
    widths = np.array([h[1] for h in heads])
    out = np.zeros((len(starts), length), dtype=np.uint64)
    for w in np.unique(widths):
        own, n = np.flatnonzero(widths == w), -(-length * int(w) // 64)
        words = np.frombuffer(b"".join(raw[starts[k] + BLOCK.size : starts[k] + BLOCK.size + 8 * n] for k in own), dtype="<u8").reshape(len(own), n)
        out[own] = unpack(words, int(w), length)
    for k, (s, (_, w, odd, _)) in enumerate(zip(starts, heads, strict=True)):
        if odd:
            at = s + BLOCK.size + 8 * -(-length * w // 64)
            where = np.frombuffer(raw, "<u2", odd, at)
            out[k, where] = np.frombuffer(raw, "<u4", odd, at + 2 * odd)
    out += np.array([h[0] for h in heads], dtype=np.uint64)[:, None]
    return out.reshape(-1)[: length * (len(heads) - 1) + heads[-1][3]].astype("<u4")


MANIFEST = "uri string, part int, file int, docs long, ids long"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two keys by which a range exchange can cut between the rows of one id, equal rows too.

    ``tie`` numbers rows in an order that depends on their values alone, so a task that is run again gives the same rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).sortWithinPartitions("doc_id", "mark")
    return rows.withColumn("tie", F.monotonically_increasing_id())


ORDER = ("doc_id", "mark", "tie")  # ascending, null ids first


def _tasks(spark: SparkSession, ids: int, ids_per_file: int) -> int:
    """So many that none writes much more than a file; below the session's number of partitions about a segment each."""
    return max(1, -(-ids // ids_per_file), min(partitions(spark), -(-ids // SEGMENT_IDS)))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, ids_per_file: int = 1 << 29) -> DataFrame:
    """Write all documents' ids, each followed by ``end_id``, as files in doc_id order; returns their manifest (lazy).

    One range exchange puts the texts in order. The number of its tasks comes from the bytes of all texts, which bound their
    ids, and a task begins a new file with the document after the one that fills a file. Null texts are empty ones,
    null ids sort first, rows of one id keep together and may fill many files. An empty table writes no file.
    """
    most = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    tasks = _tasks(docs.sparkSession, docs.agg(most).first()[0] or 0, ids_per_file)
    ranged = _keyed(docs).repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER).select("doc_id", "text")
    end = little([end_id])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, files, writer, uri = encoder(ByteEncoder, tokenizer), TaskContext.get().partitionId(), 0, None, ""

        def entry() -> pa.RecordBatch:
            n_docs, n_ids = writer.close()
            row = {"uri": [uri], "part": pa.array([part], pa.int32()), "file": pa.array([files], pa.int32()), "docs": [n_docs], "ids": [n_ids]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    uri, stream = new_file(folder, f"part-{part:06d}-{files:03d}", ".tkpf")
                    writer = TokenWriter(stream)
                writer.add(doc_id, enc.encode(text.as_py()) + end)
                if writer.ids >= ids_per_file:
                    yield entry()
                    writer, files = None, files + 1
        if writer is not None:
            yield entry()

    return ranged.mapInArrow(write, MANIFEST)


def read_token_files(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32. ``manifest`` is a
    stored table; its files are dealt to ``tasks`` tasks."""
    # one row for each file: the running sum over files may stand in one task
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("uri", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                for doc_id, start, n, crc in read_documents(row["uri"]):
                    rows.append((doc_id, row["base"] + start, n, crc))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    spread = bases.repartition(tasks or partitions(manifest.sparkSession), "uri")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, ids_per_file: int = 1 << 29) -> DataFrame:
    """Write, then read back. An empty table writes no file and gives no rows; null texts have the end id alone; repeated
    rows, and rows without an id, stand for themselves; other columns take no part."""
    scratch = Scratch(docs.sparkSession, "tokenfiles")
    manifest = scratch.table(write_token_files(docs, tokenizer, scratch.path("files"), end_id, ids_per_file), "manifest", keep=True)
    return read_token_files(manifest, max(partitions(docs.sparkSession), manifest.count()))
