"""Packing documents into windows of bounded length by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; a rest above ``unit`` is cut once more, at a
multiple of ``unit``, which leaves many small pieces that level the windows. Pieces are dealt at random
into groups of bounded size. Within a group the differencing method repeatedly merges the two partial
partitions of largest spread, laying the fullest windows of one on the emptiest of the other; the number
of windows starts at the least possible and rises while any window exceeds its capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch
from tarnlake.llm.tokens import WordEncoder, encoder, little
from tarnlake.llm.workers import drop_kept

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int, unit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with n ids."""
    out = [(s, capacity) for s in range(0, n - n % capacity, capacity)]
    rest, at = n % capacity, n - n % capacity
    if rest > unit and rest % unit:
        out.append((at, rest - rest % unit))
        at, rest = at + rest - rest % unit, rest % unit
    return out + [(at, rest)] * bool(rest)


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """Window 0..k-1 of each size. Ties fall in order of creation, so the result is determined."""
    n = len(sizes)
    # a node is a set of pieces: a leaf 0..n-1 or the union of two nodes
    left: list[int] = [-1] * n
    right: list[int] = [-1] * n
    heap = []
    for i, size in enumerate(sizes):
        load, node = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        load[0], node[0] = size, i
        heap.append((-(size if k > 1 else 0), i, load, node))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, load_a, node_a = heapq.heappop(heap)
        _, _, load_b, node_b = heapq.heappop(heap)
        load, back = load_a + load_b[::-1], node_b[::-1]
        node = np.where(node_a < 0, back, node_a)
        both = np.flatnonzero((node_a >= 0) & (back >= 0))
        if len(both):
            left += node_a[both].tolist()
            right += back[both].tolist()
            node[both] = np.arange(len(left) - len(both), len(left))
        order = np.argsort(-load, kind="stable")
        load, node = load[order], node[order]
        heapq.heappush(heap, (int(load[-1] - load[0]), made, load - load[-1], node))
        made += 1
    out = np.zeros(n, dtype=np.int64)
    for window, root in enumerate(heap[0][3].tolist() if heap else []):
        stack = [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = window
            else:
                stack += (left[x], right[x])
    return out


def pack_group(sizes: list[int], capacity: int) -> np.ndarray:
    """Windows of a group; pieces as long as a window keep one to themselves."""
    sizes_array = np.asarray(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int64)
    whole = sizes_array == capacity
    out[whole] = np.arange(whole.sum())
    rest = np.flatnonzero(~whole)
    if len(rest):
        small = sizes_array[rest]
        k = -(-int(small.sum()) // capacity)
        while True:
            found = differencing(small.tolist(), k)
            if np.bincount(found, weights=small, minlength=k).max() <= capacity:
                break
            k += 1
        out[rest] = whole.sum() + found
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, unit: int, end_id: int) -> DataFrame:
    """Every document's pieces; a null text is empty and has the end id alone."""
    end = little([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                rows += [(doc_id, s, length, zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s, length in cuts(n, capacity, unit)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, unit: int = 512, group: int = 1024) -> DataFrame:
    """One row for each piece with its sequence and offset. Sequence ids are unique, not dense.

    Null and empty texts have the end id alone; a text of any length is encoded whole and fills as many windows as it needs.
    Repeated rows, and rows without an id, are packed as often as they occur; an empty table gives no rows; other
    columns take no part.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = token_pieces(docs, tokenizer, capacity, unit, end_id).withColumn("_row", F.monotonically_increasing_id())
    pieces = scratch.table(pieces, "pieces", keep=True)  # fixes _row, by which pieces are dealt: no key can be hot
    groups = max(1, -(-pieces.count() // group))

    def pack(rows: pa.Table) -> pa.Table:
        drop_kept()  # all texts are encoded
        rows = rows.sort_by("_row")
        length = rows["length"].to_numpy()
        window = pack_group(length.tolist(), capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.r_[True, np.diff(window[order]) > 0]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        rows = rows.take(pa.array(order))
        sequence = (rows["_group"].to_numpy() << 32) + window[order]
        kept = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, PACKED)
