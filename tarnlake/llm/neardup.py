"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Texts with equal words are one node. A shingle s that stands tf times in a text weighs there

       tf * (1 + ln((N + 1) / (df + 1))),

   with N documents and df the number of documents that hold s. With a floor of 0, as op1 and the pipeline call it,
   every shingle's df is its own exact count. The texts are stored in chunks; each chunk asks for the shingles it
   holds, with the number of its rows that hold each, in slices by hash (``_asked``); a slice's counts are added up and
   answered in the asker's order (``_answered``). A shingle in all texts is one number a chunk, and a slice
   holds bounded many numbers. With another floor, which a caller may ask for, shingles of less than that share of
   the documents count as standing in it: only bounded many then have weights of their own, which
   ``common_shingles`` counts without that exchange.
2. Each node's weighted shingles are sampled by improved consistent weighted sampling: two nodes draw the same sample
   with a probability equal to their weighted Jaccard similarity. Samples are banded.
3. In each bucket of a band all nodes are compared with its hub, the node whose buckets are the fullest. Two other
   nodes of the bucket are compared only if they are not linked yet and their distances to the hub differ by no
   more than a link's distance: one minus weighted Jaccard is a metric, so no link is lost. That happens in
   blocks of bounded size which give links, never pairs: a group of copies costs a star, and only nodes too
   far from the hub to be linked meet each other. Where such nodes would fill more than a bounded number of
   blocks, they are banded again with longer bands, in which unlike nodes hardly meet.
4. A comparison is the exact weighted Jaccard similarity of the two shingle sets. Classes are the connected
   components of the links found.

With 12 bands of 2 samples a pair at a similarity of 0.8 meets in no band with probability 5e-6, with 38 bands of
6 samples 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch
from tarnlake.llm.shingles import mix, of_texts, text_key
from tarnlake.llm.workers import lean

COMMON = 0.05  # near_duplicates' default floor: the share of documents that a shingle counts as standing in at least
CHUNK, SLICE = 1 << 20, 1 << 20  # bytes of text that ask for frequencies together; shingles counted together, on average
LEVELS = ((12, 2), (38, 6))  # (bands, samples a band): of all nodes; of those whose groups are too large for blocks
_U = np.uint64


# ---- inverse document frequency ------------------------------------------------------------------


@dataclass(frozen=True)
class Frequencies:
    """Document frequencies of the common shingles, in order of their hashes; all others count as ``share`` of docs."""

    docs: int
    hashes: np.ndarray
    counts: np.ndarray
    share: float = COMMON

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """1 + ln((N + 1) / (df + 1)) of each."""
        out = np.full(len(hashes), self._idf(self.share * self.docs), dtype=np.float32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            own = self.hashes[at] == hashes
            out[own] = self._idf(self.counts[at[own]])
        return out

    def _idf(self, df):
        return inverse_frequency(self.docs, df)


def inverse_frequency(docs: int, df):
    return 1 + np.log((docs + 1) / (df + 1))


class Blocks:
    """The shingles that stand in at least half of ``share`` of a block's texts, block by block."""

    def __init__(self, share: float, docs: int = 4096, shingles: int = 1_000_000):
        self._share, self._most = share, (docs, shingles)
        self._held: list[np.ndarray] = []
        self._size = 0

    def add(self, found: np.ndarray) -> None:
        self._held.append(found)
        self._size += len(found)

    def full(self) -> bool:
        return len(self._held) >= self._most[0] or self._size >= self._most[1]

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, counts) of the block, which ends."""
        found, counts = np.unique(np.concatenate([np.empty(0, _U), *self._held]), return_counts=True)
        often = counts >= self._share / 2 * len(self._held)
        self._held, self._size = [], 0
        return found[often], counts[often]


def common_shingles(docs: int, often: DataFrame, texts: DataFrame, shingle: int, share: float = COMMON) -> Frequencies:
    """Exact document frequencies of all shingles that at least ``share`` of the texts hold; often: (hash, n) of Blocks.

    A shingle of that share overall has at least half of its share in blocks whose own half share it reaches. So only
    those can be common whose counts in ``often`` add up to half of the share: at most 2 / share times the
    mean number of shingles of a text, whatever the input. They are counted in a second pass.
    """

    def added(found: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
        rows = found.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
        hashes = rows["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        return hashes[order], rows["n"].to_numpy()[order]

    possible, _ = added(often, share / 2 * docs)
    if not len(possible):
        return Frequencies(docs, possible, np.empty(0, np.int64), share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(possible), dtype=np.int64)
        short = np.zeros(1 << 16, dtype=bool)
        short[(possible >> _U(48)).astype(np.int64)] = True
        for batch in batches:
            for _, found in of_texts((t.as_py() for t in batch.column(0)), shingle):
                found = np.unique(found[short[(found >> _U(48)).view(np.int64)]])
                at = np.minimum(np.searchsorted(possible, found), len(possible) - 1)
                total[at[possible[at] == found]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(possible[total > 0].view(np.int64)), pa.array(total[total > 0])], ["hash", "n"])

    return Frequencies(docs, *added(texts.mapInArrow(lean(count), "hash long, n long"), share * docs), share)


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """One row for each CHUNK of docs: chunk, a number; rows (doc_id, body, row, node); one text of each node in it with
    its number of rows; shingles, the number of those texts' shingles with repeats."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        upto = np.cumsum(pc.binary_length(batch.column(3)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = np.unique(upto // CHUNK, return_index=True)[1].tolist()
        for a, b in zip(start, [*start[1:], len(upto)], strict=True):
            yield batch.slice(a, b - a)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in (piece for whole in batches for piece in pieces(whole)):
            nodes, copies, texts, shingles = [], {}, [], 0
            for i, (words, found) in enumerate(of_texts((t.as_py() for t in batch.column(3)), size)):
                nodes.append(text_key(words))
                if nodes[-1] not in copies:
                    texts.append(i)
                    shingles += len(found)
                copies[nodes[-1]] = copies.get(nodes[-1], 0) + 1
            rows = pa.StructArray.from_arrays([*batch.columns[:3], pa.array(nodes, pa.binary())], ["doc_id", "body", "row", "node"])
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (rows, batch.column(3).take(pa.array(texts, pa.int64())), pa.array(list(copies.values()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, pa.array([shingles], pa.int64())], ["chunk", "rows", "texts", "copies", "shingles"])
            chunk += 1

    return keyed(docs).mapInArrow(lean(cut), f"chunk long, rows array<struct<doc_id: {id_type}, body: long, row: long, node: binary>>, texts array<string>, copies array<long>, shingles long")


def _asked(chunks: DataFrame, size: int, slices: int) -> DataFrame:
    """chunk, slice, hashes (sorted) and counts (empty: all 1; of the least width): a chunk's shingles and how many of its
    rows hold each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts, copies in zip(*batch.columns, strict=True):
                found = [np.unique(x) for _, x in of_texts((t.as_py() for t in texts.values), size)]
                rows = np.repeat(copies.values.to_numpy(), [len(x) for x in found])
                hashes, at = np.unique(np.concatenate([np.empty(0, _U), *found]), return_inverse=True)
                counts = np.bincount(at, rows, len(hashes)).astype("<u8")
                at = ((hashes >> _U(32)) * _U(slices) >> _U(32)).astype(np.int64)
                own, start = np.unique(at, return_index=True)
                ends = [*start[1:].tolist(), len(hashes)]
                out: tuple[list, list] = ([], [])
                for a, b in zip(start.tolist(), ends, strict=False):
                    out[0].append(hashes[a:b].astype("<u8").tobytes())
                    most = counts[a:b].max()
                    out[1].append(counts[a:b].astype(np.min_scalar_type(most)).tobytes() if most > 1 else b"")
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(own), pa.int64()), pa.array(own, pa.int64()), *[pa.array(c, pa.binary()) for c in out]], ["chunk", "slice", "hashes", "counts"])

    return chunks.select("chunk", "texts", "copies").mapInArrow(lean(ask), "chunk long, slice long, hashes binary, counts binary")


def _answered(asked: DataFrame, slices: int, docs: int, most_tasks: int = 20_000) -> DataFrame:
    """chunk, slice, idf: of each shingle asked for, in the order asked, by its exact number of rows in all chunks. Each
    slice is a task, or some slices are, one after the other, where there are more than ``most_tasks``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = None

        def answers() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            _, same = np.unique(np.concatenate([h for _, h, _ in held]), return_inverse=True)
            df = np.bincount(same, np.concatenate([n for *_, n in held]))
            idf = inverse_frequency(docs, df).astype("<f4")[same]
            ends = np.cumsum([len(h) for _, h, _ in held])
            found = [x.tobytes() for x in np.split(idf, ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in held], pa.int64()), pa.array([at] * len(held), pa.int64()), pa.array(found, pa.binary())], ["chunk", "slice", "idf"])

        for batch in batches:
            for chunk, own, hashes, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != at:
                    yield from answers()
                    held, at = [], own
                h = np.frombuffer(hashes, "<u8")
                held.append((chunk, h, np.frombuffer(counts, f"<u{len(counts) // len(h)}") if counts else np.ones(len(h), "<u1")))
        yield from answers()

    tasks = min(slices, most_tasks)
    dealt = asked.repartitionById(tasks, (F.col("slice") % tasks).cast("int")).sortWithinPartitions("slice")
    return dealt.mapInArrow(lean(answer), "chunk long, slice long, idf binary")


# ---- sampling ------------------------------------------------------------------------------------


def _gamma_quantiles(n: int) -> np.ndarray:
    """Gamma(2, 1) at the middles of n equal steps, by bisection of 1 - (1 + x) exp(-x)."""
    want = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < want
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


class WeightedSampler:
    """Improved consistent weighted sampling (Ioffe, 2010) with all random numbers from a shingle's hash.

    For sample k and shingle s: r and c are Gamma(2, 1), b is uniform; with weight w,
    t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The shingle of least a, with its t, is drawn.
    """

    def __init__(self, samples: int, seed: int = 1):
        self._seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))[:, None]
        grid = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self._r = _gamma_quantiles(1 << 16).astype(np.float32)
        self._log = (-np.log(grid)).astype(np.float32)
        self._rows = np.arange(samples)

    def draw(self, shingles: np.ndarray, weights: np.ndarray, step: int = 1024) -> np.ndarray:
        best = np.full(len(self._rows), np.inf, dtype=np.float32)
        out = np.zeros(len(self._rows), dtype=np.uint64)
        log_w = np.log(weights).astype(np.float32)
        low = np.int64(0xFFFF)
        for k in range(0, len(shingles), step):
            s = shingles[k : k + step]
            x = (s ^ self._seeds) * _U(0xBF58476D1CE4E5B9)
            x ^= x >> _U(32)
            x *= _U(0x94D049BB133111EB)
            x ^= x >> _U(29)
            r = self._r.take((x >> _U(48)).view(np.int64))
            v = x.view(np.int64)
            c = self._log.take((v >> 32) & low)
            c += self._log.take((v >> 16) & low)
            b = (v & low).astype(np.float32)
            b += np.float32(0.5)
            b *= np.float32(1 / 65536)
            t = log_w[k : k + step] / r
            t += b
            np.floor(t, out=t)
            a = np.log(c)
            b -= t
            b -= np.float32(1)
            a += r * b
            i = a.argmin(axis=1)
            least = a[self._rows, i]
            better = least < best
            drawn = mix(s[i] + t[self._rows, i].astype(np.int64).view(np.uint64) * _U(0xD6E8FEB86659FD93))
            out = np.where(better, drawn, out)
            best = np.where(better, least, best)
        return out


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    bands = samples.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64)
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + bands[:, k])
    return key.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, weights)."""
    (ha, wa), (hb, wb) = a, b
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha if len(hb) else np.zeros(len(ha), dtype=bool)
    both = np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64)
    either = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both
    return float(both / either) if either > 0 else 0.0


# ---- the operator --------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body (the text's hash, so that rows sharing an id keep apart), a number for each row, and text."""
    return docs.select("doc_id", F.xxhash64("text").alias("body"), F.monotonically_increasing_id().alias("row"), "text")


def _merged(side: DataFrame) -> DataFrame:
    """No table here has a proven size bound, so none is broadcast, however small it is this time."""
    return side.hint("merge")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, shingle: int = 5, levels: tuple = LEVELS, block: int = 512, most_blocks: int = 64, floor: float = COMMON
) -> DataFrame:
    """doc_id, body, class_id, kept: one row for each of docs.

    class_id is the least doc_id of the class; kept marks one row of each class, one of those with that id. Texts
    without words (null and empty ones) are one class, as texts of equal words are; a text shorter than a
    shingle is one shingle. Texts of any length are read whole, in pieces of bounded size. Repeated rows are rows of
    one class. Null ids come first in order. An empty table gives no rows. Other columns of docs take no part. With a
    floor of 0 each shingle weighs by its own document frequency, however rare it is.
    """
    scratch = Scratch(docs.sparkSession, "neardup", clean=True, batch=2 << 20)
    rows, drawn = (_drawn_floored(scratch, docs, shingle, floor, *levels[0]) if floor else _drawn_exactly(scratch, docs, shingle, *levels[0]))
    run = _Run(scratch, 1.0 - threshold, levels, block, most_blocks)
    nodes = scratch.table(rows.groupBy("node").agg(F.min(F.struct("doc_id", "body", "row")).alias("first")), "nodes")

    spokes = run.spokes(drawn.groupBy("node").agg(F.any_value("keys").alias("keys")).select("node", F.explode("keys").alias("key")), 0)
    run.sets = scratch.table(_sets(docs, nodes, drawn, spokes, shingle), "sets")
    labels = run.links(spokes, 0)[1]

    labelled = nodes.select("node", "first").join(_merged(labels), "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    labelled = scratch.table(labelled, "labelled")
    heads = scratch.table(labelled.groupBy("label").agg(F.min("first").alias("head")), "heads")
    classes = scratch.table(labelled.join(_merged(heads), "label").select("node", "head"), "classes")
    out = rows.join(_merged(classes), "node")
    out = out.select("doc_id", "body", F.col("head.doc_id").alias("class_id"), (F.col("row") == F.col("head.row")).alias("kept"))
    out = scratch.table(out, "result", keep=True)
    scratch.drop()
    return out


def _drawn_exactly(scratch: Scratch, docs: DataFrame, size: int, bands: int, per: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, row, node) of each row, and node, keys, idf of each node by exact frequencies, once a chunk."""
    # row groups hold few chunks, since a reader takes up one at a time
    chunks = scratch.table(_chunks(docs, size), "chunks", **{"parquet.block.size": str(8 << 20)})
    rows = scratch.table(chunks.select(F.explode("rows").alias("r")).select("r.*"), "rows")
    total = chunks.agg(F.sum("shingles")).first()[0] or 0
    slices = total // SLICE + 1
    answers = scratch.table(_answered(_asked(chunks, size, slices), slices, rows.count()), "answers")
    whole = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("slice", "idf"))).alias("idf"))
    whole = chunks.select("chunk", "texts").join(_merged(whole), "chunk").select("texts", "idf.idf")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(bands * per)
        for batch in batches:
            for texts, slices in zip(*batch.columns, strict=True):
                idf = np.frombuffer(b"".join(slices.as_py()), "<f4")
                cut = [(text_key(words), *np.unique(found, return_counts=True)) for words, found in of_texts((t.as_py() for t in texts.values), size)]
                _, at = np.unique(np.concatenate([h for _, h, _ in cut]), return_inverse=True)
                out: tuple[list, list, list] = ([], [], [])
                k = 0
                for node, h, tf in cut:
                    own = idf[at[k : k + len(h)]]
                    k += len(h)
                    if len(h):
                        for column, value in zip(out, (node, band_keys(sampler.draw(h, tf * own), per), own.tobytes()), strict=True):
                            column.append(value)
                yield _drawn_batch(*out)

    drawn = scratch.table(whole.mapInArrow(lean(sign), _DRAWN), "drawn")
    scratch.drop("chunks", "answers")
    return rows, drawn


def _drawn_floored(scratch: Scratch, docs: DataFrame, size: int, floor: float, bands: int, per: int) -> tuple[DataFrame, DataFrame]:
    """As ``_drawn_exactly``, with no frequency below a share of ``floor``, for each row."""
    cut = scratch.table(_numbered(docs, size, floor), "rows")
    rows = cut.filter("node is not null").select("doc_id", "body", "row", "node")
    idf = common_shingles(rows.count(), cut.filter("node is null").select("hash", "n"), docs.select("text"), size, floor)
    return rows, scratch.table(_signed(docs.select("text"), size, idf, bands, per), "drawn")


_DRAWN = "node binary, keys array<long>, idf binary"


def _drawn_batch(nodes: list, keys: list, idf: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(idf, pa.binary())], ["node", "keys", "idf"])


def _numbered(docs: DataFrame, size: int, share: float) -> DataFrame:
    """doc_id, body, row and node of each row; beside them, with null nodes, what Blocks gives of all shingles."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, block, id_type = ["doc_id", "body", "row", "node", "hash", "n"], Blocks(share), pa.int64()

        def often(step: int = 100_000) -> Iterator[pa.RecordBatch]:
            hashes, counts = block.take()
            for k in range(0, len(hashes), step):
                h, n = hashes[k : k + step].view(np.int64), counts[k : k + step].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), id_type), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.binary()), pa.array(h), pa.array(n)], names)

        for batch in batches:
            nodes, id_type = [], batch.column(0).type
            for words, found in of_texts((t.as_py() for t in batch.column(3)), size):
                nodes.append(text_key(words))
                block.add(np.unique(found))
                if block.full():
                    yield from often()
            nothing = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.binary()), nothing, nothing], names)
        yield from often()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(lean(number), f"doc_id {id_type}, body long, row long, node binary, hash long, n long")


def _signed(texts: DataFrame, size: int, idf: Frequencies, bands: int, per: int, held: int = 10_000) -> DataFrame:
    """node, keys, idf of each text; copies that a worker met not long ago are not drawn again."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, known = WeightedSampler(bands * per), {}
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for words, found in of_texts((t.as_py() for t in batch.column(0)), size):
                node = text_key(words)
                if node not in known:
                    if len(known) == held:
                        known.clear()
                    found, tf = np.unique(found, return_counts=True)
                    own = idf.weights(found).astype("<f4")
                    known[node] = band_keys(sampler.draw(found, tf * own), per) if len(found) else np.empty(0, np.int64), own.tobytes()
                for column, value in zip(out, (node, *known[node]), strict=True):
                    column.append(value)
            yield _drawn_batch(*out)

    return texts.mapInArrow(lean(sign), _DRAWN)


def _sets(docs: DataFrame, nodes: DataFrame, drawn: DataFrame, spokes: DataFrame, size: int) -> DataFrame:
    """node, hashes (sorted), tf (empty: all 1), idf and size (shingles with repeats) of the nodes in spokes, from one
    whole text of each."""
    wanted = spokes.select("node").unionByName(spokes.select(F.col("hub").alias("node"))).distinct()
    idf = drawn.join(_merged(wanted), "node", "left_semi").groupBy("node").agg(F.any_value("idf").alias("idf"))
    firsts = _merged(nodes.join(_merged(idf), "node").select("first.doc_id", "first.body", "node", "idf"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    same = rows["doc_id"].eqNullSafe(firsts["doc_id"]) & (rows["body"] == firsts["body"])
    texts = rows.join(firsts, same).select(rows["doc_id"], rows["body"], "text", "node", "idf").dropDuplicates(["doc_id", "body"]).select("node", "idf", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for _, found in of_texts((t.as_py() for t in batch.column(2)), size):
                found, tf = np.unique(found, return_counts=True)
                n = int(tf.sum())
                times = tf.astype("<u4").tobytes() if n > len(found) else b""
                for column, value in zip(out, (found.astype("<u8").tobytes(), times, n), strict=True):
                    column.append(value)
            columns = [batch.column(0), *[pa.array(c, pa.binary()) for c in out[:2]], batch.column(1), pa.array(out[2], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "hashes", "tf", "idf", "size"])

    return texts.mapInArrow(lean(cut), "node binary, hashes binary, tf binary, idf binary, size long")


def _set(hashes: bytes, tf: bytes, idf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, "<u8")
    return h, np.frombuffer(tf, "<u4") if tf else np.ones(len(h), dtype="<u4"), np.frombuffer(idf, "<f4")


def _weights(hashes: bytes, tf: bytes, idf: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, t, w = _set(hashes, tf, idf)
    return h, t * w


def _drawn_anew(asked: DataFrame, bands: int, per: int) -> DataFrame:
    """node, keys of (node, hashes, tf, idf, salt): the keys of one salt meet no others."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(bands * per)
        for batch in batches:
            keys = []
            for *own, salt in zip(*batch.columns[1:], strict=True):
                own = band_keys(sampler.draw(*_weights(*[x.as_py() for x in own])), per)
                keys.append(mix(own.view(_U) + _U(salt.as_py() & (2**64 - 1))).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    return asked.mapInArrow(lean(draw), "node binary, keys array<long>")


class _Run:
    """What one call's steps share. Tables that are joined by a hot key are written first, so that both sides of such
    a join are plain exchanges, whose large partitions adaptive execution can split."""

    sets: DataFrame

    def __init__(self, scratch: Scratch, reach: float, levels: tuple, block: int, most_blocks: int):
        self.scratch, self.reach, self.levels, self.block, self.most_blocks = scratch, reach, levels, block, most_blocks

    def table(self, df: DataFrame, name: str, level: int) -> DataFrame:
        return self.scratch.table(df, f"{name}_{level}")

    def spokes(self, members: DataFrame, level: int) -> DataFrame:
        """hub, node: the nodes of each bucket with its hub, of (node, key)."""
        sizes = self.table(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes", level)
        members = self.table(members.join(_merged(sizes), "key"), "members", level)
        fullest = members.groupBy("node").agg(F.sum("n").alias("full"))
        hubs = members.join(_merged(fullest), "node").groupBy("key").agg(F.max(F.struct("full", "node")).alias("hub"))
        hubs = self.table(hubs.select("key", F.col("hub.node").alias("hub")), "hubs", level)
        return self.table(members.join(_merged(hubs), "key").filter(F.col("node") != F.col("hub")).select("hub", "node").distinct(), "spokes", level)

    def links(self, spokes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """(hub, node) links that connect all nodes of a bucket which chains of links within it connect, and the
        (node, label) they give."""
        stars = self.table(self.distances(spokes), "stars", level)
        links = stars.filter(F.col("distance") <= self.reach + 1e-9).select("hub", "node")
        labels = components(self.scratch, links, f"stars{level}")
        more = self.table(self.open_links(stars, labels, level), "more", level)
        if more.limit(1).isEmpty():
            return links, labels
        links = links.unionByName(more)
        return links, components(self.scratch, links, f"links{level}")

    def distances(self, pairs: DataFrame) -> DataFrame:
        """hub, node, distance."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = ([x.as_py() for x in row] for row in zip(*batch.columns[2:], strict=True))
                found = [1 - weighted_jaccard(_weights(*row[:3]), _weights(*row[3:])) for row in sets]
                # links are decided on the similarity, so the rounding of 1 - (1 - t) must not matter
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(found, 9), pa.float64())], ["hub", "node", "distance"])

        own = self.sets.select("node", F.col("hashes").alias("h1"), F.col("tf").alias("t1"), F.col("idf").alias("w1"))
        other = self.sets.select(F.col("node").alias("hub"), F.col("hashes").alias("h2"), F.col("tf").alias("t2"), F.col("idf").alias("w2"))
        both = pairs.join(_merged(own), "node").join(_merged(other), "hub").select("hub", "node", "h1", "t1", "w1", "h2", "t2", "w2")
        return both.mapInArrow(lean(compare), "hub binary, node binary, distance double")

    def open_links(self, stars: DataFrame, labels: DataFrame, level: int) -> DataFrame:
        """hub, node: links between nodes of one hub's buckets that stars alone did not put under one label.

        A node lies in zone floor(distance to the hub / reach); linked nodes lie in the same or adjacent zones. Zones z
        and z + 1 of a hub form a group. Groups are dealt into blocks, and each pair of blocks is one task's
        work; a group of more than ``most_blocks`` is banded anew, at the last level excepted.
        """
        zoned = stars.select("hub", "node", F.floor(F.col("distance") / (self.reach + 1e-6)).cast("int").alias("zone"))
        zoned = self.table(zoned.join(_merged(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "zoned", level)
        open_hubs = self.table(zoned.groupBy("hub").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("hub"), "open", level)
        sized = zoned.join(_merged(open_hubs), "hub").join(_merged(self.sets.select("node", "size")), "node")
        grouped = self.table(sized.withColumn("group", F.explode(F.array(F.col("zone"), F.col("zone") - 1))), "grouped", level)
        facts = grouped.groupBy("hub", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"), F.min("label").alias("a"), F.max("label").alias("b"), F.min("zone").alias("z"))
        blocks = F.ceil(F.greatest(F.col("n") / self.block, F.col("elements") / (2048 * self.block))).cast("int")
        facts = self.table(facts.filter("a != b and z = group").select("hub", "group", blocks.alias("blocks")), "groups", level)
        dealt = grouped.join(_merged(facts), ["hub", "group"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = self.table(dealt.drop("size"), "dealt", level)
        if level + 1 == len(self.levels):
            return self.block_links(dealt)
        large = dealt.filter(F.col("blocks") > self.most_blocks)
        found = self.block_links(dealt.filter(F.col("blocks") <= self.most_blocks))
        if large.limit(1).isEmpty():
            return found
        bands, per = self.levels[level + 1]
        asked = large.select("node", F.xxhash64("hub", "group").alias("salt")).join(_merged(self.sets), "node").select("node", "hashes", "tf", "idf", "salt")
        drawn = self.table(_drawn_anew(asked, bands, per), "drawn", level + 1)
        members = drawn.select("node", F.explode("keys").alias("key")).distinct()
        return found.unionByName(self.links(self.spokes(members, level + 1), level + 1)[0])

    def block_links(self, dealt: DataFrame) -> DataFrame:
        """hub, node: the links that pairs of blocks give."""
        reach = self.reach
        placed = dealt.join(_merged(self.sets.drop("size")), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        columns = ["hub", "group", "i", "j", "node", "label", "zone", "own", "hashes", "tf", "idf"]
        key = columns[:4]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            at: tuple | None = None

            def links() -> Iterator[pa.RecordBatch]:
                if at is not None and len(held) > 1:
                    found = block_links(held, at[2], at[3], at[1], reach)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], ["hub", "node"])

            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if row[:4] != at:
                        yield from links()
                        held, at = [], row[:4]
                    held.append(row[4:])
            yield from links()

        return placed.select(*columns).repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(meet), "hub binary, node binary").distinct()


def overlaps(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], split: int, step: int = 8192) -> np.ndarray:
    """Shared weight of each of the first ``split`` sets with each other one (with all, if split is their number).

    A shingle that occurs n times is n elements of equal weight, so that the sum of minima is a matrix product.
    """
    owner = np.concatenate([np.full(int(tf.sum()), i) for i, (_, tf, _) in enumerate(sets)])
    hashes, idf = (np.concatenate([np.repeat(s[k], s[1]) for s in sets]) for k in (0, 2))
    turn = np.concatenate([np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf) for _, tf, _ in sets]).astype(np.uint64)
    element, column, counts = np.unique(mix(hashes + turn * _U(0x9E3779B97F4A7C15)) if turn.any() else hashes, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, idf, column = owner[shared], idf[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    weight = np.sqrt(idf.astype(np.float64)).astype(np.float32)
    rows, others = split, len(sets) - split or split
    out = np.zeros((rows, others))
    width = int(column.max(initial=-1)) + 1
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    for k in range(0, width, step):
        a, b = np.searchsorted(column, [k, k + step])
        x = np.zeros((len(sets), min(step, width - k)), dtype=np.float32)
        x[owner[a:b], column[a:b] - k] = weight[a:b]
        out += x[:rows] @ (x[rows:] if rows < len(sets) else x).T
    return out


def block_links(rows: list[tuple], i: int, j: int, zone: int, reach: float) -> list[tuple[bytes, bytes]]:
    """Links of one pair of blocks that join labels: at most one for each node.

    rows: (node, label, zone, block, hashes, tf, idf). Pairs with both nodes in the farther zone belong elsewhere.
    """
    rows = sorted(rows, key=lambda r: (r[3] != i, r[0]))
    split = sum(r[3] == i for r in rows)
    if i != j and (split == 0 or split == len(rows)):
        return []
    sets = [(h, tf.astype(np.int64), w) for h, tf, w in (_set(*r[4:]) for r in rows)]
    total = np.array([(tf * w).sum(dtype=np.float64) for _, tf, w in sets])
    split = split if i != j else len(rows)
    both = overlaps(sets, split)
    b0 = split if i != j else 0
    label_ids: dict[bytes, int] = {}
    label = np.array([label_ids.setdefault(r[1], len(label_ids)) for r in rows])
    near = np.array([r[2] == zone for r in rows])
    # single precision may be off by some 1e-6, so pairs at the border are measured exactly
    similar = both / (total[:split, None] + total[None, b0:] - both) >= 1 - reach - 1e-4
    similar &= (label[:split, None] != label[None, b0:]) & (near[:split, None] | near[None, b0:])
    parent = list(range(len(label_ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for p, q in zip(*np.nonzero(similar), strict=True):
        q += b0
        a, b = find(label[p]), find(label[q])
        if a != b and 1 - weighted_jaccard(_weights(*rows[p][4:]), _weights(*rows[q][4:])) <= reach + 1e-9:
            parent[a] = b
            out.append((rows[p][0], rows[q][0]))
    return out


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """node, label: the least node reachable. Least labels spread along links and then jump to the label's own
    label, so rounds grow with the logarithm of a component's length."""
    links = links.select("hub", "node")
    both = scratch.table(links.unionByName(links.select(F.col("node").alias("hub"), F.col("hub").alias("node"))).distinct(), f"both{name}")
    labels = scratch.table(both.groupBy("hub").agg(F.min("node").alias("low")).select(F.col("hub").alias("node"), F.least("hub", "low").alias("label")), f"labels{name}_0")
    k = 0
    while True:
        k += 1
        around = both.join(_merged(labels), "node").groupBy("hub").agg(F.min("label").alias("low")).withColumnRenamed("hub", "node")
        near = labels.join(_merged(around), "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = scratch.table(near.join(_merged(jump), "to").select("node", "was", F.least("to", "further").alias("label")), f"labels{name}_{k}")
        still = moved.filter(F.col("was") != F.col("label")).limit(1).isEmpty()
        labels = moved.select("node", "label")
        if still:
            return labels


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, floor: float = COMMON) -> DataFrame:
    """The rows of docs that represent their class, one each, with the columns they had.

    Of rows that repeat a class's least id and its text one stays; other cases are those of ``near_duplicates``.
    """
    found = near_duplicates(docs, threshold, floor=floor).filter("kept").select("doc_id", F.col("body").alias("_kept_body")).hint("merge")
    body = "body"
    while body in docs.columns:
        body += "_"
    rows = docs.withColumn(body, F.xxhash64("text"))
    match = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows[body] == found["_kept_body"])
    return rows.join(found, match, "left_semi").dropDuplicates(["doc_id", body]).select(*[F.col(f"`{c}`") for c in docs.columns])
