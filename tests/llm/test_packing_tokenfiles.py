import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tarnlake.llm import packing, tokenfiles
from tarnlake.llm.tokens import little

ODD = [(-1, None), (-2, ""), (-3, "x y"), (-3, "x y"), (None, "n"), (-9, "long words here " * 4000)]


def with_odd(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))


def ids_of(tok, text, end):
    return tok.encode(text or "", add_special_tokens=False).ids + [end]


def test_packing_whole(spark, sf):
    docs = with_odd(spark, sf)
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(ids_of(tok, r.text, 1))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, path("word_bpe_49k.json")).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for d, copies in want.items():
        own = sorted(pieces[d], key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(map(len, copies))
        ids = copies[0]
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(little(ids[r.start : r.start + r.length]))
        assert len({r.start for r in own}) * len(copies) == len(own)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(len(i) for c in want.values() for i in c)
    assert used > 0.96 * 2048 * (len(windows) - 1)
    assert packing.pack_documents(docs.limit(0), path("word_bpe_49k.json")).count() == 0


def test_differencing_small_cases():
    assert packing.pack_group([2048, 2048], 2048).tolist() == [0, 1]
    rnd = random.Random(5)
    for _ in range(40):
        sizes = [rnd.randint(1, 2048) for _ in range(rnd.randint(1, 60))]
        w = packing.pack_group(sizes, 2048)
        assert np.bincount(w, weights=sizes).max() <= 2048
        assert len(w) == len(sizes)
    loads = np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])
    assert sorted(loads.tolist()) == [14, 16]  # the known outcome of largest differencing on this set


def test_cuts_cover():
    for n in (1, 511, 512, 513, 2047, 2048, 2049, 5000):
        got = packing.cuts(n, 2048, 512)
        assert [s for s, _ in got] == np.cumsum([0] + [k for _, k in got])[:-1].tolist()
        assert sum(k for _, k in got) == n


def test_pack_unpack_all_widths():
    rng = np.random.default_rng(1)
    for w in range(33):
        v = rng.integers(0, 1 << w, size=(5, 256), dtype=np.uint64)
        assert (tokenfiles.unpack(tokenfiles.pack(v, w), w, 256) == v).all()


@pytest.mark.parametrize("n", [1, 255, 256, 257, 300_000])
def test_file_round_trip(tmp_path, n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(100, 900, n)).astype("<u4")
    at = sorted({0, n, *rng.integers(0, n, 20).tolist()})
    f = open(tmp_path / "a", "wb")
    w = tokenfiles.TokenWriter(f)
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        w.add(None if k == 3 else k, ids[a:b].tobytes())
    assert w.close() == (len(at) - 1, n)
    got = list(tokenfiles.read_documents(f"file://{tmp_path}/a"))
    assert got == [(None if k == 3 else k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]


def test_token_round_trip(spark, sf):
    docs = with_odd(spark, sf)
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, start = [], 0
    for r in rows:
        ids = ids_of(tok, r.text, 0)
        want.append((r.doc_id, start, len(ids), zlib.crc32(little(ids))))
        start += len(ids)
    got = sorted(map(tuple, tokenfiles.token_round_trip(docs, path("byte_bpe_50k.json")).collect()), key=lambda r: r[1])
    assert got == want
    assert tokenfiles.token_round_trip(docs.limit(0), path("byte_bpe_50k.json")).count() == 0


class Sink:
    """A stream that keeps nothing."""

    def write(self, data):
        pass

    def close(self):
        pass


def test_segments(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 2000)
    rng = np.random.default_rng(3)
    w, want, at = tokenfiles.TokenWriter(open(tmp_path / "a", "wb")), [], 0
    for k in range(100):
        ids = rng.integers(0, 70_000, [0, 3, 300, 5000][k % 4] if k % 10 else 1).astype("<u4").tobytes()
        w.add(k, ids)
        want.append((k, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert w.close() == (100, at)
    assert list(tokenfiles.read_documents(f"file://{tmp_path}/a")) == want


def test_writer_memory_does_not_grow():
    import tracemalloc

    w, ids, held = tokenfiles.TokenWriter(Sink()), little([5, 7, 0]), []
    tracemalloc.start()
    for _ in range(3):
        for k in range(4 * tokenfiles.SEGMENT_DOCS):
            w.add(k, ids)
        held.append(tracemalloc.get_traced_memory()[0])
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert held[-1] - held[0] < 100_000


def test_one_id_on_most_rows_and_many_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.selectExpr("7L as doc_id", "text"))
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(ids), zlib.crc32(little(ids))) for r in docs.collect() for ids in [ids_of(tok, r.text, 0)])
    for per_file in (1 << 29, 3000):
        got = sorted(map(tuple, tokenfiles.token_round_trip(docs, path("byte_bpe_50k.json"), 0, per_file).collect()), key=lambda r: r[1])
        assert [d for d, *_ in got] == [d for d, *_ in want] and sorted((d, n, c) for d, _, n, c in got) == want
        assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
