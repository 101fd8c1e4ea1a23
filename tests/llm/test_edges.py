"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing extra columns."""

from collections import Counter

import pytest
from public_tokenizers import path

from tarnlake.llm import bpe, html, neardup, packing, quality, sharding, tokenfiles, topk, toxicity, warc

BYTE, WORD = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
LONG = "word " * 300_000
DOCS = [(1, LONG, None), (1, LONG, None), (2, None, "s"), (3, "", "s"), (None, "a b c", None), (4, "\x00 � é", "s"), (4, "<|endoftext|> x", "s")]
CLASH = ["node", "keys", "size", "slice", "_text", "_w", "_grams", "_row", "_part", "shard", "score", "pair", "rank", "body", "length", "start"]


def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    for k, c in enumerate(CLASH):
        df = df.selectExpr("*", f"cast({k} as string) as `{c}`")
    return df


def pages(spark):
    rows = [(1, "http://h/a", "<article><p>" + LONG), (1, "http://h/a", "<article><p>" + LONG), (2, None, None), (None, "", ""), (3, "x", "<p>\x00</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("digest", "lines", "body", "pair", "rank", "n"):
        df = df.selectExpr("*", f"1 as `{c}`")
    return df


def ids(df, column="doc_id"):
    return Counter(r[column] for r in df.collect())


WANT = Counter(d for d, _, _ in DOCS)


def test_documents(spark):
    d = docs(spark)
    assert ids(sharding.shard_documents(d)) == WANT
    assert ids(quality.quality_report(d)) == WANT
    assert ids(bpe.encode_decode(d, BYTE)) == WANT
    assert ids(tokenfiles.token_round_trip(d, BYTE)) == WANT
    assert set(ids(packing.pack_documents(d, WORD))) == set(WANT)
    assert ids(neardup.near_duplicates(d)) == WANT
    assert ids(toxicity.toxicity_report(d, spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int"))) == WANT
    assert quality.filter_documents(d).columns == d.columns
    assert neardup.keep_one_of_each(d).columns == d.columns


def test_pages(spark):
    p = pages(spark)
    want = Counter([1, 1, 2, None, 3])
    assert ids(html.extract(p), "page_id") == want
    assert ids(warc.archive_round_trip(p), "page_id") == want
    got = {r.page_id: r.n_chars for r in html.extract(p).collect()}
    assert got[1] == len(LONG.strip()) and got[2] == 0


@pytest.mark.parametrize("names", [("row", "ints"), ("dist", "norm2"), ("label", "rank")])
def test_vectors(spark, names):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.5, 0.1]), (20, None)], "vec_id long, embedding array<float>")
    for c in names:
        df = df.selectExpr("*", f"1 as `{c}`")
    assert [tuple(r) for r in topk.search(df).collect()] == [(0, 1, 1, 32 * 32 + 32 * 6)]
