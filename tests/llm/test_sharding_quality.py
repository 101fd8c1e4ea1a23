import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import quality, sharding

CASES = [
    (0, None),
    (1, ""),
    (2, "one"),
    (3, "a b c a b c"),
    (4, "x\ny\nx\n\n \nx"),
    (5, "w " * 3000),
    (6, " ".join(f"word{i}" for i in range(60)) + "\n# $ |"),
    (7, "é ü ñ   z\tq\x0bv"),
    (8, "### *** " * 40 + " ".join(f"word{i}" for i in range(60))),
    (8, " ".join(f"word{i}" for i in range(60))),
    (9, "aa aa aa aa " + " ".join(f"k{i}" for i in range(80)) + " aa aa aa"),
]


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_match_brute_force(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    got = Counter(tuple(r)[:7] for r in quality.quality_report(df, sample_rows=5).collect())
    want = Counter()
    for d, t in CASES:
        n, wc, sy, dl, rep = brute(t)
        want[(d, n, wc, sy, dl, rep, n < 50 or 100 * rep > 50 * n)] += 1
    assert got == want


def test_quality_on_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in quality.quality_report(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_filter_keeps_columns_and_verdicts(spark):
    df = spark.createDataFrame([(d, t, "c") for d, t in CASES], "doc_id long, text string, _w string")
    kept = quality.filter_documents(df)
    assert kept.columns == ["doc_id", "text", "_w"]
    want = sorted(r.doc_id for r in quality.quality_report(df.select("doc_id", "text")).filter("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want == [6, 8, 9]


def test_rule_order_does_not_change_verdicts(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    parts = quality.with_words(df)
    rules = quality.production_rules()
    a = parts.filter(quality.cascade(rules).isNull()).count()
    assert a == parts.filter(quality.cascade(rules[::-1]).isNull()).count()


def test_rules_behind_a_rejection_are_not_computed(spark):
    """The costly rule fails loudly on every text that an earlier rule rejects, and is reached by the others only."""
    df = quality.with_words(spark.createDataFrame(CASES, "doc_id long, text string"))
    rules = {r.name: r for r in quality.production_rules()}
    loud = quality.Rule("loud", lambda p: F.when(p.n_words() < 50, F.raise_error(F.lit("reached")).cast("boolean")).otherwise(rules["repeats"].fails(p)))
    found = Counter(r[0] for r in df.select(quality.cascade([rules["min_words"], loud])).collect())
    assert found == {"min_words": 6, "loud": 2, None: 3}
    with pytest.raises(Exception, match="reached"):
        df.select(quality.cascade([loud, rules["min_words"]])).collect()


def test_repeats_rule_equals_its_definition(spark):
    """The short way past the windows never changes the verdict, at any share."""
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz"[: rnd.choice([2, 4, 9, 26])]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    texts += ["a b c d e f " * 2, "a b c " * 2 + "d e f g h i", "x x x", "x x x x", ""]
    df = quality.with_words(spark.createDataFrame([(t,) for t in texts], "text string"))
    for pct in (0, 20, 50, 90):
        for r in df.select("text", quality.Parts().repeats_over(pct).alias("f")).collect():
            n, *_, rep = brute(r.text)
            assert r.f == (100 * rep > pct * n), (pct, r.text)


def test_quality_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_report(df).count() == 0
    assert quality.filter_documents(df).count() == 0


def test_shards_balanced_contiguous(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(sharding.shard_documents(df, 24).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in df.collect()}
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    total, sizes, slots = sum(r.size for r in rows), Counter(), Counter()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes")
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        sizes[r.shard] += r.size
    most = max(r.size for r in rows)
    assert all(abs(sizes[k] - total / 24) <= most for k in range(24))


def test_shards_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (1, "é"), (2, None)], "doc_id long, text string")
    got = sharding.shard_documents(df, 3).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted([(8, 0)] * 4 + [(10, zlib.crc32("é".encode()))])
    assert sharding.shard_documents(df.limit(0), 3).count() == 0
