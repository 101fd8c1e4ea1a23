import random
import zlib
from collections import Counter

from public_tokenizers import path
from test_neardup import brute_classes
from test_sharding_quality import brute
from tokenizers import Tokenizer

from tarnlake.llm import toxicity
from tarnlake.llm.tokens import little

corpus_pipeline = __import__("corpus_pipeline")


def rejected(text):
    n, chars, symbols, dup, rep = brute(text)
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    letters = sum(any(c.isalpha() for c in w) for w in words)
    return n < 50 or 100 * rep > 50 * n or 100 * symbols > 5 * chars or 100 * dup > 40 * len(lines) or chars < 2 * n or chars > 20 * n or 100 * letters < 50 * n


def test_pipeline_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "toxicity", "near-dedup", "packing"]

    docs = {r.doc_id: r.text for r in table.collect()}
    kept = {d: t for d, t in docs.items() if not rejected(t)}
    clean = table.filter(table.doc_id.isin(list(kept)))
    model = toxicity.train(clean, labels)
    scorer = toxicity.Scorer(model)
    kept = {d: t for d, t in kept.items() if scorer.score(t) < toxicity.THRESHOLD}
    classes = brute_classes(sorted(kept.items()))
    kept = {d: t for d, t in kept.items() if classes[d] == d}

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == kept.keys()
    for d, own in pieces.items():
        ids = tok.encode(kept[d], add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(little(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(3, 9))) for _ in range(n))
    one, other, long = prose(80), prose(90), prose(40_000)
    rows = [(1, one), (1, one), (7, one), (None, other), (2, None), (3, ""), (4, " \n\t"), (5, "a b c"), (6, long), (8, "again " * 200)]
    names = ["body", "node", "row", "score", "_text", "_w", "_row", "_counts", "start", "length", "kept", "rank"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"cast(null as string) `{c}`" for c in names])
    labels = spark.createDataFrame([(1, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in ((1, one), (None, other), (6, long))}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
