import csv
import gzip
import json
import random

import pytest

from tarnlake.operators import conversations, corpus, logs, retrieval, turns
from tarnlake.operators.numbering import number_within
from tarnlake.sources import chunk_cache, stores
from tarnlake.streaming import turns as stream_turns

LOG = "id long, session_id string, created_at timestamp_ntz, intent string, language string, latency_ms long, user_message string, keywords array<string>"


def log_rows(spark, rows):
    import datetime as dt

    full = [(i, s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), intent, "en", ms, "m", kw) for i, s, at, intent, ms, kw in rows]
    return spark.createDataFrame(full, LOG)


def test_stats_ties_blanks_and_nulls(spark):
    df = log_rows(spark, [(1, "a", 1, "X", 3, []), (2, "", 2, "Y", 0, []), (3, None, 3, "", None, None), (4, "b", 4, None, 4, [])])
    assert tuple(logs.stats(df).first()) == (4, 2, "Y", 2)
    assert tuple(logs.stats(df, cap=1).first()) == (1, 1, "N/A", 4)
    assert tuple(logs.stats(df.limit(0)).first()) == (0, 0, "N/A", 0)
    same_time = log_rows(spark, [(1, "a", 1, "X", 3, []), (2, "a", 1, "Y", 3, [])])
    assert logs.stats(same_time).first()["top_intent"] == "Y"


def test_keyword_graph(spark):
    df = log_rows(spark, [(1, "a", 1, "X", 1, ["B", "b", "", None, "a"]), (2, "a", 2, "X", 1, ["a", "b"])])
    assert [tuple(r) for r in logs.keyword_nodes(df).collect()] == [("b", 3), ("a", 2)]
    assert sorted(map(tuple, logs.keyword_links(df, least=1).collect())) == [("a", "b", 3), ("b", "b", 1)]
    assert sorted(map(tuple, logs.keyword_links(df).collect())) == [("a", "b", 3)]


def test_filters_keep_wildcards_and_backslashes(spark):
    df = log_rows(spark, [(1, "a", 1, "X", 1, [])]).selectExpr("* except (user_message)", r"'100%_a\\\\q' user_message")
    assert logs.filter_logs(df, search="0_").count() == 1
    assert logs.filter_logs(df, search="\\q").count() == 1
    assert logs.filter_logs(df, search="zz").count() == 0
    assert logs.filter_logs(df, intent="All Intents", language="").count() == 1
    for page, size in ((0, 25), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            logs.page_of(df, page, size)


def test_csv_export(spark, tmp_path):
    df = log_rows(spark, [(1, 'q"uo,te', 1, "X", 1, ["a", "b"]), (2, " line\nbreak ", 2, "", 2, [])])
    rows = logs.export_rows(df)
    assert logs.write_csv(rows, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    read = list(csv.DictReader(part.open(newline="")))
    assert [r["session_id"] for r in read] == [" line\nbreak ", 'q"uo,te'] and read[1]["keywords"] == "a, b"
    assert not logs.write_csv(rows.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_plan_of_a_page_is_a_top_k(spark, sf):
    from tarnlake.sources.tables import router_logs

    plan = logs.page_of(router_logs(spark, sf), 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "RangePartitioning" not in plan


def test_turns_append_and_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 2, 0), ("b", 1, 3, 0)], "session_id string, turn_index long, id long, created_at long")
    new = spark.createDataFrame([("a", 4, 9), ("a", 5, 8), ("c", 6, 7)], "session_id string, id long, created_at long")
    got = turns.append_turns(old, new)
    assert sorted((r.session_id, r.turn_index, r.id) for r in got.collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 5), ("a", 4, 4), ("b", 1, 3), ("c", 1, 6)]
    batch = spark.createDataFrame([("a", 2, 77, 1), ("z", 1, 78, 1)], old.schema)
    once = turns.upsert(old, batch)
    assert sorted(map(tuple, once.collect())) == [("a", 1, 1, 0), ("a", 2, 77, 1), ("b", 1, 3, 0), ("z", 1, 78, 1)]
    assert sorted(map(tuple, turns.upsert(once, batch).collect())) == sorted(map(tuple, once.collect()))
    assert turns.missing_after(once, batch).count() == 0 and turns.missing_after(old, batch).count() == 1


def test_numbering_of_a_group_over_many_ranges(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice([None, "a", "b", "c"]), k, rnd.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, at double")
    got = number_within(df, "g", ("at", "id"), "n", parts=12).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for n, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1):
            want[i] = n
    assert {r.id: r.n for r in got} == want and len(got) == len(rows)
    assert number_within(df.limit(0), "g", ("id",), "n").count() == 0


def test_messages(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", ""), (1, 2, "user", None), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversations.last_message(df, "user").collect()] == [(1, 0, "hi")]
    assert [tuple(r) for r in conversations.last_message(df, "assistant").collect()] == [(2, 0, "x")]
    changed = spark.createDataFrame([(1, 1, "assistant", "new"), (1, 3, "user", "y")], df.schema)
    merged = {r.conv_id: r.transcript for r in conversations.render(conversations.merge_messages(df, changed)).collect()}
    assert merged[1] == "user: hi\nassistant: new\nuser: \nuser: y"


def test_recursive_split():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice(["word ", "a. ", "\n", "\n\n", "x" * rnd.randint(1, 300)]) for _ in range(rnd.randint(0, 30)))
        got = corpus.split_recursive(text)
        assert all(0 < len(c) <= 200 for c in got)
        joined, at = "".join(text.split()), 0
        for c in got:  # in order, and nothing between two chunks is lost
            c = "".join(c.split())
            found = max(k for k in range(len(joined) + 1) if joined.startswith(c, k) and k <= at) if c else at
            at = max(at, found + len(c))
        assert at == len(joined)


def test_fixed_chunks_and_numbers(spark):
    docs = spark.createDataFrame([("10", "s", "a" * 201), ("9", "s", "b"), ("2", "s", "c" * 350), ("3", "s", "d" * 351)], "doc_id string, source_reference string, page_content string")
    got = corpus.number_chunks(corpus.chunk_fixed(docs), parts=3).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.part, len(r.content)) for r in got] == [("2", 0, 200), ("2", 1, 200), ("3", 0, 200), ("3", 1, 200), ("3", 2, 51), ("9", 0, 1), ("10", 0, 200), ("10", 1, 51)]
    assert [r.chunk_index for r in got] == list(range(8))
    again = corpus.number_chunks(corpus.chunk_fixed(docs), parts=3, whole=True).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.part, r.chunk_index) for r in again] == [(r.doc_id, r.part, r.chunk_index) for r in got]


def test_chunk_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "s"), (" ", 1, "s"), ("b", 2, "")], "content string, chunk_index int, source_reference string")
    path = f"file://{tmp_path}/cache"
    assert chunk_cache.load(spark, path) is None
    chunk_cache.save(rows, path)
    assert sorted(map(tuple, chunk_cache.load(spark, path).collect())) == [("0", 0, "a", "s"), ("2", 2, "b", "Unknown")]
    assert chunk_cache.load(spark, path, chunk_cache.CacheHeader(chunk_size=300)) is None
    old = tmp_path / "old.jsonl.gz"
    with gzip.open(old, "wt") as f:
        f.write(json.dumps({"cache_version": 1, "chunk_size": 200, "chunk_overlap": 50}) + "\n\n" + json.dumps({"content": " x ", "chunk_index": 4, "source_reference": None}) + "\n")
    assert [tuple(r) for r in chunk_cache.load_jsonl(spark, str(old)).collect()] == [("4", 4, "x", "Unknown")]
    assert chunk_cache.load_jsonl(spark, str(old), chunk_cache.CacheHeader(cache_version=2)) is None
    assert chunk_cache.load_jsonl(spark, str(tmp_path / "gone.gz")) is None


def item(content, **more):
    return {"content": content, "source_reference": "s", "chunk_index": 1} | more


def test_context_items(spark):
    raw = json.dumps({"documents": [item("A  b"), item("a b"), item(" "), 5, item("c", source_reference="", url="http://u"), *[item(f"x{k}") for k in range(9)]]})
    df = spark.createDataFrame([("k", raw), ("bad", "nope"), ("none", '{"documents": []}')], "key string, raw string")
    items = retrieval.context_items(df, "key", "raw")
    got = items.orderBy("ordinal").collect()
    assert [(r.ordinal, r.content, r.source_reference) for r in got] == [(1, "A  b", "s"), (2, "c", "http://u"), (3, "x0", "s"), (4, "x1", "s"), (5, "x2", "s")]
    cites = retrieval.citations(items, "key").orderBy("id").collect()
    blocks = retrieval.grounding_context(items, "key").first()["context"].split("\n\n")
    assert [f"[{c.id}] Source: {c.source}" for c in cites] == [b.split("\n")[0] for b in blocks]


def test_context_items_of_a_large_source(spark, tmp_path):
    """A source of 150 MB of texts, more than one variant may hold, has all its items."""
    from pyspark.sql import functions as F

    from tarnlake.plans.retrieval_queries import context_items

    text = F.concat(F.lit("d"), (F.col("id") / 2).cast("int").cast("string"), F.repeat(F.lit(" word"), 1_000_000))
    docs = spark.range(30, numPartitions=10).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("big").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = context_items(spark, str(tmp_path)).select("key", "ordinal", F.substring("content", 1, 3).alias("c"), "source_reference").orderBy("ordinal").collect()
    # ids 0 and 1 have the same text, but not the same source_reference
    assert [tuple(r) for r in got] == [("big", 1, "d0 ", "https://x.example/big"), ("big", 2, "d0 ", "big"), ("big", 3, "d1 ", "big"), ("big", 4, "d2 ", "Unknown Source"), ("big", 5, "d2 ", "big")]


def test_context_items_over_rows(spark):
    rows = [("k", 3, json.dumps({"documents": [item("x")]})), ("k", 1, json.dumps({"documents": [item("b"), item("a")]})), ("k", 2, json.dumps({"documents": [item("A"), item("c")]})), ("k", 4, "nope")]
    got = retrieval.context_items(spark.createDataFrame(rows, "key string, at int, raw string"), "key", "raw", at="at", most=3).orderBy("ordinal").collect()
    assert [(r.ordinal, r.content) for r in got] == [(1, "b"), (2, "a"), (3, "c")]


def test_fusion(spark):
    d = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank int")
    s = spark.createDataFrame([(2, 1), (3, 2)], "chunk_id long, rank int")
    got = retrieval.fuse(d, s).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3]
    assert got[0].score == round(0.5 / 62 + 0.5 / 61, 6)


def test_stream_numbering(spark, tmp_path):
    from pyspark.sql import functions as F

    source, out = tmp_path / "in", str(tmp_path / "out")
    parts = [[("a", 1), ("b", 2), ("a", 3)], [("a", 4), ("c", 5)], [("c", 6)], [("a", 7)], [("d", 8)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame([(s, i, "m") for s, i in rows], "session_id string, id long, user_message string").coalesce(1).write.parquet(f"{source}/{k}")
    assert stream_turns.read_table(spark, out) is None
    stream = spark.readStream.schema("session_id string, id long, user_message string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    q = stream_turns.upsert_sink(stream_turns.number_turns(stream), out, str(tmp_path / "check"), fanout=2)
    q.awaitTermination(120)
    assert q.exception() is None
    got = stream_turns.read_table(spark, out).groupBy("session_id").agg(F.sort_array(F.collect_list("turn_index")).alias("t")).collect()
    assert {r.session_id: r.t for r in got} == {"a": [1, 2, 3, 4], "b": [1], "c": [1, 2], "d": [1]}
    assert stream_turns.runs(spark, out) == ([(0, 3), (4, 4)], [])  # two by two, and those four as one


def test_sink_replays_and_upserts(spark, tmp_path):
    path, schema = str(tmp_path), "session_id string, turn_index long, v long"

    def batch(k, rows):
        kept = []

        class Stream:  # hands its batches to what the sink would give to foreachBatch
            writeStream = property(lambda self: self)
            option = trigger = lambda self, *a, **k: self
            start = lambda self: None

            def foreachBatch(self, merge):  # noqa: N802
                kept.append(merge)
                return self

        stream_turns.upsert_sink(Stream(), path, "", fanout=2)
        kept[0](spark.createDataFrame(rows, schema), k)

    def table():
        return sorted(map(tuple, stream_turns.read_table(spark, path).collect()))

    batch(0, [("a", 1, 0), ("a", 2, 0)])
    batch(1, [("a", 2, 1), ("b", 1, 1)])
    assert table() == [("a", 1, 0), ("a", 2, 1), ("b", 1, 1)]
    assert stream_turns.runs(spark, path) == ([(0, 1)], [(0, 0), (1, 1)])
    batch(1, [("a", 2, 1), ("b", 1, 1)])  # a replay
    assert table() == [("a", 1, 0), ("a", 2, 1), ("b", 1, 1)]
    batch(2, [("b", 1, 2)])
    assert table() == [("a", 1, 0), ("a", 2, 1), ("b", 1, 2)]
    assert stream_turns.runs(spark, path) == ([(0, 1), (2, 2)], [])
    (tmp_path / "run-0-2").mkdir()  # a run without its commit mark
    assert table() == [("a", 1, 0), ("a", 2, 1), ("b", 1, 2)]


def test_one_conversation_over_many_ranges(spark):
    rnd = random.Random(9)
    kinds = ["user", "assistant", "system", None]
    rows = [(c, t, rnd.choice(kinds), f"{c}/{t}") for c, n in ((1, 900), (2, 1), (3, 40), (None, 60)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    at = {(c, t): (role, text) for c, t, role, text in rows}
    pairs = sorted(((c, t, x, at[c, t + 1][1] if at.get((c, t + 1), ("",))[0] == "assistant" else None) for c, t, role, x in rows if role == "user"), key=str)
    assert sorted(map(tuple, turns.pair_turns(df).collect()), key=str) == pairs
    asked = {(c, t): sum(1 for u in range(t + 1) if at[c, u][0] == "user") for c, t, _, _ in rows}
    assert {(r.conv_id, r.turn): r.user_turns for r in turns.running_turns(df).collect()} == asked
    known = spark.createDataFrame([(1, 890)], "conv_id long, n_known long")
    got = sorted(((r.conv_id, r.turn, r.position) for r in conversations.new_messages(df, known).collect()), key=str)
    assert got == sorted(((c, t, t + 1) for c, t, role, _ in rows if role not in ("system", None) and (c != 1 or t >= 890)), key=str)


def test_sync_counts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 0), ("a", 2, 0)], "session_id string, turn_index long, v long")
    batch = spark.createDataFrame([("a", 2, 1), ("b", 1, 1)], old.schema)
    assert turns.sync_turns(old, batch, f"{tmp_path}/x") == {"success": 2, "fail": 0}
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/x").collect())) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 1)]
    assert turns.sync_turns(old, batch, f"{tmp_path}/y", unique=False) == {"success": 2, "fail": 0}
    assert spark.read.parquet(f"{tmp_path}/y").count() == 4
    lost = spark.createDataFrame([(None, 1, 1)], old.schema)
    assert turns.sync_turns(old, lost, f"{tmp_path}/z") == {"success": 0, "fail": 1}  # a key that cannot be found again


def test_newest_first_and_vector_index(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "conv_id long, created_at long")
    assert [r.conv_id for r in conversations.newest_first(df).collect()] == [3, 2, 1]
    assert [r.conv_id for r in conversations.newest_first(df, without=3).collect()] == [2, 1]
    chunks = spark.createDataFrame([(0, "a"), (1, "b")], "chunk_index long, content string")
    vectors = spark.createDataFrame([(1, [0.5])], "chunk_index long, embedding array<float>")
    assert [tuple(r) for r in stores.vector_index(chunks, vectors).collect()] == [(1, "b", [0.5])]
