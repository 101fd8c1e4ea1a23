import pytest
from pyspark.sql import functions as F

from tarnlake.config import Settings, flag
from tarnlake.functions.retry import retry
from tarnlake.functions.text import fill_template
from tarnlake.operators import conversations, retrieval
from tarnlake.sources import stores


def test_settings():
    s = Settings.read({"TARNLAKE_CHUNK_SIZE": " 300 ", "TARNLAKE_STATS_CAP": "none", "TARNLAKE_WEB_HOSTS": "a.b, ,c.d", "TARNLAKE_DENSE_WEIGHT": "0.7", "TARNLAKE_RRF_C": ""})
    assert (s.chunk_size, s.stats_cap, s.web_hosts, s.dense_weight, s.rrf_c) == (300, None, ("a.b", "c.d"), 0.7, 60)
    assert flag("Yes") and not flag("0") and flag(None, True)


def test_retry():
    waits, calls = [], []

    @retry(attempts=3, delay=1, on=(KeyError,), sleep=waits.append)
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise KeyError
        return "ok"

    assert f() == "ok" and waits == [1, 2]
    with pytest.raises(KeyError):
        retry(attempts=2, sleep=waits.append)(lambda: {}["x"])()


def test_stores(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert stores.table_or_none(spark, path) is None
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert stores.reuse_or_build(spark, path, build).count() == 3
    assert built == [1]
    assert stores.write_counted(spark.range(10), f"{path}2", even=F.col("id") % 2 == 0) == {"rows": 10, "even": 5}


def test_saved_conversations(spark):
    df = spark.createDataFrame([('[{"id": "a", "messages": [{"id": "1", "role": "user", "content": "x", "timestamp": 5}]}]',), ("oops",), (None,)], "t string")
    got = [r.c for r in df.select(conversations.parse_saved(F.col("t")).alias("c")).collect()]
    assert got[0][0].messages[0].timestamp == 5 and got[1] == [] and got[2] == []
    rows = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    saved = conversations.to_saved(conversations.nest(rows)).first()["saved"]
    assert saved == '{"id":"1","title":"hi","messages":[{"id":"0","role":"user","content":"hi"}]}'
    assert conversations.by_id(rows, 2).count() == 0


def test_message_sources(spark):
    kind = "conv_id long, turn long, role string, text string, sources array<struct<source_reference:string,chunk_index:int,excerpt:string>>"
    tool = '{"documents": [{"source_reference": "t", "chunk_index": 3, "content": " c "}, {"content": ""}]}'
    rows = [(1, 0, "assistant", "old", [("s", 1, "e")]), (1, 1, "assistant", "new", []), (1, 2, "tool", tool, None), (2, 0, "tool", tool, None), (2, 1, "tool", "x" * 51, None), (2, 2, "tool", "short", None)]
    got = retrieval.message_sources(spark.createDataFrame(rows, kind)).orderBy("conv_id", "id").collect()
    assert [tuple(r) for r in got] == [(1, 1, "s", 1, "e"), (2, 1, "t", 3, "c"), (2, 2, "Unknown Source", None, None), (2, 3, "Medical Knowledge Base", None, None)]


def test_template(spark):
    got = spark.range(1).select(fill_template("Q: {q} / {x}{y}", q=F.lit("say {y} $1"), y=F.lit("SECRET"), z=F.lit(None)).alias("t")).first()["t"]
    assert got == "Q: say {y} $1 / {x}SECRET"  # what stands in a value is not searched again
    assert spark.range(1).select(fill_template("a {z}b", z=F.lit(None)).alias("t")).first()["t"] == "a b"


def test_checked_message(spark):
    from tarnlake.operators.logs import checked_message

    df = spark.createDataFrame([(" a\x07b ",)], "m string")
    assert df.select(checked_message(F.col("m")).alias("m")).first()["m"] == "ab"
    for bad in (" \x07 ", None):
        with pytest.raises(Exception, match="empty or invalid"):
            spark.createDataFrame([(bad,)], "m string").select(checked_message(F.col("m")).alias("m")).collect()
