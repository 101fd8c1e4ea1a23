import random
import re

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text
from tarnlake.functions.lexicon import INJECTION_PATTERNS, INJECTION_TOKENS, INTENT_TERMS, INTENTS
from tarnlake.operators import router

ODD = ["", " ", "\n\t a \x1c b \x1f", "\x00a\x07b\x7fc\x9fd\x85", " x y ", "A" * 1999, "A" * 2000 + "B", "𝒜 astral 🙂" * 300, "ශ ்", "hello ශ", "ABC வ ශ"]


def plain_sanitize(t, most=2000):
    if not t:
        return ""
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", t[:most])
    kind = ""
    if any(x.lower() in t.lower() for x in INJECTION_TOKENS):
        kind = "dangerous_token"
    else:
        kind = next((n for n, p in INJECTION_PATTERNS if re.search("(?i)" + p, t)), "")
    return (f"[FLAGGED:{kind}] {t}" if kind else t).strip()


def samples():
    rnd = random.Random(2)
    parts = [" ", "\n", "\t", "\x00", "\x85", " ", "\x1c", "ignore", "previous", "all", "instructions", "you are now", "ACT as a", "show", "system", "prompt", "[inst]", "<|IM_end|>", "x" * 19, "x" * 15, "é", "İ", "ශ", "வ"]
    yield from ODD
    for _ in range(600):
        yield "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 9)))
    for gap in (19, 20, 21):
        yield "ignore" + "a" * gap + "previous" + "b" * gap + "instruction"
    for gap in (14, 15, 16):
        yield "show" + "a" * gap + "system" + "b" * gap + "prompt"
    yield "ignore\nall instructions"


def test_text_functions_equal_python(spark):
    texts = list(samples())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    t = F.col("t")
    got = df.select("id", text.sanitize(t).alias("s"), text.py_strip(t).alias("p"), text.normalize(t).alias("n"), text.detect_language(t).alias("l")).collect()
    for r in got:
        x = texts[r.id]
        first = next((c for c in x if "඀" <= c <= "෿" or "஀" <= c <= "௿"), None)
        assert r.s == plain_sanitize(x), repr(x)
        assert r.p == x.strip(), repr(x)
        assert r.l == ("en" if first is None else "si" if first >= "඀" else "ta")
        if x.isascii():
            assert r.n == " ".join(x.lower().split()), repr(x)


def test_null_texts(spark):
    df = spark.createDataFrame([(None,)], "t string")
    t = F.col("t")
    row = df.select(text.sanitize(t).alias("a"), text.normalize(t).alias("b"), text.detect_language(t).alias("c"), text.first_filled(t, default="d").alias("d"), text.contains_any(t, ("x",)).alias("e")).first()
    assert tuple(row) == ("", "", "en", "d", False)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("message", "intent", "keywords"),
    [
        ("", "Unclear", []),
        ("  Thank You ", "Non_Medical", ["thank you"]),
        ("I have severe CHEST pain", "Emergency_Triage", ["severe chest pain", "chest pain"]),
        ("Which hospitals are near?", "Facility_Locator", ["hospital", "hospitals", "which", "near"]),
        ("the latest news", "Test_Diagnostics", ["test", "latest", "news"]),
        ("want details about know with from please fever", "Symptom_Information", ["fever"]),
        ("zzz", "Unclear", []),
    ],
)
def test_router(spark, message, intent, keywords):
    got = one(spark, router.fallback(F.lit(message)))
    assert (got.intent, got.keywords) == (intent, keywords)


def test_router_reaches_every_intent(spark):
    texts = [terms[0] for _, terms in INTENT_TERMS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(router.fallback(F.col("t")).intent.alias("i"))
    assert [r.i for r in df.collect()] == [i for i, _ in INTENT_TERMS]
    assert {i for i, _ in INTENT_TERMS} < set(INTENTS)


RAW = [
    ('{"intent": "Emergency", "keywords": "one", "reason": 1}', "Emergency_Triage", ["one"], None),
    ('<think>{a}</think> {"intent": "Unclear", "keywords": [" a ", "", 3]}', "Unclear", ["a", "3"], None),
    ('```json\n{"intent": "Medical Emergency"}\n```', "Emergency_Triage", [], None),
    ('{"intent": "Nonsense"}', "Unclear", [], "unsupported_intent"),
    ('{"intent": "Cost_Insurance"} trailing', "Cost_Insurance", [], None),
    ("no json", "Unclear", [], "invalid_json"),
    ("[1]", "Unclear", [], "invalid_json"),
    ('[{"intent": "Cost_Insurance"}]', "Cost_Insurance", [], None),
    ('{"a": {"intent": "Cost_Insurance"}', "Cost_Insurance", [], None),
    ('{"intent": "Unclear", "intent": "Cost_Insurance"}', "Cost_Insurance", [], None),
    ("[" * 100_000, "Unclear", [], "invalid_json"),
    ('{"a":' * 30_000, "Unclear", [], "invalid_json"),
    (None, "Unclear", [], "invalid_json"),
    ('{"intent": " "}', "Unclear", [], None),
]


def test_parse_output(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RAW)], "id int, raw string")
    for r in router.parse_output(df, "raw").collect():
        _, intent, keywords, error = RAW[r.id]
        assert (r.payload.intent, r.payload.keywords) == (intent, keywords), RAW[r.id]
        assert (r.error or "").split(":")[0] == (error or ""), RAW[r.id]
        assert error != "invalid_json" or r.error == "invalid_json: No JSON object found: line 1 column 1 (char 0)"


def test_gates(spark):
    lit = F.lit
    assert one(spark, router.relevance_gate(lit("yes"), lit(False), lit(0))) == "no_context_response"
    assert one(spark, router.relevance_gate(lit("no"), lit(True), lit(2))) == "improve"
    assert one(spark, router.relevance_gate(lit(None).cast("string"), lit(True), lit(3))) == "no_context_response"
    assert one(spark, router.critique_gate(lit(True), lit(""), lit(0))) == "end"
    assert one(spark, router.critique_gate(lit(True), lit("x"), lit(1))) == "generate_answer"
    assert one(spark, router.critique_gate(lit(True), lit("x"), lit(2))) == "end"
    assert one(spark, router.tool_for(lit("do you know"), lit(None).cast("string"))) == "web_search"
    assert one(spark, router.tool_for(lit("now"), lit("dengue"))) == "retrieve"
    assert one(spark, text.localized("clarify", lit("xx"))).startswith("Could")
