"""The deterministic intent router and the shapes that router output takes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.config import SETTINGS
from tarnlake.functions.lexicon import INTENT_ALIASES, INTENTS, Lexicon
from tarnlake.functions.text import any_of, bind, contains_any, filled, py_strip, strip_json_fence

PAYLOAD = "language string, intent string, keywords array<string>, english_translation_or_summary string"
NO_WORDS = "array<string>"


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """Those of ``terms`` that occur in the text, in the order of ``terms``."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t))


def keyword_candidates(text: Column, terms: tuple[str, ...], stop_words: tuple[str, ...] = Lexicon.stop_words, most: int = 8) -> Column:
    """Matched terms, then the text's words of four letters or more without stop words; each once."""

    def found(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit("([A-Za-z][A-Za-z-]{3,})"), F.lit(1))
        words = F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words
        return F.slice(F.array_distinct(F.concat(hits(t, terms), words)), 1, most)

    return bind(text, found)


def fallback(message: Column, lexicon: Lexicon = Lexicon()) -> Column:  # noqa: B008
    """Struct(intent, keywords) of the rules in order: blank, social phrase, emergency, first intent with a term."""
    none = F.array().cast(NO_WORDS)

    def found(intent: str, keywords: Column) -> Column:
        return F.struct(F.lit(intent).alias("intent"), keywords.alias("keywords"))

    def rules(t: Column) -> Column:
        out = F.when(t == "", found("Unclear", none))
        out = out.when(t.isin(*lexicon.social), found("Non_Medical", F.array(t)))
        out = out.when(any_of(t, lexicon.emergency), found("Emergency_Triage", F.slice(hits(t, lexicon.emergency), 1, 8)))
        for intent, terms in lexicon.intents:
            out = out.when(any_of(t, terms), found(intent, keyword_candidates(t, terms, lexicon.stop_words)))
        return out.otherwise(found("Unclear", none))

    return bind(F.lower(py_strip(F.coalesce(message, F.lit("")))), rules)


def canonical_intent(c: Column) -> Column:
    """Blank is Unclear; aliases map to their intent; other names stay."""
    name = F.coalesce(filled(c), F.lit("Unclear"))
    out = None
    for alias, intent in INTENT_ALIASES.items():
        out = F.when(name == alias, intent) if out is None else out.when(name == alias, intent)
    return out.otherwise(name)


def clean_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast(NO_WORDS)), py_strip), lambda k: k != "")


def payload_from_json(text: Column) -> Column:
    """The four payload fields of a JSON object; a single keyword may stand alone; other shapes are empty."""
    v = F.try_parse_json(text)
    several = F.try_variant_get(v, "$.keywords", NO_WORDS)
    single = F.when(F.schema_of_variant(F.try_variant_get(v, "$.keywords", "variant")) == "STRING", F.array(F.try_variant_get(v, "$.keywords", "string")))
    field = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    return F.struct(
        F.coalesce(py_strip(field("language")), F.lit("")).alias("language"),
        canonical_intent(field("intent")).alias("intent"),
        clean_keywords(F.coalesce(single, several)).alias("keywords"),
        F.coalesce(py_strip(field("english_translation_or_summary")), F.lit("")).alias("english_translation_or_summary"),
    )


def allowed(intent: Column) -> Column:
    return intent.isin(*INTENTS)


NO_OBJECT = "No JSON object found: line 1 column 1 (char 0)"


def first_object(text: str, most_read: int = 50) -> tuple[dict | None, str | None]:
    """(object, error): the whole text if it is an object, else the first brace from which an object can be read.

    Nesting too deep for the reader counts as unreadable. Braces are tried until ``most_read`` times the text's
    length has been read in vain, which only texts of thousands of unclosed braces reach.
    """
    reader = json.JSONDecoder()
    try:
        value = reader.decode(text)
    except (ValueError, RecursionError):
        value = None
    at, left = (-1 if isinstance(value, dict) else text.find("{")), most_read * len(text) + 100_000
    while at >= 0 and left > 0:
        try:
            value, _ = reader.raw_decode(text, at)
            left -= 1
        except json.JSONDecodeError as e:
            left -= e.pos - at + 1
        except RecursionError:
            left -= 10_000
        if isinstance(value, dict):
            break
        at = text.find("{", at + 1)
    return (value, None) if isinstance(value, dict) else (None, NO_OBJECT)


def _read_objects(text: Column) -> Column:
    """Struct(object as JSON text, error) of each text. Python, in Arrow batches: reading an object from the middle
    of a text has no built-in form. A null text is passed over."""

    @F.pandas_udf("object string, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [first_object(t) if t is not None else (None, None) for t in texts]
            yield pd.DataFrame({"object": [None if o is None else json.dumps(o, ensure_ascii=False) for o, _ in rows], "error": [e for _, e in rows]}, dtype=object)

    return read(text)


def repair_json(df: DataFrame, column: str, out: str = "object") -> DataFrame:
    """Adds the router's object as JSON text (null: none) and ``<out>_error``. A null text counts as empty."""
    text = strip_json_fence(F.coalesce(F.col(column), F.lit("")))
    return df.withColumn("_read", _read_objects(text)).withColumns({out: F.col("_read.object"), f"{out}_error": F.col("_read.error")}).drop("_read")


def parse_output(df: DataFrame, column: str) -> DataFrame:
    """Adds payload (intent Unclear where it is not allowed) and error: null, invalid_json or unsupported_intent.

    Texts that begin with an object are read in the JVM; only the others go to Python.
    """
    text = df.withColumn("_text", strip_json_fence(F.coalesce(F.col(column), F.lit(""))))
    own = F.col("_text").startswith("{") & F.try_parse_json("_text").isNotNull()
    read = text.withColumn("_own", own).withColumn("_read", _read_objects(F.when(~F.col("_own"), F.col("_text"))))
    found = F.when(F.col("_own"), F.col("_text")).otherwise(F.col("_read.object"))
    got = read.withColumn("_p", F.when(found.isNotNull(), payload_from_json(found)))
    ok = allowed(F.col("_p.intent"))
    empty = F.struct(F.lit("").alias("language"), F.lit("Unclear").alias("intent"), F.array().cast(NO_WORDS).alias("keywords"), F.lit("").alias("english_translation_or_summary"))
    payload = F.when(F.col("_p").isNull(), empty).when(ok, F.col("_p")).otherwise(F.col("_p").withField("intent", F.lit("Unclear")))
    error = F.when(F.col("_p").isNull(), F.concat(F.lit("invalid_json: "), F.col("_read.error"))).when(~ok, "unsupported_intent")
    return got.withColumns({"payload": payload, "error": error}).drop("_text", "_own", "_read", "_p")


def normalize_row(df: DataFrame) -> DataFrame:
    """A log row before it is stored: trimmed fields, blank to null, latency not below 0; intents as they are."""
    return df.select(
        "id",
        "session_id",
        filled(F.col("language")).alias("language"),
        F.coalesce(filled(F.col("intent")), F.lit("Unclear")).alias("intent"),
        clean_keywords(F.col("keywords")).alias("keywords"),
        F.greatest(F.coalesce("latency_ms", F.lit(0).cast("long")), F.lit(0).cast("long")).alias("latency_ms"),
    )


def stored_row(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The router log's row: what the graph routed by (route_language, route_intent, route_keywords, route_summary), each
    from the model's ``payload`` (JSON text) where it is missing or empty, beside the payload itself cleaned.

    Rows without any intent are not logged. The stored intent keeps its name: aliases are not mapped here.
    """
    v = F.try_parse_json(payload)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    missing = lambda c: F.nullif(F.col(c), F.lit(""))
    single = F.when(F.schema_of_variant(F.try_variant_get(v, "$.keywords", "variant")) == "STRING", F.array(field("keywords")))
    words = F.coalesce(single, F.try_variant_get(v, "$.keywords", NO_WORDS), F.array().cast(NO_WORDS))
    cleaned = F.struct(
        F.coalesce(py_strip(field("language")), F.lit("")).alias("language"),
        py_strip(F.coalesce(F.nullif(field("intent"), F.lit("")), F.lit("Unclear"))).alias("intent"),
        clean_keywords(words).alias("keywords"),
        F.coalesce(py_strip(field("english_translation_or_summary")), F.lit("")).alias("english_translation_or_summary"),
    )
    rows = df.select(
        "session_id",
        "turn_index",
        "user_message",
        F.coalesce(missing("route_language"), field("language")).alias("language"),
        F.coalesce(missing("route_intent"), F.nullif(field("intent"), F.lit(""))).alias("intent"),
        F.when(F.size(F.coalesce("route_keywords", F.array().cast(NO_WORDS))) > 0, F.col("route_keywords")).otherwise(words).alias("keywords"),
        F.coalesce(missing("route_summary"), field("english_translation_or_summary")).alias("english_translation_or_summary"),
        cleaned.alias("router_payload"),
        "created_at",
        F.greatest(F.coalesce("latency_ms", F.lit(0).cast("long")), F.lit(0).cast("long")).alias("latency_ms"),
    )
    return rows.filter("intent is not null")


# ---- control flow as pure functions of a row -------------------------------------------------------


def final_intent(model_intent: Column, model_error: Column, fallback_intent: Column) -> Column:
    """The model's intent, or the rules' where the model failed and the rules know better."""
    model = F.coalesce(model_intent, F.lit("Unclear"))
    return F.when(model_error.isNotNull() & (fallback_intent != "Unclear"), fallback_intent).otherwise(model)


def next_agent(intent: Column, rag_query: Column, needs_follow_up: Column) -> Column:
    query = filled(rag_query).isNotNull()
    return F.when(needs_follow_up, "finalize_response").when(intent.isin("Unclear", "Non_Medical"), "query_classifier_agent").when(query, "medical_info_agent").otherwise("query_classifier_agent")


def tool_for(query: Column, rag_query: Column, terms: tuple[str, ...] = Lexicon.current) -> Column:
    """web_search for time-sensitive questions, retrieve for a prepared query, else the model chooses."""
    prepared = F.coalesce(rag_query, F.lit("")) != ""
    asked = F.when(prepared, rag_query).otherwise(query)
    return F.when(contains_any(asked, terms), "web_search").when(prepared, "retrieve").otherwise("llm")


def relevance_gate(score: Column, has_context: Column, attempts: Column, most: int = SETTINGS.max_rewrite_attempts) -> Column:
    return F.when(~has_context, "no_context_response").when(score == "yes", "generate_answer").when(attempts >= most, "no_context_response").otherwise("improve")


def critique_gate(needs: Column, feedback: Column, attempts: Column, most: int = SETTINGS.max_critique_attempts) -> Column:
    again = needs & (F.coalesce(feedback, F.lit("")) != "")
    return F.when(attempts >= most, "end").when(again, "generate_answer").otherwise("end")
