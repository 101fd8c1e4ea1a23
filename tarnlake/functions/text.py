"""Column functions for text hygiene, all in built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.config import SETTINGS
from tarnlake.functions.lexicon import INJECTION_PATTERNS, INJECTION_TOKENS, MESSAGES

SPACE = r"[\s\x1c-\x1f]"  # with (?U): the white space that Python's str.split knows
# the same characters one by one, for trimming without a pattern
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """The text without outer white space, null if nothing is left."""
    return F.nullif(py_strip(c), F.lit(""))


def first_filled(*cols: Column, default: str = "") -> Column:
    """The first text that is not blank: an empty string counts as missing."""
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def normalize(c: Column) -> Column:
    """Lower case, each run of white space one space, none outside; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U){SPACE}+", " "))


def detect_language(c: Column) -> Column:
    """By the first character of a known script: si (Sinhala), ta (Tamil), else en."""
    first = F.regexp_extract(F.coalesce(c, F.lit("")), "[\\u0D80-\\u0DFF\\u0B80-\\u0BFF]", 0)
    return F.when(first == "", "en").when(first >= "඀", "si").otherwise("ta")


def injection_type(c: Column) -> Column:
    """The first sign of prompt injection, else an empty string. Literal tokens come before patterns."""
    low = F.lower(c)
    out = F.when(any_of(low, [t.lower() for t in INJECTION_TOKENS]), "dangerous_token")
    for name, pattern in INJECTION_PATTERNS:
        out = out.when(c.rlike("(?iud)" + pattern), name)
    return out.otherwise("")


def any_of(c: Column, terms: Iterable[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | c.contains(t)
    return hit


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Plain substrings of the lower-cased text: no word borders."""
    return bind(F.lower(F.coalesce(c, F.lit(""))), lambda t: any_of(t, terms))


def sanitize(c: Column, max_length: int = SETTINGS.max_input_length, check_injection: bool = True) -> Column:
    """Cut to ``max_length`` characters, drop control characters, mark injections, strip. Null is empty.

    The mark is added after the cut, so a marked text may be longer.
    """
    clean = F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, max_length), CONTROL, "")
    if not check_injection:
        return py_strip(clean)
    kind = injection_type(clean)
    return py_strip(F.when(kind == "", clean).otherwise(F.concat(F.lit("[FLAGGED:"), kind, F.lit("] "), clean)))


def message_error(clean: Column) -> Column:
    """Why a request is refused: nothing is left of its sanitized message. Null if it is accepted."""
    return F.when(clean == "", "Message is empty or invalid.")


def strip_json_fence(c: Column) -> Column:
    """The inside of a text that is one fenced block, else the stripped text."""
    text = py_strip(c)
    pattern = r"(?siU)^```(?:json)?\s*(.*?)\s*```\z"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def localized(kind: str, language: Column, default: str | None = None) -> Column:
    """The message of that kind; an unknown language gets ``default`` or the English one."""
    texts = MESSAGES[kind]
    fallback = F.lit(default if default is not None else texts["en"])
    out = None
    for code, text in texts.items():
        out = F.when(language == code, text) if out is None else out.when(language == code, text)
    return out.otherwise(fallback)


def iso_timestamp(ts: Column) -> Column:
    """UTC, milliseconds cut off, trailing Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_label(ts: Column) -> Column:
    """As in "Tue Jan 2, 2024"."""
    return F.date_format(ts, "EEE MMM d, yyyy")


def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """The URL's host is one of ``hosts`` or below one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def fill_template(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by the column of that name; null is empty.

    The template is cut once, so that what stands in a value, braces too, is text.
    """
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template) if values else [template]
    filled_in = [F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)]
    return F.concat(*filled_in)
