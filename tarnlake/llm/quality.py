"""Quality rules as a short-circuit cascade ordered by rejection per cost.

DataFrame functions only. Every rule is a predicate "this document fails" over a document's ``Parts``. On a random sample
each rule's cost (its measured run time from the raw text on) and selectivity (its share of rejected documents)
are estimated; the rules then stand in one CASE expression, most rejection per cost first, so that a document pays
only for the rules up to the first that rejects it: lines, windows and all else but the words, which every rule needs,
are cut inside the rules. The order changes cost, never the verdict.

Null and empty texts have no words; texts of any length are read whole. Repeated rows and ids are judged each on
their own, extra columns pass through whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch

WORD, SPACE_RUN = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    inside = F.btrim(text, F.lit(SPACES))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, SPACE_RUN))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def once(value: Column) -> Column:
    """The value, computed once for each row: the optimizer moves neither filters nor projections through a
    generator, so an expensive column is not repeated in each place that names it."""
    return F.explode(F.array(value))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed where it is needed and once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _text (null: empty) and _w (its words)."""
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn("_w", once(words_of(F.col("_text"))))


def windows(words: Column) -> Column:
    """A 64-bit hash of each window of three words, in order."""
    last = F.size(words) - 2
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(last > 0, F.slice(hashes, F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<long>"))


def repeat_words(words: Column, most: Callable[[Column], Column] | None = None) -> Column:
    """Words covered by three-word windows that occur twice or more; null where they are at most ``most`` (of the number
    of windows that repeat an earlier hash, each of which covers six words at most).

    Texts without any repeated window hash, which are most, leave at a hash-set test. For the rest, 33 bits of each hash
    with the window's start behind them are sorted as plain numbers; windows alone with their bits drop out. The others'
    (hash, start) pairs are sorted, neighbours of equal hash are compared word by word, and the union of the
    windows found is measured from their sorted starts.
    """
    three = lambda i: F.slice(words, i + 1, 3)
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (three(a["i"]) == three(b["i"])), F.lit(False))
    alike = lambda a, b: F.shiftright(a.bitwiseXOR(b), 31) == 0

    def covered(grams: Column) -> Column:
        marked = F.sort_array(F.transform(grams, lambda h, i: F.shiftleft(h, 31).bitwiseOR(i.cast("long"))))
        several = bound(marked, lambda s: F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1))))
        start = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        pairs = F.sort_array(F.transform(several, lambda x: F.struct(F.get(grams, start(x)).alias("h"), start(x).alias("i"))))
        repeated = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        starts = bound(pairs, lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")),
            lambda acc: acc["n"],
        )

    def measured(grams: Column) -> Column:
        again = F.size(grams) - F.size(F.array_distinct(grams))
        nothing = F.lit(0).cast("long")
        found = lambda n: F.when(n == 0, nothing) if most is None else F.when(most(n), F.lit(None).cast("long"))
        return bound(again, lambda n: found(n).otherwise(covered(grams)))

    return bound(windows(words), measured)


class Parts:
    """What rules are made of, as expressions over _text and _w that are computed where a rule names them; ``counted``
    names columns that hold some of it already."""

    def __init__(self, counted: tuple[str, ...] = ()):
        self._counted = counted

    def _or(self, name: str, value: Callable[[], Column]) -> Column:
        return F.col(name) if name in self._counted else value()

    def n_words(self) -> Column:
        return self._or("n_words", lambda: F.size("_w").cast("long"))

    def word_chars(self) -> Column:
        return self._or("word_chars", lambda: F.length(F.array_join("_w", "")).cast("long"))

    def n_symbols(self) -> Column:
        return self._or("n_symbols", lambda: (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOL, ""))).cast("long"))

    def lines(self) -> Column:
        """Struct(n: lines with a word, dup: those equal to an earlier one)."""
        counts = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
        return self._or("lines", lambda: bound(lines_with_words(F.col("_text")), counts))

    def n_repeat_words(self) -> Column:
        return self._or("n_repeat_words", lambda: repeat_words(F.col("_w")))

    def letter_words(self) -> Column:
        return self._or("letter_words", lambda: F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))))

    def repeats_over(self, pct: int) -> Column:
        """100 * n_repeat_words > pct * n_words. A repeated window's words occur elsewhere too, so c covered words leave
        n_words - c / 2 distinct ones at most: texts with more than (1 - pct / 200) * n_words need no windows. Where n
        windows repeat an earlier one, at most 2 n windows are repeated at all, and they cover 6 n words: texts
        for which that is too few need no comparing."""
        if "n_repeat_words" in self._counted:
            return 100 * self.n_repeat_words() > pct * self.n_words()
        few = 200 * F.size(F.array_distinct("_w")) <= (200 - pct) * F.size("_w")
        covered = repeat_words(F.col("_w"), lambda n: 600 * n.cast("long") <= pct * F.size("_w"))
        return F.when(few, F.coalesce(100 * covered > pct * self.n_words(), F.lit(False))).otherwise(False)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Parts], Column]


def production_rules(
    min_words: int = 50,
    repeat_pct: int = 50,
    symbol_pct: int = 5,
    dup_line_pct: int = 40,
    min_word_len: int = 2,
    max_word_len: int = 20,
    letter_word_pct: int = 50,
) -> list[Rule]:
    """Integer comparisons throughout; a document without words fails min_words."""
    return [
        Rule("min_words", lambda p: p.n_words() < min_words),
        Rule("repeats", lambda p: p.repeats_over(repeat_pct)),
        Rule("symbols", lambda p: 100 * p.n_symbols() > symbol_pct * p.word_chars()),
        Rule("dup_lines", lambda p: bound(p.lines(), lambda x: 100 * x["dup"] > dup_line_pct * x["n"])),
        Rule("word_length", lambda p: bound(p.word_chars(), lambda n: (n < min_word_len * p.n_words()) | (n > max_word_len * p.n_words()))),
        Rule("letters", lambda p: 100 * p.letter_words() < letter_word_pct * p.n_words()),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """The rules by rejection per cost on a random sample of about ``sample_rows`` rows of (text).

    Costs are run times over the sample beyond that of an empty pass. An empty table keeps the order given.
    """
    n = docs.count()
    if n == 0:
        return list(rules)
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.table(docs.select("text").sample(fraction=min(1.0, sample_rows / n), seed=seed), "sample")
    worded = with_words(sample)

    def timed(flag: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = worded.agg(F.coalesce(F.sum(flag.cast("int")), F.lit(0)).alias("n")).first()["n"]
        return time.perf_counter() - began, hits

    timed(F.size("_w") < 0)  # compiles what the passes share
    base, _ = timed(F.size("_w") < 0)
    found = {r.name: timed(r.fails(Parts())) for r in rules}
    scratch.drop()
    return sorted(rules, key=lambda r: -(found[r.name][1] + 0.5) / max(found[r.name][0] - base, 1e-3))


def cascade(rules: list[Rule], parts: Parts = Parts()) -> Column:  # noqa: B008
    """Name of the first rule, in the given order, that rejects the document; null: kept. Rules behind it are not
    computed."""
    out: Column | None = None
    for r in rules:
        out = F.when(r.fails(parts), r.name) if out is None else out.when(r.fails(parts), r.name)
    return F.lit(None).cast("string") if out is None else out


def filter_documents(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows that every rule keeps, with the columns they had. Null and empty texts are rejected
    by min_words; helper columns are local to a struct, so clashing names in the input survive."""
    rules = order_rules(docs, rules or production_rules(), sample_rows)
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    kept = with_words(carried).filter(cascade(rules).isNull())
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def quality_report(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Per document: the base counts, base_failed, and kept (the cascade's verdict).

    A null text counts as one without words. Base counts are always computed, as they are returned; the verdict
    reads their columns, and of the other rules those that the cascade reaches are computed.
    """
    rules = order_rules(docs, rules or production_rules(), sample_rows)
    p, names = Parts(), ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")
    base = F.struct(*[getattr(p, n)().alias(n) for n in names])
    counted = with_words(docs.select("doc_id", "text")).withColumn("_counts", once(base))
    counted = counted.select("doc_id", "_text", "_w", *[F.col(f"_counts.{n}").alias(n) for n in names])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.when(failed, False).otherwise(cascade([r for r in rules if r.name not in ("min_words", "repeats")], Parts(names)).isNull())
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"), verdict.alias("kept"))
