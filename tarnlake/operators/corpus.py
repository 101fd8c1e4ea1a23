"""Corpus preparation: scan, citation, chunking, global chunk numbers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.config import SETTINGS
from tarnlake.functions.text import filled, first_filled, py_strip

COLUMNS = ["doc_id", "markdown", "source_url", "source_pdf", "title", "site"]
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def scan(df: DataFrame) -> DataFrame:
    """Documents with content: page_content, source_reference (URL, else PDF, else id), title, site, doc_id."""
    rows = df.select(*COLUMNS).filter(filled(F.col("markdown")).isNotNull())
    url, pdf, doc = F.col("source_url"), F.col("source_pdf"), F.col("doc_id")
    return rows.select(
        py_strip(doc).alias("doc_id"),
        py_strip(F.col("markdown")).alias("page_content"),
        first_filled(url, pdf, doc).alias("source_reference"),
        first_filled(F.col("title")).alias("title"),
        first_filled(F.col("site")).alias("site"),
    )


def scan_counts(df: DataFrame) -> DataFrame:
    blank = filled(F.col("markdown")).isNull()
    return df.agg(F.count_if(~blank).alias("loaded"), F.count_if(blank).alias("skipped"))


def chunk_fixed(docs: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``, while they add something new."""
    step = size - overlap
    n = F.length("page_content")
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    # cut inside the row: an explode of positions would copy the whole text to each of its chunks
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substr(F.col("page_content"), k * step + 1, F.lit(size)))
    return docs.select("doc_id", "source_reference", F.posexplode(pieces).alias("part", "content")).filter("content != ''")


def number_chunks(chunks: DataFrame, parts: int | None = None, whole: bool = False) -> DataFrame:
    """Adds chunk_index: 0, 1, ... over all chunks in order of (numeric doc_id, part).

    ``whole``: each document has its parts 0, 1, ... without a gap, as the splitters give them; its chunks then
    need not be sorted again.

    Prefix sums over ranges: counts of ranges of ids enter one running sum, a window numbers each range.
    """
    by_doc = chunks.withColumn("_id", F.col("doc_id").cast("long"))
    firsts = first_numbers(by_doc.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")), parts).drop("_n")
    local = F.col("part") if whole else F.row_number().over(Window.partitionBy("_id").orderBy("part")) - 1
    return by_doc.withColumn("_local", local).join(firsts, "_id").withColumn("chunk_index", F.col("_first") + F.col("_local")).drop("_id", "_local", "_first")


def chunk_counts(docs: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """(_id, _n): how many chunks ``chunk_fixed`` cuts of each document, without cutting them."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("page_content") - overlap) / step).cast("int"))
    return docs.filter("page_content != ''").select(F.col("doc_id").cast("long").alias("_id"), n.alias("_n")).groupBy("_id").agg(F.sum("_n").alias("_n"))


def first_numbers(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """(_id, _n, _first) of (_id, _n): the sum of _n over all smaller ids. Narrow rows only."""
    n = parts or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # kept: both readers must see the same ranges
    counts = counts.repartitionByRange(n, "_id").withColumn("_range", F.spark_partition_id()).cache()
    totals = counts.groupBy("_range").agg(F.sum("_n").alias("_sum"))  # a row for each range
    bases = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return before.join(F.broadcast(bases), "_range").select("_id", "_n", (F.col("_before") + F.col("_base")).alias("_first"))


def number_hits(hits: DataFrame, firsts: DataFrame) -> DataFrame:
    """chunk_index in place of (num, part) of a few rows, such as a top list, which is what is broadcast."""
    found = firsts.join(F.broadcast(hits), firsts["_id"] == hits["num"])
    return found.withColumn("chunk_index", F.col("_first") + F.col("part")).drop("_id", "_n", "_first", "num", "part")


def chunks_at(docs: DataFrame, firsts: DataFrame, numbers: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """The chunks of the few chunk_index in ``numbers``, with their other columns: only their documents are cut."""
    at = (F.col("chunk_index") >= F.col("_first")) & (F.col("chunk_index") < F.col("_first") + F.col("_n"))
    places = firsts.join(F.broadcast(numbers), at).select(F.col("_id"), (F.col("chunk_index") - F.col("_first")).alias("part"), *numbers.columns)
    own = docs.withColumn("_id", F.col("doc_id").cast("long"))
    piece = F.substr(F.col("page_content"), (F.col("part") * (size - overlap) + 1).cast("int"), F.lit(size))
    return own.join(F.broadcast(places), "_id").withColumn("content", piece).select("doc_id", "source_reference", "part", "content", *numbers.columns)


def split_recursive(text: str, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the first separator that occurs, keep it with its piece, cut
    longer pieces at the next one, merge neighbours up to ``size`` and carry at most ``overlap`` over."""
    out: list[str] = []
    held: deque[str] = deque()
    n = 0
    for p in split_pieces(text, size, separators) if text else ():
        if held and n + len(p) > size:
            out.append("".join(held))
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.popleft())
        held.append(p)
        n += len(p)
    out.append("".join(held))
    return [s for s in (x.strip() for x in out) if s]


def split_pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Uncut pieces of at most ``size``; joined they are the text."""
    sep = next((s for s in separators if s == "" or s in text), "")
    if not sep:
        return [text[k : k + size] for k in range(0, len(text), size)]
    cut = text.split(sep)
    pieces = [p + sep for p in cut[:-1]] + [cut[-1]] * bool(cut[-1])
    return [q for p in pieces for q in ([p] if len(p) <= size else split_pieces(p, size, separators[separators.index(sep) + 1 :]))]


def chunk_recursive(docs: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """The same columns as ``chunk_fixed``; Python in Arrow batches, as merging carries state along a text."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_recursive(t, size, overlap) if t else [])

    return docs.select("doc_id", "source_reference", F.posexplode(split("page_content")).alias("part", "content"))


def rehydrate(cached: DataFrame) -> DataFrame:
    """Documents from cached chunk rows: blank ones go, a missing source is "Unknown", id is the number as text."""
    rows = cached.filter(filled(F.col("content")).isNotNull())
    return rows.select(
        F.col("chunk_index").cast("string").alias("id"),
        "chunk_index",
        py_strip(F.col("content")).alias("page_content"),
        F.coalesce(F.nullif("source_reference", F.lit("")), F.lit("Unknown")).alias("source_reference"),
    )
