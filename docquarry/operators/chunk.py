"""Overlapping chunks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.config import Config
from docquarry.functions.text import collapse


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"the chunk size must be positive, not {size}")
    if overlap < 0:
        raise ValueError(f"the overlap must not be negative, but is {overlap}")
    if overlap >= size:
        raise ValueError(f"the overlap ({overlap}) must be smaller than the chunk size ({size})")


def _windows(clean: Column, size: int, step: int) -> Column:
    """How many windows a page has, its whitespace collapsed."""
    if size == 1:  # those on a space hold nothing
        return F.length(F.replace(clean, F.lit(" ")))
    return F.when(F.length(clean) > 0, F.greatest(F.lit(0), F.expr(f"cast((length(clean) - {size} + {step - 1}) div {step} as int)")) + 1).otherwise(0)


def _cut(pages: DataFrame, size: int, step: int) -> DataFrame:
    """(doc_id, page_number, clean, base): chunks, the first of each page numbered base."""
    last = F.length("clean") - 1 if size == 1 else _windows(F.col("clean"), size, step) - 1
    windows = pages.filter(F.length("clean") > 0).select("doc_id", "page_number", "clean", "base", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    before = F.length(F.replace(F.substring("clean", F.lit(1), F.col("i")), F.lit(" "))) if size == 1 else F.col("i")
    cut = windows.select("doc_id", (F.col("base") + before).cast("int").alias("chunk_id"), "page_number", (F.col("i") * step).alias("start"), F.trim(F.substring("clean", F.col("i") * step + 1, F.lit(size))).alias("text"))
    return cut.filter(F.length("text") > 0)


def chunk_pages(pages: DataFrame, size: int = Config.chunk_size, overlap: int = Config.chunk_overlap) -> DataFrame:
    """(doc_id, page_number, text) -> doc_id, chunk_id, page_number, start, text.

    Windows of `size` characters over the page's text, whitespace collapsed,
    each `overlap` characters into the one before; the first that reaches the
    end is the last. Chunks do not cross pages. chunk_id counts a document's
    chunks from 0. The only shuffle is of pages, by doc_id, which are numbered
    by the windows of the pages before them; where a document is one row,
    chunk_documents() needs none.
    """
    check_chunking(size, overlap)
    step = size - overlap
    clean = pages.select("doc_id", "page_number", collapse(F.col("text")).alias("clean"))
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return _cut(clean.withColumn("base", F.coalesce(F.sum(_windows(F.col("clean"), size, step)).over(before), F.lit(0))), size, step)


def _numbered(docs: DataFrame, size: int, step: int) -> DataFrame:
    """(doc_id, pages) with n, the windows of each page."""
    clean = docs.select("doc_id", F.transform("pages", collapse).alias("pages"))
    return clean.withColumn("n", F.expr("transform(pages, clean -> " + _sql_windows(size, step) + ")"))


def _sql_windows(size: int, step: int) -> str:
    if size == 1:
        return "length(replace(clean, ' '))"
    return f"if(length(clean) > 0, greatest(0, cast((length(clean) - {size} + {step - 1}) div {step} as int)) + 1, 0)"


def chunk_documents(docs: DataFrame, size: int = Config.chunk_size, overlap: int = Config.chunk_overlap) -> DataFrame:
    """(doc_id, pages: array of texts), one row for each document -> as chunk_pages(), without a shuffle."""
    check_chunking(size, overlap)
    step = size - overlap
    sums = "aggregate(n, named_struct('at', 0, 'all', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x, 'all', array_append(s.all, s.at)))"
    rows = _numbered(docs, size, step).select("doc_id", "pages", F.expr(f"{sums}.all").alias("bases"))
    pages = rows.select("doc_id", F.posexplode(F.arrays_zip("pages", "bases")).alias("i", "p"))
    return _cut(pages.select("doc_id", (F.col("i") + 1).alias("page_number"), F.col("p.pages").alias("clean"), F.col("p.bases").alias("base")), size, step)


def count_chunks(docs: DataFrame, size: int = Config.chunk_size, overlap: int = Config.chunk_overlap) -> DataFrame:
    """(doc_id, pages: array of texts) -> doc_id, page_count, chunk_count, without making chunks."""
    check_chunking(size, overlap)
    total = F.expr("aggregate(n, 0L, (s, x) -> s + x)")
    return _numbered(docs, size, size - overlap).select("doc_id", F.size("pages").cast("long").alias("page_count"), total.alias("chunk_count"))


def without_chunks(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have pages but no chunk: doc_id, stage, message."""
    lost = pages.select("doc_id").distinct().join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
    return lost.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("chunk").alias("stage"), F.lit("The document has no text to chunk.").alias("message"))
