"""Files to pages: binary files, a router by extension, and one parser a format.

Every function that reads several files is lazy and never fails for one of
them: what cannot be read becomes a row of errors (doc_id, stage, message).
Single-file functions raise.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import SUPPORTED, Config
from docquarry.errors import DocumentProcessingError
from docquarry.functions.text import suffix
from docquarry.operators.paginate import pages_of_paragraphs, solid, table_row
from docquarry.schemas import UPLOAD
from docquarry.sources import docx, pdf

EMPTY = "The file is empty."
BLANK = "The document has no text."
NO_PAGES = "The PDF file has no pages."
CORRUPT = "The PDF file is damaged and cannot be opened."
UNREADABLE = "The file cannot be read."
UNKNOWN = "Files of type {} are not supported; these are: " + ", ".join(sorted(SUPPORTED))


def unsupported(extension: str) -> str:
    return UNKNOWN.format(extension or "(none)")


def route(name: Column) -> Column:
    """pdf, docx, or unsupported."""
    ext = suffix(name)
    return F.when(ext.isin(*SUPPORTED), F.substring(ext, 2, 10)).otherwise("unsupported")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_id (the path), filename, content of the files under a path."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        files = reader.load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


_PARSED = "doc_id string, n int, kind string, cells array<string>, message string"


def _parse_pdf(content: bytes) -> list[tuple[str, list[str]]]:
    try:
        texts = pdf.page_texts(content)
    except Exception as e:
        raise ValueError(CORRUPT) from e
    if not texts:
        raise ValueError(NO_PAGES)
    return [("page", [t]) for t in texts]


def _parse_docx(content: bytes) -> list[tuple[str, list[str]]]:
    try:
        paragraphs, rows = docx.paragraphs_and_rows(content)
    except Exception as e:
        raise ValueError(UNREADABLE) from e
    return [("paragraph", [p]) for p in paragraphs] + [("row", r) for r in rows]


def _parse(parser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                try:
                    parts, message = parser(content.as_py()), None
                except ValueError as e:
                    parts, message = [], str(e)
                rows = [(doc_id, i, kind, cells, None) for i, (kind, cells) in enumerate(parts, 1)] or [(doc_id, None, "error", None, message or BLANK)]
                types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n", "kind", "cells", "message"])

    return run


def load_pdfs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of PDF files (doc_id, content). Blank pages stay; a document of blank pages only is an error."""
    parsed = files.select(F.col("doc_id").cast("string"), "content").mapInArrow(_parse(_parse_pdf), _PARSED)
    read = parsed.filter("kind = 'page'").select("doc_id", F.col("n").alias("page_number"), F.col("cells")[0].alias("text"))
    solid_docs = read.groupBy("doc_id").agg(F.bool_or(F.length("text") > 0).alias("any"))
    pages = read.join(solid_docs.filter("any"), "doc_id", "left_semi")
    errors = parsed.filter("kind = 'error'").select("doc_id", "message").union(solid_docs.filter("not any").select("doc_id", F.lit(BLANK)))
    return pages, errors.select("doc_id", F.lit("load").alias("stage"), "message")


def load_docx(files: DataFrame, target: int = Config.page_target) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of Word files: paragraphs, then the rows of all tables, packed into pages of about `target` characters."""
    parsed = files.select(F.col("doc_id").cast("string"), "content").mapInArrow(_parse(_parse_docx), _PARSED)
    lines = parsed.filter("kind <> 'error'").select("doc_id", "n", F.when(F.col("kind") == "row", table_row(F.col("cells"))).otherwise(F.col("cells")[0]).alias("text"))
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l")).select("doc_id", solid(F.transform("l", lambda x: x["text"])).alias("paragraphs"))
    pages = pages_of_paragraphs(docs.filter(F.size("paragraphs") > 0), target=target)
    errors = parsed.filter("kind = 'error'").select("doc_id", "message").union(docs.filter(F.size("paragraphs") == 0).select("doc_id", F.lit(BLANK)))
    return pages, errors.select("doc_id", F.lit("load").alias("stage"), "message")


def load_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of files (doc_id, filename, content), each by its extension."""
    sized = files.select(F.col("doc_id").cast("string").alias("doc_id"), "filename", "content", (F.coalesce(F.octet_length("content"), F.lit(0)) == 0).alias("empty"), route(F.col("filename")).alias("route"))
    pdf_pages, pdf_errors = load_pdfs(sized.filter("not empty and route = 'pdf'"))
    docx_pages, docx_errors = load_docx(sized.filter("not empty and route = 'docx'"))
    ext = suffix(F.col("filename"))
    head, tail = UNKNOWN.split("{}")
    message = F.when(F.col("empty"), EMPTY).otherwise(F.concat(F.lit(head), F.when(ext == "", "(none)").otherwise(ext), F.lit(tail)))
    other = sized.filter("empty or route = 'unsupported'").select("doc_id", F.lit("load").alias("stage"), message.alias("message"))
    return pdf_pages.unionByName(docx_pages), pdf_errors.unionByName(docx_errors).unionByName(other)


def _single(spark: SparkSession, content: bytes, filename: str) -> DataFrame:
    """The pages of one file; errors raise."""
    if not content:
        raise ValueError(EMPTY)
    extension = os.path.splitext(filename)[1].lower()
    if extension not in SUPPORTED:
        raise ValueError(unsupported(extension))
    files = spark.createDataFrame([(filename, filename, bytearray(content))], UPLOAD)
    pages, errors = load_documents(files)
    for e in errors.collect():
        raise DocumentProcessingError(e.message) if e.message in (CORRUPT, UNREADABLE) else ValueError(e.message)
    return pages


def load_document_from_bytes(spark: SparkSession, content: bytes, filename: str) -> DataFrame:
    """doc_id, page_number, text of one PDF or Word file."""
    return _single(spark, content, filename)


def load_pdf_from_bytes(spark: SparkSession, content: bytes) -> DataFrame:
    return _single(spark, content, "uploaded.pdf")


def load_docx_from_bytes(spark: SparkSession, content: bytes) -> DataFrame:
    return _single(spark, content, "uploaded.docx")


def load_pdf(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a PDF file in any store that Spark reads."""
    rows = read_files(spark, path).select("content").take(1)
    if not rows:
        raise FileNotFoundError(path)
    return _single(spark, bytes(rows[0].content), "document.pdf")
