"""Files or pages to an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import Config
from docquarry.errors import DocumentProcessingError
from docquarry.operators import index as indexes
from docquarry.operators.chunk import chunk_pages, without_chunks
from docquarry.operators.embed import Embedder
from docquarry.sources.files import EMPTY, load_document_from_bytes, load_documents

STEPS = ("Reading the text", "Cutting it into chunks", "Computing embeddings", "Building the index")
EMBEDDING_FAILED = "The embeddings could not be computed."
INDEX_FAILED = "The index could not be built."


@dataclass(frozen=True)
class Built:
    """Lazy tables of an index: its chunks with embeddings, its pages, a row for each document, and what failed."""

    index: DataFrame
    pages: DataFrame
    metadata: DataFrame
    errors: DataFrame


def build_from_pages(pages: DataFrame, embedder: Embedder, size: int = Config.chunk_size, overlap: int = Config.chunk_overlap, filenames: DataFrame | None = None, errors: DataFrame | None = None) -> Built:
    """An index of pages (doc_id, page_number, text)."""
    chunks = chunk_pages(pages, size, overlap)
    lost = without_chunks(pages, chunks)
    return Built(indexes.embed_chunks(chunks, embedder), pages, indexes.metadata(pages, chunks, embedder.dimension, filenames), lost if errors is None else errors.unionByName(lost))


def build_from_files(files: DataFrame, embedder: Embedder, size: int = Config.chunk_size, overlap: int = Config.chunk_overlap) -> Built:
    """An index of files (doc_id, filename, content); those that fail are in errors."""
    pages, errors = load_documents(files)
    return build_from_pages(pages, embedder, size, overlap, files.select(F.col("doc_id").cast("string").alias("doc_id"), "filename"), errors)


def build_one(spark: SparkSession, content: bytes, filename: str, embedder: Embedder, size: int = Config.chunk_size, overlap: int = Config.chunk_overlap, on_step: Callable[[str], None] | None = None) -> Built:
    """An index of one file, computed and cached; whatever fails raises DocumentProcessingError.

    on_step hears of each of STEPS as it begins.
    """
    tell = on_step or (lambda _: None)
    if not content:
        raise DocumentProcessingError(EMPTY)
    try:
        tell(STEPS[0])
        pages = load_document_from_bytes(spark, content, filename).cache()
        tell(STEPS[1])
        chunks = chunk_pages(pages, size, overlap)
        indexes.require_chunks(chunks)
    except ValueError as e:
        raise DocumentProcessingError(str(e)) from e
    try:
        tell(STEPS[2])
        built = build_from_pages(pages, embedder, size, overlap, spark.createDataFrame([(filename, filename)], "doc_id string, filename string"))
        index = built.index.cache()
        index.count()
    except Exception as e:
        raise DocumentProcessingError(EMBEDDING_FAILED) from e
    tell(STEPS[3])
    if indexes.of_wrong_width(index, embedder.dimension).take(1):
        raise DocumentProcessingError(INDEX_FAILED)
    return Built(index, pages, built.metadata, built.errors)
