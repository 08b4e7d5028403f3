"""The index: chunks with their vectors, in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.errors import DocumentProcessingError
from docquarry.functions.text import fingerprint
from docquarry.operators.embed import Embedder


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunks with their embedding; a vector never parts from its chunk."""
    return chunks.withColumn("embedding", embedder.column(F.col("text")))


def of_wrong_width(vectors: DataFrame, dimension: int) -> DataFrame:
    """The rows whose embedding is null or has another width."""
    return vectors.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension)


def add(index: DataFrame, more: DataFrame, dimension: int) -> DataFrame:
    """index with further rows; an action checks the width of what is added."""
    bad = of_wrong_width(more, dimension).take(1)
    if bad:
        width = len(bad[0]["embedding"] or [])
        raise ValueError(f"the index holds vectors of {dimension} numbers, but one of {width} was added")
    return index.unionByName(more)


def metadata(pages: DataFrame, chunks: DataFrame, dimension: int, filenames: DataFrame | None = None) -> DataFrame:
    """doc_id, page_count, chunk_count, embedding_dimension, status (and filename, from (doc_id, filename)).

    Blank pages count as pages. A document without chunks has status "empty",
    others "ready".
    """
    page_counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    chunk_counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    out = counted(page_counts.join(chunk_counts, "doc_id", "left"), dimension)
    return out if filenames is None else out.join(filenames.select("doc_id", "filename"), "doc_id", "left")


def counted(counts: DataFrame, dimension: int) -> DataFrame:
    """metadata() of documents whose pages and chunks are counted (doc_id, page_count, chunk_count)."""
    return counts.select(
        "doc_id",
        "page_count",
        F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"),
        F.lit(dimension).alias("embedding_dimension"),
        F.when(F.col("chunk_count") > 0, "ready").otherwise("empty").alias("status"),
    )


def with_fingerprint(files: DataFrame, name: str = "filename", content: str = "content") -> DataFrame:
    return files.withColumn("fingerprint", fingerprint(F.col(name), F.col(content)))


def new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (with fingerprint) that the registry, which holds only successes, does not have."""
    return files.join(registry.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*files.columns)


def replaced(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """index, with all rows of the documents in `fresh` replaced by those."""
    return index.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").select(*index.columns).unionByName(fresh)


def save(index: DataFrame, path: str) -> None:
    """Write an index as Parquet."""
    index.write.mode("overwrite").parquet(path)


def require_chunks(chunks: DataFrame) -> None:
    """For single documents: an error if there is no chunk."""
    if chunks.isEmpty():
        raise DocumentProcessingError("The document has no text to chunk.")
