"""Exact top-k search by inner product.

Questions are a query set: they are read in blocks of bounded size, and each
block is sent to the tasks that hold the vectors. Two ways to score a block:

* "expression": a join with the broadcast block and array functions; its sums
  run in array order, so they are reproducible bit by bit;
* "arrow": a matrix product for every Arrow batch, which keeps the batch's own
  top k; the choice for many questions.

Either way ranks come from one window by question, which Spark limits to k
rows a task before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.config import Config, check_top_k
from docquarry.functions.text import strip
from docquarry.functions.vectors import dot


def valid_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """Questions stripped, without blank ones."""
    return questions.withColumn(column, strip(F.col(column))).filter(F.length(column) > 0)


def _blocks(queries: DataFrame, limit: int) -> Iterator[list]:
    """(qid, embedding) rows of one width, about `limit` bytes at a time; those without a vector are left out."""
    held: dict[int, list] = {}
    for row in queries.select("qid", "embedding").filter("size(embedding) > 0").toLocalIterator():
        block = held.setdefault(len(row.embedding), [])
        block.append(row)
        if len(block) * (8 * len(row.embedding) + 16) >= limit:
            yield held.pop(len(row.embedding))
    yield from held.values()


def ranked(scores: DataFrame, k: int, ties: list[str]) -> DataFrame:
    """(qid, similarity, ...) -> its k best rows by question, with rank from 1. NaN is never a hit."""
    best = Window.partitionBy("qid").orderBy(F.desc("similarity"), *ties)
    return scores.filter(F.col("similarity").isNotNull() & ~F.isnan("similarity")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _batch_top(ids: np.ndarray, vectors: np.ndarray, k: int, ties: list[np.ndarray], scale: bool):
    """Rows (query number, row number, score) of the k best of a batch, ties by the tie columns."""

    def run(batch_vectors: np.ndarray):
        scores = batch_vectors @ vectors.T
        if scale:
            own = (batch_vectors * batch_vectors).sum(axis=1)
            theirs = (vectors * vectors).sum(axis=1)
            length = np.sqrt(own[:, None] * theirs[None])
            scores = np.divide(scores, length, out=np.zeros_like(scores), where=length > 0)
        place = np.empty(len(scores), np.int64)
        place[np.lexsort(ties[::-1])] = np.arange(len(scores))
        out = []
        for q in range(len(ids)):
            s = scores[:, q]
            ok = np.flatnonzero(~np.isnan(s))
            if len(ok) > k:  # all that may be among the k best, ties included
                ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[len(ok) - k]]
            ok = ok[np.lexsort((place[ok], -s[ok]))][:k]
            out.append((np.full(len(ok), q), ok, s[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return run


def _dense(col: pa.Array) -> np.ndarray:
    rows = len(col)
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 1))


def _arrow_scores(block, k: int, ties: list[str], scale: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = block.value
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(at)), vectors.shape[1]))
            if not batch.num_rows:
                continue
            order = [np.asarray(batch.column(batch.schema.get_field_index(t))) for t in ties]
            q, row, score = _batch_top(ids, vectors, k, order, scale)(_dense(batch.column(at)))
            rest = batch.drop_columns(["embedding"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), *rest.columns, pa.array(score)], ["qid", *rest.schema.names, "similarity"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = Config.top_k, ties: list[str] | None = None, how: str = "arrow", scale: bool = False, block_bytes: int = Config.question_block_bytes) -> DataFrame:
    """The k best rows of vectors (embedding, ...) for each query (qid, embedding).

    qid, the columns of vectors but for embedding, similarity, rank. Equal
    similarities are ranked by the `ties` columns. If there are fewer than k
    rows, all are ranked. `scale` divides by both lengths, for vectors that are
    not of length 1 ("arrow" only). Rows without a vector, or with one of another
    width than the query's, are no hits; a query without a vector has none.
    """
    check_top_k(k)
    if how not in ("arrow", "expression"):
        raise ValueError(f"unknown way to score: {how}")
    spark = vectors.sparkSession
    rest = [c for c in vectors.columns if c != "embedding"]
    ties = ties or rest[:1]
    vectors = vectors.filter(F.col("embedding").isNotNull())
    qid_type = queries.schema["qid"].dataType
    types = {f.name: f for f in vectors.schema.fields}
    schema = T.StructType([T.StructField("qid", qid_type), *(types[c] for c in rest), T.StructField("similarity", T.DoubleType())])
    out = None
    for rows in _blocks(queries, block_bytes):
        if how == "arrow":
            ids = np.array([r.qid for r in rows])
            data = np.array([[np.nan if x is None else x for x in r.embedding] for r in rows], np.float64)
            part = vectors.mapInArrow(_arrow_scores(spark.sparkContext.broadcast((ids, data)), k, ties, scale), schema)
        else:
            block = spark.createDataFrame([(r.qid, list(r.embedding)) for r in rows], T.StructType([T.StructField("qid", qid_type), T.StructField("q", T.ArrayType(T.FloatType()))]))
            part = vectors.join(F.broadcast(block), F.size("q") == F.size("embedding")).select("qid", *rest, dot(F.col("q"), F.col("embedding")).alias("similarity"))
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k, ties)


def best_similarity(questions: DataFrame, hits: DataFrame, threshold: float = Config.confidence_threshold) -> DataFrame:
    """qid, best_similarity (0 without hits), low_confidence (strictly below the threshold)."""
    best = questions.select("qid").join(hits.groupBy("qid").agg(F.max("similarity").alias("best")), "qid", "left")
    return best.select("qid", F.coalesce("best", F.lit(0.0)).alias("best_similarity")).withColumn("low_confidence", low_confidence(F.col("best_similarity"), threshold))


def low_confidence(similarity: Column, threshold: float) -> Column:
    return similarity < F.lit(float(threshold))
