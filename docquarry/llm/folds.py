"""Fixed folds of rows by id, and labelled samples of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most: those of least id hash.
TRAIN_ROWS = 20_000


def fold(id_col: str, n: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def held_out(id_col: str, n: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves rest modulo n; a null id is held out of nothing."""
    return fold(id_col, n) == rest


def training_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, rest: int, limit: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id, ...) with y: the labelled rows outside the held-out fold, for at most limit labels."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.filter(~held_out("doc_id", n, rest)).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    return docs.join(F.broadcast(known), "doc_id")
