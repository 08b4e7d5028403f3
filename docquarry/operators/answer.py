"""Questions to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.config import Config, check_threshold
from docquarry.operators.embed import Embedder
from docquarry.operators.generate import Generator
from docquarry.operators.prompt import context, gathered, prompt, source_pages
from docquarry.operators.search import low_confidence, search, valid_questions


def retrieve(index: DataFrame, questions: DataFrame, embedder: Embedder, k: int = Config.top_k, how: str = "arrow", scale: bool = False) -> DataFrame:
    """The k best chunks of index (doc_id, chunk_id, ..., embedding) for each question (qid, question), blank ones left out."""
    asked = valid_questions(questions).select("qid", embedder.column(F.col("question")).alias("embedding"))
    return search(index, asked, k, ["doc_id", "chunk_id"], how, scale)


def answer(index: DataFrame, questions: DataFrame, embedder: Embedder, generator: Generator, k: int = Config.top_k, threshold: float = Config.confidence_threshold, dimension: int | None = None, how: str = "arrow", scale: bool = False) -> DataFrame:
    """One row for each question (qid, question) that is not blank.

    question, answer, error (why there is none), sources (pages of the hits,
    never of the answer), chunks, best_similarity, low_confidence, confidence_threshold, top_k,
    embedding_dimension, num_retrieved_chunks and prompt. Questions without
    hits keep their row.
    """
    asked = valid_questions(questions).select("qid", "question")
    check_threshold(threshold)
    hits = gathered(retrieve(index, questions, embedder, k, how, scale))
    rows = asked.join(hits, "qid", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(dict(hits.dtypes)["chunks"])))
    rows = rows.withColumn("best_similarity", F.coalesce(F.try_element_at("chunks", F.lit(1))["similarity"], F.lit(0.0)))
    rows = rows.withColumn("low_confidence", low_confidence(F.col("best_similarity"), threshold))
    rows = rows.withColumn("prompt", prompt(F.col("question"), context(F.col("chunks")), F.col("low_confidence")))
    return rows.withColumn("reply", generator.column(F.col("prompt"), F.col("chunks"))).select(
        "qid",
        "question",
        "reply.answer",
        "reply.error",
        source_pages(F.col("chunks")).alias("sources"),
        "chunks",
        "best_similarity",
        "low_confidence",
        F.lit(float(threshold)).alias("confidence_threshold"),
        F.lit(k).alias("top_k"),
        F.lit(dimension or embedder.dimension).alias("embedding_dimension"),
        F.size("chunks").alias("num_retrieved_chunks"),
        "prompt",
    )
