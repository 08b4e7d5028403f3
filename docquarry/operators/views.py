"""What is shown of answers, chunks, vectors and the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABEL = 80


def chunk_view(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_id", "page_number", F.length("text").alias("n_chars"), "text")


def embedding_view(vectors: DataFrame, *columns: str, shown: int = 10) -> DataFrame:
    """columns, dimension, element type and the first numbers of each vector."""
    kind = dict(vectors.dtypes)["embedding"]
    return vectors.select(*columns, F.size("embedding").alias("dimension"), F.lit(kind.removeprefix("array<").removesuffix(">")).alias("dtype"), F.slice("embedding", 1, shown).alias("first_values"))


def history_view(history: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, seq, question, answer, sources) numbered by sequence, newest first; long questions are cut for the label."""
    n = F.row_number().over(Window.partitionBy(session).orderBy("seq"))
    label = F.when(F.length("question") > LABEL, F.concat(F.substring("question", 1, LABEL), F.lit("..."))).otherwise(F.col("question"))
    pages = F.array_join(F.transform("sources", lambda p: F.concat(F.lit("Page "), p.cast("string"))), ", ")
    return history.select(session, n.alias("n"), label.alias("label"), "question", "answer", pages.alias("pages")).orderBy(session, F.desc("n"))


def answer_view(answers: DataFrame) -> DataFrame:
    """The facts beside an answer."""
    pages = F.coalesce(F.nullif(F.array_join("sources", ", "), F.lit("")), F.lit("none"))
    return answers.select("qid", "question", "answer", pages.alias("pages"), "best_similarity", "low_confidence", "confidence_threshold", "top_k", "num_retrieved_chunks", "embedding_dimension")


def source_view(answers: DataFrame) -> DataFrame:
    """One row for each hit of an answer."""
    return answers.select("qid", F.explode("chunks").alias("c")).select("qid", "c.rank", "c.doc_id", "c.chunk_id", "c.page_number", "c.similarity", "c.text")
