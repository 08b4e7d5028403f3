"""Documents and questions that are tables already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.paginate import pages_of_paragraphs, paragraphs_of, texts_of_pages
from docquarry.operators.search import valid_questions


def single_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) as documents of one page each."""
    return docs.select("doc_id", F.lit(1).alias("page_number"), F.col(text).alias("text"))


def paged(docs: DataFrame, text: str = "text", target: int | None = None) -> DataFrame:
    """(doc_id, text) as pages packed from the text's lines."""
    rows = docs.select("doc_id", paragraphs_of(F.col(text)).alias("paragraphs"))
    return pages_of_paragraphs(rows, **({"target": target} if target else {}))


def with_pages(docs: DataFrame, text: str = "text", single: bool = False) -> DataFrame:
    """(doc_id, pages): the texts of a document's pages, packed from its lines or, if single, one."""
    pages = F.array(F.coalesce(F.col(text), F.lit(""))) if single else texts_of_pages(paragraphs_of(F.col(text)))
    return docs.select("doc_id", pages.alias("pages"))


def questions(table: DataFrame, qid: str, text: str) -> DataFrame:
    """qid, question: the non-blank texts of a table."""
    return valid_questions(table.select(F.col(qid).alias("qid"), F.col(text).alias("question")))
