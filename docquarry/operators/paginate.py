"""Paragraphs, and pages made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import Config
from docquarry.functions.text import strip


def solid(texts: Column) -> Column:
    """An array of texts, stripped, without the blank ones."""
    return F.filter(F.transform(texts, strip), lambda x: F.length(x) > 0)


def paragraphs_of(text: Column) -> Column:
    """The non-blank lines of a text."""
    return solid(F.split(F.coalesce(text, F.lit("")), "\n"))


def table_row(cells: Column) -> Column:
    """A table row as one line: its non-blank cells with bars between; empty if it has none."""
    return F.array_join(solid(cells), " | ")


def packed_pages(paragraphs: Column, target: int = Config.page_target) -> Column:
    """Arrays of paragraphs: a page closes as soon as its paragraphs hold `target` characters."""
    empty = F.array().cast("array<string>")
    state = lambda done, held, n: F.struct(done.alias("done"), held.alias("held"), n.alias("n"))

    def add(acc: Column, paragraph: Column) -> Column:
        held, n = F.concat(acc["held"], F.array(paragraph)), acc["n"] + F.length(paragraph)
        return F.when(n >= target, state(F.concat(acc["done"], F.array(held)), empty, F.lit(0))).otherwise(state(acc["done"], held, n))

    def close(acc: Column) -> Column:
        return F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])

    return F.aggregate(paragraphs, state(F.array().cast("array<array<string>>"), empty, F.lit(0)), add, close)


def texts_of_pages(paragraphs: Column, target: int = Config.page_target) -> Column:
    """The texts of the pages that an array of paragraphs makes, with blank lines between paragraphs."""
    return F.transform(packed_pages(paragraphs, target), lambda page: F.array_join(page, "\n\n"))


def pages_of_paragraphs(docs: DataFrame, paragraphs: str = "paragraphs", target: int = Config.page_target) -> DataFrame:
    """(doc_id, paragraphs) -> doc_id, page_number, text: paragraphs with blank lines between."""
    pages = docs.select("doc_id", F.posexplode(packed_pages(F.col(paragraphs), target)).alias("i", "page"))
    return pages.select("doc_id", (F.col("i") + 1).alias("page_number"), F.array_join("page", "\n\n").alias("text"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, para_no from 1, text."""
    return docs.select("doc_id", F.posexplode(paragraphs_of(F.col("text"))).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("para_no"), "text")
