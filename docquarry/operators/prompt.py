"""Context blocks and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import three_places

NO_CONTEXT = "(no passages were found)"
ROLE = "A reader has a question, and a search has found the passages below for it."
RULES = (
    "Answer in one or two sentences, in the language of the question.",
    "Copy figures, names and dates letter by letter from the passages.",
    "Every statement has to be in a passage: what none of them says stays unsaid.",
    "Where the passages leave the question open, reply that the documents do not answer it.",
)
NOTE = "The search is unsure of these passages. Check that they are about the question at all before they are used."
INTRO = ROLE + "\n\nRules:\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(RULES, 1)) + "\n"
CUE = "Answer:"


def context(hits: Column) -> Column:
    """One block of a hit array (rank, page_number, similarity, text), in rank order."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["rank"], h["page_number"], h["similarity"], h["text"])))
    parts = F.transform(ordered, lambda h: F.concat(F.lit("[Page "), h["page_number"].cast("string"), F.lit(" | similarity "), three_places(h["similarity"]), F.lit("]\n"), h["text"]))
    return F.coalesce(F.nullif(F.array_join(parts, "\n\n"), F.lit("")), F.lit(NO_CONTEXT))


def prompt(question: Column, context_block: Column, low_confidence: Column) -> Column:
    note = F.when(F.coalesce(low_confidence, F.lit(False)), F.lit("\n" + NOTE + "\n")).otherwise("")
    return F.concat(F.lit(INTRO), note, F.lit("\nPassages:\n"), context_block, F.lit("\n\nQuestion:\n"), question, F.lit("\n\n" + CUE))


def gathered(hits: DataFrame) -> DataFrame:
    """(qid, rank, ...) -> qid, chunks: the hits of a question in rank order; k of them at most."""
    rows = F.struct("rank", "doc_id", "chunk_id", "page_number", "text", "similarity")
    return hits.groupBy("qid").agg(F.array_sort(F.collect_list(rows)).alias("chunks"))


def source_pages(chunks: Column) -> Column:
    """The distinct pages of a hit array, ascending."""
    return F.array_sort(F.array_distinct(F.transform(chunks, lambda c: c["page_number"])))
