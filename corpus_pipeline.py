"""A corpus pipeline of the operators in docquarry.llm.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; run()
writes them as Parquet and the next stage reads them back.

What holds for every stage: docs may have any columns beside doc_id, text and
source, and all but the last return them as they are; an empty table gives an
empty result; the order of rows does not matter; a row whose doc_id is null is
scored, cut and mixed like others, and is never a duplicate of any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import store
from docquarry.llm.decontaminate import without_leaks
from docquarry.llm.mixing import mixed_texts
from docquarry.llm.near_dedup import one_of_each
from docquarry.llm.suffix_dedup import with_repeats_cut
from docquarry.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Null, empty and blank texts have the score of no match, and stay. Rows that
    repeat an id are scored each.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays, in one row.

    Texts without words are duplicates of nothing: they stay, one for each id.
    Rows that repeat an id with other texts are documents of their own.
    """
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what a 100-byte string repeats from an earlier place; n_chars follows.

    All rows stay. A code point that loses some of its bytes goes whole; a null
    text becomes empty.
    """
    return with_repeats_cut(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null, empty and blank texts leak nothing; rows that repeat an id are judged
    each.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, once for each pass that takes of it.

    A row has the columns of documents, with text and n_chars of what is taken,
    then size (words of the document), source_size and target (of the source)
    and taken (words of the row). Columns that are called like these four give
    way. Texts without words give nothing; null sources are a source.
    """
    return mixed_texts(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: The mix draws pseudorandom numbers and the deduplications hash; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage keeps on its way is deleted when the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = store.mark()
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name)
        store.clear(spark, begin, docs)
    return docs
