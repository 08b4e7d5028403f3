"""Retrieval from the command line: python -m docquarry.cli report.pdf"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from docquarry.config import Config

STOP = {"quit", "exit", "q"}
SUGGESTIONS = (
    "When does the ferry leave the quay at Lindvik?",
    "Who is in charge of the mist nets?",
    "Where is fuel for the dinghy stored?",
    "Which channel does the coast guard answer on?",
)


def print_results(question: str, hits: list[dict], write: Callable[[str], None] = print) -> None:
    write(f"\nQuestion: {question}")
    if not hits:
        write("No results returned.")
    for h in hits:
        write(f"\n#{h['rank']}  page {h['page_number']}  similarity {h['similarity']:.4f}\n{h['text']}")


def questions(lines: Iterable[str]) -> Iterable[str]:
    """Stripped lines, blank ones left out, up to a word that stops."""
    for line in lines:
        line = line.strip()
        if line.lower() in STOP:
            return
        if line:
            yield line


def loop(retriever, lines: Iterable[str], top_k: int = Config.top_k, write: Callable[[str], None] = print) -> None:
    for q in questions(lines):
        print_results(q, retriever.retrieve(q, top_k), write)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from docquarry.api import build_retriever_from_pdf

    argv = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("docquarry").getOrCreate()
    retriever = build_retriever_from_pdf(spark, argv[0])
    print("Try:", *SUGGESTIONS, sep="\n  ")
    try:
        loop(retriever, iter(lambda: input("\n> "), None))
    except (EOFError, KeyboardInterrupt):
        print()


if __name__ == "__main__":
    main()
