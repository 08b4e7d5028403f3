"""One document, one question at a time: driver-side objects over the same plans.

    session = Session(spark)
    session.upload(open("report.pdf", "rb").read(), "report.pdf")
    session.ask("What was the revenue in 2024?")
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import Config, check_top_k
from docquarry.errors import DocumentProcessingError
from docquarry.operators import index as indexes
from docquarry.operators.answer import answer, retrieve
from docquarry.operators.embed import Embedder, create_embedder
from docquarry.operators.generate import Generator, create_generator
from docquarry.operators.search import search
from docquarry.plans.ingest import Built, build_from_pages, build_one
from docquarry.sources.files import load_pdf

NO_QUESTION = "Ask a question first."
NO_INDEX = "The index is empty."


class VectorStore:
    """Vectors of one width with their chunks, searched exactly by inner product."""

    def __init__(self, spark: SparkSession, dimension: int, rows: DataFrame | None = None):
        self.spark, self.dimension, self.rows = spark, dimension, rows

    def add(self, embeddings: list, chunks: list[dict]) -> None:
        """Append chunks (chunk_id, page_number, text) and their vectors, in order; ids stay as they are."""
        if len(embeddings) != len(chunks):
            raise ValueError(f"{len(embeddings)} vectors for {len(chunks)} chunks")
        at = self.rows.count() if self.rows is not None else 0
        data = [(at + i, c["chunk_id"], c["page_number"], c["text"], [float(x) for x in v]) for i, (v, c) in enumerate(zip(embeddings, chunks, strict=True))]
        more = self.spark.createDataFrame(data, "vec_id long, chunk_id int, page_number int, text string, embedding array<float>")
        empty = self.spark.createDataFrame([], more.schema)
        self.rows = indexes.add(self.rows if self.rows is not None else empty, more, self.dimension)

    def search(self, query: list, top_k: int = Config.top_k) -> list[dict]:
        """The best chunks: chunk_id, page_number, text, similarity, rank from 1."""
        check_top_k(top_k)
        if self.rows is None or self.rows.isEmpty():
            raise ValueError(NO_INDEX)
        query = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, embedding array<float>")
        hits = search(self.rows, query, top_k, ["vec_id"], "expression")
        return [{k: r[k] for k in ("chunk_id", "page_number", "text", "similarity", "rank")} for r in hits.orderBy("rank").collect()]


class Retriever:
    """The best chunks of an index for a question."""

    def __init__(self, index: DataFrame, embedder: Embedder):
        self.index, self.embedder = index, embedder

    def questions(self, question: str) -> DataFrame:
        if not question.strip():
            raise ValueError(NO_QUESTION)
        if self.index.isEmpty():
            raise ValueError(NO_INDEX)
        return self.index.sparkSession.createDataFrame([(0, question.strip())], "qid long, question string")

    def retrieve(self, question: str, top_k: int = Config.top_k) -> list[dict]:
        hits = retrieve(self.index, self.questions(question), self.embedder, check_top_k(top_k))
        return [{k: r[k] for k in ("chunk_id", "page_number", "text", "similarity", "rank")} for r in hits.orderBy("rank").collect()]


class RAGSystem:
    """Answers with their sources."""

    def __init__(self, retriever: Retriever, generator: Generator, top_k: int = Config.top_k, confidence_threshold: float = Config.confidence_threshold, embedding_dimension: int | None = None):
        self.retriever, self.generator = retriever, generator
        self.top_k, self.threshold = check_top_k(top_k), confidence_threshold
        self.dimension = embedding_dimension or retriever.embedder.dimension

    def answer(self, question: str) -> dict:
        r = self.retriever
        rows = answer(r.index, r.questions(question), r.embedder, _Held(), self.top_k, self.threshold, self.dimension)
        out = rows.first().asDict(recursive=True)
        out["answer"] = self.generator.generate(out.pop("prompt"))  # on the driver, once; what fails raises
        out.pop("qid"), out.pop("error")
        return out


class _Held:
    """Leaves the answer open."""

    def column(self, prompt, chunks):
        return F.struct(F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"))


def build_retriever_from_pages(pages: DataFrame, embedder: Embedder | None = None, chunk_size: int = Config.chunk_size, chunk_overlap: int = Config.chunk_overlap) -> Retriever:
    """A retriever over pages (page_number, text, and doc_id if there are several documents)."""
    embedder = embedder or create_embedder()
    pages = pages if "doc_id" in pages.columns else pages.withColumn("doc_id", F.lit("document"))
    index = build_from_pages(pages, embedder, chunk_size, chunk_overlap).index.cache()
    if index.isEmpty():
        raise ValueError("The document has no text to chunk.")
    return Retriever(index, embedder)


def build_retriever_from_pdf(spark: SparkSession, path: str, embedder: Embedder | None = None, chunk_size: int = Config.chunk_size, chunk_overlap: int = Config.chunk_overlap) -> Retriever:
    return build_retriever_from_pages(load_pdf(spark, path), embedder, chunk_size, chunk_overlap)


def index_document_from_bytes(spark: SparkSession, content: bytes, filename: str = "uploaded.pdf", embedder: Embedder | None = None, chunk_size: int = Config.chunk_size, chunk_overlap: int = Config.chunk_overlap, on_step: Callable[[str], None] | None = None) -> tuple[Retriever, dict]:
    """A retriever over one file, and its metadata."""
    embedder = embedder or create_embedder()
    built: Built = build_one(spark, content, filename, embedder, chunk_size, chunk_overlap, on_step)
    row = built.metadata.first().asDict()
    return Retriever(built.index, embedder), {k: row[k] for k in ("filename", "page_count", "chunk_count", "embedding_dimension", "status")}


def build_retriever_from_bytes(spark: SparkSession, content: bytes, filename: str = "uploaded.pdf", embedder: Embedder | None = None, chunk_size: int = Config.chunk_size, chunk_overlap: int = Config.chunk_overlap) -> Retriever:
    return index_document_from_bytes(spark, content, filename, embedder, chunk_size, chunk_overlap)[0]


index_document_from_upload = index_document_from_bytes


def file_hash(filename: str, content: bytes) -> str:
    return hashlib.sha256(filename.encode() + content).hexdigest()


class Session:
    """A document, the questions asked of it, and what the user interface would show.

    `state` is no_document, processing, ready, answering or answer. The same
    file is processed once; another one replaces it, with its history. A file
    that failed is tried again.
    """

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, generator: Generator | None = None):
        self.spark, self.embedder, self._generator = spark, embedder or create_embedder(), generator
        self.clear()

    def clear(self) -> None:
        self.state, self.retriever, self.metadata, self.hash, self.error, self.last = "no_document", None, None, None, None, None
        self.history: list[dict] = []

    @property
    def generator(self) -> Generator:
        if self._generator is None:
            self._generator = create_generator()
        return self._generator

    def upload(self, content: bytes, filename: str, on_step: Callable[[str], None] | None = None) -> bool:
        """True if the file was processed, False if it was there already. Errors raise, and leave no document."""
        own = file_hash(filename, content)
        if own == self.hash:
            self.state = "ready"
            return False
        self.clear()
        self.state = "processing"
        try:
            self.retriever, self.metadata = index_document_from_bytes(self.spark, content, filename, self.embedder, on_step=on_step)
        except DocumentProcessingError as e:
            self.state, self.error = "no_document", str(e)
            raise
        self.hash, self.state = own, "ready"
        return True

    def ask(self, question: str, top_k: int = Config.top_k, confidence_threshold: float = Config.confidence_threshold) -> dict:
        if self.retriever is None:
            raise ValueError("Upload a document first.")
        if not question.strip():
            raise ValueError(NO_QUESTION)
        self.state = "answering"
        try:
            self.last = RAGSystem(self.retriever, self.generator, top_k, confidence_threshold).answer(question)
        except Exception:
            self.state = "ready"
            raise
        self.history.append({k: self.last[k] for k in ("question", "answer", "sources")})
        self.state = "answer"
        return self.last
