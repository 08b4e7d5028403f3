"""The retrieval engine's registered queries, over the tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import SUPPORTED, Config
from docquarry.functions.text import collapse, fingerprint, suffix
from docquarry.functions.vectors import norm, normalised
from docquarry.operators.answer import answer, retrieve
from docquarry.operators.chunk import chunk_documents, count_chunks
from docquarry.operators.embed import HashedEmbedder, create_embedder
from docquarry.operators.generate import Extractive, error_class
from docquarry.operators.index import add, counted, embed_chunks, new_files, replaced, save
from docquarry.operators.paginate import paragraphs, table_row
from docquarry.operators.prompt import context, gathered, prompt, source_pages
from docquarry.operators.search import best_similarity, search
from docquarry.operators.views import answer_view, chunk_view, embedding_view, history_view, source_view
from docquarry.plans.oracles import ORACLES
from docquarry.sources.docx import make_docx
from docquarry.sources.files import load_documents, load_docx, load_pdfs, route
from docquarry.sources.pdf import make_pdf
from docquarry.sources.tables import paged, questions, with_pages
from docquarry.sources.shared import shared_dir
from docquarry.streaming.ingest import ingest_tables

#: The vectors that ask in the knn queries: those whose id is divisible by this.
QUERY_EVERY = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", collapse(F.col("text")).alias("text"))


def paragraph_rows(spark, sf_dir):
    return _long(paragraphs(_docs(spark, sf_dir)), "para_no")


def pseudo_pages(spark, sf_dir):
    return _long(paged(_docs(spark, sf_dir)), "page_number")


def _chunks(docs, size=Config.chunk_size, overlap=Config.chunk_overlap):
    return _long(chunk_documents(docs, size, overlap), "chunk_id", "page_number", "start")


def chunks(spark, sf_dir):
    return _chunks(with_pages(_docs(spark, sf_dir), single=True))


def chunks_small(spark, sf_dir):
    return _chunks(with_pages(_docs(spark, sf_dir), single=True), 120, 40)


def chunks_no_overlap(spark, sf_dir):
    return _chunks(with_pages(_docs(spark, sf_dir), single=True), 500, 0)


def chunks_by_page(spark, sf_dir):
    return _chunks(with_pages(_docs(spark, sf_dir)))


def doc_metadata(spark, sf_dir):
    counts = count_chunks(with_pages(_docs(spark, sf_dir))).filter("page_count > 0")
    return _long(counted(counts, Config.embedding_dimension), "embedding_dimension")


def shown_chunks(spark, sf_dir):
    return _long(chunk_view(chunk_documents(with_pages(_docs(spark, sf_dir), single=True))), "chunk_id", "page_number", "n_chars")


def replaced_documents(spark, sf_dir):
    """Chunks of which those of every third document are replaced by those of its first line."""
    docs = _docs(spark, sf_dir)
    fresh = docs.filter("doc_id % 3 = 0").select("doc_id", F.split("text", "\n")[0].alias("text"))
    made = lambda d: _chunks(with_pages(d, single=True))
    return replaced(made(docs), made(fresh))


def table_rows(spark, sf_dir):
    """Pages as a table row: id, a blank cell, url."""
    cells = F.array(F.col("page_id").cast("string"), F.lit(" \t"), F.concat(F.lit(" "), "url", F.lit("\n")))
    return _table(spark, sf_dir, "pages").select("page_id", table_row(cells).alias("line"))


def vectors_shown(spark, sf_dir):
    view = embedding_view(_table(spark, sf_dir, "embeddings"), "vec_id")
    first = F.array_join(F.transform("first_values", lambda x: F.round(x.cast("double") * 1_000_000, 0).cast("long").cast("string")), ",")
    return view.select("vec_id", F.col("dimension").cast("long").alias("dimension"), "dtype", first.alias("first_values"))


def vector_norms(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


def unit_vectors(spark, sf_dir):
    """Vectors scaled by their ids, and back to length 1."""
    grown = F.transform("embedding", lambda x: (x.cast("double") * (F.col("vec_id") + 1)).cast("float"))
    unit = _table(spark, sf_dir, "embeddings").select("vec_id", normalised(grown).alias("u"))
    return unit.select("vec_id", F.round(norm(F.col("u")), 6).alias("norm"), F.round(F.col("u")[0].cast("double"), 5).alias("first"))


def _knn(k: int):
    def run(spark, sf_dir):
        vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        asking = vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")
        hits = search(vectors, asking, k, ["vec_id"])
        return _long(hits.select("qid", "vec_id", "rank", F.round("similarity", 6).alias("similarity")), "rank")

    return run


def _best(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asking = vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")
    # of a vector's two best, one at least is another's
    near = search(vectors, asking, 2, ["vec_id"]).filter("vec_id <> qid")
    return best_similarity(asking, near, 0.5).withColumn("best_similarity", F.round("best_similarity", 6))


def index_add(spark, sf_dir):
    """The search over vectors of odd ids that were added to those of even ones."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = add(vectors.filter("vec_id % 2 = 0"), vectors.filter("vec_id % 2 = 1"), 64)
    asking = vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return _long(search(index, asking, 3, ["vec_id"]).select("qid", "vec_id", "rank", F.round("similarity", 6).alias("similarity")), "rank")


def index_saved(spark, sf_dir):
    """An index, written and read again: the width of each vector and the words that it counts."""
    index = embed_chunks(chunk_documents(with_pages(_docs(spark, sf_dir))), HashedEmbedder(unit=False))
    to = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    save(index, to)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).cast("long")
    return _long(spark.read.parquet(to).select("doc_id", "chunk_id", F.size("embedding").alias("width"), total.alias("n_words")), "chunk_id", "width")


def embedder_width(spark, sf_dir):
    """Unit vectors of an embedder that is chosen by name."""
    e = create_embedder("hashed-64")
    vectors = _docs(spark, sf_dir).select("doc_id", e.column(F.col("text")).alias("v"))
    return vectors.select("doc_id", F.size("v").cast("long").alias("width"), F.lit(e.dimension).cast("long").alias("dimension"), F.round(norm(F.col("v")), 5).alias("norm"))


def supported_formats(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(sorted(SUPPORTED))), "i long, extension string")


def hashed_embedding(spark, sf_dir):
    e = HashedEmbedder()
    own = _docs(spark, sf_dir).select("doc_id", F.explode(e.buckets(F.col("text"))).alias("bucket"))
    return _long(own.groupBy("doc_id", "bucket").agg(F.count("*").alias("n")), "bucket")


def _asked(spark, sf_dir):
    return questions(_table(spark, sf_dir, "benchmark"), "item_id", "text")


def _hits(spark, sf_dir, k: int = Config.top_k):
    """Benchmark passages as questions over all chunks; counts are whole numbers, so that scores are exact."""
    e = HashedEmbedder(unit=False)
    index = embed_chunks(chunk_documents(with_pages(_docs(spark, sf_dir))), e)
    return retrieve(index, _asked(spark, sf_dir), e, k, scale=True)


def retrieve_benchmark(spark, sf_dir):
    return _long(_hits(spark, sf_dir).select("qid", "doc_id", "chunk_id", "page_number", "rank", F.round("similarity", 9).alias("similarity")), "chunk_id", "page_number", "rank")


def source_page_lists(spark, sf_dir):
    return gathered(_hits(spark, sf_dir)).select("qid", F.array_join(source_pages(F.col("chunks")).cast("array<string>"), ", ").alias("pages"), F.size("chunks").cast("long").alias("n"))


def context_blocks(spark, sf_dir):
    return gathered(_hits(spark, sf_dir)).select("qid", context(F.col("chunks")).alias("context"))


def prompts(spark, sf_dir):
    rows = gathered(_hits(spark, sf_dir)).join(_asked(spark, sf_dir), "qid")
    low = F.col("chunks")[0]["similarity"] < 0.6
    return rows.select("qid", prompt(F.col("question"), context(F.col("chunks")), low).alias("prompt"))


def _answers(spark, sf_dir):
    e = HashedEmbedder(unit=False)
    index = embed_chunks(chunk_documents(with_pages(_docs(spark, sf_dir))), e)
    return answer(index, _asked(spark, sf_dir), e, Extractive(), threshold=0.6, scale=True)


def extractive_answers(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("best_similarity", F.round("best_similarity", 9))
    return rows.select("qid", "question", "answer", "error", F.array_join("sources", ",").alias("sources"), F.col("num_retrieved_chunks").cast("long").alias("n"), "best_similarity", "low_confidence")


def answers_shown(spark, sf_dir):
    rows = answer_view(_answers(spark, sf_dir)).withColumn("best_similarity", F.round("best_similarity", 9))
    return _long(rows, "top_k", "num_retrieved_chunks", "embedding_dimension")


def sources_shown(spark, sf_dir):
    rows = source_view(_answers(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))
    return _long(rows, "rank", "chunk_id", "page_number")


def route_by_extension(spark, sf_dir):
    kinds = F.array(*map(F.lit, (".pdf", ".PDF", ".docx", ".txt", "", ".tar.DocX")))
    names = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("files/report"), F.col("page_id").cast("string"), F.element_at(kinds, (F.col("page_id") % 6 + 1).cast("int"))).alias("name"))
    return names.select("page_id", "name", suffix(F.col("name")).alias("ext"), route(F.col("name")).alias("route"))


def fingerprints_of_files(spark, sf_dir):
    name = F.concat(F.lit("document"), F.col("doc_id").cast("string"))
    return _docs(spark, sf_dir).select("doc_id", fingerprint(name, F.encode("text", "UTF-8")).alias("fingerprint"))


def new_documents_only(spark, sf_dir):
    """Files whose content is not that of one with an even id."""
    files = _docs(spark, sf_dir).select("doc_id", fingerprint(F.lit("same"), F.encode("text", "UTF-8")).alias("fingerprint"))
    return new_files(files, files.filter("doc_id % 2 = 0")).select("doc_id")


def questions_valid(spark, sf_dir):
    asked = _table(spark, sf_dir, "conversations").filter("role = 'user'")
    return questions(asked.withColumn("id", F.struct("conv_id", "turn")), "id", "text").select("qid.conv_id", "qid.turn", "question")


def history(spark, sf_dir):
    asked = _table(spark, sf_dir, "conversations").filter("role = 'user'")
    rows = asked.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("question"), F.lit("").alias("answer"), F.array(F.lit(2), F.lit(7)).alias("sources"))
    return _long(history_view(rows).select("session_id", "n", "label", "pages"), "n")


MESSAGES = (
    "API key not valid", "401 Unauthorized", "HTTP 403", "429 Too Many Requests", "Quota exceeded", "the rate is too high",
    "generate_content failed", "bad request", "RATE limit", "moderate load", "RATE_LIMIT_EXCEEDED",
)


def llm_error_class(spark, sf_dir):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "i long, message string")
    return rows.select("i", "message", error_class(F.col("message")).alias("class"))


def _made(make: Callable[[str], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return run


def _word_file(text: str) -> bytes:
    """Paragraphs for the lines, but the second: a table of its words, which is read after all paragraphs."""
    lines = text.split("\n")
    return make_docx(lines[:1] + lines[2:], [[lines[1].split(" ")]] if len(lines) > 1 else [])


def docx_pages(spark, sf_dir):
    """Documents written as Word files, with a table, and read again."""
    files = _docs(spark, sf_dir).mapInArrow(_made(_word_file), "doc_id long, content binary")
    pages, _ = load_docx(files)
    return _long(pages, "doc_id", "page_number")


#: By doc_id modulo 6: a good Word file, and files that cannot be read.
_NAMES = (".docx", ".pdf", ".pdf", ".pdf", ".txt", ".docx")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            made.append((lambda: make_docx((t or "").split("\n")), lambda: b"", lambda: b"junk", lambda: make_pdf([[], []]), lambda: b"text", lambda: b"junk")[i % 6]())  # noqa: B023
        names = [f"d{i}{_NAMES[i % 6]}" for i in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(made, pa.binary())], ["doc_id", "filename", "content"])


def load_errors(spark, sf_dir):
    """Files that have no page with text, with what is said of them."""
    _, errors = load_documents(_docs(spark, sf_dir).mapInArrow(_files, "doc_id long, filename string, content binary"))
    return _long(errors, "doc_id")


def pdf_pages(spark, sf_dir):
    """Documents written as PDF files, a page for each line, and read again."""
    files = _docs(spark, sf_dir).mapInArrow(_made(lambda t: make_pdf([[x] for x in t.split("\n")])), "doc_id long, content binary")
    pages, _ = load_pdfs(files)
    return _long(pages, "doc_id", "page_number")


def stream_ingest(spark, sf_dir):
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ingest_tables(spark, f"{sf_dir}/documents.parquet", _docs(spark, sf_dir).schema, f"{to}/chunks", f"{to}/checkpoint", "*").awaitTermination()
    return _long(spark.read.parquet(f"{to}/chunks").drop("batch"), "chunk_id", "page_number", "start")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve_benchmark(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_text": clean_text,
    "paragraphs": paragraph_rows,
    "pseudo_pages": pseudo_pages,
    "chunks": chunks,
    "chunks_small": chunks_small,
    "chunks_no_overlap": chunks_no_overlap,
    "chunks_by_page": chunks_by_page,
    "doc_metadata": doc_metadata,
    "chunk_view": shown_chunks,
    "replaced": replaced_documents,
    "table_rows": table_rows,
    "embedding_view": vectors_shown,
    "vector_norms": vector_norms,
    "unit_vectors": unit_vectors,
    "knn_k1": _knn(1),
    "knn_k3": _knn(3),
    "knn_k5": _knn(5),
    "knn_k10": _knn(10),
    "best_similarity": _best,
    "index_add": index_add,
    "index_saved": index_saved,
    "embedder_width": embedder_width,
    "supported_formats": supported_formats,
    "hashed_embedding": hashed_embedding,
    "retrieve_benchmark": retrieve_benchmark,
    "source_pages": source_page_lists,
    "context_block": context_blocks,
    "prompt": prompts,
    "extractive_answer": extractive_answers,
    "answer_view": answers_shown,
    "source_view": sources_shown,
    "route_by_extension": route_by_extension,
    "fingerprint": fingerprints_of_files,
    "new_documents_only": new_documents_only,
    "questions_valid": questions_valid,
    "history_view": history,
    "llm_error_class": llm_error_class,
    "load_errors": load_errors,
    "docx_pages": docx_pages,
    "pdf_pages": pdf_pages,
    "stream_ingest": stream_ingest,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
