import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions.text import blank, collapse, fingerprint, strip, suffix, three_places
from docquarry.functions.vectors import dot, norm, normalised
from docquarry.operators.chunk import chunk_documents, chunk_pages, count_chunks, without_chunks
from docquarry.operators.paginate import packed_pages, paragraphs, solid, table_row
from docquarry.sources.tables import paged, single_pages

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def loop_chunks(pages, size, overlap):
    out = []
    for number, text in pages:
        clean, at = " ".join((text or "").split()), 0
        while clean:
            piece = clean[at : at + size].strip()
            if piece:
                out.append((len(out), number, piece))
            if at + size >= len(clean):
                break
            at += size - overlap
    return out


def test_whitespace_as_python_sees_it(spark):
    texts = [f"{a}x{b}{c}y{a}" for a in SPACES for b, c in zip(SPACES, reversed(SPACES), strict=True)] + ["", " ", SPACES]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", collapse(F.col("t")), strip(F.col("t")), blank(F.col("t"))).collect()
    for t, c, s, b in rows:
        assert (c, s, b) == (" ".join(t.split()), t.strip(), not t.strip())


def test_three_places_round_halves_to_even(spark):
    values = [0.0625, -0.0625, 0.35, 1.0, 0.12345, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", three_places(F.col("v"))).collect()
    assert [s for _, s in rows] == [f"{v:.3f}" for v in values]


def test_suffix(spark):
    names = {"a.pdf": ".pdf", "A.PDF": ".pdf", ".pdf": "", "a.": "", "a.b.docx": ".docx", "noext": "", "x/.docx": "", "dir.x/a": "", "a..pdf": ".pdf"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", suffix(F.col("n"))).collect()
    assert {n: s for n, s in rows} == names


def test_fingerprint_is_name_then_bytes(spark):
    import hashlib

    rows = spark.createDataFrame([("é.pdf", bytearray(b"abc"))], "n string, c binary").select(fingerprint(F.col("n"), F.col("c"))).first()
    assert rows[0] == hashlib.sha256("é.pdf".encode() + b"abc").hexdigest()


@pytest.mark.parametrize("size, overlap", [(500, 50), (7, 3), (2, 1), (1, 0), (10, 0), (100, 99)])
def test_chunks_equal_a_loop(spark, size, overlap):
    rng = random.Random(size)
    docs = {d: [(p, "".join(rng.choice("abé 漢\n ") for _ in range(rng.randrange(0, 260)))) for p in (1, 2, 3)] for d in range(6)}
    rows = spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in ps], "doc_id long, page_number int, text string")
    got = chunk_pages(rows, size, overlap).orderBy("doc_id", "chunk_id").collect()
    for d, pages in docs.items():
        assert [(r.chunk_id, r.page_number, r.text) for r in got if r.doc_id == d] == loop_chunks(pages, size, overlap)
    whole = spark.createDataFrame([(d, [t for _, t in ps]) for d, ps in docs.items()], "doc_id long, pages array<string>")
    by_document = chunk_documents(whole, size, overlap)
    assert by_document.orderBy("doc_id", "chunk_id").collect() == got
    assert "Exchange" not in by_document._jdf.queryExecution().executedPlan().toString()
    counts = {r.doc_id: (r.page_count, r.chunk_count) for r in count_chunks(whole, size, overlap).collect()}
    assert counts == {d: (3, len(loop_chunks(ps, size, overlap))) for d, ps in docs.items()}


def test_chunk_counts_at_the_edges(spark):
    rows = spark.createDataFrame([(n, 1, "x" * n) for n in (1, 499, 500, 501)], "doc_id long, page_number int, text string")
    assert {r.doc_id: r["count"] for r in chunk_pages(rows).groupBy("doc_id").count().collect()} == {1: 1, 499: 1, 500: 1, 501: 2}


def test_chunk_parameters_are_checked_in_order(spark):
    rows = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_number int, text string")
    for size, overlap, word in ((0, -1, "size"), (5, -1, "negative"), (5, 5, "smaller")):
        with pytest.raises(ValueError, match=word):
            chunk_pages(rows, size, overlap)


def test_blank_documents_are_reported(spark):
    pages = spark.createDataFrame([("a", 1, " \n"), ("b", 1, "text"), ("b", 2, None)], "doc_id string, page_number int, text string")
    assert [r.doc_id for r in without_chunks(pages, chunk_pages(pages)).collect()] == ["a"]


def test_pages_close_at_the_target(spark):
    cases = [["a" * 1500, "b"], ["a" * 1499, "b", "c"], ["a" * 4000], ["a", "b"], []]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p array<string>").select("i", packed_pages(F.col("p")).alias("q")).orderBy("i").collect()
    assert [[len(p) for p in r.q] for r in rows] == [[1, 1], [2, 1], [1], [2], []]


def test_paragraphs_and_table_rows(spark):
    docs = spark.createDataFrame([(1, " a \n\n\tb\n "), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.para_no, r.text) for r in paragraphs(docs).collect()] == [(1, 1, "a"), (1, 2, "b")]
    assert paged(docs).collect()[0].text == "a\n\nb"
    row = spark.createDataFrame([(["x ", " ", "y"], ["", " "])], "a array<string>, b array<string>").select(table_row(F.col("a")), table_row(F.col("b")), solid(F.col("b"))).first()
    assert (row[0], row[1], row[2]) == ("x | y", "", [])


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(dot(F.col("a"), F.col("a")), norm(F.col("a")), normalised(F.col("a")), normalised(F.col("z"))).first()
    assert row[0] == 25 and row[1] == 5 and row[2] == pytest.approx([0.6, 0.8]) and row[3] == [0, 0]


def test_chunking_stays_in_generated_code(spark):
    plan = chunk_pages(single_pages(spark.createDataFrame([(1, "x")], "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1
