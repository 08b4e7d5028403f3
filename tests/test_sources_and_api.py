import os

import pytest

from docquarry.api import RAGSystem, Session, VectorStore, build_retriever_from_pdf, index_document_from_bytes
from docquarry.cli import loop, questions
from docquarry.errors import DocumentProcessingError
from docquarry.operators.embed import HashedEmbedder
from docquarry.operators.generate import Extractive
from docquarry.plans import catalogue
from docquarry.plans.ingest import STEPS
from docquarry.sources import files as f
from docquarry.sources.docx import W, make_docx, paragraphs_and_rows
from docquarry.sources.pdf import make_pdf, page_texts
from docquarry.sources.sample import PAGES, sample_pdf
from docquarry.streaming.ingest import ingest_files, ingest_tables


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_round_trip(compress):
    pages = [["One (line) \\ here", "é ü – €"], [], ["last"]]
    assert page_texts(make_pdf(pages, compress)) == ["One (line) \\ here\né ü – €", "", "last"]


def test_pdf_operators_and_maps():
    stream = b"BT /F1 9 Tf 1 0 0 1 50 700 Tm [(Hel) 20 (lo) -300 (world)] TJ 0 -12 Td <0041> Tj (next) ' ET"
    cmap = b"1 beginbfchar <00> <0058> endbfchar 1 beginbfrange <41> <42> <0061> endbfrange"
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream), b"<< /Type /Font /Subtype /Type1 /ToUnicode 6 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
    ]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1))
    assert page_texts(data) == ["Hello world\nXa\nnext"]


def test_docx_paragraphs_then_tables():
    data = make_docx([" a ", "", "b<&>"], [[["x", " "], ["", " "], ["y", "z"]]], between=True)
    assert paragraphs_and_rows(data) == ([" a ", "", "b<&>"], [["x", " "], ["", " "], ["y", "z"]])


def test_docx_merged_cells_repeat():
    import io
    import zipfile

    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t><w:tab/><w:t>!</w:t></w:r></w:p></w:tc>"
    rows = f'<w:tr>{cell("a", "<w:gridSpan w:val=\"2\"/>")}{cell("v", "<w:vMerge w:val=\"restart\"/>")}</w:tr><w:tr>{cell("b")}{cell("c")}{cell("", "<w:vMerge/>")}</w:tr>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body><w:tbl>{rows}</w:tbl></w:body></w:document>')
    assert paragraphs_and_rows(out.getvalue())[1] == [["a\t!", "a\t!", "v\t!"], ["b\t!", "c\t!", "v\t!"]]


def test_files_are_routed_and_failures_reported(spark):
    rows = [
        ("1", "a.PDF", make_pdf([["one"], []])), ("2", "b.docx", make_docx(["p" * 1500, "q"], [[["c", "d"]]])), ("3", "c.txt", b"x"), ("4", "noext", b"x"), ("5", "e.pdf", b""),
        ("6", "f.pdf", b"junk"), ("7", "g.pdf", make_pdf([[], []])), ("8", "h.docx", make_docx([" "])), ("9", "i.docx", b"junk"), ("10", "j.pdf", make_pdf([])),
    ]
    files = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "doc_id string, filename string, content binary")
    pages, errors = f.load_documents(files)
    assert {(r.doc_id, r.page_number, r.text) for r in pages.collect()} == {("1", 1, "one"), ("1", 2, ""), ("2", 1, "p" * 1500), ("2", 2, "q\n\nc | d")}
    assert {r.doc_id: r.message for r in errors.collect()} == {
        "3": f.unsupported(".txt"), "4": f.unsupported(""), "5": f.EMPTY, "6": f.CORRUPT, "7": f.BLANK, "8": f.BLANK, "9": f.UNREADABLE, "10": f.NO_PAGES,
    }


def test_single_files_raise(spark):
    for content, name, error, match in ((b"", "a.pdf", ValueError, "empty"), (b"x", "a", ValueError, "none"), (b"x", "a.pdf", DocumentProcessingError, "damaged"), (make_pdf([]), "a.pdf", ValueError, "pages")):
        with pytest.raises(error, match=match):
            f.load_document_from_bytes(spark, content, name)
    with pytest.raises(FileNotFoundError):
        f.load_pdf(spark, "/nowhere/x.pdf")


def test_sample_document(spark, tmp_path):
    assert len(PAGES) == 9
    path = tmp_path / "sample.pdf"
    path.write_bytes(sample_pdf())
    retriever = build_retriever_from_pdf(spark, str(path))
    assert retriever.index.count() == 9
    assert retriever.retrieve("how many stayed over in the spring of 2019")[0]["page_number"] == 6
    assert retriever.retrieve("grey seals pup on which skerries")[0]["page_number"] == 7
    written = []
    loop(retriever, ["", " outboard oil ratio ", "QUIT", "never"], 1, written.append)
    assert any("page 4" in w for w in written) and len(written) == 2
    assert list(questions([" a ", "", "Exit", "b"])) == ["a"]


def test_sessions(spark):
    steps, s = [], Session(spark, generator=Extractive())
    with pytest.raises(ValueError, match="Upload"):
        s.ask("x")
    assert s.upload(sample_pdf(), "sample.pdf", steps.append) and tuple(steps) == STEPS
    assert s.metadata == {"filename": "sample.pdf", "page_count": 9, "chunk_count": 9, "embedding_dimension": 256, "status": "ready"}
    out = s.ask(" solar panels feed the batteries ", top_k=1)
    assert out["sources"] == [5] and out["question"] == "solar panels feed the batteries" and out["top_k"] == 1 and s.state == "answer"
    assert not s.upload(sample_pdf(), "sample.pdf") and len(s.history) == 1
    with pytest.raises(ValueError, match="question"):
        s.ask(" ")
    with pytest.raises(ValueError, match="between 0 and 1"):
        s.ask("seals", confidence_threshold=1.5)
    with pytest.raises(DocumentProcessingError):
        s.upload(b"junk", "bad.pdf")
    assert s.state == "no_document" and s.history == [] and s.error


def test_parts_of_the_single_document_interface(spark):
    store = VectorStore(spark, 2)
    with pytest.raises(ValueError, match="empty"):
        store.search([1, 0])
    chunks = [{"chunk_id": 0, "page_number": 1, "text": "a"}, {"chunk_id": 0, "page_number": 2, "text": "b"}]
    store.add([[1, 0], [0, 1]], chunks)
    store.add([[1, 0]], chunks[:1])
    assert [(h["rank"], h["text"], h["similarity"]) for h in store.search([1, 0], 9)] == [(1, "a", 1.0), (2, "a", 1.0), (3, "b", 0.0)]
    with pytest.raises(ValueError, match="vectors for"):
        store.add([[1, 0]], chunks)
    with pytest.raises(ValueError, match="numbers"):
        store.add([[1, 0, 0]], chunks[:1])
    for content, name in ((b"", "a.pdf"), (make_docx([" "]), "a.docx"), (b"x", "a.exe")):
        with pytest.raises(DocumentProcessingError):
            index_document_from_bytes(spark, content, name)
    with pytest.raises(DocumentProcessingError, match="overlap"):
        index_document_from_bytes(spark, sample_pdf(), chunk_size=5, chunk_overlap=5)
    retriever, meta = index_document_from_bytes(spark, make_docx(["only words"]), "a.docx", HashedEmbedder(32))
    assert meta["embedding_dimension"] == 32 and RAGSystem(retriever, Extractive(), embedding_dimension=0).answer("words")["embedding_dimension"] == 32


def test_files_are_ingested_once(spark, tmp_path):
    folder, to = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(folder)
    (folder / "a.pdf").write_bytes(sample_pdf())
    run = lambda: ingest_files(spark, str(folder), HashedEmbedder(16), to, str(tmp_path / "cp")).awaitTermination()
    run()
    (folder / "b.docx").write_bytes(make_docx(["second"]))
    (folder / "c.txt").write_bytes(b"no")
    run()
    assert spark.read.parquet(f"{to}/index").count() == 10 and spark.read.parquet(f"{to}/errors").count() == 1


@pytest.mark.parametrize("kind", ["file", "folder", "odd names", "partitions"])
def test_tables_are_ingested_from_files_and_folders(spark, tmp_path, kind):
    at = f"{tmp_path}/documents.parquet"
    rows = spark.range(40).selectExpr("id as doc_id", "if(id = 7, null, repeat(concat('word', id, ' '), 200)) as text", "id % 2 as half")
    if kind == "file":
        rows.coalesce(1).write.parquet(f"{tmp_path}/parts")
        (part,) = (tmp_path / "parts").glob("*.parquet")
        part.rename(at)
    else:
        rows.repartition(3).write.partitionBy(*["half"] * (kind == "partitions")).parquet(at)
    if kind == "odd names":
        for i, part in enumerate((tmp_path / "documents.parquet").glob("*.parquet")):
            part.rename(f"{at}/{i}")
    shown = lambda q: sorted(map(str, catalogue.queries()[q](spark, str(tmp_path)).collect()))
    assert shown("stream_ingest") == shown("chunks") != []


def test_a_file_is_ingested_by_its_own_name(spark, tmp_path):
    for name, i in (("a*[1].parquet", 1), ("ab[1].parquet", 2), ("ab1.parquet", 3)):
        spark.createDataFrame([(i, "text")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made{i}")
        (part,) = (tmp_path / f"made{i}").glob("*.parquet")
        part.rename(tmp_path / name)
    ingest_tables(spark, f"{tmp_path}/a*[1].parquet", spark.createDataFrame([], "doc_id long, text string").schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
