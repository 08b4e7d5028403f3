import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.errors import GenerationError
from docquarry.operators import index as indexes
from docquarry.operators.answer import answer, retrieve
from docquarry.operators.embed import HashedEmbedder, create_embedder
from docquarry.operators.generate import Extractive, answered, api_key, create_generator, error_class, explain
from docquarry.operators.prompt import NO_CONTEXT, NOTE, context, prompt, source_pages
from docquarry.operators.search import best_similarity, search, valid_questions
from docquarry.operators.views import answer_view, embedding_view, history_view, source_view
from docquarry.plans.ingest import build_from_pages


def table(spark, n=40, dim=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


@pytest.mark.parametrize("how", ["arrow", "expression"])
@pytest.mark.parametrize("k", [1, 3, 10, 100])
def test_search_is_exact_with_ties_by_id(spark, how, k):
    vectors, rows = table(spark)
    asked = vectors.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), "embedding")
    got = search(vectors, asked, k, ["vec_id"], how, block_bytes=100).orderBy("qid", "rank").collect()
    for q, v in rows[:5]:
        want = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows))[:k]
        assert [(r.rank, r.vec_id, r.similarity) for r in got if r.qid == q] == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


@pytest.mark.parametrize("how", ["arrow", "expression"])
def test_nan_is_no_hit(spark, how):
    rows = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, [0.5]), (4, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0])], "qid long, embedding array<float>")
    assert [r.vec_id for r in search(rows, asked, 5, ["vec_id"], how).orderBy("rank").collect()] == [1, 3]


def test_search_limits_before_it_shuffles(spark):
    vectors, _ = table(spark)
    asked = vectors.limit(2).select(F.col("vec_id").alias("qid"), "embedding")
    plan = search(vectors, asked, 3, ["vec_id"], "expression")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("how", ["arrow", "expression"])
def test_vectors_of_other_widths_are_no_hits(spark, how):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0]), (4, None), (5, []), (6, [1.0, None])], "vec_id long, embedding array<float>")
    asked = rows.select(F.col("vec_id").alias("qid"), "embedding")
    got = {(r.qid, r.vec_id) for r in search(rows, asked, 9, ["vec_id"], how).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_failed_calls_cost_their_own_rows():
    def generate(prompt):
        if prompt == "bad":
            raise GenerationError("no answer")
        return prompt.upper()

    got = list(answered(iter([pd.Series(["a", "bad"]), pd.Series([], dtype=object), pd.Series(["b"])]), generate))
    assert [tuple(r) for batch in got for r in batch.itertuples(index=False)] == [("A", None), (None, "no answer"), ("B", None)]


def test_top_k_is_checked(spark):
    vectors, _ = table(spark)
    with pytest.raises(ValueError, match="top_k"):
        search(vectors, vectors, 0)


def test_add_checks_widths(spark):
    vectors, _ = table(spark, 3, 4)
    assert indexes.add(vectors, vectors, 4).count() == 6
    with pytest.raises(ValueError, match="numbers"):
        indexes.add(vectors, vectors.withColumn("embedding", F.lit(None).cast("array<float>")), 4)


def test_new_and_replaced_files(spark):
    files = indexes.with_fingerprint(spark.createDataFrame([("a", bytearray(b"bc")), ("ab", bytearray(b"c")), ("x", bytearray(b"y"))], "filename string, content binary"))
    assert {r.filename for r in indexes.new_files(files, files.filter("filename = 'a'")).collect()} == {"x"}  # no separator: a+bc is ab+c
    old = spark.createDataFrame([(1, "o"), (2, "o")], "doc_id long, text string")
    new = spark.createDataFrame([(2, "n")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in indexes.replaced(old, new).collect()} == {(1, "o"), (2, "n")}


def test_metadata_counts_blank_pages(spark):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, " "), ("e", 1, "")], "doc_id string, page_number int, text string")
    built = build_from_pages(pages, HashedEmbedder(16))
    assert {(r.doc_id, r.page_count, r.chunk_count, r.status) for r in built.metadata.collect()} == {("d", 2, 1, "ready"), ("e", 1, 0, "empty")}
    assert [r.doc_id for r in built.errors.collect()] == ["e"]
    assert built.index.first().embedding and len(built.index.first().embedding) == 16


def test_confidence_is_strict(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    hits = spark.createDataFrame([(1, 0.5), (2, 0.49)], "qid long, similarity double")
    assert {r.qid: (r.best_similarity, r.low_confidence) for r in best_similarity(q, hits, 0.5).collect()} == {1: (0.5, False), 2: (0.49, True), 3: (0.0, True)}
    single = spark.createDataFrame([(1, 0.35)], "qid long, s float").select("qid", F.col("s").cast("double").alias("similarity"))
    assert best_similarity(q.limit(1), single, 0.35).first().low_confidence


def test_questions(spark):
    q = spark.createDataFrame([(1, "  a  "), (2, " \n"), (3, None)], "qid long, question string")
    assert [(r.qid, r.question) for r in valid_questions(q).collect()] == [(1, "a")]


def test_context_and_prompt(spark):
    rows = spark.createDataFrame([([(2, 7, 0.0625, "b"), (1, 2, 0.9, "a")],), ([],)], "h array<struct<rank:int,page_number:int,similarity:double,text:string>>")
    blocks = [r[0] for r in rows.select(context(F.col("h"))).collect()]
    assert blocks == ["[Page 2 | similarity 0.900]\na\n\n[Page 7 | similarity 0.062]\nb", NO_CONTEXT]
    low, high = (rows.limit(1).select(prompt(F.lit("why?"), F.lit("ctx"), F.lit(x))).first()[0] for x in (True, False))
    assert NOTE in low and NOTE not in high and low.endswith("Answer:") and "\n\nPassages:\nctx\n\nQuestion:\nwhy?\n\n" in low
    assert "\n\n\n" not in low and "\n\n\n" not in high
    pages = spark.createDataFrame([([(7,), (2,), (7,)],)], "h array<struct<page_number:int>>").select(source_pages(F.col("h"))).first()[0]
    assert pages == [2, 7]


def test_answers_end_to_end(spark):
    pages = spark.createDataFrame([("d", 1, "cats purr at night"), ("d", 2, "dogs bark at noon")], "doc_id string, page_number int, text string")
    e = HashedEmbedder()
    index = build_from_pages(pages, e).index
    asked = spark.createDataFrame([(1, "dogs bark"), (2, " "), (3, "zebra")], "qid long, question string")
    rows = {r.qid: r for r in answer(index, asked, e, Extractive(), 1).collect()}
    assert set(rows) == {1, 3} and rows[1].answer == "dogs bark at noon" and rows[1].sources == [2] and rows[1].num_retrieved_chunks == 1
    assert not rows[1].low_confidence and rows[3].low_confidence and rows[1].embedding_dimension == 256
    assert retrieve(index, asked, e, 5).filter("qid = 1").count() == 2
    none = answer(index.limit(0), asked, e, Extractive()).filter("qid = 1").first()
    assert none.answer == Extractive.NOTHING and none.sources == [] and none.best_similarity == 0 and NO_CONTEXT in none.prompt
    assert Extractive().generate(rows[1].prompt) == "dogs bark at noon"
    shown = answer(index, asked, e, Extractive(), 2)
    assert answer_view(shown).filter("qid = 1").first().pages == "1, 2" and source_view(shown).filter("qid = 1").count() == 2
    assert len(embedding_view(index, "chunk_id").first().first_values) == 10


def test_history_labels(spark):
    rows = spark.createDataFrame([("s", 1, "q" * 80, "a", [2, 7]), ("s", 5, "q" * 81, "a", [])], "session_id string, seq long, question string, answer string, sources array<int>")
    got = history_view(rows).collect()
    assert [(r.n, r.label, r.pages) for r in got] == [(2, "q" * 80 + "...", ""), (1, "q" * 80, "Page 2, Page 7")]


def test_embedders(spark):
    row = spark.createDataFrame([("B a a",), ("",), (None,)], "t string").select(HashedEmbedder(8).column(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in row[0].v) == pytest.approx(1) and set(row[1].v) == {0.0} and set(row[2].v) == {0.0}
    assert create_embedder("hashed-7").dimension == 7
    with pytest.raises(ValueError):
        HashedEmbedder(0)


def test_error_classes(spark, monkeypatch):
    cases = {"API KEY bad": "bad_key", "x 403": "bad_key", "429": "rate_limit", "quota": "rate_limit", "the rate": "rate_limit", "RATE_LIMIT_EXCEEDED": "rate_limit", "generate": "client"}
    rows = spark.createDataFrame([(m,) for m in cases], "m string").select("m", error_class(F.col("m"))).collect()
    assert dict(map(tuple, rows)) == cases
    assert explain("generate") != explain("rate") and explain("x", "server") != explain("x", "other")
    with pytest.raises(ValueError, match="unknown provider"):
        create_generator("nobody")
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="GEMINI_API_KEY"):
        api_key()
