"""The pipeline, stage by stage, against what each stage is to keep."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import store
from docquarry.llm.toxicity import toxicity
from tests.llm import brute
from tests.llm.test_operators import DOCS, corpus


def data(spark, tmp_path):
    docs = [(d, t, "en", f"s{d % 3}", len(t)) for d, t in corpus(11, 50)]
    docs += [(600, "you are an idiot and " + docs[20][1], "en", "s1", 0), (601, None, "en", None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (600, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = max((t for _, t, *_ in docs if t), key=len).split()[40:70]
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tmp_path):
    folder = data(spark, tmp_path)
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    docs = read("documents").cache()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        after = {r.doc_id: r for r in out.collect()}
        if i < 4:
            assert out.columns == docs.columns
        if name == "toxicity":
            assert set(after) == {r.doc_id for r in toxicity(docs, read("labels")).collect() if not r.predicted} and 600 not in after
        if name == "near_dedup":
            assert set(after) == {d for d, (_, c) in brute.near_duplicates([(r.doc_id, r.text) for r in before.values()]).items() if d == c}
        if name == "suffix_dedup":
            want = brute.without_repeats([(r.doc_id, r.text) for r in before.values()])
            assert {d: r.text for d, r in after.items()} == {d: b.decode("utf-8", "ignore") for d, b in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in read("benchmark").collect()]
            assert set(after) == set(before) - {d for d, _ in brute.leaks([(r.doc_id, r.text) for r in before.values()], items)} and len(after) < len(before)
        if name == "mix":
            assert after and all(r.taken > 0 for r in after.values())
        path = os.path.join(folder, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    begin = store.mark()
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.collect()} == set(after) and store.mark() == begin + 1
    store.clear(spark, begin)


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated ids, clashing columns: each stage keeps the columns, whatever the order of rows."""
    long_ = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long_, "s"), (None, None, None), (1, long_, "s"), (1, long_, "s"), (1, "quite another text", "t"), (2, long_ + " more", "t"), (3, "", "t"), (3, " ", "t"), (4, None, "t"), (5, "a b c", None)]
    clash = ("id", "n", "f", "score", "size", "target", "taken", "source_size", "row", "pass", "c0", "c1", "digest", "spans", "kept", "component", "half", "y", "lo", "hi", "first", "set_a", "set_b", "rank")
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, None), (1, "quite another text"), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    results = set()
    for part, order in enumerate((rows, rows[::-1])):
        docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in order], DOCS)
        docs = docs.withColumns({c: F.lit("x") for c in clash})
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert part or stage(spark, docs.limit(0), folder).count() == 0
            if name != "mix":
                assert out.schema.simpleString() == docs.schema.simpleString()
            path = f"{folder}/{part}-{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            kept[name] = tuple(sorted((str(r.doc_id), str(r.text)) for r in docs.select("doc_id", "text").collect()))
        results.add(tuple(kept.items()))
    (found,) = results
    found = dict(found)
    assert len(found["toxicity"]) == len(rows)
    # ids 1 and 2 are near; another text of id 1 is a document of its own; texts without words stay once for each id
    assert [d for d, _ in found["near_dedup"]] == ["1", "1", "3", "4", "5", "None", "None"]
    assert ("1", "quite another text") in found["suffix_dedup"] and ("1", "quite another text") not in found["decontaminate"]
    assert {d for d, _ in found["mix"]} <= {"1", "5", "None"} and ("5", "a b c") in found["mix"]
