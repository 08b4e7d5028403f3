"""The corpus operators' registered queries: opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.llm.decontaminate import leaks
from docquarry.llm.fingerprints import fingerprints
from docquarry.llm.language_model import language_model_scores
from docquarry.llm.licenses import license_matches
from docquarry.llm.mixing import mix_sources
from docquarry.llm.near_dedup import near_duplicates
from docquarry.llm.quality import quality
from docquarry.llm.suffix_dedup import remove_repeats
from docquarry.llm.toxicity import toxicity
from docquarry.llm.warc import archive_pages


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_model(spark, sf_dir):
    return language_model_scores(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op5_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_licenses(spark, sf_dir):
    return license_matches(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op10_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: the words of a text, A-Z lower-cased.
WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h), strlen(h)) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP7_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::INT, 200)) AS g FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM t WHERE n >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
m AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100 AS fresh FROM r),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m) GROUP BY doc_id, k),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(struct_pack(a := a, b := b) ORDER BY a) AS l FROM runs GROUP BY doc_id),
cut AS (SELECT t.doc_id, n, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, l FROM t LEFT JOIN kept USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(range(len(l) + 1), lambda i:
    substr(h, (2 * CASE WHEN i = 0 THEN 0 ELSE l[i].b END + 1)::INT, (2 * (CASE WHEN i = len(l) THEN n ELSE l[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE l[i].b END))::INT)), '') END)) AS kept_sha256
FROM cut
"""

OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.reach),
k AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.id = d.doc_id
"""


def queries():
    return {"op1_quality": op1_quality, "op2_decontaminate": op2_decontaminate, "op3_language_model": op3_language_model, "op4_warc": op4_warc, "op5_fingerprints": op5_fingerprints, "op6_licenses": op6_licenses, "op7_suffix_dedup": op7_suffix_dedup, "op8_toxicity": op8_toxicity, "op9_mix": op9_mix, "op10_near_dedup": op10_near_dedup}


def oracle_sql():
    return {"op4_warc": OP4_SQL, "op7_suffix_dedup": OP7_SQL, "op10_near_dedup": OP10_SQL}
