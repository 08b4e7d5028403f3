"""Files or tables that arrive in a folder, indexed once each.

The file source's checkpoint makes each file count once; each micro-batch is
written under its number, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docquarry.config import Config
from docquarry.operators.chunk import chunk_documents
from docquarry.operators.embed import Embedder
from docquarry.plans.ingest import build_from_files
from docquarry.sources.tables import with_pages

BINARY = "path string, modificationTime timestamp, length long, content binary"


def _write(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest_tables(spark: SparkSession, path: str, schema: T.StructType, to: str, checkpoint: str, glob: str = "*.parquet", size: int = Config.chunk_size, overlap: int = Config.chunk_overlap) -> StreamingQuery:
    """Chunk the rows (doc_id, text) of Parquet files as they arrive; ends when all there are have been read.

    path: a folder, whose files that glob matches are read, or one file.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):
        # the file source takes folders only
        path, glob = at.getParent().toString(), re.sub(r"[\\*?\[\]{}]", r"\\\g<0>", at.getName())
    docs = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, i: _write(chunk_documents(with_pages(rows, single=True), size, overlap), to, i)).start()


def ingest_files(spark: SparkSession, folder: str, embedder: Embedder, to: str, checkpoint: str, size: int = Config.chunk_size, overlap: int = Config.chunk_overlap) -> StreamingQuery:
    """Index PDF and Word files as they arrive: `to`/index and `to`/errors."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(folder)

    def batch(rows: DataFrame, i: int) -> None:
        named = rows.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
        built = build_from_files(named, embedder, size, overlap)
        _write(built.index, f"{to}/index", i)
        _write(built.errors, f"{to}/errors", i)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
