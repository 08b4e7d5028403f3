"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docquarry.sources.shared import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where this process has kept tables that are not deleted yet, in order.
_kept: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    _kept.append(path)
    df.write.option("compression", "snappy").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete kept tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.kept_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if at in _kept:
        _kept.remove(at)


def mark() -> int:
    """How many tables are kept now; see clear()."""
    return len(_kept)


def clear(spark: SparkSession, since: int, *but: DataFrame) -> None:
    """Delete the tables that were kept since mark() gave that number, but for some."""
    stay = {t.kept_at for t in but}
    for at in [x for x in _kept[since:] if x not in stay]:
        _delete(spark, at)


def buckets(df: DataFrame, each: int = 256 << 20) -> int:
    """Groups that rows made of df are dealt to: as many as shuffle partitions, more where they would be made of over `each` bytes.

    By the plan's estimate of its size; results do not depend on it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(tasks(df.sparkSession), min(size // each, 1 << 20))


def tasks(spark: SparkSession) -> int:
    """Partitions for shuffles that carry packed rows, as the session sizes its own."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
