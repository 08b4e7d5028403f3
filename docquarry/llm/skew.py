"""Joins of rows with their groups, where one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import tasks

#: Groups that are dealt to several tasks, at most: a group of fewer than 1/MOST_HOT of all rows is not one.
MOST_HOT, LEAST_HOT = 4096, 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "c") -> DataFrame:
    """rows joined with groups (one row to each of keys, `count` of rows in it, read twice: keep it).

    Rows of groups with more than 1/MOST_HOT of all counted rows are dealt to
    the partitions by another hash, and such groups, at most MOST_HOT of them,
    are repeated for each. rows must have an id.
    """
    spark = rows.sparkSession
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = groups.filter(F.col(count) > max(LEAST_HOT, total // MOST_HOT)).select(*keys)
    if hot.isEmpty():
        return rows.join(groups, keys)
    n = tasks(spark)
    marked = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    salted = rows.join(marked, keys, "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("id"), F.lit(n))).otherwise(0).cast("int")).drop("is_hot")
    spread = groups.join(marked, keys, "left").withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))).drop("is_hot")
    return salted.join(spread, [*keys, "salt"]).drop("salt")
