"""Sums of arrays over a whole table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytesops import lean

#: Arrays that one task adds up.
FAN = 32


def _of_partition(batches):
    sums = None
    for batch in batches:
        for x in batch.column(0):
            own = np.frombuffer(x.as_buffer(), np.float64)
            sums = own.copy() if sums is None else sums + own
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["part"])


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"g": table["g"][:1], "part": pa.array([sum(np.frombuffer(x.as_buffer(), np.float64) for x in table["part"]).tobytes()], pa.binary())})


def total(parts: DataFrame) -> np.ndarray | None:
    """The sum of all arrays (of 64-bit floats) in the one column of parts; each partition adds up its own, then a tree of tasks FAN of these."""
    rows = parts.mapInArrow(lean(_of_partition), "part binary")
    left = rows.rdd.getNumPartitions()
    rows = rows.withColumn("g", F.spark_partition_id().cast("long"))
    while left > FAN:
        left = -(-left // FAN)
        rows = rows.withColumn("g", F.expr(f"g div {FAN}")).groupBy("g").applyInArrow(_added, "g long, part binary")
    rows = rows.select("part").collect()
    return sum(np.frombuffer(r.part, np.float64) for r in rows) if rows else None
