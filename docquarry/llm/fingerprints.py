"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the shortest stretch that is not
yet in the dictionary, which it joins. The phrases' hashes form a set; its
signature holds the least hash in each of BINS bins (empty bins borrow from the
next full one). The share of equal bins estimates how much two phrase sets
have in common, as two texts that compress well together do.

For comparison each text is also edited: its second half gives way to the
beginning of the next document. Documents are dealt out by ranges of their
ids; the first of every range is also sent to the range before it, so that each
task can read its documents in order, holding two at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytesops import U, mix, prefix_hash, span_hash
from docquarry.llm.store import tasks

BINS = 128
#: The signature of a text without phrases.
NOTHING = np.full(BINS, 0xFFFF, np.uint16)


def phrases(text: str, cuts: list[int], seen: set[str], end: int) -> None:
    """Parse text from the last cut on; append the ends of phrases, up to the last that ends at `end` or before.

    The dictionary holds every prefix of what it holds, so the longest known
    stretch is found by doubling and halving.
    """
    n = len(text)
    i = cuts[-1] if cuts else 0
    while i < n:
        most = n - i
        low, high = 0, 4
        while high < most and text[i : i + high] in seen:
            low, high = high, 2 * high
        if high >= most:
            high = most
            if text[i:n] in seen:  # the rest is known whole
                if n <= end:
                    cuts.append(n)
                return
        while high - low > 1:
            middle = (low + high) // 2
            if text[i : i + middle] in seen:
                low = middle
            else:
                high = middle
        if i + high > end:
            return
        i += high
        seen.add(text[i - high : i])
        cuts.append(i)


def signature(text: str, cuts: list[int]) -> np.ndarray:
    """BINS minima over the hashes of the phrases that end at cuts."""
    if not cuts:
        return NOTHING
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, *cuts])
    if len(data) != len(text):
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[at]
    h = span_hash(prefix_hash(data), at[:-1], at[1:])
    keyed = np.sort((h % U(BINS)) << U(56) | h >> U(8))
    bins = (keyed >> U(56)).astype(np.int64)
    new = np.append(True, bins[1:] != bins[:-1])
    full, least = bins[new], keyed[new] & U((1 << 56) - 1)
    donor = np.searchsorted(full, np.arange(BINS)) % len(full)
    lent = (full[donor] - np.arange(BINS)) % BINS
    return ((mix(least[donor] + lent.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(48)) % U(0xFFFF)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray:
    cuts: list[int] = []
    phrases(text, cuts, set(), len(text))
    return signature(text, cuts)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, other: str) -> str:
    """text, its last half replaced by the first as many code points of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def both(text: str, edited: str, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts that begin with the same `shared` code points, which are parsed once."""
    cuts: list[int] = []
    seen: set[str] = set()
    phrases(text, cuts, seen, min(shared, len(text), len(edited)) - 1)
    cuts2, seen2 = cuts.copy(), seen.copy()
    phrases(text, cuts, seen, len(text))
    phrases(edited, cuts2, seen2, len(edited))
    return signature(text, cuts), signature(edited, cuts2)


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, tail, doc_id, text) in order -> a row for each document that is not a tail."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # (range, doc_id, text)
    waiting = None  # the row of the document before, but for near_next
    rows: list[list] = []

    def pack():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def settle(other: str):
        nonlocal waiting
        _, doc_id, text = held
        edited = edit(text, other)
        own, changed = both(text, edited, len(text) - len(text) // 2)
        if waiting:
            rows.append([*waiting[0], likeness(waiting[1], own)])
        waiting = ([doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed)], own)

    def close(text: str):
        nonlocal waiting
        rows.append([*waiting[0], likeness(waiting[1], fingerprint(text))])
        waiting = None

    for batch in batches:
        for i in range(batch.num_rows):
            part, tail, doc_id, text = (c[i].as_py() for c in batch.columns)
            text = text or ""
            if held:
                settle(text)
                if tail:
                    close(text)
            held = None if tail else (part, doc_id, text)
            if len(rows) >= 256:
                yield pack()
                rows = []
    if rows:
        yield pack()


def _range_of(doc_id: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are not above doc_id, looked up in two steps."""
    if not splits:
        return F.lit(0)
    width = math.isqrt(len(splits)) + 1
    rows = [splits[i : i + width] for i in range(0, len(splits), width)]
    array = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    count = lambda a: F.size(F.filter(a, lambda x: x <= doc_id))
    row = count(array([r[0] for r in rows]))
    return F.when(row > 0, (row - 1) * width + count(F.element_at(F.array(*map(array, rows)), F.greatest(row, F.lit(1))))).otherwise(0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of docs.

    Documents follow each other by ascending id, null first, rows that share
    an id by a hash of their texts; after the last comes the first. Null
    counts as empty. A text without phrases has a fingerprint of its own.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = tasks(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("q")).first().q
    splits = sorted(set(found or []))
    ranged = docs.select(F.coalesce(_range_of(F.col("doc_id"), splits), F.lit(0)).alias("range"), "doc_id", F.xxhash64("text").alias("h"), "text")
    firsts = sorted(ranged.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("f")).collect(), key=lambda r: r.range)
    # one row for each range: what is sent to the range before it, and from the first range to the last
    sent = spark.createDataFrame([(r.f.doc_id, r.f.h, firsts[i - 1].range) for i, r in enumerate(firsts)], "fd long, fh long, before int")
    rows = ranged.join(F.broadcast(sent), ranged.doc_id.eqNullSafe(sent.fd) & (ranged.h == sent.fh), "left")
    places = F.filter(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("range"), F.lit(1).alias("tail"))), lambda x: x["range"].isNotNull())
    rows = rows.select(F.explode(places).alias("p"), "doc_id", "h", "text").select("p.range", "p.tail", "doc_id", "h", "text")
    rows = rows.repartition(n, "range").sortWithinPartitions("range", "tail", F.asc_nulls_first("doc_id"), "h")
    return rows.select("range", "tail", "doc_id", "text").mapInArrow(_pairs, _FIELDS)
