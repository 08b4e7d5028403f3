"""A quality classifier on document statistics.

Each text gives STATISTICS numbers. Standardised, they go through random
Fourier features, whose inner products approximate a Gaussian kernel; a ridge
regression on these (and on the statistics themselves) is fitted from normal
equations that every partition sums for its rows. Isotonic regression turns raw
scores into probabilities. It is fitted on scores that each half of the
training rows gets from the equations of the other half.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytesops import LOWER, SPACE, blocks, lean, packed, prefix_hash, shingles, span_hash, words
from docquarry.llm.folds import held_out
from docquarry.llm.store import keep
from docquarry.llm.sums import total

FEATURES = 128
RIDGE = 3.0
#: Raw scores are calibrated on a grid of this many steps over LOW..HIGH.
STEPS, LOW, HIGH = 1024, -0.5, 1.5

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)
_KINDS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "letter": _LETTER,
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": SPACE,
    "wide": _BYTES >= 128,
    "symbol": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    "bang": np.isin(_BYTES, list(b"!?")),
    "stop": np.isin(_BYTES, list(b".,;:")),
    "bar": _BYTES == ord("|"),
}
STATISTICS = ("log_bytes", "log_words", *(f"{k}_share" for k in _KINDS), "upper_of_letters", "word_length", "word_length_spread", "plain_words", "symbol_words", "distinct_words", "log_distinct", "top_word", "repeated_next", "log_lines", "line_words")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    so_far = np.append(0, np.cumsum(values, dtype=np.float64))
    return so_far[first[1:]] - so_far[first[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) of a block."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    share = {k: _sums(t[data], offsets) / size for k, t in _KINDS.items()}
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    some = np.maximum(count, 1).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    mean = _sums(length, first) / some
    spread = np.sqrt(np.maximum(_sums(length**2, first) / some - mean**2, 0))
    letters, symbols = (np.append(0, np.cumsum(t[data])) for t in (_LETTER, _KINDS["symbol"] | _KINDS["bang"]))
    n_letters, n_symbols = (x[ends] - x[starts] for x in (letters, symbols))
    plain = _sums(n_letters >= length - 1, first) / some
    symbolic = _sums(n_symbols > 0, first) / some
    hashes = span_hash(prefix_hash(LOWER[data]), starts, ends)
    next_same = np.zeros(len(hashes), bool)
    next_same[1:] = hashes[1:] == hashes[:-1]
    next_same[first[:-1][count > 0]] = False
    distinct, at = shingles(hashes, first, 1)
    kinds = np.diff(at).astype(np.float64)
    # the share of the most frequent word: order words by text, then hash
    text = np.repeat(np.arange(n), count)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    run = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, t[run], np.diff(np.append(run, len(h))))
    lines = _sums(data == 10, offsets) + 1
    columns = [np.log1p(np.diff(offsets)), np.log1p(count), *share.values(), share["upper"] / np.maximum(share["letter"], 1e-9) * (share["letter"] > 0), mean, spread, plain, symbolic, kinds / some, np.log1p(kinds), top / some, _sums(next_same, first) / some, np.log(lines), np.log1p(count / lines)]
    return np.stack(columns, axis=1)


def _describe(batches):
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            f = statistics(data, offsets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed(f.reshape(-1), np.arange(hi - lo + 1) * f.shape[1])], ["doc_id", "f"])


def _matrix(col: pa.Array, width: int, kind=np.float32) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), kind) for x in col]
    return np.stack(rows).astype(np.float64) if rows else np.zeros((0, width))


class Kernel:
    """Standardised statistics, their random Fourier features, and 1."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        d = len(mean)
        rng = np.random.Generator(np.random.PCG64(20))
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((d, FEATURES)) / math.sqrt(d)
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b) * 4, x / math.sqrt(x.shape[1]), np.ones((len(x), 1))], axis=1)


def _moments(batches):
    d = len(STATISTICS)
    sums = np.zeros((3, d))
    for batch in batches:
        f = _matrix(batch.column(0), d)
        sums += np.stack([np.full(d, float(len(f))), f.sum(axis=0), (f**2).sum(axis=0)])
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["part"])


def _equations(kernel: Kernel):
    """(f, y, half) -> this partition's normal equations of each half."""

    def run(batches):
        width = FEATURES + len(STATISTICS) + 1
        sums = np.zeros((2, width, width + 1))
        for batch in batches:
            z, y, half = kernel(_matrix(batch.column(0), len(STATISTICS))), np.asarray(batch.column(1), np.float64), np.asarray(batch.column(2))
            for h in (0, 1):
                own = half == h
                sums[h] += z[own].T @ np.concatenate([z[own], y[own, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["part"])

    return run


def solve(equations: np.ndarray) -> np.ndarray:
    width = len(equations)
    ridge = np.full(width, RIDGE)
    ridge[-1] = 1e-6
    return np.linalg.solve(equations[:, :width] + np.diag(ridge), equations[:, width])


def _raw(kernel: Kernel, weights: np.ndarray):
    """(f, which, ...) -> raw score by weights[which], then the columns after which."""

    def run(batches):
        for batch in batches:
            z, which = kernel(_matrix(batch.column(0), len(STATISTICS))), np.asarray(batch.column(1))
            raw = np.einsum("ij,ij->i", z, weights[which])
            yield pa.RecordBatch.from_arrays([pa.array(raw), *batch.columns[2:]], ["raw", *batch.schema.names[2:]])

    return run


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to mean under weight (pool adjacent violators)."""
    pools: list[list[float]] = []
    for w, m in zip(weight.tolist(), mean.tolist(), strict=True):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, m2, k2 = pools.pop()
            w1, m1, k1 = pools[-1]
            pools[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2]
    return np.concatenate([np.full(k, m) for _, m, k in pools]) if pools else np.zeros(0)


def _step(raw):
    return F.least(F.greatest(F.floor((raw - LOW) / (HIGH - LOW) * STEPS), F.lit(0)), F.lit(STEPS - 1)).cast("int")


def calibration(cells: list[tuple[int, float, float]]) -> list[float]:
    """The probability at each step of the raw score, from (step, rows, rows of label 1)."""
    if not cells:
        return [0.5] * STEPS
    step, n, ones = (np.array(x, np.float64) for x in zip(*sorted(cells), strict=True))
    level = isotonic(n, ones / n)
    # steps without rows lie between their neighbours; a hundredth of the slope keeps the order within a pool
    at = np.arange(STEPS)
    line = np.interp(at, step, level)
    return np.clip(0.99 * line + 0.01 * (at + 0.5) / STEPS, 0, 1).tolist()


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, raw: one row for each row of docs.

    held_out: crc32 of the id as text is divisible by 5; all other labelled
    rows are learned from. Null, empty and blank texts have statistics, too:
    those of nothing. Labels that are null, or of null ids, are left out;
    without any, every score is 0.5. Rows that repeat an id are scored each.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = keep(docs.mapInArrow(lean(_describe), "doc_id long, f binary"), "statistics")
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    half = (F.xxhash64("doc_id").bitwiseAND(1)).cast("int").alias("half")
    train = keep(described.join(known.filter(~held_out("doc_id", 5, 0)), "doc_id").select("f", "y", half), "training")
    d, width = len(STATISTICS), FEATURES + len(STATISTICS) + 1
    moments = total(train.select("f").mapInArrow(_moments, "part binary"))
    kernel, weights, table = Kernel(np.zeros(d), np.ones(d)), np.zeros((1, width)), [0.5] * STEPS
    if moments is not None and moments[0] > 0:
        n, s, q = moments.reshape(3, d)
        kernel = Kernel(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)))
        parts = total(train.mapInArrow(_equations(kernel), "part binary")).reshape(2, width, width + 1)
        crossed = np.stack([solve(parts[1]), solve(parts[0])])
        raw = train.select("f", F.col("half").alias("which"), "y").mapInArrow(_raw(kernel, crossed), "raw double, y double")
        cells = raw.groupBy(_step(F.col("raw")).alias("step")).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
        table = calibration([(r.step, r.n, r.ones) for r in cells])
        weights = solve(parts.sum(axis=0))[None]
    scored = described.select("f", F.lit(0).alias("which"), "doc_id").mapInArrow(_raw(kernel, weights), "raw double, doc_id long")
    score = F.array(*map(F.lit, table))[_step(F.col("raw"))]
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "raw")
