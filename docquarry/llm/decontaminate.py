"""Benchmark decontamination: CGK embedding, bit sampling, exact edit verification.

Texts are sequences of words: runs of letters, digits and bytes above 0x7F, A-Z
lower-cased; a code point of a script without spaces (Chinese, Japanese, Thai,
Lao) is a word of its own. A document leaks an item if some stretch of it is
within the item's edit bound, EDIT_RATE of its words; an item of fewer than
LEAST_EDITED words must be met exactly, and one of fewer than PIECE words must
be the whole document. Of most items, two distinct three-word pieces survive any
edits within the bound, so only windows that hold two are looked at; items of
few distinct pieces have every window looked at that holds one.

Each such window, of an item's size, is embedded by CGK random walks: at step j
the walk writes the word it stands on and moves ahead if a random bit of (j,
word) says so. Walks over sequences of small edit distance fall into step, so
their outputs agree at most steps. Each of ROUNDS independent walks is sampled
at a few steps; windows meet the items whose samples are equal. Whatever meets
is verified by its edit distance. The test suite measures the recall.

The benchmark is a query set: it is read in blocks of BLOCK_BYTES, and each
block is sent to the documents once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytesops import LOWER, U, blocks, lean, mix, prefix_hash, randoms, span_hash, spans

EDIT_RATE = 0.2
LEAST_EDITED = 7
PIECE = 3
ROUNDS = 48
SAMPLES = 3
BLOCK_BYTES = 4 << 20

WORDLY = np.zeros(256, bool)
WORDLY[48:58] = WORDLY[97:123] = True
WORDLY[128:] = True

_PLACE = randoms(PIECE, 31) | U(1)
_WALK = randoms(ROUNDS, 37)
_PAD = U(0x0123456789ABCDEF)
_BITS = 22


def _alone(data: np.ndarray) -> np.ndarray:
    """Where words are cut: at code points of scripts without spaces, and after them."""
    lead = np.flatnonzero(data & 0xC0 != 0x80)
    one, two = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    solo = ((one >= 0xE3) & (one <= 0xE9)) | ((one == 0xE0) & (two >= 0xB8) & (two <= 0xBB)) | ((one == 0xF0) & (two >= 0xA0) & (two <= 0xB3))
    cut = np.zeros(len(data), bool)
    cut[lead] = solo | np.append(False, solo[:-1])
    return cut


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased data, and each text's first (n+1)."""
    inside = WORDLY[data]
    starts, ends, first = spans(inside, offsets)
    if len(data) and data.max() >= 0xE0:
        begin = np.zeros(len(data) + 1, bool)
        begin[starts] = True
        end = np.zeros(len(data) + 1, bool)
        end[ends] = True
        cut = _alone(data) & inside
        begin[:-1] |= cut
        end[:-1] |= cut & np.append(False, inside[:-1])
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
        first = np.searchsorted(starts, offsets)
    return starts, ends, first


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, and each text's first (n+1)."""
    data = LOWER[data]
    starts, ends, first = spans_of_words(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), starts, ends, first


def pieces(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the PIECE words from each word on."""
    n = len(hashes) - PIECE + 1
    return mix(sum((hashes[j : n + j] * _PLACE[j] for j in range(PIECE)), np.zeros(max(n, 0), np.uint64))) if n > 0 else np.zeros(0, np.uint64)


def edit_bound(n: int) -> int:
    """Edits that an item of n words may have."""
    return int(EDIT_RATE * n) if n >= LEAST_EDITED else 0


def _sampled_steps(n: int) -> np.ndarray:
    """The steps of a walk over n words that each round samples."""
    u = (randoms(ROUNDS * SAMPLES, 41) >> U(11)).astype(np.float64) / 2.0**53
    return (u * 2 * n).astype(np.int64).reshape(ROUNDS, SAMPLES)


def sample_keys(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(rounds, windows): the key of each window words[start:start+n] in each round."""
    steps = _sampled_steps(n)
    at = np.zeros((ROUNDS, len(starts)), np.int64)
    keys = np.broadcast_to(mix(_WALK + U(n))[:, None], at.shape).copy()
    top = len(words) - 1
    for j in range(int(steps.max()) + 1):
        word = np.where(at < n, words[np.minimum(starts + at, top)], _PAD)
        for s in range(SAMPLES):
            here = np.flatnonzero(steps[:, s] == j)
            if len(here):
                keys[here] = mix(keys[here] * U(3) + word[here] * _PLACE[s])
        at += ((word ^ mix(_WALK + U(j + 1))[:, None]) * U(0x9E3779B97F4A7C15) >> U(63)).astype(np.int64)
    return keys


def edits(item: list, text: list, bound: int) -> tuple[int, int]:
    """(least edit distance of item to a prefix of text, its length), by bit-parallel dynamic programming; bound + 1 if over."""
    n = len(item)
    peq: dict = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    top, full = 1 << (n - 1), (1 << n) - 1
    pv, mv, score = full, 0, n
    best = (n, 0) if n <= bound else (bound + 1, 0)
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & full  # the empty prefix of the item costs a step, too
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Index:
    """A block of benchmark items, made ready for search."""

    def __init__(self, ids: list, texts: list):
        col = pa.array(texts, pa.large_string())
        self.ids, self.words, self.bound = [], [], []
        self.short: dict = {}
        for lo, _, data, offsets in blocks(col):
            hashes, _, _, first = word_spans(data, offsets)
            for i in range(len(offsets) - 1):
                own = hashes[first[i] : first[i + 1]]
                if len(own):
                    if len(own) < PIECE:
                        self.short.setdefault(tuple(own.tolist()), []).append(len(self.ids))
                    self.ids.append(ids[lo + i])
                    self.words.append(own)
                    self.bound.append(edit_bound(len(own)))
        self.size = np.array([len(w) for w in self.words], np.int64)
        own = [np.unique(pieces(w)) for w in self.words]
        # an edit ends at most PIECE pieces; where fewer than two distinct ones are sure to survive, one hit is enough
        self.single = np.array([len(p) - PIECE * k < 2 for p, k in zip(own, self.bound, strict=True)], bool)
        item = np.repeat(np.arange(len(own)), [len(p) for p in own])
        flat = np.concatenate([np.zeros(0, np.uint64), *own])
        order = np.argsort(flat, kind="stable")
        self.piece, self.piece_item = flat[order], item[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.piece >> U(64 - _BITS)] = True
        keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            if len(w) >= PIECE:
                keys.append(sample_keys(w, np.zeros(1, np.int64), len(w)).reshape(-1))
                of.append(np.full(ROUNDS, i))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.key, self.key_item = key[order], np.concatenate(of)[order]

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(size, starts) of the windows that hold two distinct pieces of the benchmark, or one of an item that may keep only one."""
        p = pieces(hashes)
        at = np.flatnonzero(self.maybe[p >> U(64 - _BITS)])
        lo = np.searchsorted(self.piece, p[at], "left")
        n_items = np.searchsorted(self.piece, p[at], "right") - lo
        text = np.searchsorted(first, at, "right") - 1
        ok = (n_items > 0) & (at + PIECE <= first[text + 1])
        at, lo, n_items, text = at[ok], lo[ok], n_items[ok], text[ok]
        if not len(at):
            return
        # the next hit with another piece, in the same text
        h = p[at]
        change = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        nxt = change[np.searchsorted(change, np.arange(len(h)), "right")]
        second = nxt < len(h)
        second[second] &= text[nxt[second]] == text[second]
        at2 = np.where(second, at[np.minimum(nxt, len(at) - 1)], 0)
        hit = np.repeat(np.arange(len(at)), n_items)
        item = self.piece_item[np.repeat(lo - np.append(0, np.cumsum(n_items))[:-1], n_items) + np.arange(int(n_items.sum()))]
        alone = self.single[item]
        ok = second[hit] | alone
        hit, item, alone = hit[ok], item[ok], alone[ok]
        size = self.size[item]
        reach = size + np.array(self.bound, np.int64)[item]
        begin = np.maximum(np.where(alone, at[hit], at2[hit]) + PIECE - reach, first[:-1][text[hit]])
        end = np.maximum(at[hit] + 1, begin)
        for n in np.unique(size).tolist():
            own = size == n
            depth = np.bincount(begin[own], minlength=len(hashes) + 1) - np.bincount(end[own], minlength=len(hashes) + 1)
            yield n, np.flatnonzero(np.cumsum(depth) > 0)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> dict:
        """{(text, item): (edits, first word, words)}: the closest stretch of each text to each item it leaks."""
        found: dict = {}
        if self.short:
            for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < PIECE)).tolist():
                for item in self.short.get(tuple(hashes[first[t] : first[t + 1]].tolist()), ()):
                    found[t, item] = (0, int(first[t]), len(self.words[item]))
        for n, starts in self.windows(hashes, first):
            for lo in range(0, len(starts), 4096):
                own = starts[lo : lo + 4096]
                text = np.searchsorted(first, own, "right") - 1
                keys = sample_keys(hashes, own, n)
                at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
                r, w = np.nonzero(self.key[at] == keys)
                pairs = set()
                for k, i in zip(at[r, w].tolist(), w.tolist(), strict=True):
                    x = self.key[k]
                    while k < len(self.key) and self.key[k] == x:
                        pairs.add((i, int(self.key_item[k])))
                        k += 1
                for i, item in sorted(pairs):
                    t, s = int(text[i]), int(own[i])
                    bound = self.bound[item]
                    best = found.get((t, item))
                    if best and best[0] == 0:
                        continue
                    stretch = hashes[s : min(s + n + bound, int(first[t + 1]))].tolist()
                    d, m = edits(self.words[item].tolist(), stretch, bound)
                    if d <= bound and (best is None or (d, s) < best[:2]):
                        found[t, item] = (d, s, m)
        return found


_FIELDS = ["doc_id", "item_id", "edits", "item_words", "start_byte", "end_byte"]


def _search(index):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, offsets in blocks(batch.column(1)):
                hashes, starts, ends, first = word_spans(data, offsets)
                found = index.value.search(hashes, first)
                if found:
                    rows = [(ids[lo + t].as_py(), index.value.ids[i], d, len(index.value.words[i]), int(starts[s] - offsets[t]), int(ends[s + max(m, 1) - 1] - offsets[t])) for (t, i), (d, s, m) in sorted(found.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _FIELDS)

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The items, in blocks of about BLOCK_BYTES."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += 4 * len(row.t)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_words, start_byte, end_byte: one row for each document and item it leaks.

    edits counts word edits between the item and the closest stretch, which
    bytes start_byte to end_byte of the text hold; of several, the first.
    Null and empty texts leak nothing. Items that are null or without words
    match nothing; those of fewer than LEAST_EDITED words match exactly, and of
    fewer than PIECE words only a document that holds nothing else. Rows that repeat an id each give their rows; ids may be
    null. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{f} long" for f in _FIELDS)
    out = None
    for ids, texts in benchmark_blocks(benchmark, item_col, item_text_col):
        index = Index(ids, texts)
        if index.ids:
            part = docs.mapInArrow(lean(_search(spark.sparkContext.broadcast(index))), schema)
            out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def _without(index):
    def run(batches):
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for lo, _, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
                hashes, _, _, first = word_spans(data, offsets)
                for t, _ in index.value.search(hashes, first):
                    stay[lo + t] = False
            yield batch.filter(pa.array(stay))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs (text, ...) that leak no item, as leaks() finds them, with the same columns."""
    for ids, texts in benchmark_blocks(benchmark, item_col, item_text_col):
        index = Index(ids, texts)
        if index.ids:
            docs = docs.mapInArrow(lean(_without(docs.sparkSession.sparkContext.broadcast(index))), docs.schema)
    return docs
