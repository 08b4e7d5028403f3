"""Prediction by partial matching over bytes, and a unigram base to hold it against.

The model is a trie of byte contexts of up to ORDER symbols, A-Z lower-cased,
with counts of what followed each in the training texts; a text ends with an
end symbol. Contexts of ORDER symbols count occurrences, shorter ones count the
different symbols before them (update exclusion). A symbol is coded in the
longest context that the trie holds. If it was not seen there, an escape leads
to the next shorter context, where the symbols of the longer one are excluded;
last comes a uniform choice among what is left.

How likely an escape is, is estimated from the training texts: contexts are
pooled by order, by whether an escape has led there, and by their total and
their number of symbols; a class escapes as often as an occurrence that is left
out of its context's counts would have been new there.

Counts cover all training texts: tasks count their distinct grams, and buckets
of grams are summed. The whole trie is the model. Contexts of fewer than LOW
symbols go to every task; the others are dealt to buckets by their last LOW
symbols, so that a bucket holds all that its contexts need, and what escapes are
learned from adds up over buckets. The probabilities of at most MAX_NODES
frequent grams are sent out, and texts look them up; their other grams meet the
trie by bucket.

The unigram base needs the counts of every word: those of at most HEAD frequent
words are sent out; the others are met by hash bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytesops import LOWER, U, blocks, lean, mix, packed, prefix_hash, regroup, span_hash, words
from docquarry.llm.folds import held_out
from docquarry.llm.store import buckets, keep
from docquarry.llm.sums import total

ORDER = 5
#: Grams whose probabilities are sent out; the others are met by bucket, with the same result.
MAX_NODES = 1 << 21
LOW = 3
HEAD = 1 << 17
#: Distinct keys that a task holds before it sends them on.
HELD = 1 << 20
SYMBOL_BITS = 9
END, START, ALPHABET = 256, 257, 257
GRAMS, WORDS, TEXTS = 0, 1, 2
#: Classes that escapes are pooled by.
CLASSES = 61 * 64
#: What escapes are learned from: by order and whether an escape led there, the new and all, by class.
EVIDENCE = (ORDER + 1, 2, 2, CLASSES)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER symbols of context and the symbol, for each byte and end of text; each text's first (n+1)."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    at = offsets[:-1] + np.arange(n) * (ORDER + 1)  # in the stream: START * ORDER, text, END
    stream = np.full(len(data) + n * (ORDER + 1), START, np.uint64)
    text = np.repeat(np.arange(n), length)
    stream[np.arange(len(data)) + text * (ORDER + 1) + ORDER] = LOWER[data]
    stream[at + ORDER + length] = END
    out = stream[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= stream[ORDER - k : len(stream) - k] << U(SYMBOL_BITS * k)
    coded = stream[ORDER:] != START
    first = np.append(0, np.cumsum(length + 1))
    return out[coded], first


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), first


class _Counter:
    """Counts of 64-bit keys, a block at a time."""

    def __init__(self):
        self.keys, self.counts, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.new.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD // 2:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c for _, c in self.new)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[at], np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)
        self.new, self.size = [], 0

    def packed(self, kind: int, n: int) -> pa.RecordBatch:
        self.settle()
        order, first = regroup(np.arange(len(self.keys)), (mix(self.keys) % U(n)).astype(np.int64), n)
        some = np.flatnonzero(np.diff(first))
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), packed(self.keys[order], first).take(pa.array(some)), packed(self.counts[order], first).take(pa.array(some))],
            ["kind", "bucket", "keys", "counts"],
        )
        self.__init__()
        return out


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, texts = {GRAMS: _Counter(), WORDS: _Counter()}, 0
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                texts += hi - lo
                counters[GRAMS].add(grams(data, offsets)[0])
                counters[WORDS].add(word_hashes(data, offsets)[0])
                for kind, c in counters.items():
                    if len(c.keys) + c.size > HELD:
                        yield c.packed(kind, n)
        for kind, c in counters.items():
            yield c.packed(kind, n)
        ends = _Counter()
        ends.add(np.zeros(1, np.uint64), np.array([texts]))
        yield ends.packed(TEXTS, n)

    return run


def _unpack(col, kind) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in col)])


def _sum(table: pa.Table) -> pa.Table:
    c = _Counter()
    c.add(_unpack(table["keys"], np.uint64), _unpack(table["counts"], np.int64))
    c.settle()
    return pa.table({"kind": table["kind"][:1], "bucket": table["bucket"][:1], "keys": packed(c.keys, np.array([0, len(c.keys)])), "counts": packed(c.counts, np.array([0, len(c.keys)]))})


def _words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_unpack(batch.column("keys"), np.uint64).view(np.int64)), pa.array(_unpack(batch.column("counts"), np.int64))], ["word", "n"])


def _trie_entries(counted: DataFrame) -> DataFrame:
    """(order, gram, n, count): occurrences, and what the model counts, for grams of every order."""
    level = counted.filter(f"kind = {GRAMS}").mapInArrow(_words, "word long, n long").select(F.col("word").alias("gram"), "n", F.col("n").alias("count"))
    out = level.select(F.lit(ORDER).alias("order"), "*")
    for o in range(ORDER - 1, -1, -1):
        suffix = F.col("gram").bitwiseAND((1 << SYMBOL_BITS * (o + 1)) - 1).alias("gram")
        level = level.groupBy(suffix).agg(F.sum("n").alias("n"), F.count("*").alias("count"))
        out = out.union(level.select(F.lit(o).alias("order"), "*"))
    return out


def _threshold(counted: DataFrame, most: int) -> int:
    """The least count t such that at most `most` rows have n >= t."""
    sizes = counted.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int").alias("g")).agg(F.count("*").alias("rows"), F.max("n").alias("top")).orderBy(F.desc("g")).collect()
    total, floor = 0, 1
    for i, r in enumerate(sizes):
        total += r.rows
        if total > most:
            return r.top + 1
    return floor


class Trie:
    """The context counts, by order: sorted grams (context, then symbol) with counts, and of each context
    its total, its number of symbols, and what these symbols count one order below. `escape` gives escape
    probabilities by (order, after an escape) and class. A part of the whole trie will do for grams whose
    suffixes, with all that follows their contexts, are in it.
    """

    def __init__(self, order: np.ndarray, gram: np.ndarray, count: np.ndarray, escape: dict | None = None):
        self.gram, self.count, self.context, self.total, self.kinds, self.excluded = [], [], [], [], [], []
        self.escape, self.node = escape, []
        for o in range(ORDER + 1):
            own = order == o
            at = np.argsort(gram[own])
            g, c = gram[own][at], count[own][at].astype(np.float64)
            ctx = g >> U(SYMBOL_BITS)
            first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(g) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
            self.gram.append(g)
            self.count.append(c)
            self.context.append(ctx[first])
            self.total.append(add(c))
            self.kinds.append(add(np.ones(len(g))))
            below = self._find(self.gram[o - 1], g & U((1 << SYMBOL_BITS * o) - 1))[0] if o and len(g) else np.zeros(len(g), np.int64)
            self.excluded.append(add(self.count[o - 1][below]) if o and len(g) else np.zeros(len(first)))
            self.node.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g)))))

    @staticmethod
    def _class(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(np.maximum(total, 0) + 1) * 2, 60).astype(np.int64) * 64 + np.minimum(np.log2(np.maximum(kinds, 0) + 1) * 4, 63).astype(np.int64)

    def evidence(self, low: int, high: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """(order, after an escape, new, every) by class, from the entries of orders low to high - 1."""
        for o in range(ORDER + 1):
            if low <= o < high:
                c, n = self.count[o], self.node[o]
                once = c == 1
                cls = self._class(self.total[o][n] - 1, self.kinds[o][n] - once)
                yield o, False, np.bincount(cls, weights=once.astype(float), minlength=CLASSES), np.bincount(cls, weights=c, minlength=CLASSES)
            if not (low <= o + 1 < high and o < ORDER and len(self.gram[o + 1])):
                continue
            # occurrences that are new one order above, but for themselves
            rare = self.count[o + 1] == 1
            g, above = self.gram[o + 1][rare] & U((1 << SYMBOL_BITS * (o + 1)) - 1), self.node[o + 1][rare]
            c = self.count[o][self._find(self.gram[o], g)[0]]
            here = self._find(self.context[o], g >> U(SYMBOL_BITS))[0]
            new = c == 1
            cls = self._class(self.total[o][here] - (self.excluded[o + 1][above] - c) - 1, self.kinds[o][here] - (self.kinds[o + 1][above] - 1) - new)
            yield o, True, np.bincount(cls, weights=new.astype(float), minlength=CLASSES), np.bincount(cls, minlength=CLASSES).astype(float)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def code(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol after its context."""
        out = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        took, kinds, fell = np.zeros(len(gram)), np.zeros(len(gram)), np.zeros(len(gram), bool)  # what the context above excludes here
        for o in range(ORDER, -1, -1):
            if not len(self.context[o]):
                continue
            g = gram[open_] & U((1 << SYMBOL_BITS * (o + 1)) - 1)
            node, there = self._find(self.context[o], g >> U(SYMBOL_BITS))
            at, seen = self._find(self.gram[o], g)
            total = np.where(there, self.total[o][node] - took[open_], 0)
            new = np.where(there, self.kinds[o][node] - kinds[open_], 0)
            cls = self._class(total, new)
            escape = np.where(fell[open_], self.escape[o, True][cls], self.escape[o, False][cls])
            hit = there & seen
            out[open_[hit]] += np.log10((1 - escape[hit]) * self.count[o][at[hit]] / total[hit])
            miss = there & ~seen & (new > 0)
            out[open_[miss]] += np.log10(escape[miss])
            took[open_] = np.where(there, self.excluded[o][node], 0)
            kinds[open_] = np.where(there, self.kinds[o][node], 0)
            fell[open_] |= there
            open_ = open_[~hit]
        if len(open_):
            out[open_] -= np.log10(ALPHABET - (self.kinds[0][0] if len(self.kinds[0]) else 0))
        return out


class Known:
    """A hash table of grams and their log10 probabilities."""

    NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        bits = max(10, int(len(gram) * 2).bit_length())
        self.shift, self.keys, self.values = U(64 - bits), np.full(1 << bits, self.NONE), np.zeros(1 << bits, np.float32)
        left, at = np.arange(len(gram)), self._at(gram)
        self.probes = 0
        while len(left) and self.probes < 16:
            free = self.keys[at] == self.NONE
            self.keys[at[free]] = gram[left[free]]
            put = self.keys[at] == gram[left]
            self.values[at[put]] = value[left[put]]
            left, at = left[~put], (at[~put] + 1) & ((1 << bits) - 1)
            self.probes += 1

    def _at(self, gram: np.ndarray) -> np.ndarray:
        return (gram * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def lookup(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each gram's value, 0 where it has none, and whether it has one."""
        at = self._at(gram)
        ok = self.keys[at] == gram
        out = np.where(ok, self.values[at].astype(np.float64), 0.0)
        miss = np.flatnonzero(~ok)
        at = at[miss]
        for _ in range(1, self.probes):
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == gram[miss]
            out[miss[hit]], ok[miss[hit]] = self.values[at[hit]], True
            miss, at = miss[~hit], at[~hit]
        return out, ok


_built: dict[int, Known] = {}


def _known(model) -> Known:
    """The table of a broadcast, built once in each Python worker."""
    if model.value["uid"] not in _built:
        _built.clear()
        _built[model.value["uid"]] = Known(model.value["gram"], model.value["value"])
    return _built[model.value["uid"]]


def _bucket(gram: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a gram of order LOW or more: by the last LOW symbols of its context."""
    return (mix(gram >> U(SYMBOL_BITS) & U((1 << SYMBOL_BITS * LOW) - 1)) % U(n)).astype(np.int64)


def _placed(n: int):
    """(order, gram, count) -> entries packed by bucket."""

    def run(batches):
        for batch in batches:
            o, g, c = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2))
            order, first = regroup(np.arange(len(g)), _bucket(g, n), n)
            some = np.flatnonzero(np.diff(first))
            pick = lambda x: packed(x[order], first).take(pa.array(some))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pick(o), pick(g), pick(c)], ["bucket", "orders", "grams", "counts"])

    return run


def _part(low, table: pa.Table, escape: dict | None = None) -> Trie:
    """A bucket's part of the trie, with the low orders."""
    order, gram, count = low.value
    own = _unpack(table["orders"], np.int32), _unpack(table["grams"], np.uint64), _unpack(table["counts"], np.int64)
    return Trie(np.concatenate([order, own[0]]), np.concatenate([gram, own[1]]), np.concatenate([count, own[2]]), escape)


def _evidence(low):
    def run(table: pa.Table) -> pa.Table:
        out = np.zeros(EVIDENCE)
        for o, fell, new, every in _part(low, table).evidence(LOW, ORDER + 1):
            out[o, int(fell)] += np.stack([new, every])
        return pa.table({"part": pa.array([out.tobytes()], pa.binary())})

    return run


def _frequent(low, escape, least: int):
    def run(table: pa.Table) -> pa.Table:
        trie = _part(low, table, escape.value)
        g = trie.gram[ORDER][trie.count[ORDER] >= least]
        return pa.table({"gram": pa.array(g.view(np.int64)), "value": pa.array(trie.code(g).astype(np.float32))})

    return run


def _in_head(hashes: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return Trie._find(head, hashes)


def _tail(model, n: int, kind: int):
    """(key, text) -> words outside the head, or grams that are not sent out, with each text's key and their number, by bucket."""

    def run(batches):
        head = model.value["head"]
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                keys = np.asarray(batch.column(0).slice(lo, hi - lo))
                hashes, first = word_hashes(data, offsets) if kind == WORDS else grams(data, offsets)
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                out = ~(_in_head(hashes, head) if kind == WORDS else _known(model).lookup(hashes))[1]
                hashes, text = hashes[out], text[out]
                order = np.lexsort((hashes, text))
                hashes, text = hashes[order], text[order]
                if not len(hashes):
                    continue
                at = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
                tf = np.diff(np.append(at, len(hashes))).astype(np.int32)
                hashes, text = hashes[at], text[at]
                order, first = regroup(np.arange(len(hashes)), (mix(hashes) % U(n)).astype(np.int64) if kind == WORDS else _bucket(hashes, n), n)
                some = np.flatnonzero(np.diff(first))
                pick = lambda x: packed(x[order], first).take(pa.array(some))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pick(hashes), pick(keys[text]), pick(tf)], ["bucket", "words", "texts", "tf"])

    return run


def _meet(n: int, low=None, escape=None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A bucket's words in texts, and in the vocabulary, or grams and trie: sums by text, packed by text bucket."""
        w, t, tf = _unpack(left["words"], np.uint64), _unpack(left["texts"], np.int64), _unpack(left["tf"], np.int32)
        order = np.lexsort((w, t))
        w, t, tf = w[order], t[order], tf[order]
        fresh = np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])) if len(w) else np.zeros(0, bool)
        w, t, tf = w[fresh], t[fresh], tf[fresh]  # rows that repeat a text
        if low:
            kinds, of = np.unique(w, return_inverse=True)
            value, known = _part(low, right, escape.value).code(kinds)[of], np.ones(len(w), bool)
        else:
            vocabulary, counts = _unpack(right["keys"], np.uint64), _unpack(right["counts"], np.int64)
            at, known = Trie._find(vocabulary, w)
            value = np.log10(np.where(known, counts[at] if len(counts) else 0, 0) + 1.0)
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, x.dtype)
        t, s, k = t[first], add(tf * value), add(np.where(known, tf, 0).astype(np.int64))
        order, first = regroup(np.arange(len(t)), (mix(t.view(np.uint64)) % U(n)).astype(np.int64), n)
        some = np.flatnonzero(np.diff(first))
        pick = lambda x: packed(x[order], first).take(pa.array(some))
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "texts": pick(t), "sums": pick(s), "known": pick(k)})

    return run


def _by_text(table: pa.Table) -> pa.Table:
    t, s, k = _unpack(table["texts"], np.int64), _unpack(table["sums"], np.float64), _unpack(table["known"], np.int64)
    order = np.lexsort((s, t))
    t, s, k = t[order], s[order], k[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    if not len(first):
        return pa.table({"key": pa.array([], pa.int64()), "tail_sum": pa.array([], pa.float64()), "tail_known": pa.array([], pa.int64())})
    return pa.table({"key": pa.array(t[first]), "tail_sum": pa.array(np.add.reduceat(s, first)), "tail_known": pa.array(np.add.reduceat(k, first))})


def _score(model):
    """(doc_id, key, text) -> words, and of those in the head the known and their sum, and the log10 probability of the grams sent out."""

    def run(batches):
        v = model.value
        table, head, logs, seen = _known(model), v["head"], np.log10(v["head_count"] + 1.0), v["head_count"] > 0
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                g, first = grams(data, offsets)
                score = np.add.reduceat(table.lookup(g)[0], first[:-1])
                hashes, first = word_hashes(data, offsets)
                at, ok = _in_head(hashes, head)
                sums = np.append(0.0, np.cumsum(np.where(ok, logs[at] if len(head) else 0.0, 0.0)))
                known = np.append(0, np.cumsum(ok & (seen[at] if len(head) else False)))
                take = lambda x: pa.array(x[first[1:]] - x[first[:-1]])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), take(known), take(sums), pa.array(score)], ["doc_id", "key", "words", "head_known", "head_sum", "score"])

    return run


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, rest: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    held_out says that crc32 of the id as text leaves rest modulo folds; the
    other rows are learned from, with null ids among them. Null and empty
    texts have the end token only. score is log10 of the probability that the
    model gives to the text and its end; without training texts, all symbols
    are as likely. Rows that repeat an id or a text count and are scored each.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = buckets(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = docs.filter(~held_out("doc_id", folds, rest)).select("text")
    counted = train.mapInArrow(lean(_count(n)), "kind int, bucket int, keys binary, counts binary")
    counted = keep(counted.groupBy("kind", "bucket").applyInArrow(_sum, "kind int, bucket int, keys binary, counts binary"), "counts")

    entries = keep(_trie_entries(counted), "trie")
    numbers = lambda t: (t["order"].to_numpy(), t["gram"].to_numpy().view(np.uint64), t["count"].to_numpy())
    low = numbers(entries.filter(F.col("order") < LOW).select("order", "gram", "count").toArrow())
    parts = entries.filter(F.col("order") >= LOW).select("order", "gram", "count")
    parts = keep(parts.mapInArrow(lean(_placed(n)), "bucket int, orders binary, grams binary, counts binary"), "parts")
    evidence = np.zeros(EVIDENCE)
    for o, fell, new, every in Trie(*low).evidence(0, LOW):
        evidence[o, int(fell)] += np.stack([new, every])
    low = spark.sparkContext.broadcast(low)
    more = total(parts.groupBy("bucket").applyInArrow(_evidence(low), "part binary"))
    if more is not None:
        evidence += more.reshape(EVIDENCE)
    escape = spark.sparkContext.broadcast({(o, fell): (evidence[o, int(fell), 0] + 0.15) / (evidence[o, int(fell), 1] + 0.3) for o in range(ORDER + 1) for fell in (False, True)})
    least = _threshold(entries.filter(F.col("order") == ORDER), MAX_NODES)
    frequent = parts.groupBy("bucket").applyInArrow(_frequent(low, escape, least), "gram long, value float").toArrow()
    vocabulary = counted.filter(f"kind = {WORDS}")
    listed = vocabulary.mapInArrow(_words, "word long, n long")
    totals = listed.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    texts = counted.filter(f"kind = {TEXTS}").mapInArrow(_words, "word long, n long").agg(F.sum("n").alias("n")).first().n or 0
    head = listed.filter(F.col("n") >= _threshold(listed, HEAD)).toArrow()
    word = head["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    model = spark.sparkContext.broadcast({
        "uid": np.random.default_rng().integers(1 << 62),
        "gram": frequent["gram"].to_numpy().view(np.uint64), "value": frequent["value"].to_numpy(),
        "head": word[order], "head_count": head["n"].to_numpy()[order],
    })

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    tail = keyed.select("key", "text").mapInArrow(lean(_tail(model, n, WORDS)), "bucket int, words binary, texts binary, tf binary")
    met = tail.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(_meet(n), "bucket int, texts binary, sums binary, known binary")
    rare = met.groupBy("bucket").applyInArrow(_by_text, "key long, tail_sum double, tail_known long")
    tail = keyed.select("key", "text").mapInArrow(lean(_tail(model, n, GRAMS)), "bucket int, words binary, texts binary, tf binary")
    met = tail.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(_meet(n, low, escape), "bucket int, texts binary, sums binary, known binary")
    others = met.groupBy("bucket").applyInArrow(_by_text, "key long, tail_sum double, tail_known long").select("key", F.col("tail_sum").alias("more"))
    scores = keyed.mapInArrow(lean(_score(model)), "doc_id long, key long, words long, head_known long, head_sum double, score double")
    tokens, kinds = (totals.n or 0) + texts, totals.v + (texts > 0)
    floor = float(np.log10(tokens + (kinds + 1)))
    n_tokens = F.col("words") + 1
    return scores.join(rare, "key", "left").join(others, "key", "left").select(
        "doc_id",
        held_out("doc_id", folds, rest).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(texts > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + float(np.log10(texts + 1)) - n_tokens * floor).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
