"""Repeated byte strings across a corpus, by a distributed merge sort of suffixes.

Every string of LENGTH bytes holds an anchor: the least hash among its GRAM-byte
grams. Equal strings hold equal anchors at equal offsets, so it is enough to
sort the suffixes that begin at anchors, each with the bytes before it appended
in reverse: its context holds every LENGTH-byte string around the anchor.

1. Anchors go out by hash, packed many to a row; those met once vanish.
2. Contexts of the others are sorted into runs where their texts are read.
   Runs leave front-coded: of each context only what it does not share with the
   one before, and equal contexts of a run once, with their earliest place. The
   other places repeat whole, which is settled there and then.
3. Each task merges its runs with a loser tree that carries common prefixes, so
   known prefixes are never compared again. Runs are exchanged by the hash of
   the first GRAM bytes, since strings that share LENGTH bytes share those.
4. In merged order, equal contexts are neighbours: all but the earliest place
   repeat whole. Where different contexts share an anchor, the prefixes that
   the merge found (and those of the reversed left parts) tell for each offset
   which LENGTH-byte strings are equal; all but the earliest are repeats.

Exact copies of a text are settled by digest beforehand and sort nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.bytesops import U, blocks, column, lean, mix, packed, prefix_hash, regroup, span_hash
from docquarry.llm.loser_tree import front_decode, merge
from docquarry.llm.skew import join_groups
from docquarry.llm.store import buckets, keep

LENGTH = 100
GRAM = 32
#: Stands for bytes beyond a text's ends; UTF-8 has no such byte.
BEYOND = 255
#: Anchors, and bytes of contexts, that a task holds before it sends them on.
HELD_ANCHORS, HELD_CONTEXTS = 1_000_000, 60_000


def _sliding(x: np.ndarray, width: int, how: np.ufunc) -> np.ndarray:
    """how over x[i:i+width], for i up to len(x) - width."""
    span = 1
    while 2 * span <= width:
        x = how(x[:-span], x[span:])
        span *= 2
    return how(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places in data of grams that are least in some length-byte string of one text, and their hashes."""
    n, span = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    hashes = span_hash(prefix, at, at + gram)
    rank = np.maximum((hashes >> U(32)).astype(np.uint32), np.uint32(1))
    whole = np.ones(n - length + 1, bool)  # does the string from here end in the same text
    for end in offsets[1:-1].tolist():
        whole[max(0, end - length + 1) : end] = False
    least = np.where(whole, _sliding(rank, span, np.minimum), np.uint32(0))
    padded = np.zeros(len(least) + 2 * (span - 1), np.uint32)
    padded[span - 1 : span - 1 + len(least)] = least
    places = np.flatnonzero(_sliding(padded, span, np.maximum) == rank)
    return places, hashes[places]


def _anchor_rows(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush():
            h, keys, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            # the bucket takes the low half of the hash, the rest tells grams of a bucket apart
            order, first = regroup(np.arange(len(h)), ((h & U(0xFFFFFFFF)) % U(n_buckets)).astype(np.int64), n_buckets)
            some = np.flatnonzero(np.diff(first))
            pick = lambda x: packed(x[order], first).take(pa.array(some))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pick((h >> U(32)).astype(np.uint32)), pick(keys), pick(pos)], ["bucket", "h", "key", "pos"])

        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                keys = np.asarray(batch.column(0).slice(lo, hi - lo))
                fresh = np.zeros(hi - lo, bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = True
                places, h = anchors(data, offsets)
                text = np.searchsorted(offsets, places, "right") - 1
                text_ok = fresh[text]
                places, h, text = places[text_ok], h[text_ok], text[text_ok]
                held.append((mix(h), keys[text], (places - offsets[text]).astype(np.uint32)))
                size += len(h)
                if size >= HELD_ANCHORS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _joined(col: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(column(col)[0].tobytes(), kind)


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket's anchors that occur at two places or more: (key, places)."""
    h, key, pos = _joined(table["h"], np.uint32), _joined(table["key"], np.int64), _joined(table["pos"], np.uint32)
    place = mix(key.view(np.uint64)) ^ mix(pos.astype(np.uint64) + U(77))
    order = np.lexsort((place, h))
    h, place, key, pos = h[order], place[order], key[order], pos[order]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    fresh = new_h.copy()
    fresh[1:] |= place[1:] != place[:-1]
    runs = np.flatnonzero(new_h)
    many = np.repeat(np.add.reduceat(fresh.astype(np.int64), runs) > 1, np.diff(np.append(runs, len(h))))
    key, pos = key[fresh & many], pos[fresh & many]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return pa.table({"key": pa.array(key[first]), "places": packed(pos, np.append(first, len(key)))})


def _contexts(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows: the LENGTH bytes from at, the LENGTH - GRAM before it in reverse, and how many of each are of the text [lo, hi)."""
    left = LENGTH - GRAM
    out = np.full((len(at), LENGTH + left + 2), BEYOND, np.uint8)
    top = len(data) - 1
    ahead = at[:, None] + np.arange(LENGTH)
    out[:, :LENGTH] = np.where(ahead < hi[:, None], data[np.minimum(ahead, top)], BEYOND)
    back = at[:, None] - 1 - np.arange(left)
    out[:, LENGTH:-2] = np.where(back >= lo[:, None], data[np.maximum(back, 0)], BEYOND)
    out[:, -2] = np.minimum(at - lo, left)
    out[:, -1] = np.minimum(hi - at, LENGTH)
    return out


def _common(rows: np.ndarray) -> np.ndarray:
    """The prefix each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        apart = rows[1:] != rows[:-1]
        out[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    return out


def _runs(n_buckets: int):
    """(id, places, text) -> front-coded sorted runs, one row for each bucket of a run."""

    names = ["bucket", "lcps", "tails", "ids", "pos"]

    def run(batches):
        held, size = [], 0

        def flush():
            rows, ids, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            prefix = prefix_hash(np.ascontiguousarray(rows[:, :GRAM]).reshape(-1))
            starts = np.arange(len(rows)) * GRAM
            bucket = (span_hash(prefix, starts, starts + GRAM) % U(n_buckets)).astype(np.int64)
            width = rows.shape[1]
            order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").reshape(-1), kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            rows, ids, pos, bucket = rows[order], ids[order], pos[order], bucket[order]
            common = _common(rows)
            edge = np.append(True, bucket[1:] != bucket[:-1])
            common[edge] = 0
            fresh = common < width
            at = np.flatnonzero(fresh)
            # of equal contexts the earliest place goes on
            entry = np.cumsum(fresh) - 1
            by_place = np.lexsort((pos, ids, entry))
            lead = by_place[np.searchsorted(entry[by_place], np.arange(len(at)))]
            later = (ids != ids[lead][entry]) | (pos != pos[lead][entry])
            common, kept = common[at], rows[at]
            tails = kept[np.arange(width) >= common[:, None]]
            tail_at = np.append(0, np.cumsum(width - common))
            key_at = np.append(np.flatnonzero(edge[at]), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at][key_at[:-1]].astype(np.int32)), packed(common.astype(np.uint8), key_at), packed(tails, tail_at[key_at]), packed(ids[lead], key_at), packed(pos[lead], key_at)], names)
            if later.any():
                # the others' spans: no context, and starts and ends for places
                ids, pos, ends = ids[later], pos[later].astype(np.int64), rows[later][:, -2:].astype(np.int64)
                spans = np.stack([pos - ends[:, 0], pos + ends[:, 1]], axis=1).astype(np.uint32)
                order, first = regroup(np.arange(len(ids)), (mix(ids.view(np.uint64)) % U(n_buckets)).astype(np.int64), n_buckets)
                some = np.flatnonzero(np.diff(first))
                pick = lambda x, k: packed(x[order].reshape(-1), k * first).take(pa.array(some))
                none = pa.array([b""] * len(some), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), none, none, pick(ids, 1), pick(spans, 2)], names)

        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                ids = np.asarray(batch.column(0).slice(lo, hi - lo))
                lists = batch.column(1).slice(lo, hi - lo).to_pylist()
                at = [np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in lists]
                text = np.repeat(np.arange(hi - lo), [len(x) for x in at])
                at = np.concatenate(at) + offsets[text]
                fits = at + GRAM <= offsets[text + 1]
                at, text = at[fits], text[fits]
                for i in range(0, len(at), HELD_CONTEXTS):
                    p, t = at[i : i + HELD_CONTEXTS], text[i : i + HELD_CONTEXTS]
                    held.append((_contexts(data, offsets[t], offsets[t + 1], p), ids[t], (p - offsets[t]).astype(np.uint32)))
                    size += len(p)
                    if size >= HELD_CONTEXTS:
                        yield from flush()
                        held, size = [], 0
        if size:
            yield from flush()

    return run


def _first_of(classes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each entry is the least of its class by rank."""
    order = np.lexsort((rank, classes))
    new = np.append(True, classes[order][1:] != classes[order][:-1])
    first = np.empty(len(classes), bool)
    first[order] = rank[order] == rank[order][new][np.cumsum(new) - 1]
    return first


def _settle(table: pa.Table) -> pa.Table:
    """Merge a bucket's runs; (id, spans) of bytes that repeat earlier ones, as pairs of 32-bit places."""
    left, width = LENGTH - GRAM, 2 * LENGTH - GRAM + 2
    runs, ids, pos, out = [], [], [], []
    for row in table.to_pylist():
        own, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["pos"], np.uint32).astype(np.int64)
        if not row["lcps"]:  # spans that are settled
            out.append((own, at[::2], at[1::2]))
            continue
        lcps = list(row["lcps"])
        runs.append((front_decode(lcps, row["tails"], width), lcps))
        ids.append(own)
        pos.append(at)
    if not runs:
        return _by_id(out)
    of, where, common = (np.array(x, np.int64) for x in merge(runs))
    fresh = common < width
    entry = np.cumsum(fresh) - 1  # of each merged string
    string = np.append(0, np.cumsum([len(x) for x in ids]))[of] + where
    ids, pos = np.concatenate(ids)[string], np.concatenate(pos)[string]
    order = np.lexsort((pos, ids))
    rank = np.empty(len(ids), np.int64)  # a place that was read twice has one rank
    rank[order] = np.cumsum(np.append(True, (ids[order][1:] != ids[order][:-1]) | (pos[order][1:] != pos[order][:-1])))
    first = _first_of(entry, rank)
    keys = np.frombuffer(b"".join(runs[r][0][i] for r, i in zip(of[fresh].tolist(), where[fresh].tolist(), strict=True)), np.uint8).reshape(-1, width)
    have_left, have_right = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    out.append((ids[~first], pos[~first] - have_left[entry[~first]], pos[~first] + have_right[entry[~first]]))

    # contexts that differ but share an anchor
    lead = np.flatnonzero(first)
    lead = lead[np.unique(entry[lead], return_index=True)[1]]  # an earliest place of each class
    right = common[fresh]
    new = right < GRAM
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    if several.any():
        right, new, group, lead = right[several], new[several], group[several], lead[several]
        new[0] = True
        keys, have_left, have_right = keys[several], have_left[several], have_right[several]
        by_left = np.argsort(np.ascontiguousarray(keys[:, LENGTH:-2]).view(f"S{left}").reshape(-1), kind="stable")
        by_left = by_left[np.argsort(group[by_left], kind="stable")]
        back = _common(keys[by_left, LENGTH:-2])
        new_left = np.append(True, group[by_left][1:] != group[by_left][:-1])
        hit = np.zeros((len(keys), left + 1), bool)
        for j in range(left + 1):
            ok = np.flatnonzero((have_left >= left - j) & (have_right >= GRAM + j))
            if len(ok) < 2:
                continue
            a = np.cumsum(new | (right < GRAM + j))
            b = np.empty(len(keys), np.int64)
            b[by_left] = np.cumsum(new_left | (back < left - j))
            hit[ok, j] = ~_first_of((a * (len(keys) + 1) + b)[ok], rank[lead[ok]])
        edges = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, j1 = np.nonzero(edges == 1)
        _, j2 = np.nonzero(edges == -1)
        p = pos[lead[row]]
        out.append((ids[lead[row]], p - left + j1, p - left + j2 - 1 + LENGTH))
    return _by_id(out)


def _by_id(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """(id, spans) of ids with starts and ends."""
    ids, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((starts, ids))
    ids = ids[order]
    spans = np.stack([starts[order], ends[order]], axis=1).astype(np.uint32).reshape(-1)
    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return pa.table({"id": pa.array(ids[at]), "spans": packed(spans, 2 * np.append(at, len(ids)))})


def _cut(as_text: bool):
    """(doc_id, text, spans, ...) -> doc_id, n_bytes, the maximal removed runs, what stays (bytes, or whole code points as text), ..."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                n_bytes, removed, kept = [], [], []
                for i, x in enumerate(lists.slice(lo, hi - lo).to_pylist()):
                    text = data[offsets[i] : offsets[i + 1]]
                    n_bytes.append(len(text))
                    if not x:
                        removed.append([])
                        kept.append(text.tobytes())
                        continue
                    s = np.minimum(np.frombuffer(b"".join(x), np.uint32).reshape(-1, 2).astype(np.int64), len(text))
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, s[:, 0], 1)
                    np.add.at(depth, s[:, 1], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    removed.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                    kept.append(text[~gone].tobytes())
                    if as_text:
                        kept[-1] = kept[-1].decode("utf-8", "ignore").encode()
                made = [ids.slice(lo, hi - lo), pa.array(n_bytes, pa.int64()), pa.array(removed, run_type), pa.array(kept, pa.string() if as_text else pa.binary())]
                rest = [c.slice(lo, hi - lo) for c in batch.columns[3:]]
                yield pa.RecordBatch.from_arrays([*made, *rest], ["doc_id", "n_bytes", "removed", "kept", *batch.schema.names[3:]])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end), kept (binary): one row for each row of docs.

    Columns named in carry follow under c0, c1, ... With as_text, kept is the
    text of the code points that stay whole.

    Removed is each byte covered by a LENGTH-byte string that also starts
    earlier: in a text of smaller id, or earlier in the same text. Matches do
    not cross texts, and are judged on the input. Null counts as empty; texts
    of fewer bytes lose nothing. Rows that repeat an id and a text are one
    text. Rows that repeat an id with other texts are texts of their own, in the
    order of a hash of both. A row whose id is null takes no part and loses
    nothing. Other columns of docs are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    n = buckets(docs)
    rest = [f"c{i}" for i in range(len(carry))]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(a) for c, a in zip(carry, rest, strict=True)))
    docs = docs.select("*", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest"), F.col("id").alias("own_id"))
    ids = keep(docs.filter(f"id is not null and octet_length(text) >= {LENGTH}").select("id", "digest", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("n")), "ids")
    several = keep(ids.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("id", F.lit(True).alias("several")), "several")
    if not several.isEmpty():
        told_apart = lambda d: d.join(several, "id", "left").withColumn("id", F.when(F.col("several"), F.xxhash64("id", "digest")).otherwise(F.col("id"))).drop("several")
        docs, ids = told_apart(docs), told_apart(ids)
    firsts = keep(ids.groupBy("digest").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.count("*").alias("c")), "firsts")

    found = docs.filter(f"id is not null and octet_length(text) >= {LENGTH}").select(F.xxhash64("text").alias("key"), "text")
    found = found.mapInArrow(lean(_anchor_rows(n)), "bucket int, h binary, key binary, pos binary")
    twice = found.groupBy("bucket").applyInArrow(_repeated, "key long, places binary")
    twice = twice.groupBy("key").agg(F.collect_list("places").alias("places"))
    sought = twice.join(firsts.select("key", "first", "digest"), "key").select(F.col("first").alias("id"), "digest", "places")
    texts = docs.join(sought, ["id", "digest"]).select("id", "places", "text")
    runs = texts.mapInArrow(lean(_runs(n)), "bucket int, lcps binary, tails binary, ids binary, pos binary")
    spans = runs.groupBy("bucket").applyInArrow(_settle, "id long, spans binary")

    copies = join_groups(ids.select("id", "n", "digest"), firsts.filter("c > 1").select("digest", "first", "c"), ["digest"]).filter("id <> first")
    little = F.expr("transform(array(7, 5, 3, 1), i -> substring(lpad(hex(n), 8, '0'), i, 2))")
    whole = copies.groupBy("id").agg(F.max("n").alias("n")).select("id", F.unhex(F.concat(F.lit("00000000"), F.array_join(little, ""))).alias("spans"))
    spans = keep(spans.union(whole).groupBy("id").agg(F.collect_list("spans").alias("spans")), "spans")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    made = [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    return docs.join(spans, "id", "left").select("own_id", "text", "spans", *rest).mapInArrow(lean(_cut(as_text)), T.StructType([*made, *docs.select(*rest).schema.fields]))


def with_repeats_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs, its columns as they were, with what remove_repeats() leaves of each text.

    A code point that loses some of its bytes goes whole. chars_col, if there
    is one, counts the code points anew. Rows stay even if all of their text
    goes; a null text becomes empty.
    """
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    cut = remove_repeats(docs, id_col, text_col, rest, as_text=True)
    types = dict(docs.dtypes)
    own = {id_col: F.col("doc_id").cast(types[id_col]), text_col: F.col("kept")} | {c: F.col(f"c{i}") for i, c in enumerate(rest)}
    if chars_col in rest:
        own[chars_col] = F.length("kept").cast(types[chars_col])
    return cut.select(*(own[c].alias(c) for c in docs.columns))
