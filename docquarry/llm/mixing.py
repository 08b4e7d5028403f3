"""Mixing sources to target weights.

Each source's documents are dealt into streams of about STREAM words; a stream's
words are laid end to end and packed into blocks of BLOCK words, by one pass over
its sorted texts. Blocks are numbered from stream to stream.
Sources get target shares; shares turn into numbers of block slots. Output
shards draw their source counts from multinomials over what is left of these
numbers, so that the last shard meets them exactly. A source's i-th slot takes
block P(i mod blocks) of pass i div blocks, P a pseudorandom permutation of its
block indices that differs from pass to pass; slots join the blocks by index.
No block is used more often than passes, and no target asks for more than
REPEATS passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.bytesops import U, blocks, lean, mix, prefix_hash, span_hash, words
from docquarry.llm.store import keep, tasks

BLOCK = 32
REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Words to a stream, about; streams are numbered, and their blocks counted, on the cluster.
STREAM = 1 << 18
SHARDS, SHARD_SLOTS = 1024, 4096
#: Slots that one task row of the plan stands for.
PLAN_ROW = 1 << 17
ROUNDS = 16


def targets(sizes: list[int], weights: list[float], share: float = 1.0, repeats: int = REPEATS) -> list[float]:
    """What each source is to give of share * sum(sizes): by weight, none above repeats times its size."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    left = share * size.sum()
    while open_.any():
        want = weight * left / weight[open_].sum()
        over = open_ & (want > repeats * size)
        if not over.any():
            out[open_] = want[open_]
            break
        out[over] = repeats * size[over]
        left -= out[over].sum()
        open_ &= ~over
    return out.tolist()


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), applied to x: a swap-or-not shuffle."""
    x = x.astype(np.int64)
    keys = mix(mix(np.arange(ROUNDS, dtype=np.uint64) + U(1)) + U(key & 0xFFFFFFFFFFFFFFFF))
    for k in keys:
        other = (int(k % U(n)) - x) % n
        coin = mix(np.maximum(x, other).astype(np.uint64) ^ k) >> U(63)
        x = np.where(coin == 1, other, x)
    return x


def draw(quotas: list[int], seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): multinomial counts by shard that add up to the quotas."""
    left = np.array(quotas, np.int64)
    total = int(left.sum())
    size = max(SHARD_SLOTS, -(-total // SHARDS))
    rng = np.random.Generator(np.random.PCG64(seed))
    given = np.zeros(len(left), np.int64)
    out = []
    for shard in range(-(-total // size)):
        need = min(size, int(left.sum()))
        counts = np.zeros(len(left), np.int64)
        while need:  # what a multinomial draws beyond a source's rest is drawn anew
            rest = left - counts
            got = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            counts += got
            need -= int(got.sum())
        out += [(shard, s, int(given[s]), int(c)) for s, c in enumerate(counts) if c]
        given += counts
        left -= counts
    return out


def _slots(seed: int):
    """(shard, source_no, first, n, blocks) -> (shard, source_no, slot, pass, block)"""

    def run(batches):
        for batch in batches:
            for shard, s, first, n, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = first
                while at < first + n:
                    turn = at // blocks
                    end = min(first + n, (turn + 1) * blocks)
                    slot = np.arange(at, end)
                    block = permuted(slot - turn * blocks, blocks, seed * 1_000_003 + s * 8191 + turn)
                    k = end - at
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard)), pa.array(np.full(k, s)), pa.array(slot), pa.array(np.full(k, turn)), pa.array(block)], ["shard", "source_no", "slot", "pass", "block"])
                    at = end

    return run


def _count_words(at: int):
    """Appends size, the words of the text in column `at`, in whose place comes a hash of it."""

    def run(batches):
        for batch in batches:
            size, tie = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in blocks(batch.column(at)):
                first = words(data, offsets)[2]
                size.append(np.diff(first))
                tie.append(span_hash(prefix_hash(data), offsets[:-1], offsets[1:]).view(np.int64))
            columns = list(batch.columns)
            columns[at] = pa.array(np.concatenate(tie))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(size))], [*batch.schema.names, "size"])

    return run


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, tie (a hash of the text), size (its words), and row, the column row_col: one row for each row of docs."""
    row = F.col(row_col) if row_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("tie"), row.alias("row"))
    source = rows.schema["source"].dataType.simpleString()
    return rows.mapInArrow(lean(_count_words(2)), f"doc_id long, source {source}, tie long, row long, size long")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of (source_no, stream, base, doc_id, text), in order -> their blocks and their rows.

    A stream begins with a row that has its first block's number, base, and no
    text. Blocks (block, tokens, and parts: row and words of it) come without
    doc_id; rows (row, doc_id, size) without block.
    """
    names = ["source_no", "block", "tokens", "parts", "row", "doc_id", "size"]
    part_type = pa.list_(pa.struct([("row", pa.int64()), ("n", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), part_type, pa.int64(), pa.int64(), pa.int64()]
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    row, source, block = task << 40, None, 0
    tokens: list[bytes] = []  # stretches of the block that is being filled
    parts: list[dict] = []
    held = 0
    out: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def close():
        nonlocal tokens, parts, held, block
        if held:
            out.append((source, block, b" ".join(tokens), parts, None, None, None))
            block += 1
        tokens, parts, held = [], [], 0

    for batch in batches:
        sources, bases, ids = (batch.column(i).to_pylist() for i in (0, 2, 3))
        for lo, hi, data, offsets in blocks(batch.column(4)):
            raw = data.tobytes()
            starts, ends, first = words(data, offsets)
            for i in range(lo, hi):
                if bases[i] is not None:
                    close()
                    source, block = sources[i], bases[i]
                    continue
                at, end = int(first[i - lo]), int(first[i - lo + 1])
                out.append((source, None, None, None, row, ids[i], end - at))
                while at < end:
                    n = min(BLOCK - held, end - at)
                    tokens.append(raw[starts[at] : ends[at + n - 1]])
                    parts.append({"row": row, "n": n})
                    at, held = at + n, held + n
                    if held == BLOCK:
                        close()
                row += 1
                if len(out) >= 4096:
                    yield flush()
                    out = []
    close()
    if out:
        yield flush()


class Mix:
    """A planned mix of `sized` (see sizes(); kept, since it is read several times).

    `listed`: each source with its number, size, target, blocks and streams;
    `slots`: what each output slot takes; `bases`: the first block of each
    stream; `rows`: sized, with the place of each row's first word in its source.
    """

    def __init__(self, sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, seed: int = 1):
        spark = sized.sparkSession
        # sources are few (they have weights); documents are many
        found = sorted(sized.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r.source is None, str(r.source or "").encode()))
        total = [int(r.n) for r in found]
        target = targets(total, [float(weights[i % len(weights)]) for i in range(len(found))], share)
        source = sized.schema["source"].dataType.simpleString()
        listed = spark.createDataFrame([(r.source, i, total[i], target[i], max(1, round(total[i] / STREAM))) for i, r in enumerate(found)], f"s {source}, source_no long, source_size long, target double, streams long")
        self.listed, self.spark = F.broadcast(listed), spark
        streamed = self.in_streams(sized)
        by_stream = streamed.groupBy("source_no", "stream").agg(F.ceil(F.sum("size") / BLOCK).cast("long").alias("n"))
        order = Window.partitionBy("source_no").orderBy("stream")
        self.bases = keep(by_stream.select("source_no", "stream", "n", (F.sum("n").over(order) - F.col("n")).alias("base")), "streams")
        blocks_of = {r.source_no: int(r.n) for r in self.bases.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
        have = [blocks_of.get(i, 0) for i in range(len(found))]
        quotas = [min(REPEATS * b, round(t * b / n)) if n else 0 for n, t, b in zip(total, target, have, strict=True)]
        within = F.sum("size").over(Window.partitionBy("source_no", "stream").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        self.rows = streamed.withColumn("within", within).join(self.bases.select("source_no", "stream", "base"), ["source_no", "stream"]).withColumn("offset", F.col("base") * BLOCK + F.col("within"))
        plan = spark.createDataFrame([(shard, s, first, n, have[s]) for shard, s, first, n in draw(quotas, seed)], "shard long, source_no long, first long, n long, blocks long")
        at = F.explode(F.expr(f"sequence(first, first + n - 1, {PLAN_ROW}L)"))
        plan = plan.withColumn("at", at).select("shard", "source_no", F.col("at").alias("first"), F.expr(f"least({PLAN_ROW}L, first + n - at)").alias("n"), "blocks")
        self.slots = plan.repartition(tasks(spark), "shard", "source_no", "first").mapInArrow(_slots(seed), "shard long, source_no long, slot long, pass long, block long")

    def in_streams(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, ...) with the source's facts and the row's stream."""
        return rows.join(self.listed, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("stream", F.pmod(F.xxhash64("doc_id"), F.col("streams")))

    def packed(self, docs: DataFrame) -> DataFrame:
        """The blocks and rows of docs (doc_id, source, tie, text), as _pack() gives them: texts are shuffled once, by stream."""
        texts = self.in_streams(docs).select("source_no", "stream", F.lit(None).cast("long").alias("base"), "doc_id", "text", "tie")
        begin = self.bases.select("source_no", "stream", "base", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("tie"))
        rows = begin.union(texts).repartition(tasks(self.spark), "source_no", "stream").sortWithinPartitions("source_no", "stream", F.col("base").isNull(), F.asc_nulls_first("doc_id"), "tie")
        return rows.select("source_no", "stream", "base", "doc_id", "text").mapInArrow(lean(_pack), "source_no long, block long, tokens string, parts array<struct<row: long, n: long>>, row long, doc_id long, size long")

    def drawn(self, made: DataFrame, *columns: str) -> DataFrame:
        """made (source_no, block, ...) with the slots that take its blocks, and `columns` of these.

        By sorting: a plan's row stands for up to PLAN_ROW slots and a row of `rows` for all its
        blocks, so that Spark takes either side for far smaller than it is, and would broadcast it.
        """
        return made.join(self.slots.select("source_no", "block", *columns).hint("merge"), ["source_no", "block"])

    @property
    def pieces(self) -> DataFrame:
        """Each row's words from lo to hi - 1 that lie in a block."""
        some = self.rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(offset div {BLOCK}, (offset + size - 1) div {BLOCK})")))
        lo, hi = F.expr(f"greatest(offset, block * {BLOCK}) - offset"), F.expr(f"least(offset + size, (block + 1) * {BLOCK}) - offset")
        return some.withColumn("lo", lo.cast("int")).withColumn("hi", hi.cast("int"))


def _with_tie(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, tie, text), ties as sizes() has them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            tie = [np.zeros(0, np.int64), *(span_hash(prefix_hash(data), offsets[:-1], offsets[1:]).view(np.int64) for _, _, data, offsets in blocks(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(tie)), batch.column(2)], ["doc_id", "source", "tie", "text"])

    source = rows.schema["source"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id long, source {source}, tie long, text string")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of docs.

    A text's size is its number of words; null, empty and blank texts have 0
    and give nothing. Sources in order of code points, null last, weigh 1, 2,
    3, 1, ... and share the sum of all sizes; see targets(). taken counts the
    words that the packed blocks of the mix's slots have of the row, repeats
    included, at most REPEATS times its size. Rows that repeat an id, and null
    ids, are rows of their own. The same rows give the same mix, however they
    are partitioned. Other columns are ignored; an empty table gives an empty
    result.
    """
    m = Mix(keep(sizes(docs, id_col, text_col, source_col), "sized"))
    packed_ = keep(m.packed(_with_tie(docs, id_col, text_col, source_col)).drop("tokens"), "packed")
    uses = m.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    used = packed_.filter("block is not null").select("source_no", "block", "parts").join(uses, ["source_no", "block"])
    got = used.select("uses", F.explode("parts").alias("p")).groupBy("p.row").agg(F.sum(F.col("p.n") * F.col("uses")).alias("got"))
    rows = packed_.filter("block is null").select("source_no", "row", "doc_id", "size").join(got, "row", "left").join(m.listed, "source_no")
    return rows.select("doc_id", F.col("s").alias("source"), "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def packed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """shard, slot, source, tokens: the mix of mix_sources() itself, one row for each slot of a source.

    tokens are the words of the block that the slot takes: BLOCK of them, fewer in a stream's last block.
    """
    m = Mix(keep(sizes(docs, id_col, text_col, source_col), "sized"))
    made = m.packed(_with_tie(docs, id_col, text_col, source_col)).filter("block is not null")
    met = m.drawn(made, "shard", "slot").join(m.listed, "source_no")
    return met.select("shard", "slot", F.col("s").alias("source"), F.split("tokens", "[\\x20\\x09-\\x0D]+").alias("tokens"))


def _tokens(text_col: str) -> str:
    return f"regexp_extract_all(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """What the mix takes of each row of docs, in docs' columns, then size, source_size, target and taken.

    A row comes once for each pass that takes of it. Its text is the words of
    the blocks that the pass takes, in their order and joined by spaces, or the
    text as it is where all are taken; taken counts them, so that they add up
    to mix_sources()' taken. chars_col, if there is one, counts the code points
    anew. Columns of docs may have any names; those called like the four that
    are added give way to them. Null ids and rows that repeat an id are rows of
    their own.
    """
    added = ("size", "source_size", "target", "taken")
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in own.items()), F.monotonically_increasing_id().alias("row"))
    rows = keep(rows, "numbered")  # numbers must stay the same
    m = Mix(keep(sizes(rows, own[id_col], own[text_col], own[source_col], "row"), "sized"))
    drawn = m.drawn(m.pieces.select("source_no", "block", "size", "source_size", "target", "lo", "hi", "row"), "pass")
    drawn = drawn.groupBy("row", "pass").agg(*(F.first(c).alias(c) for c in ("size", "source_size", "target")), F.sum(F.expr("hi - lo")).alias("taken"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    t = own[text_col]
    # the lambda has a text's words found once, not once for each span
    text = F.expr(f"if(taken = size, {t}, transform(array({_tokens(t)}), w -> array_join(flatten(transform(spans, x -> slice(w, x.lo + 1, x.hi - x.lo))), ' '))[0])")
    out = rows.join(drawn, "row").withColumn("mixed", text)
    column = {c: F.col(a) for c, a in own.items()} | {text_col: F.col("mixed")}
    if chars_col in own:
        column[chars_col] = F.length("mixed").cast(dict(docs.dtypes)[chars_col])
    return out.select(*(column[c].alias(c) for c in docs.columns if c not in added), *added)
