"""Near-duplicate detection by a chosen-path set similarity join.

Each text becomes the set of its five-word shingles and a vector of minwise
tokens. Random trees branch the documents by selected tokens: a node holds the
documents that agree on every token selected on its path. Nodes small enough are
compared exhaustively; larger ones branch on more tokens. A pair at the
threshold meets in at least one of the independent trees but for one chance in
ten million. Every pair that is found is confirmed on full shingle sets.

A family of near copies never falls apart into small nodes. So the roots' links
(within nodes of up to LEAF members, and of every member of a larger node to its
least member) are confirmed and joined into components first; after that, only
pairs of different components are looked for, and only in nodes that hold
several:

* a node of up to MEMBERS is compared whole, in one block;
* a larger one, all but MEMBERS of whose members are of one component, is
  compared in blocks, each of which meets only the others' block;
* any other branches, and its children are treated alike; what has not come
  apart after DEPTH levels is compared in blocks, every one with every other.

A block compares the members' minwise tokens. Where few pairs come close, these
are confirmed one by one; where many do, the block is compared again on full
shingle sets and gives a spanning forest of its links. So no pair in a node is
left out, and no task emits more than a fixed number of pairs for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.bytesops import LOWER, U, blocks, lean, mix, packed, prefix_hash, randoms, shingles, span_hash, words
from docquarry.llm.graph import components
from docquarry.llm.skew import join_groups
from docquarry.llm.store import drop, keep

WIDTH = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
POSITIONS = 64
TREES = 16
#: Root nodes of up to LEAF members are compared before others.
LEAF = 16
#: A document in a node that branches goes to BRANCH children, down to DEPTH.
BRANCH = 2
DEPTH = 12
#: Members of a block; pairs that it gives for each; shingles that are counted at once.
MEMBERS, SPARSE, SLAB = 2048, 4, 4096
#: Of POSITIONS minwise tokens, a pair at the threshold shares 48 +- 3.5; fewer than this at 3e-6.
LEAST_SHARED = 32

_XOR, _MUL = randoms(POSITIONS, 5), randoms(POSITIONS, 7) | U(1)
_TREE = randoms(TREES, 17)
_SLOT = randoms(BRANCH, 19)


def shingle_sets(col: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, first) with each text's distinct shingles, sorted."""
    for lo, hi, data, offsets in blocks(col):
        data = LOWER[data]
        starts, ends, first = words(data, offsets)
        yield lo, hi, *shingles(span_hash(prefix_hash(data), starts, ends), first, width)


def _by_text(values: np.ndarray, first: np.ndarray, how: np.ufunc, empty: int) -> np.ndarray:
    """how.reduce over each text's values; empty where it has none."""
    n = np.diff(first)
    out = np.full(len(n), empty, values.dtype)
    if len(values):
        out[n > 0] = how.reduceat(values, first[:-1][n > 0])
    return out


def set_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that tell shingle sets apart, 128 bits together."""
    return tuple(_by_text(mix(hashes ^ U(s)), first, np.add, 0).view(np.int64) for s in (0x1234567, 0x89ABCDEF01))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, first in shingle_sets(batch.column(1), width):
                a, b = set_keys(x, first)
                sig = np.empty((hi - lo, POSITIONS), np.uint32)
                for i in range(POSITIONS):
                    sig[:, i] = _by_text((x ^ _XOR[i]) * _MUL[i], first, np.minimum, 0) >> U(32)
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(a), pa.array(b), pa.array(np.diff(first)), packed(sig.reshape(-1), np.arange(hi - lo + 1) * POSITIONS)],
                    ["id", "set_a", "set_b", "n", "sig"],
                )

    return run


def _signatures(col: pa.Array) -> np.ndarray:
    out = [np.frombuffer(x.as_buffer(), np.uint32) for x in col]
    return np.stack(out) if out else np.zeros((0, POSITIONS), np.uint32)


def _roots(batches):
    """(id, n, sig) -> (node, id, n): the root of each tree selects one position."""
    for batch in batches:
        sig = _signatures(batch.column("sig"))
        for t in range(TREES):
            node = mix(sig[:, t * POSITIONS // TREES].astype(np.uint64) ^ _TREE[t])
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("id"), batch.column("n")], ["node", "id", "n"])


def _children(batches):
    """(node, id, n, comp, sig) -> its children: the path so far selects the positions."""
    for batch in batches:
        sig = _signatures(batch.column("sig"))
        node = np.asarray(batch.column("node")).view(np.uint64)
        for s in range(BRANCH):
            at = (mix(node ^ _SLOT[s]) >> U(32)) % U(POSITIONS)
            token = sig[np.arange(len(sig)), at.astype(np.int64)].astype(np.uint64)
            child = mix(mix(node + _SLOT[s]) ^ token)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(c) for c in ("id", "n", "comp"))], ["node", "id", "n", "comp"])


def _alike(batches):
    for batch in batches:
        same = (_signatures(batch.column("sa")) == _signatures(batch.column("sb"))).sum(axis=1) >= LEAST_SHARED
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(same))


def _sets(width: int):
    """(id, set_a, set_b, text) -> (id, members): rows whose text is not the one that was sketched go."""

    def run(batches):
        for batch in batches:
            for lo, hi, x, first in shingle_sets(batch.column(3), width):
                a, b = set_keys(x, first)
                mine = (a == np.asarray(batch.column(1).slice(lo, hi - lo))) & (b == np.asarray(batch.column(2).slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed(x, first)], ["id", "members"]).filter(pa.array(mine))

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _members(ids: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, members): the full shingle sets of ids."""
    wanted = texts.join(reps.select("id", "set_a", "set_b", "doc").join(ids, "id"), "doc").select("id", "set_a", "set_b", "text")
    return keep(wanted.mapInArrow(lean(_sets(width)), "id long, members binary"), "sets")


def _common(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> np.ndarray:
    """How many members each set of left shares with each of right; `same`: they are the same sets, and what they hold alone is left out."""
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    if same:
        values, times = np.unique(x, return_counts=True)
        shared = values[times > 1]
    else:
        shared = np.intersect1d(x, y)
    if not len(shared):
        return out
    at = []
    for sets, flat in ((left, x), (right, y)):
        of, where = np.repeat(np.arange(len(sets)), [len(m) for m in sets]), np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        ok = shared[where] == flat
        of, where = of[ok], where[ok]
        order = np.argsort(where, kind="stable")
        at.append((len(sets), of[order], where[order]))
    for lo in range(0, len(shared), SLAB):
        slabs = []
        for n, of, where in at:
            a, b = np.searchsorted(where, (lo, lo + SLAB))
            slab = np.zeros((n, min(SLAB, len(shared) - lo)), np.float32)
            slab[of[a:b], where[a:b] - lo] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[1].T
    return out


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of near (a symmetric matrix) that connect what all its edges connect."""
    left = np.ones(len(near), bool)
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            todo += new.tolist()
            yield from ((at, x) for x in new.tolist())


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block's two sides; the same, if it is met with itself."""
    side = table["side"].to_numpy()
    return np.flatnonzero(side == table["i"][0].as_py()), np.flatnonzero(side == table["j"][0].as_py())


def _screen(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's pairs that may be links, by minwise tokens: themselves (dense 0), or all that are in one (dense 1)."""
        l, r = _sides(table)  # noqa: E741
        ids, comp, n = (table[c].to_numpy() for c in ("id", "comp", "n"))
        sig = _signatures(table["sig"].combine_chunks())
        found = np.zeros((0, 2), np.int64)
        if len(l) and len(r) and comp.min() < comp.max():
            same = np.zeros((len(l), len(r)), np.uint8)
            for p in range(POSITIONS):
                same += sig[l, p][:, None] == sig[r, p]
            may = (same >= LEAST_SHARED) & (comp[l][:, None] != comp[r])
            may &= 100 * np.minimum(n[l][:, None], n[r]) >= percent * np.maximum(n[l][:, None], n[r])
            if l is r or np.array_equal(l, r):
                may = np.triu(may, 1)
            x, y = np.nonzero(may)
            found = np.stack([l[x], r[y]], axis=1)
        dense = len(found) > SPARSE * len(ids)
        a, b = (np.unique(found), np.zeros(0, np.int64)) if dense else found.T
        none = np.full(len(a), -1)
        column = lambda c, some: pa.array(table[c].to_numpy()[a] if some else none)
        other = pa.array(none if dense else ids[b])
        return pa.table({"dense": pa.array(np.full(len(a), int(dense), np.int32)), "a": pa.array(ids[a]), "b": other} | {c: column(c, dense) for c in ("node", "i", "j", "side", "comp")})

    return run


def _finish(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's links between different components: as many as connect what they all connect."""
        l, r = _sides(table)  # noqa: E741
        ids, comp = table["id"].to_numpy(), table["comp"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["members"]]
        links = []
        if len(l) and len(r):
            n = np.array([len(m) for m in sets])
            common = _common([sets[x] for x in l], [sets[x] for x in r], np.array_equal(l, r)).astype(np.int64)
            ok = (100 * common >= percent * (n[l][:, None] + n[r] - common)) & (comp[l][:, None] != comp[r])
            near = np.zeros((len(ids), len(ids)), bool)
            near[np.ix_(l, r)] = ok
            links = [(ids[a], ids[b]) for a, b in _forest(near | near.T)]
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on their full shingle sets."""
    sets = _members(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), reps, texts, width)
    # one document may be in very many pairs, on the side of a
    of = sets.select(F.col("id").alias("b"), F.col("members").alias("ys"))
    degree = pairs.groupBy("a").agg(F.count("*").alias("c"))
    first = keep(sets.select(F.col("id").alias("a"), F.col("members").alias("xs")).join(degree, "a"), "firsts")
    both = join_groups(pairs.withColumnRenamed("b", "id"), first, ["a"]).select("a", F.col("id").alias("b"), "xs").join(of, "b")
    links = keep(both.select("a", "b", "xs", "ys").mapInArrow(lean(_confirm(percent)), "a long, b long"), "links")
    drop(sets, first)
    return links


def _root_links(rows: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links within small root nodes and of larger ones' members to the least, and the rows (node, id, n) of larger ones."""
    nodes = keep(rows.groupBy("node").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("rep")).filter("c > 1"), "counts")
    met = keep(join_groups(rows, nodes, ["node"]), "met")
    large = met.filter(F.col("c") > LEAF)
    star = large.select(F.col("rep.id").alias("a"), F.col("rep.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))
    small = met.filter(F.col("c") <= LEAF).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    every = F.expr("inline(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.id as a, x.n as na, y.id as b, y.n as nb)))))")
    able = small.select(every).union(star).filter(F.expr(f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)"))
    able = able.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sig = reps.select("id", "sig")
    close = able.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    of = keep(able.groupBy("a").agg(F.count("*").alias("c")).join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a"), "firsts")
    close = join_groups(close.withColumnRenamed("b", "id"), of, ["a"]).select("a", F.col("id").alias("b"), "sa", "sb")
    close = keep(close.mapInArrow(lean(_alike), "a long, b long"), "close")
    links = _confirmed(close, reps, texts, width, percent)
    drop(nodes, of, close)
    return links, large.select("node", "id", "n")


def _blocks(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(placed, rest) of rows (node, id, n, comp, c): what is compared in blocks (node, i, j, side, id, n, comp), and what branches."""
    one = rows.filter(F.col("c") <= MEMBERS).select("node", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("side"), "id", "n", "comp")
    big = rows.filter(F.col("c") > MEMBERS)
    if big.isEmpty():
        return one, None
    counts = big.groupBy("node", "comp").agg(F.count("*").alias("k")).groupBy("node").agg(F.sum("k").alias("c"), F.max(F.struct("k", "comp")).alias("most"))
    counts = keep(counts.select("node", "c", F.col("most.comp").alias("most"), (F.col("c") - F.col("most.k")).alias("others")), "counts")
    able = counts if last else counts.filter(F.col("others") <= MEMBERS)
    own = join_groups(big.drop("c"), able, ["node"]).withColumn("major", F.col("comp") == F.col("most"))
    # sides 0 .. minor - 1 are of the others, those after them of the largest component, which is not met with itself
    own = own.withColumn("minor", F.greatest(F.lit(1), F.ceil(F.col("others") / MEMBERS)).cast("long")).withColumn("rest", F.ceil((F.col("c") - F.col("others")) / MEMBERS).cast("long"))
    own = own.withColumn("side", F.when(F.col("major"), F.col("minor") + F.pmod(F.xxhash64("id"), F.col("rest"))).otherwise(F.pmod(F.xxhash64("id"), F.col("minor"))))
    own = own.withColumn("other", F.explode(F.expr("if(major, sequence(0L, minor - 1), sequence(0L, minor + rest - 1))")))
    placed = one.union(own.select("node", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "n", "comp"))
    return placed, None if last else join_groups(big.drop("c"), counts.filter(F.col("others") > MEMBERS), ["node"]).select("node", "id", "n", "comp")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (node, id, n, comp), with c, of nodes that hold several components."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return keep(join_groups(rows, keep(nodes.select("node", "c"), "counts"), ["node"]), "mixed")


def _deep_links(large: DataFrame, stars: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links between different components in the larger root nodes (node, id, n), and in what they branch into."""
    rows = large.join(stars.select("id", F.col("component").alias("of")), "id", "left").select("node", "id", "n", F.coalesce("of", "id").alias("comp"))
    placed = None
    for level in range(1, DEPTH + 1):
        rows = _mixed(rows)
        now, rest = _blocks(rows, level == DEPTH)
        placed = now if placed is None else placed.union(now)
        if rest is None or rest.isEmpty():
            break
        children = rest.join(reps.select("id", "sig"), "id").select("node", "id", "n", "comp", "sig")
        rows = keep(children.mapInArrow(lean(_children), "node long, id long, n long, comp long"), "nodes")
    screened = placed.join(reps.select("id", "sig"), "id").groupBy("node", "i", "j").applyInArrow(_screen(percent), "dense int, a long, b long, node long, i long, j long, side long, comp long")
    screened = keep(screened, "screened")
    pairs = keep(screened.filter("dense = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "close")
    found = []
    if not pairs.isEmpty():
        found.append(_confirmed(pairs, reps, texts, width, percent))
    dense = screened.filter("dense = 1").select("node", "i", "j", "side", F.col("a").alias("id"), "comp")
    if not dense.isEmpty():
        sets = _members(dense.select("id").distinct(), reps, texts, width)
        found.append(keep(dense.join(sets, "id").groupBy("node", "i", "j").applyInArrow(_finish(percent), "a long, b long").distinct(), "links"))
        drop(sets)
    return reduce(DataFrame.union, found) if found else None


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, bool]:
    """id, set_a, set_b, n, component: one row for each row of docs (id, text); and whether vertices are ids.

    component is the same for rows that are linked: the least of their vertices.
    A row's vertex is its id or, where an id stands for several shingle sets, a
    hash of both. Rows without shingles or id have none.
    """
    sketch = keep(docs.mapInArrow(lean(_sketch(width)), "id long, set_a long, set_b long, n long, sig binary"), "sketch")
    some = sketch.filter("n > 0 and id is not null")
    sets = F.struct("set_a", "set_b")
    several = keep(some.groupBy("id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).filter("lo <> hi").select("id", F.lit(True).alias("several")), "several")
    vertex, plain = F.col("id"), several.isEmpty()
    if not plain:
        some = some.join(several, "id", "left")
        vertex = F.when(F.col("several"), F.xxhash64("id", "set_a", "set_b")).otherwise(F.col("id"))
    reps = some.groupBy("set_a", "set_b").agg(F.min(F.struct(vertex.alias("id"), F.col("id").alias("doc"), "n", "sig")).alias("r"), F.count("*").alias("c"))
    reps = keep(reps.select("r.*", "set_a", "set_b", "c"), "reps")

    rows = keep(reps.select("id", "n", "sig").mapInArrow(lean(_roots), "node long, id long, n long"), "nodes")
    texts = docs.withColumnRenamed("id", "doc")
    links, large = _root_links(rows, reps, texts, width, percent)
    drop(rows)
    stars = keep(components(links), "stars")
    more = _deep_links(large, stars, reps, texts, width, percent)
    if more is not None and not more.isEmpty():
        stars = keep(components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "stars")
    classes = keep(reps.join(stars, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component"), "c"), "classes")
    known = join_groups(some.select("id", "set_a", "set_b", "n"), classes, ["set_a", "set_b"]).select("id", "set_a", "set_b", "n", "component")
    return known.union(sketch.filter("n = 0 or id is null").select("id", "set_a", "set_b", "n", F.lit(None).cast("long"))), plain


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Words are runs of other than 0x20 and 0x09-0x0D, A-Z lower-cased. A text of
    fewer than width words has its whole sequence as one shingle; null, empty
    and blank texts have none and link with nothing. component_id is the least
    id reachable over links of Jaccard similarity percent/100 or more; kept
    says that it is the row's own. Rows that repeat an id and a text get the
    same result, each; rows that repeat an id with other texts are documents of
    their own. A row whose id is null takes no part: component_id is null and
    kept is true. Other columns of docs are ignored; an empty table gives an
    empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found, plain = _classes(docs, width, percent)
    least = F.coalesce("component", "id")
    if not plain:
        found = keep(found, "found")
        known = found.filter("component is not null")
        groups = keep(known.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("c")), "components")
        found = join_groups(known, groups, ["component"]).select("id", "n", "least").union(found.filter("component is null").select("id", "n", "id"))
        least = F.col("least")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(True)).alias("kept"))


def _set_keys(batches):
    """(id, text, ...) -> the same, with the text's set keys."""
    for batch in batches:
        keys = [set_keys(x, first) for _, _, x, first in shingle_sets(batch.column(1))]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(k[i] for k in keys)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b)], [*batch.schema.names, "set_a", "set_b"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near duplicates, with the same columns.

    It is the row of least id; of rows that share that id, the one of least
    hash of its shingles, then of all its columns, so the order of rows does not
    matter. Rows that repeat an id with unlike texts are documents of their
    own. Rows without words stay, one for each id, and so do rows whose id is
    null, all of them. Columns may have any names.
    """
    # columns pass under names of our own
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(a) for c, a in own.items()))
    found, _ = _classes(rows.select("id", "text"), WIDTH, PERCENT)
    found = keep(found.filter("id is not null"), "found")
    group = found.groupBy("component").agg(F.min(F.struct("id", "set_a", "set_b")).alias("first"))
    stay = group.filter("component is not null").select("first.*").union(found.filter("component is null").select("id", "set_a", "set_b"))
    stay = keep(stay.distinct(), "stay")
    # ids of one row need no more than the id; those of several are told apart by their sets, and then by all columns
    often = keep(found.groupBy("id").count().filter("count > 1").select("id"), "often")
    kept = rows.filter("id is not null")
    if often.isEmpty():
        kept = kept.join(stay, "id", "left_semi").select(*own.values())
    else:
        several = kept.join(often, "id", "left_semi")
        kept = kept.join(stay.join(often, "id", "left_anti"), "id", "left_semi").select(*own.values())
        schema = T.StructType([*several.schema.fields, T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType())])
        several = several.mapInArrow(lean(_set_keys), schema).join(stay, ["id", "set_a", "set_b"], "left_semi")
        order = F.xxhash64(*(F.col(a).cast("string") for a in own.values()))
        several = several.withColumn("rank", F.row_number().over(Window.partitionBy("id", "set_a", "set_b").orderBy(order)))
        kept = kept.union(several.filter("rank = 1").select(*own.values()))
    kept = kept.union(rows.filter("id is null").select(*own.values()))
    return kept.select(*(F.col(a).alias(c) for c, a in own.items()))
