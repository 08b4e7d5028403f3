"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults and threats of several grades, targets, negators,
reporting verbs, other. Three transducers are composed into one table:

* negation: an insult or threat within SCOPE words after a negator is negated;
* reported speech: one after a reporting verb, in the same clause, is reported;
* target: one that follows or precedes a target in its clause is aimed.

The composition reads a clause word by word and, at its end, has matched each
insult and threat as one pattern: its kind, and bare, aimed, negated or
reported. A pattern has one weight, on all arcs that emit it. A document's score
is the logistic of the weighted sum of its matches.

What is an insult is learned, in whatever languages the labelled rows have: for
words and their prefixes (so that inflected forms count together) the log odds
of toxic against clean rows that hold them, less one standard error, give the
grade. Words of the seed lexicon are threats, or insults of grade SEED_GRADE,
unless labelled rows speak against it. Pattern weights are then learned by
logistic regression, from matches with the other half's lexicon, so that they
know how far a learned word is to be trusted.

Only clauses with an insult or a threat are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.bytesops import LOWER, U, blocks, lean, mix, packed, prefix_hash, span_hash
from docquarry.llm.decontaminate import spans_of_words
from docquarry.llm.folds import held_out, training_sample
from docquarry.llm.store import keep

#: The seed lexicon.
LEXICON = {
    "insult": """idiot idiots moron morons stupid scum trash worthless pathetic loser losers clown clowns disgusting
        dumb fool fools imbecile jerk vermin garbage filth filthy pig pigs rat rats coward cowards liar liars
        ugly freak freaks lowlife scumbag dimwit dunce halfwit degenerate parasite parasites subhuman
        dummkopf trottel abschaum idiota imbécil basura escoria crétin ordure""",
    "threat": """kill murder hurt destroy beat shoot stab strangle burn crush hang smash slaughter
        töten umbringen matar matarte tuer tuerai""",
    "target": """you your yours yourself he him his she her they them their this that these those
        everyone people man woman guy guys du dich dir dein deine ihr euch usted ustedes vosotros tú tu te
        toi vous votre ellos ils elles""",
    "negator": """not no never neither nor without hardly isn aren wasn weren don doesn didn won cannot nobody
        nicht kein keine nie niemals ohne nunca ni sin ne pas jamais sans""",
    "report": """said says say called calls wrote writes quoted quotes reported reports claimed claims allegedly according
        sagte sagt schrieb behauptet dijo dice escribió dit disait écrit""",
}
#: Least evidence of a learned insult's grades.
GRADES = (2.0, 3.0, 4.0)
SEED_GRADE = 3
THREAT = len(GRADES) + 1
OTHER, TARGET, NEGATOR, REPORT, END = 0, THREAT + 1, THREAT + 2, THREAT + 3, THREAT + 4
HITS = range(1, THREAT + 1)
SCOPE = 3
KINDS = (*(f"insult{g}" for g in range(1, THREAT)), "threat")
CONTEXTS = ("bare", "aimed", "negated", "reported")
PATTERNS = tuple(f"{k}_{c}" for k in KINDS for c in CONTEXTS)
#: Log odds of the patterns where there are no labelled rows to learn from: bias, then PATTERNS.
PRIOR = (-3.0, *(x * c for x in (0.5, 2.0, 5.0, 4.0) for c in (1.0, 1.2, 0.1, 0.1)))
RIDGE = 0.5
#: Prefixes of a word that count as words of their own, in bytes; rows that must hold a learned one.
STEM = range(3, 11)
LEAST_ROWS = 3

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\r()[]{}\"|")] = True


def _negation(state: int, symbol: int) -> tuple[int, bool]:
    """State: words left in a negator's scope."""
    if symbol == NEGATOR:
        return SCOPE, False
    return max(0, state - 1), state > 0 and symbol in HITS


def _reported(state: int, symbol: int) -> tuple[int, bool]:
    """State: has the clause a reporting verb so far."""
    return int(state or symbol == REPORT), bool(state) and symbol in HITS


def _aimed(state: int, symbol: int) -> tuple[int, tuple[tuple[int, str], ...]]:
    """State: 0 no target yet, -1 target met, else the strongest hit, which waits for one."""
    if symbol == TARGET:
        return -1, ((state, "aimed"),) if state > 0 else ()
    if symbol == END:
        return 0, ((state, "bare"),) if state > 0 else ()
    if symbol in HITS:
        if state == -1:
            return -1, ((symbol, "aimed"),)
        return max(state, symbol), ((min(state, symbol), "bare"),) if state else ()
    return state, ()


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The composed transducer: next state by state and symbol, and what each of these arcs emits, by pattern."""
    states, table, emit = {(0, 0, 0): 0}, [], []
    for neg, rep, aim in (queue := [(0, 0, 0)]):
        for symbol in range(END + 1):
            new_neg, negated = _negation(neg, symbol)
            new_rep, reported = _reported(rep, symbol)
            if reported or negated:
                new_aim, out = aim, ((symbol, "reported" if reported else "negated"),)
            else:
                new_aim, out = _aimed(aim, symbol)
            nxt = (0, 0, 0) if symbol == END else (new_neg, new_rep, new_aim)
            if nxt not in states:
                states[nxt] = len(states)
                queue.append(nxt)
            table.append(states[nxt])
            row = np.zeros(len(PATTERNS), np.int32)
            for kind, context in out:
                row[PATTERNS.index(f"{KINDS[kind - 1]}_{context}")] += 1
            emit.append(row)
    return np.array(table).reshape(-1, END + 1), np.stack(emit)


NEXT, EMIT = compose()
_EMITS = EMIT.any(axis=1)
#: The state after some words that are OTHER.
_PASS = [np.arange(len(NEXT))]
for _ in range(SCOPE):
    _PASS.append(NEXT[_PASS[-1], OTHER])
_PASS = np.stack(_PASS)


class Words:
    """The words of a block of texts: spans, hashes, and those of prefixes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        self.starts, self.ends, self.first = spans_of_words(data, offsets)
        self.prefix = prefix_hash(data)
        self.hash = span_hash(self.prefix, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def stems(self, some: np.ndarray):
        """(which of some, hashes) of whole words, then of their prefixes."""
        yield np.arange(len(some)), self.hash[some]
        length = self.ends[some] - self.starts[some]
        for n in STEM:
            longer = np.flatnonzero(length > n)
            at = self.starts[some[longer]]
            yield longer, ~span_hash(self.prefix, at, at + n)


def _hashes(words: list[str]) -> np.ndarray:
    data = "\n".join(words).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash


_SEEDS = {name: _hashes(LEXICON[name].split()) for name in LEXICON}


class Lexicon:
    """Symbols of words: those of whole words, and of prefixes; the strongest hit stands."""

    BITS = 20

    def __init__(self, stem: np.ndarray, symbol: np.ndarray):
        order = np.argsort(stem)
        self.stem, self.symbol = stem[order], symbol[order].astype(np.uint8)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self.stem >> U(64 - self.BITS)] = True
        self.rank = np.array([0, *range(4, 4 + len(HITS)), 1, 2, 3], np.uint8)  # by symbol: hits above others

    def find(self, words: Words) -> np.ndarray:
        """The symbol of each word."""
        _, some, of = np.unique(words.hash, return_index=True, return_inverse=True)
        best = np.zeros(len(some), np.uint8)
        for which, h in words.stems(some):
            able = np.flatnonzero(self.maybe[h >> U(64 - self.BITS)])
            which, h = which[able], h[able]
            at = np.minimum(np.searchsorted(self.stem, h), len(self.stem) - 1)
            s = np.where(self.stem[at] == h, self.symbol[at], OTHER)
            best[which] = np.where(self.rank[s] > self.rank[best[which]], s, best[which])
        return best[of]


def lexicon(stem: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rows: tuple[int, int]) -> Lexicon:
    """From how many toxic and clean rows hold each stem, of so many rows of either kind."""
    own: dict[int, int] = {}
    for name, symbol in (("report", REPORT), ("negator", NEGATOR), ("target", TARGET), ("threat", THREAT), ("insult", SEED_GRADE)):
        own |= dict.fromkeys(_SEEDS[name].tolist(), symbol)
    if min(rows) > 0 and len(stem):
        odds = np.log((toxic + 0.5) / (rows[0] + 1)) - np.log((clean + 0.5) / (rows[1] + 1))
        sure = odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        grade = np.where(toxic >= LEAST_ROWS, np.searchsorted(GRADES, sure, "right"), 0)
        for h, g, n in zip(stem.tolist(), grade.tolist(), (toxic + clean).tolist(), strict=True):
            seed = own.get(h, OTHER)
            if seed == THREAT or seed == SEED_GRADE:
                if n >= 10 and not g:
                    own[h] = OTHER
            elif g:
                own[h] = g
    return Lexicon(np.fromiter(own.keys(), np.uint64, len(own)), np.fromiter(own.values(), np.uint8, len(own)))


def matches(data: np.ndarray, offsets: np.ndarray, by: Lexicon) -> np.ndarray:
    """(texts, patterns): how often each text matches each pattern."""
    out = np.zeros((len(offsets) - 1, len(PATTERNS)), np.int32)
    words = Words(data, offsets)
    if not len(words.hash):
        return out
    symbol = by.find(words)
    clause = np.cumsum(BREAK[data], dtype=np.int64)[words.starts] + words.text  # two texts share none
    known = np.flatnonzero(symbol)
    hit = np.zeros(int(clause[-1]) + 1, bool)
    hit[clause[known[(symbol[known] >= 1) & (symbol[known] <= THREAT)]]] = True
    known = known[hit[clause[known]]]
    if not len(known):
        return out
    # all clauses with hits side by side, from known word to known word
    own = clause[known]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    length = np.diff(np.append(start, len(known)))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    between = np.minimum(np.diff(known, prepend=0) - 1, SCOPE)
    text, state = words.text[known[start]], np.zeros(len(start), np.int64)

    def emit(arc, of):
        some = np.flatnonzero(_EMITS[arc])
        np.add.at(out, of[some], EMIT[arc[some]])

    for j in range(int(length[0])):
        n = int(np.searchsorted(-length, -j, "left"))  # clauses with more than j known words
        at = start[:n] + j
        now = _PASS[between[at], state[:n]] if j else state[:n]
        s = symbol[known[at]]
        emit(now * (END + 1) + s, text[:n])
        state[:n] = NEXT[now, s]
    emit(state * (END + 1) + END, text)
    return out


def _stem_rows(batches):
    """(text) -> each stem and how many rows hold it."""
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            stem, _ = _stems_by_row(data, offsets)
            stem, rows = np.unique(stem, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(rows)], ["stem", "rows"])


def _stems_by_row(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct stems of each text, and the text of each."""
    words = Words(data, offsets)
    salt = mix(words.text.astype(np.uint64) + U(5))
    _, some = np.unique(words.hash ^ salt, return_index=True)
    found = list(words.stems(some))
    stem, text = np.concatenate([h for _, h in found]), np.concatenate([words.text[some[w]] for w, _ in found])
    _, at = np.unique(stem ^ mix(text.astype(np.uint64) + U(5)), return_index=True)
    return stem[at], text[at]


def _held(stems):
    """(half, y, text) -> how many rows of each half and kind hold each of stems: (half, kind) counts, packed; and the rows."""

    def run(batches):
        known = stems.value
        counts, rows = np.zeros((4, len(known)), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            group = np.asarray(batch.column(0)) * 2 + (np.asarray(batch.column(1)) > 0)
            rows += np.bincount(group, minlength=4)
            for lo, hi, data, offsets in blocks(batch.column(2)):
                stem, text = _stems_by_row(data, offsets)
                at = np.minimum(np.searchsorted(known, stem), max(len(known) - 1, 0))
                ok = known[at] == stem if len(known) else np.zeros(len(stem), bool)
                at, of = at[ok], group[lo:hi][text[ok]]
                for g in range(4):
                    counts[g] += np.bincount(at[of == g], minlength=len(known))
        for g in range(4):
            some = np.flatnonzero(counts[g])
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([int(rows[g])]), packed(some, np.array([0, len(some)])), packed(counts[g][some], np.array([0, len(some)]))], ["g", "rows", "at", "n"])

    return run


def lexicons(sample: DataFrame) -> tuple[list[Lexicon], Lexicon]:
    """Of each half of sample (half, y, text), and of all of it. Only stems of LEAST_ROWS toxic rows come to the driver: sample is bounded."""
    spark = sample.sparkSession
    stems = sample.filter("y > 0").select("text").mapInArrow(lean(_stem_rows), "stem long, rows long").groupBy("stem").agg(F.sum("rows").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    stem = np.sort(stems.select("stem").toArrow()["stem"].to_numpy().view(np.uint64))
    counts, rows = np.zeros((4, len(stem))), np.zeros(4, np.int64)
    for r in sample.select("half", "y", "text").mapInArrow(lean(_held(spark.sparkContext.broadcast(stem))), "g long, rows long, at binary, n binary").toLocalIterator():
        counts[r.g, np.frombuffer(r.at, np.int64)] += np.frombuffer(r.n, np.int64)
        rows[r.g] += r.rows
    made = [lexicon(stem, counts[2 * h + 1], counts[2 * h], (rows[2 * h + 1], rows[2 * h])) for h in (0, 1)]
    return made, lexicon(stem, counts[1] + counts[3], counts[0] + counts[2], (rows[1] + rows[3], rows[0] + rows[2]))


def _match(by, halves=None):
    """Appends f, the matches in column text, to whatever columns there are; with halves, by the lexicon of the row's other half."""

    def run(batches):
        for batch in batches:
            at, found = batch.schema.get_field_index("text"), []
            for lo, hi, data, offsets in blocks(batch.column(at)):
                if halves is None:
                    found.append(matches(data, offsets, by.value))
                else:
                    half = np.asarray(batch.column(batch.schema.get_field_index("half")).slice(lo, hi - lo))
                    found.append(np.where(half[:, None] == 0, matches(data, offsets, halves.value[1]), matches(data, offsets, halves.value[0])))
            flat = np.concatenate(found).reshape(-1).astype(np.int32) if found else np.zeros(0, np.int32)
            f = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(PATTERNS)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, f], [*batch.schema.names, "f"])

    return run


def _matched(rows: DataFrame, by, halves=None) -> DataFrame:
    """rows, which have a text, with f: the matches of each of PATTERNS."""
    return rows.mapInArrow(lean(_match(by, halves)), T.StructType([*rows.schema.fields, T.StructField("f", T.ArrayType(T.IntegerType()))]))


def _inputs(f: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(f), 1)), np.log1p(f)], axis=1)


def fit(f: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method, drawn towards PRIOR."""
    prior = np.array(PRIOR)
    w = prior.copy()
    if len(y) == 0 or y.min() == y.max():
        return w.tolist()
    x = _inputs(f)
    pull = np.full(len(w), RIDGE)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Lexicon, list[float]]:
    """Words and pattern weights from labelled rows (doc_id, text) outside the held-out fold, at most folds.TRAIN_ROWS labels."""
    sample = training_sample(docs.select("doc_id", "text"), labels, label, 5, 0)
    sample = keep(sample.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), "y", "text"), "labelled")
    halves, all_ = lexicons(sample)
    rows = _matched(sample, None, sample.sparkSession.sparkContext.broadcast(halves)).select("f", "y").collect()
    return all_, fit(np.array([r.f for r in rows], float).reshape(len(rows), len(PATTERNS)), np.array([r.y for r in rows]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with f, the matches of each of PATTERNS, and score."""
    by, weights = learn(docs, labels)
    odds = F.lit(weights[0]) + sum((F.lit(w) * F.log1p(F.col("f")[i].cast("double")) for i, w in enumerate(weights[1:])), F.lit(0.0))
    return _matched(docs, docs.sparkSession.sparkContext.broadcast(by)).withColumn("score", 1 / (1 + F.exp(-odds)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and one count for each pattern: one row for each row of docs.

    Null, empty and blank texts match nothing and get the score of no match.
    Labels that are null, or of null ids, are left out; without labels of both
    kinds PRIOR stands. Rows that repeat an id are scored each. Other columns
    are ignored; an empty table gives an empty result.
    """
    out = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col("f")[i].alias(p) for i, p in enumerate(PATTERNS)))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that score below threshold, with the same columns.

    As toxicity() scores them. Columns may have any names: they pass under
    names of our own.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = docs.select(*(F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns))
    return scored(rows, labels).filter(F.col("score") < threshold).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
