"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_duplicates(docs):
    """{doc_id: (n_shingles, component)} of (doc_id, text)."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def without_repeats(docs, length=100):
    """{doc_id: the bytes that stay} of (doc_id, text)."""
    return {d: kept for d, (*_, kept) in _repeats(docs, length).items()}


def remove_repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of what stays)} of (doc_id, text)."""
    return {d: (*counts, hashlib.sha256(kept).hexdigest()) for d, (*counts, kept) in _repeats(docs, length).items()}


def _repeats(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * (len(b) + 1)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        runs = sum(gone[i] and not gone[i - 1] for i in range(1, len(b))) + (bool(b) and gone[0])
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out[d] = (len(b), sum(gone), runs, kept)
    return out


def crc_fold(doc_id, n):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def _escape_class(total, kinds):
    return min(int(math.log2(max(total, 0) + 1) * 2), 60), min(int(math.log2(max(kinds, 0) + 1) * 4), 63)


def context_model(texts, order):
    """(seen, escape) of symbol lists: counts by context, and escape counts [new, all] by class."""
    seen = {}
    for s in texts:
        for i in range(order, len(s)):
            after = seen.setdefault(tuple(s[i - order : i]), {})
            after[s[i]] = after.get(s[i], 0) + 1
    for o in range(order - 1, -1, -1):
        for ctx in [c for c in seen if len(c) == o + 1]:
            for x in seen[ctx]:
                after = seen.setdefault(ctx[1:], {})
                after[x] = after.get(x, 0) + 1
    escape = {}

    def add(key, new, every):
        e = escape.setdefault(key, [0, 0])
        e[0] += new
        e[1] += every

    for ctx, after in seen.items():
        total = sum(after.values())
        for x, c in after.items():
            add((len(ctx), False, *_escape_class(total - 1, len(after) - (c == 1))), int(c == 1), c)
            if c == 1 and ctx:
                below = seen[ctx[1:]]
                left = {y: n for y, n in below.items() if y not in after or y == x}
                add((len(ctx) - 1, True, *_escape_class(sum(left.values()) - 1, len(left) - (below[x] == 1))), int(below[x] == 1), 1)
    return seen, escape


def language_model(docs, order):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base, score)] of (doc_id, text), by a dictionary of contexts."""
    count, ends, train = {}, 0, []
    symbols = lambda t: [257] * order + [*(t or "").translate(ASCII_LOWER).encode(), 256]
    for d, t in docs:
        if crc_fold(d, 7) != 2:
            train.append(symbols(t))
            for w in words(t):
                count[w] = count.get(w, 0) + 1
            ends += 1
    seen, escape = context_model(train, order)
    total, kinds = sum(count.values()) + ends, len(count) + (ends > 0)
    out = []
    for d, t in docs:
        s, score = symbols(t), 0.0
        for i in range(order, len(s)):
            excluded, fell = set(), False
            for o in range(order, -1, -1):
                all_after = seen.get(tuple(s[i - o : i]), {})
                after = {k: c for k, c in all_after.items() if k not in excluded}
                if after:
                    sum_ = sum(after.values())
                    new, every = escape.get((o, fell, *_escape_class(sum_, len(after))), (0, 0))
                    p = (new + 0.15) / (every + 0.3)
                    if s[i] in after:
                        score += math.log10((1 - p) * after[s[i]] / sum_)
                        break
                    score += math.log10(p)
                fell = fell or bool(all_after)
                excluded = set(all_after)
            else:
                score -= math.log10(257 - len(seen.get((), {})))
        c = [*(count.get(w, 0) for w in words(t)), ends]
        base = sum(math.log10((x + 1) / (total + kinds + 1)) for x in c)
        out.append((d, crc_fold(d, 7) == 2, len(c), sum(x > 0 for x in c), total, base, score))
    return out


def lz_phrases(text):
    """Ends of the LZ78 phrases of a text, one step at a time."""
    seen, out, i = set(), [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in seen:
            j += 1
        seen.add(text[i:j])
        out.append(j)
        i = j
    return out


def edited(docs):
    """{doc_id: (n_chars, sha256 of the edited text, the next doc_id)} of (doc_id, text), ids unlike."""
    docs = sorted((d, t or "") for d, t in docs)
    out = {}
    for i, (d, t) in enumerate(docs):
        n, after = len(t), docs[(i + 1) % len(docs)]
        new = t[: n - n // 2] + after[1][: n // 2]
        out[d] = (n, hashlib.sha256(new.encode()).hexdigest(), after[0])
    return out


def clause_patterns(text, kinds, scope=3):
    """{pattern: matches} of insults (of grade 3) and threats, each by all that its clause holds."""
    out = {}
    for clause in re.split(r"[.,;:!?\n\r()\[\]{}\"|]", (text or "").translate(ASCII_LOWER)):
        w = [kinds.get(x) for x in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", clause)]
        target = w.index("target") if "target" in w else len(w)
        report = w.index("report") if "report" in w else len(w)
        waiting = []
        for i, k in enumerate(w):
            if k not in ("insult", "threat"):
                continue
            if i > report:
                context = "reported"
            elif "negator" in w[max(0, i - scope) : i]:
                context = "negated"
            elif i > target:
                context = "aimed"
            else:
                waiting.append(k)
                continue
            name = ("insult3_" if k == "insult" else "threat_") + context
            out[name] = out.get(name, 0) + 1
        # of those before the first target, the strongest is aimed at it
        waiting.sort()
        for i, k in enumerate(waiting):
            name = ("insult3_" if k == "insult" else "threat_") + ("aimed" if target < len(w) and i == len(waiting) - 1 else "bare")
            out[name] = out.get(name, 0) + 1
    return out


def stem_grades(rows, lengths, grades, least):
    """{(bytes, is it a whole word): grade} of (text, is it toxic)."""
    held = {}
    for text, bad in rows:
        stems = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.translate(ASCII_LOWER).encode()):
            stems |= {(w, True)} | {(w[:n], False) for n in lengths if n < len(w)}
        for x in stems:
            held.setdefault(x, [0, 0])[bool(bad)] += 1
    n = [sum(not bad for _, bad in rows), sum(bool(bad) for _, bad in rows)]
    out = {}
    for x, (b, a) in held.items():
        sure = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        out[x] = sum(sure >= g for g in grades) if a >= least else 0
    return out


#: Scripts whose code points are words of their own: kana and Han, Thai and Lao.
UNSPACED = r"[\u3000-\u9fff\u0e00-\u0eff\U00020000-\U00033fff]"


def benchmark_words(text):
    return re.findall(UNSPACED + r"|(?:(?!" + UNSPACED + r")[0-9a-z\u0080-\U0010ffff])+", (text or "").translate(ASCII_LOWER))


def leaks(docs, items):
    """{(doc_id, item_id): least edits} of (id, text) tables: the closest stretch, where it is within a fifth of the item's words."""
    out = {}
    for d, text in docs:
        w = benchmark_words(text)
        for i, item in items:
            x = benchmark_words(item)
            n = len(x)
            if n < 3:
                if n and w == x:
                    out[d, i] = 0
                continue
            row = [0] * (len(w) + 1)  # of no words of the item, a stretch may begin anywhere
            for k, a in enumerate(x, 1):
                new = [k]
                for j, b in enumerate(w, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
                row = new
            if min(row) <= (n // 5 if n >= 7 else 0):
                out[d, i] = min(row)
    return out


def statistics(text):
    """What the quality classifier knows of a text, counted one by one."""
    b = (text or "").encode()
    n = max(len(b), 1)
    letter = lambda c: chr(c).isalpha() if c < 128 else True
    upper, lower_space = lambda c: 65 <= c <= 90, b" \t\n\x0b\x0c\r"
    symbol, bang, stop = b"#$%&*+/<=>@[\\]^_`{|}~", b"!?", b".,;:"
    kinds = (upper, letter, lambda c: 48 <= c <= 57, lambda c: c in lower_space, lambda c: c >= 128, lambda c: c in symbol, lambda c: c in bang, lambda c: c in stop, lambda c: c == 124)
    shares = [sum(map(k, b)) / n for k in kinds]
    w = re.findall(rb"[^\x20\x09-\x0d]+", b)
    low = [x.lower() for x in w]
    m = max(len(w), 1)
    lengths = [len(x) for x in w]
    mean = sum(lengths) / m
    spread = math.sqrt(max(sum(x * x for x in lengths) / m - mean * mean, 0))
    plain = sum(sum(map(letter, x)) >= len(x) - 1 for x in w) / m
    symbols = sum(any(c in symbol or c in bang for c in x) for x in w) / m
    top = max((low.count(x) for x in set(low)), default=0) / m
    again = sum(x == y for x, y in zip(low, low[1:], strict=False)) / m
    lines = b.count(b"\n") + 1
    of_letters = shares[0] / shares[1] if shares[1] else 0
    return [math.log1p(len(b)), math.log1p(len(w)), *shares, of_letters, mean, spread, plain, symbols, len(set(low)) / m, math.log1p(len(set(low))), top, again, math.log(lines), math.log1p(len(w) / lines)]


def ridge(rows, y, penalty):
    """Weights that minimise squared errors plus penalty times squared weights, by stacking the penalty below the rows."""
    import numpy as np

    stacked = np.concatenate([rows, np.diag(np.sqrt(penalty))])
    return np.linalg.lstsq(stacked, np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]


def bins(hashes, n):
    """{bin: least hash} of phrase hashes."""
    out = {}
    for h in hashes:
        out[h % n] = min(out.get(h % n, 1 << 64), h >> 8)
    return out
