"""Multiway merge of sorted byte strings that never re-compares known prefixes."""

from __future__ import annotations


def front_decode(lcps: list[int], tails: bytes, width: int) -> list[bytes]:
    """The strings (all of one width) of a front-coded run: each keeps lcp bytes of the one before."""
    out, last, at = [], b"", 0
    for h in lcps:
        end = at + width - h
        last = last[:h] + tails[at:end]
        at = end
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge runs of (strings, length of the prefix common with the string before).

    Returns three lists over the merged order: the run of each string, its
    place there, and its common prefix with the string before. A loser tree
    keeps with each contender the prefix h it shares with the last winner. Of
    two contenders the one with the longer h is smaller; only at equal h are
    bytes read, from h on, and the loser takes the prefix found as its h.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    h, place = [0] * k, [0] * k
    losers = [0] * k
    from_bytes = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's h is updated."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if h[a] != h[b]:
            return (a, b) if h[a] > h[b] else (b, a)
        d = h[a]
        diff = from_bytes(x[d:], "big") ^ from_bytes(y[d:], "big")
        d = len(x) - ((diff.bit_length() + 7) >> 3)
        if not diff or x[d] < y[d]:
            h[b] = d
            return a, b
        h[a] = d
        return b, a

    winners = list(range(k))
    at = k // 2
    while len(winners) > 1:
        ahead = []
        for i in range(0, len(winners), 2):
            w, lost = play(winners[i], winners[i + 1])
            losers[at + i // 2] = lost
            ahead.append(w)
        winners, at = ahead, at // 2
    w = winners[0]
    of, where, common = [], [], []
    while heads[w] is not None:
        of.append(w)
        where.append(place[w])
        common.append(h[w])
        strings, lcps = runs[w]
        i = place[w] = place[w] + 1
        if i < len(strings):
            heads[w], h[w] = strings[i], lcps[i]
        else:
            heads[w] = None
        node = (w + k) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2
    return of, where, common
