"""Suffix arrays by induced sorting and permuted common prefixes, on arrays instead of single characters.

Induced sorting fills a bucket for each character in order; whatever a stretch of a bucket induces is known at once, so stretches
are handled as arrays, and a bucket needs one more round for each repetition of its character that its own entries induce.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to which the reduced text is sorted by induction again; larger ones by doubling ranks.
RECURSE = 4096


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    after = np.minimum(nearest + 1, n - 1)
    return (text[nearest] < text[after]) | (nearest == n - 1)


def _ranks(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by character, each one's number among its equals, the distinct characters and their counts."""
    order = np.argsort(chars, kind="stable")
    counts = np.bincount(chars)
    own = np.flatnonzero(counts)
    counts = counts[own]
    return order, np.arange(len(chars)) - np.repeat(np.cumsum(counts) - counts, counts), own, counts


def _induce(text: np.ndarray, small: np.ndarray, start: np.ndarray, end: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order."""
    out = np.full(len(text), -1, np.int64)
    chars = text[lms]
    order, nth, own, counts = _ranks(chars)
    tail = end.copy()
    tail[own] -= counts
    seeds = tail.copy()  # where each bucket's seeds begin
    out[tail[chars[order]] + nth] = lms[order]
    head = start.copy()

    def larger(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if len(before):
            chars = text[before]
            order, nth, own, counts = _ranks(chars)
            out[head[chars[order]] + nth] = before[order]
            head[own] += counts

    used = np.flatnonzero(end > start)
    for c in used:
        at = start[c]
        while at < head[c]:
            stop = head[c]
            larger(out[at:stop])
            at = stop
        larger(out[seeds[c] : end[c]])
    tail = end.copy()

    def smaller(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[small[before]]
        if len(before):
            chars = text[before]
            order, nth, own, counts = _ranks(chars)
            out[tail[chars[order]] - 1 - nth] = before[order]
            tail[own] -= counts

    for c in used[::-1]:
        at = end[c]
        while at > tail[c]:
            stop = tail[c]
            smaller(out[stop:at][::-1])
            at = stop
        smaller(out[start[c] : head[c]][::-1])
    out[0] = len(text) - 1  # the end mark
    return out


def _doubled(text: np.ndarray) -> np.ndarray:
    """The suffix array by doubling ranks. A rank is where its group begins in the order; only groups of several are sorted again."""
    n, k = len(text), 1

    def heads(keys: np.ndarray) -> np.ndarray:
        """For sorted keys, where each one's equals begin."""
        new = np.append(True, keys[1:] != keys[:-1])
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = heads(text[order])
    active = order
    while True:
        active = active[np.bincount(rank[active], minlength=n)[rank[active]] > 1]
        if not len(active):
            break
        after = np.minimum(active + k, n - 1)
        keys = rank[active] * (n + 1) + np.where(active + k < n, rank[after] + 1, 0)
        by = np.argsort(keys)
        active, keys = active[by], keys[by]
        rank[active] = rank[active] + heads(keys) - heads(rank[active])
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of integers whose last is 0 and the only 0."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1]
    if len(text) and text.max() < 1 << 15:
        text = text.astype(np.int16)  # sorted by digits, not by comparison
    small = _types(text)
    counts = np.bincount(text)
    end = np.cumsum(counts)
    start = end - counts
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    some = _induce(text, small, start, end, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = some[is_lms[some]]
    # Names: neighbours get one name if their substrings up to the next leftmost-smaller position are equal.
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    active, k = np.flatnonzero(same), 0
    while len(active):
        active = active[length[a[active]] > k]
        unequal = text[a[active] + k] != text[b[active] + k]
        same[active[unequal]] = False
        active = active[~unequal]
        k += 1
    name = np.empty(n, np.int64)
    name[ordered] = np.append(0, np.cumsum(~same))
    reduced = name[lms]
    kinds = int(reduced.max()) + 1
    if kinds == len(lms):
        order = np.argsort(reduced)
    else:
        order = suffix_array(reduced) if kinds <= RECURSE else _doubled(reduced)
    return _induce(text, small, start, end, lms[order])


def permuted_prefixes(text: np.ndarray, order: np.ndarray, breaks: int) -> np.ndarray:
    """By position: the characters that a suffix shares with its predecessor in order, none beyond a character up to ``breaks``.

    Only irreducible values, where the characters before differ or break, are found by comparison; each of the others is one less
    than its left neighbour's.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    known = (before < 0) | (at == 0) | (before == 0)
    left = text[np.maximum(at, 1) - 1]
    known |= (left != text[np.maximum(before, 1) - 1]) | (left <= breaks)
    shared = np.zeros(n, np.int64)
    active = np.flatnonzero(known & (before >= 0))
    k = 0
    while len(active):
        x, y = active + k, before[active] + k
        inside = (x < n) & (y < n)
        active, x, y = active[inside], x[inside], y[inside]
        active = active[(text[x] == text[y]) & (text[x] > breaks)]
        k += 1
        shared[active] = k
    from_left = np.maximum.accumulate(np.where(known, at, 0))
    return np.maximum(shared[from_left] - (at - from_left), 0)
