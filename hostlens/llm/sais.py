"""Suffix arrays by induced sorting, and common prefixes in text order.

``suffix_array`` classifies suffixes as smaller or larger than their right
neighbour, sorts the substrings between leftmost-smaller positions by inducing,
names them, sorts the suffixes of the names while these repeat, and induces the
whole order from the sorted leftmost-smaller suffixes.  Inducing works on
vectors: with a small alphabet a bucket's entries are taken at once (a bucket
feeds itself only along runs of its own letter); where that would take a few
entries at a time, as in long runs of one letter, and for short strings, plain
loops do the same.  With a large alphabet (most names) buckets are too small for
that; there prefixes of doubled length are ranked until all differ.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024
SHORT = 2000
FEW = 24


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers (a proper prefix sorts first)."""
    if len(s) == 0:
        return np.zeros(0, np.int64)
    ended = np.append(s.astype(np.int64) + 1, 0)  # a least letter of its own at the end
    return _sort(ended, int(ended.max()) + 1)[1:]


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last is)."""
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # last places of runs of one letter
    up = np.append(s[ends[:-1]] < s[ends[:-1] + 1], True)
    return np.repeat(up, np.diff(ends, prepend=-1))


def _sort(s: np.ndarray, letters: int) -> np.ndarray:
    if len(s) < SHORT:
        return np.array(_sort_lists(s.tolist(), letters), np.int64)
    if letters > SMALL_ALPHABET:
        return _sort_by_doubling(s, letters)
    small = _smaller(s)
    left = np.zeros(len(s), bool)
    left[1:] = small[1:] & ~small[:-1]
    places = np.flatnonzero(left)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=letters))])
    narrow = s.astype(np.uint16)  # 16 bits sort by radix
    order = places[np.argsort(narrow[places], kind="stable")]
    sa = _induce_buckets(narrow, small, order, bounds)
    found = sa[left[sa]]  # leftmost-smaller places in order of their substrings
    names = _names(s, places, found)
    total = int(names.max()) + 1 if len(names) else 0
    if total < len(places):
        by_place = names[np.argsort(found, kind="stable")]
        order = places[_sort(by_place, total)]
    else:
        order = found
    return _induce_buckets(narrow, small, order, bounds)


def _names(s: np.ndarray, places: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings (each up to the next such place) in sorted order."""
    nexts = np.full(len(s), len(s) - 1)
    nexts[places[:-1]] = places[1:]
    length = nexts[found] - found + 1
    same = np.zeros(len(found), bool)
    at = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(at):
        at = at[s[found[at] + k] == s[found[at - 1] + k]]
        k += 1
        done = length[at] == k
        same[at[done]] = True
        at = at[~done]
    return np.cumsum(~same) - 1


def _place(s: np.ndarray, order: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An array with ``order`` at the ends of its buckets, and how many each bucket got."""
    sa = np.full(len(s), -1, np.int64)
    counts = np.bincount(s[order], minlength=len(bounds) - 1)
    begin = bounds[1:] - counts
    sa[np.arange(len(order)) + np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)] = order
    return sa, counts


def _deal(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of letters, the letters, their numbers, and each entry's rank among equals (in that order)."""
    by = np.argsort(c, kind="stable")
    c = c[by]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    n = np.diff(np.append(first, len(c)))
    return by, c[first], n, np.arange(len(c)) - np.repeat(first, n)


def _induce_buckets(s: np.ndarray, small: np.ndarray, order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in (at least substring) order."""
    sa, counts = _place(s, order, bounds)
    ends = bounds[1:]
    head, tail = bounds[:-1].copy(), bounds[1:].copy()

    def larger(js):
        if len(js) < FEW:
            for j in js.tolist():
                if j > 0 and not small[j - 1]:
                    c = s[j - 1]
                    sa[head[c]] = j - 1
                    head[c] += 1
            return
        js = js[js > 0] - 1
        js = js[~small[js]]
        if len(js):
            by, c, n, rank = _deal(s[js])
            sa[np.repeat(head[c], n) + rank] = js[by]
            head[c] += n

    def smaller(js):  # from right to left
        if len(js) < FEW:
            for j in js.tolist():
                if j > 0 and small[j - 1]:
                    c = s[j - 1]
                    tail[c] -= 1
                    sa[tail[c]] = j - 1
            return
        js = js[js > 0] - 1
        js = js[small[js]]
        if len(js):
            by, c, n, rank = _deal(s[js])
            sa[np.repeat(tail[c], n) - 1 - rank] = js[by]
            tail[c] -= n

    for c in range(len(counts)):
        at = bounds[c]
        while at < head[c]:
            at, upto = head[c], at
            larger(sa[upto:at])
        if counts[c]:
            larger(sa[ends[c] - counts[c]:ends[c]])
    for c in range(len(counts) - 1, -1, -1):
        at = ends[c]
        while at > tail[c]:
            at, upto = tail[c], at
            smaller(sa[at:upto][::-1])
        smaller(sa[bounds[c]:head[c]][::-1])
    sa[0] = len(s) - 1  # the end itself
    return sa


def _sort_by_doubling(s: np.ndarray, letters: int) -> np.ndarray:
    """The order of the suffixes from ranks of their first letters, then of twice as many each round; only suffixes
    that share their rank with others are sorted again."""
    n, bits = len(s), letters.bit_length()
    key, known = s + 1, 1  # as many letters as go into 63 bits; past the end, zeros
    while known < n and (known + 1) * bits < 64:
        key = key << bits
        key[:n - known] |= s[known:] + 1
        known += 1
    order = at = np.argsort(key)
    key, place, rank = key[order], np.arange(n), np.empty(n, np.int64)
    while True:
        first = np.append(True, key[1:] != key[:-1])
        rank[at] = place[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        tied = ~(first & np.append(first[1:], True))
        at, place = at[tied], place[tied]
        if not len(at):
            return order
        after = at + known
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[place] = at
        known *= 2


def _sort_lists(s: list[int], letters: int) -> list[int]:
    """The same on plain lists."""
    n = len(s)
    small = [True] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    places = [i for i in range(1, n) if small[i] and not small[i - 1]]
    counts = [0] * letters
    for c in s:
        counts[c] += 1
    heads, tails, total = [], [], 0
    for c in counts:
        heads.append(total)
        total += c
        tails.append(total)

    def induce(order):
        sa = [-1] * n
        tail = tails[:]
        for j in reversed(order):
            c = s[j]
            tail[c] -= 1
            sa[tail[c]] = j
        head = heads[:]
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not small[j]:
                c = s[j]
                sa[head[c]] = j
                head[c] += 1
        tail = tails[:]
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and small[j]:
                c = s[j]
                tail[c] -= 1
                sa[tail[c]] = j
        sa[0] = n - 1
        return sa

    if not places:
        return induce(places)
    is_left = bytearray(n)
    for p in places:
        is_left[p] = 1
    found = [j for j in induce(places) if is_left[j]]
    nexts = dict(zip(places, [*places[1:], n - 1]))
    name, names, last = -1, {}, None
    for p in found:
        piece = s[p:nexts[p] + 1]
        if piece != last:
            name += 1
            last = piece
        names[p] = name
    if name + 1 < len(places):
        order = [places[i] for i in _sort_lists([names[p] for p in places], name + 1)]
    else:
        order = found
    return induce(order)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the length (up to ``most``) that its suffix shares with the one before it in ``sa``.

    Computed in text order: where the letters to the left of a suffix and of its predecessor agree, the length
    is one less than that of the place to the left; only the other places compare letters."""
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (s[:-1] == s[before[1:] - 1])
    heads = np.flatnonzero(~follows)
    reach = np.append(heads[1:], n) - heads + most  # so that a run's last place still has its ``most``
    i, j, limit = heads, before[heads], np.minimum(np.minimum(n - heads, n - before[heads]), reach)
    length = np.zeros(len(heads), np.int64)
    at = np.flatnonzero((j >= 0) & (limit > 0))
    words = np.zeros(n, np.uint64)
    for k in range(min(8, n)):  # the eight letters from each place on, as one number (letters are bytes here)
        words[:n - k] |= s[k:].astype(np.uint64) << np.uint64(8 * k)
    while len(at):
        a, b = i[at] + length[at], j[at] + length[at]
        differ = words[a] ^ words[b]
        equal = differ == 0
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        length[at] += np.where(equal, 8, low)
        at = at[equal & (length[at] < limit[at])]
    length = np.minimum(length, np.maximum(limit, 0))
    shared[heads] = length
    place = np.arange(n)
    head = np.maximum.accumulate(np.where(follows, 0, place))
    return np.minimum(np.maximum(shared[head] - (place - head), 0), most)
