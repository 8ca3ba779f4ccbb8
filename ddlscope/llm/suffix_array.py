"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

The steps are those of linear-time induced sorting: classify every suffix as
smaller (S) or larger (L) than the next one, sort the substrings between
leftmost S suffixes by an induced scan, name them, sort the string of names
recursively where names repeat, and induce the order of all suffixes from the
sorted leftmost S suffixes.  A scan places the predecessor of each suffix it
passes at the head (or tail) of that predecessor's bucket.  Here a scan moves on
by blocks: all entries up to the first slot that the block itself fills have
their final value, so they are handled together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (non-negative integers) in sorted order."""
    n = len(text)
    if n <= 1:
        return np.arange(n)
    t = np.ascontiguousarray(text, np.min_scalar_type(int(text.max())))  # small symbols: fast gathers and radix sorts
    small = _is_small(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_index(n))
    counts = np.bincount(t).astype(_index(n))
    ends = np.cumsum(counts, dtype=_index(n))
    if len(lms) > 1:
        # substrings in order, then names in text order
        order = _induce(t, small, ends - counts, ends, lms)
        mark = np.zeros(n, bool)
        mark[lms] = True
        order = order[mark[order]]
        names = _named(t, lms, order)
        if names.max() + 1 < len(lms):
            lms = lms[suffix_array(names)]
        else:
            lms = order
    return _induce(t, small, ends - counts, ends, lms)


def _index(n: int) -> type:
    """Type of positions in a text of ``n`` symbols."""
    return np.int32 if n < 1 << 31 else np.int64


def _is_small(t: np.ndarray) -> np.ndarray:
    """S suffixes; equal neighbours take the class of the run's end, the last run is L."""
    step = np.flatnonzero(t[1:] != t[:-1])
    rises = np.append(t[step] < t[step + 1], False)
    return np.repeat(rises, np.diff(np.concatenate([[-1], step, [len(t) - 1]])))


def _named(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-S substring, equal ones alike, in text order."""
    n = len(t)
    upto = np.append(lms[1:], n)  # the last one ends with the text's end, which no other has
    size = np.zeros(n, _index(n))
    size[lms] = upto - lms + 1
    a, b = order[:-1], order[1:]
    same = (size[a] == size[b]) & (a != lms[-1]) & (b != lms[-1])
    live = np.flatnonzero(same)
    at = 0
    while len(live):
        x, y = a[live], b[live]
        if at >= 512:  # few are so long
            for k, p, q in zip(live, x, y):
                same[k] = np.array_equal(t[p + at:p + size[p]], t[q + at:q + size[p]])
            break
        equal = t[x + at] == t[y + at]
        same[live[~equal]] = False
        at += 1
        live = live[equal & (size[x] > at)]
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(n, _index(n))
    names[order] = rank
    return names[lms]


def _grouped(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols, number of each, first place of each in that order)."""
    order = c.argsort(kind="stable")
    s = c[order]
    edge = (s[1:] != s[:-1]).nonzero()[0]
    first = np.zeros(len(edge) + 1, np.int64)
    first[1:] = edge + 1
    number = np.empty_like(first)
    number[:-1] = first[1:] - first[:-1]
    number[-1] = len(s) - first[-1]
    return order, s[first], number, first


def _induce(t, small, starts, ends, lms) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, _index(n))
    if len(lms):
        order, symbol, number, first = _grouped(t[lms])
        sa[(ends[symbol] - number - first).repeat(number) + np.arange(len(lms))] = lms[order]
    placed = sa.copy()

    heads = starts.copy()
    sa[heads[t[n - 1]]] = n - 1  # the empty suffix comes first and induces the last symbol's
    heads[t[n - 1]] += 1
    at, block = 0, 1 << 12
    while at < n:
        to = min(n, at + block)
        while True:
            x = sa[at:to]
            p = x[x > 0] - 1
            p = p[~small[p]]
            c = t[p]
            land = int(heads[c].min()) if len(c) else n
            if land >= to:
                break
            to = land
        if len(p):
            order, symbol, number, first = _grouped(c)
            sa[(heads[symbol] - first).repeat(number) + np.arange(len(c))] = p[order]
            heads[symbol] += number
        block = min(1 << 16, max(64, 2 * (to - at)))
        at = to

    sa[placed >= 0] = -1  # the scan back places every S suffix anew
    tails = ends.copy()
    at, block = n, 1 << 12
    while at > 0:
        to = max(0, at - block)
        while True:
            x = sa[to:at][::-1]
            p = x[x > 0] - 1
            p = p[small[p]]
            c = t[p]
            land = int(tails[c].max()) - 1 if len(c) else -1
            if land < to:
                break
            to = land + 1
        if len(p):
            order, symbol, number, first = _grouped(c)
            sa[(tails[symbol] - 1 + first).repeat(number) - np.arange(len(c))] = p[order]
            tails[symbol] -= number
        block = min(1 << 16, max(64, 2 * (at - to)))
        at = to
    return sa


def permuted_lcp(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix, ``most`` at the longest, with the suffix sorted before its own.

    A position whose left neighbour equals that of its predecessor in the order
    has a value of one less than the position before it; only the others are
    compared symbol by symbol.
    """
    n = len(text)
    kind = _index(n + most + 8)  # positions and prefixes, with what a comparison may go beyond them
    phi = np.full(n, -1, kind)
    phi[sa[1:]] = sa[:-1]
    own = phi <= 0
    own[:1] = True
    inner = np.flatnonzero(~own).astype(kind)
    own[inner] = text[inner - 1] != text[phi[inner] - 1]
    del inner
    at = np.flatnonzero(own).astype(kind)
    del own
    other = phi[at]
    del phi
    value = np.zeros(len(at), kind)
    # irreducible values must not be cut before they are carried on; a carried value is cut at ``most`` only
    # where it is read, so comparing to most + distance is enough
    reach = np.append(at[1:], kind(n)) - at + kind(most)
    wide = 8 // text.itemsize
    words = _words(text, wide)
    live = np.flatnonzero(other >= 0).astype(kind)
    parted = [live[:0]]
    while len(live):  # several symbols at a time, as long as they are equal
        x, y = at[live] + value[live], other[live] + value[live]
        inside = (np.maximum(x, y) < len(words)) & (value[live] < reach[live])
        equal = np.zeros(len(live), bool)
        equal[inside] = words[x[inside]] == words[y[inside]]
        parted.append(live[~equal & (value[live] < reach[live])])
        live = live[equal]
        value[live] += kind(wide)
    live = np.concatenate(parted)
    while len(live):
        x, y = at[live] + value[live], other[live] + value[live]
        live, x, y = (z[np.maximum(x, y) < n] for z in (live, x, y))
        live = live[text[x] == text[y]]
        value[live] += kind(1)
        live = live[value[live] < reach[live]]
    del other, reach, words, parted
    if not len(at):
        return np.zeros(n, kind)
    carried = np.repeat(value + at, np.diff(np.append(at, kind(n))))
    carried -= np.arange(n, dtype=kind)
    return np.clip(carried, 0, most, out=carried)


def _words(text: np.ndarray, wide: int) -> np.ndarray:
    """At each position the next ``wide`` symbols in one 64-bit number: a view, whose numbers are only compared with each other."""
    text = np.ascontiguousarray(text)
    n = max(0, len(text) - wide + 1)
    return np.ndarray(n, np.uint64, text, strides=(text.itemsize,)) if n else np.zeros(0, np.uint64)


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """For each position: does its string of ``length`` symbols start at another position too?"""
    n = len(text)
    if n == 0:
        return np.zeros(0, bool)
    text = text.astype(np.min_scalar_type(int(text.max())))
    sa = suffix_array(text)
    with_previous = permuted_lcp(text, sa, length) >= length
    found = with_previous.copy()
    rank = np.flatnonzero(with_previous[sa[1:]])
    found[sa[rank]] = True
    return found
