"""Suffix arrays by induced sorting, with array operations over whole buckets.

Suffixes are smaller (S) or larger (L) than their right neighbour; a leftmost smaller one (LMS) starts a
substring that ends at the next. These substrings are sorted and named; if names repeat, the string of
names is sorted the same way, one level down. From the order of the LMS suffixes all others are induced:
over bytes bucket by bucket, each bucket's suffixes placing their left neighbours in one stable step,
linear in the text; over names, whose buckets are tiny, by sorting what stands before the next LMS suffix.
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the empty suffix is smallest."""
    n = len(t)
    turn = np.full(n, n, np.int64)
    differs = np.flatnonzero(t[1:] != t[:-1])
    turn[differs] = differs
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = np.zeros(n, bool)
    inside = turn < n
    at = turn[inside]
    small[inside] = t[at] < t[at + 1]
    return small


def sorted_chains(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of code strings, and for each place in it whether it differs from the one before.

    Strings are compared a machine word at a time; only those still tied are looked at again. ``last`` breaks
    what ties remain.
    """
    per, n = 63 // bits, len(codes)

    def word(which: np.ndarray, r: int) -> np.ndarray:
        key = np.zeros(len(which), np.int64)
        at, length = starts[which], lengths[which]
        for q in range(r * per, r * per + per):
            key = (key << bits) | np.where(q < length, codes[np.minimum(at + q, n - 1)], 0)
        return key

    everything = np.arange(len(starts))
    key = word(everything, 0)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    fresh = new[at]
    r = 1
    while len(at):
        goes_on = lengths[order[at]] > r * per  # tied strings are of one length, so whole groups go on
        at, fresh = at[goes_on], fresh[goes_on]
        if not len(at):
            break
        which = order[at]
        key = word(which, r)
        again = np.lexsort((key, np.cumsum(fresh)))
        order[at] = which[again]
        key = key[again]
        fresh[1:] |= key[1:] != key[:-1]
        new[at] = fresh
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at, fresh = at[tied], fresh[tied]
        r += 1
    if last is not None:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if len(at):
            group, which = np.cumsum(new)[at], order[at]
            order[at] = which[np.lexsort((last[which], group))]
            new[:] = True
    return order, new


def induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array of bytes from the sorted LMS suffixes."""
    n = len(t)
    sa = np.empty(n, np.int32)
    size = np.bincount(t, minlength=256)
    ends = np.cumsum(size)
    heads = ends - size
    fill = heads.copy()

    def put(items: np.ndarray, step: int, fill: np.ndarray) -> None:
        """Append to the buckets of the items' own bytes, in order."""
        byte = t[items]
        order = np.argsort(byte, kind="stable")
        byte = byte[order]
        counts = np.bincount(byte, minlength=256)
        within = np.arange(len(items)) - (np.cumsum(counts) - counts)[byte]
        sa[fill[byte] + step * within - (step < 0)] = items[order]
        fill += step * counts

    put(np.array([n - 1], np.int32), 1, fill)  # before the empty suffix
    group = t[lms]
    cuts = np.searchsorted(group, np.arange(257))
    for c in range(256):
        if not size[c]:
            continue
        done = heads[c]
        while done < fill[c]:  # one round for each length of a run of the byte
            items = sa[done : fill[c]]
            done = fill[c]
            left = items[items > 0] - 1
            left = left[~small[left]]
            if len(left):
                put(left, 1, fill)
        left = lms[cuts[c] : cuts[c + 1]]
        if len(left):
            put((left - 1).astype(np.int32), 1, fill)
    larger = fill.copy()
    fill = ends.copy()
    for c in range(255, -1, -1):
        if not size[c]:
            continue
        done = ends[c]
        while done > fill[c]:
            items = sa[fill[c] : done][::-1]
            done = fill[c]
            left = items[items > 0] - 1
            left = left[small[left]]
            if len(left):
                put(left, -1, fill)
        items = sa[heads[c] : larger[c]][::-1]
        left = items[items > 0] - 1
        left = left[small[left]]
        if len(left):
            put(left, -1, fill)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``t`` (non-negative integers) in ascending order."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    m = len(lms)
    codes = np.zeros(n + 1, np.int64)
    codes[:n] = 2 * t.astype(np.int64) + small + 1
    bits = int(codes.max()).bit_length()
    if m:
        stops = np.r_[lms[1:], n]
        order, new = sorted_chains(codes, lms, stops - lms + 1, bits)
        if not new.all():
            names = np.empty(m, np.int64)
            names[order] = np.cumsum(new) - 1
            order = suffix_array(names)
        lms_sorted = lms[order]
    else:
        lms_sorted = lms
    if t.dtype == np.uint8:
        return induced(t, small, lms_sorted)
    rank = np.zeros(n + 1, np.int64)
    rank[lms_sorted] = np.arange(m) + 1
    following = np.full(n + 1, n, np.int64)  # the next LMS suffix after each place
    following[lms] = lms
    following = np.minimum.accumulate(following[::-1])[::-1][1:]
    everything = np.arange(n)
    return sorted_chains(codes, everything, following - everything + 1, bits, rank[following])[0].astype(np.int32)


def common_prefixes(t: np.ndarray, sa: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes of bytes, and each suffix's neighbour before it in the array (-1: none).

    Where both suffixes follow the same byte, the prefix is one shorter than that of the place before; the others
    are compared word by word, up to ``most``. Places in ``fresh`` always are, so that no prefix is carried past them.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    carried = np.zeros(n, bool)
    i = np.arange(1, n)
    p = phi[1:]
    ok = p > 0
    carried[1:][ok] = t[i[ok] - 1] == t[p[ok] - 1]
    carried[fresh] = False
    own = np.flatnonzero(~carried & (phi >= 0))
    padded = np.r_[t, np.zeros(most + 16, np.uint8)]
    words = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
    length = np.zeros(n, np.int64)
    a, b, at = own, phi[own], 0
    while len(a) and at < most:
        x = words[a + at] ^ words[b + at]
        over = x != 0
        if over.any():
            low = x[over] & (~x[over] + np.uint64(1))
            length[a[over]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        a, b = a[~over], b[~over]
        at += 8
    length[a] = most
    length[own] = np.minimum(length[own], np.minimum(n - own, n - phi[own]))
    # prefixes that are carried shrink by one a place
    level = np.where(carried, 0, length + np.arange(n))
    last = np.maximum.accumulate(np.where(carried, -1, np.arange(n)))
    return np.maximum(level[last] - np.arange(n), 0), phi
