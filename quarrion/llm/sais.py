"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are smaller (S) or larger (L) than their right neighbours. The
leftmost S of each run of them begins a substring that ends at the next one; these
substrings are sorted by inducing, named, and the sequence of names is sorted
by the same procedure. From their order that of all suffixes is induced in
two scans of the buckets. Over few symbols a scan goes bucket by bucket with
arrays, over many entry by entry; both do the same work in linear time.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Entries a bucket has on average from which on a scan goes bucket by bucket.
WIDE = 150
#: Symbols of nine bits that are compared at a time.
AT_ONCE, BITS = 7, 9


def kinds(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last symbol is the smallest and stands nowhere else."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    until = np.flatnonzero(differs)
    rises = np.append(t[:-1] < t[1:], True)
    return rises[until[np.searchsorted(until, np.arange(n))]]


def _dealt(sa: np.ndarray, at: np.ndarray, key: np.ndarray, p: np.ndarray, up: bool) -> None:
    """Put positions into their symbols' buckets, in order, from the front (``up``) or from the end."""
    if not len(p):
        return
    order = np.argsort(key, kind="stable")
    key, p = key[order], p[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(new, len(key)))
    rank = np.arange(len(key)) - np.repeat(new, n)
    slot = at[key]
    sa[slot + rank if up else slot - rank] = p
    at[key[new]] += n if up else -n


def _by_bucket(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    sa = np.full(len(t), -1, np.int32)
    top = len(starts) - 1
    own = t[lms]
    cut = np.searchsorted(own, np.arange(top + 1))  # leftmost S by bucket, as they come in order of their first symbols
    head = starts[:-1].copy()
    for c in range(top):
        begin, done = starts[c], starts[c]
        while head[c] > done:  # runs of one symbol
            p = sa[done : head[c]] - 1
            done = head[c]
            p = p[p >= 0]
            p = p[t[p] == c]
            sa[head[c] : head[c] + len(p)] = p
            head[c] += len(p)
        p = np.concatenate([sa[begin : head[c]], lms[cut[c] : cut[c + 1]]]) - 1
        p = p[p >= 0]
        key = t[p]
        larger = key > c
        _dealt(sa, head, key[larger], p[larger], True)
    tail = starts[1:] - 1
    for c in range(top - 1, -1, -1):
        end, done = starts[c + 1] - 1, starts[c + 1] - 1
        while tail[c] < done:
            p = sa[tail[c] + 1 : done + 1][::-1] - 1
            done = tail[c]
            p = p[p >= 0]
            p = p[(t[p] == c) & small[p]]
            sa[tail[c] - len(p) + 1 : tail[c] + 1] = p[::-1]
            tail[c] -= len(p)
        p = np.concatenate([sa[tail[c] + 1 : end + 1][::-1], sa[starts[c] : head[c]][::-1]]) - 1
        p = p[p >= 0]
        key = t[p]
        less = key < c
        _dealt(sa, tail, key[less], p[less], False)
    sa[0] = len(t) - 1
    return sa


def _by_entry(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, np.int32)
    own = t[lms]
    new = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
    sa[starts[own + 1] + np.arange(len(own)) - np.repeat(new[1:], np.diff(new))] = lms
    sa = array("i", sa.tobytes())  # arrays, not lists: places are met in no order, and few bytes stay in the cache
    # For each position the bucket of the one on its left if that is to be placed, else -1; the last entry is that of empty places.
    larger, smaller = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
    larger[1:n][~small[:-1]] = t[:-1][~small[:-1]]
    smaller[1:n][small[:-1]] = t[:-1][small[:-1]]
    to, at = array("i", larger.tobytes()), starts[:-1].tolist()
    for i in sa:  # places that are filled on the way are met later
        c = to[i]
        if c >= 0:
            h = at[c]
            sa[h] = i - 1
            at[c] = h + 1
    to, at = array("i", smaller.tobytes()), (starts[1:] - 1).tolist()
    for i in reversed(sa):
        c = to[i]
        if c >= 0:
            h = at[c]
            sa[h] = i - 1
            at[c] = h - 1
    sa[0] = n - 1
    return np.frombuffer(sa, np.int32)


def induced(t: np.ndarray, small: np.ndarray, top: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S in the order of their first symbols at least."""
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=top))])
    return (_by_bucket if top * WIDE < len(t) else _by_entry)(t, small, starts, lms)


def named(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost-S substrings, in the order of the text; equal ones have one name."""
    size = np.append(np.diff(lms) + 1, 1)
    at = np.searchsorted(lms, order)
    length = size[at]
    same = np.flatnonzero(length[1:] == length[:-1]) + 1
    alike, offset = same, 0
    equal = np.zeros(len(order), bool)
    while len(alike):
        alike = alike[t[order[alike] + offset] == t[order[alike - 1] + offset]]
        offset += 1
        through = length[alike] == offset
        equal[alike[through]] = True
        alike = alike[~through]
    names = np.empty(len(lms), np.int32)
    names[at] = np.cumsum(~equal) - 1
    return names


def suffix_array(t: np.ndarray, top: int) -> np.ndarray:
    """The suffix array of symbols below ``top``; the last symbol is 0 and stands nowhere else."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    small = kinds(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    first = lms[np.argsort(t[lms], kind="stable")]
    sa = induced(t, small, top, first)
    if len(lms) > 1:
        leftmost = np.zeros(len(t), bool)
        leftmost[lms] = True
        order = sa[leftmost[sa]]
        names = named(t, lms, order)
        most = int(names.max()) + 1
        if most < len(lms):
            order = lms[suffix_array(names, most)]
        sa = induced(t, small, top, order)
    return sa


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length of the prefix that its suffix shares with the one before it in the suffix array.

    Where the symbol on the left is the same for both, the length is one less
    than that of the position on the left; only the other positions are compared, several symbols at a time. Symbols are below 512.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa] = np.append(-1, sa[:-1])
    i = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] <= 0) | (t[:-1] != t[np.maximum(before[1:] - 1, 0)])
    at = i[fresh & (before >= 0)]
    packed, padded = np.zeros(n, np.uint64), np.append(t, np.zeros(AT_ONCE, t.dtype)).astype(np.uint64)
    for k in range(AT_ONCE):
        packed = (packed << np.uint64(BITS)) | padded[k : k + n]
    length = np.zeros(n, np.int32)
    live = at
    a, b = live.copy(), before[live]
    while len(live):
        same = packed[a] == packed[b]
        live, a, b = live[same], a[same] + AT_ONCE, b[same] + AT_ONCE
        length[live] += AT_ONCE
    live = at
    while len(live):
        live = live[t[live + length[live]] == t[before[live] + length[live]]]
        length[live] += 1
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    return length[last] - (i - last).astype(np.int32)
