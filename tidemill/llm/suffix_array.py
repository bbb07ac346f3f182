"""Suffix arrays by induced sorting, in vector operations.

Suffixes are classified as smaller or larger than their right neighbour, the leftmost smaller ones (LMS) are sorted, and
all others are induced from them in two linear scans. A scan walks the buckets of first bytes; within a bucket it
handles in one step all entries that are already placed, so that it costs a few vector operations a bucket.
"""

from __future__ import annotations

import numpy as np


def _classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S-type, LMS positions). A suffix is S-type if it is smaller than the next one; the last one isn't."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    small = np.zeros(n, bool)
    if len(change):
        # Each position takes the type of the next change to its right; the run at the end is L-type.
        at = np.searchsorted(change, np.arange(n - 1))
        known = at < len(change)
        small[:-1][known] = (text[change] < text[change + 1])[at[known]]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return small, lms


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array, given the LMS suffixes in their order (or LMS substrings, if only those are in order)."""
    n, ends = len(text), np.cumsum(sizes)
    begins = ends - sizes
    out = np.full(n, -1, np.int32)
    by_char = lms[np.argsort(text[lms], kind="stable")]
    lms_sizes = np.bincount(text[lms], minlength=len(sizes))
    lms_ends = np.cumsum(lms_sizes)
    head, done = begins.copy(), begins.copy()

    def place(found: np.ndarray) -> None:
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, counts = found[order], np.bincount(chars, minlength=len(sizes))
        at = 0
        for c in np.flatnonzero(counts):
            out[head[c] : head[c] + counts[c]] = found[at : at + counts[c]]
            head[c] += counts[c]
            at += counts[c]

    place(np.array([n - 1], np.int32))  # the end of the text comes before everything
    for c in np.flatnonzero(sizes):
        while done[c] < head[c]:
            now = out[done[c] : head[c]]
            done[c] = head[c]
            before = now[now > 0] - 1
            place(before[~small[before]])
        now = by_char[lms_ends[c] - lms_sizes[c] : lms_ends[c]]
        before = now - 1
        place(before[~small[before]])

    tail, done = ends.copy(), ends.copy()

    def place_back(found: np.ndarray) -> None:
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, counts = found[order], np.bincount(chars, minlength=len(sizes))
        at = 0
        for c in np.flatnonzero(counts):
            out[tail[c] - counts[c] : tail[c]] = found[at : at + counts[c]][::-1]
            tail[c] -= counts[c]
            at += counts[c]

    for c in np.flatnonzero(sizes)[::-1]:
        while tail[c] < done[c]:
            now = out[tail[c] : done[c]][::-1]
            done[c] = tail[c]
            before = now[now > 0] - 1
            place_back(before[small[before]])
        now = out[begins[c] : head[c]][::-1]
        before = now[now > 0] - 1
        place_back(before[small[before]])
    return out


def _rank_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names: its suffix array.

    Few different names are sorted by induction again; otherwise ranks of runs of 1, 2, 4, ... names are merged until
    all differ.
    """
    n = len(names)
    distinct = int(names.max()) + 1
    if distinct <= 256 and n > 1024:
        return suffix_array(names.astype(np.uint8))
    rank, step = names.astype(np.int64), 1
    while True:
        key = rank * np.int64(n + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def _name_substrings(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order; equal substrings have equal names, which keep their order."""
    n = len(text)
    nxt = np.append(lms[1:], n - 1)
    length = nxt - lms + 1
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (nxt[a] != n - 1) & (nxt[b] != n - 1)
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        equal = text[lms[a[at]] + k] == text[lms[b[at]] + k]
        same[at[~equal]] = False
        k += 1
        at = at[equal & (k < length[a[at]])]
    names = np.empty(len(lms), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(~same)))
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a uint8 array in lexicographic order; a prefix comes before what it begins."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small, lms = _classify(text)
    lms = lms.astype(np.int32)
    sizes = np.bincount(text, minlength=256)
    if len(lms) > 1:
        rough = _induce(text, small, lms, sizes)
        is_lms = np.full(n, -1, np.int64)
        is_lms[lms] = np.arange(len(lms))
        order = is_lms[rough]
        names = _name_substrings(text, lms, order[order >= 0])
        if int(names.max()) + 1 < len(lms):
            lms = lms[_rank_names(names)]
        else:
            sorted_lms = np.empty(len(lms), np.int64)
            sorted_lms[names] = np.arange(len(lms))
            lms = lms[sorted_lms]
    return _induce(text, small, lms, sizes)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each position in text order, the suffix before it in the suffix array (-1 for the first), and the
    length of their common prefix, up to `most`."""
    n = len(text)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    word = np.zeros(n, np.uint64)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in range(8):
        word |= padded[k : k + n] << np.uint64(8 * k)
    plcp = np.zeros(n, np.int32)
    at = np.flatnonzero(phi >= 0)
    k = 0
    while len(at) and k < most:
        at = at[(at + k < n) & (phi[at] + k < n)]
        differ = word[at + k] ^ word[phi[at] + k]
        # The lowest set bit tells the first differing byte; a word that runs over the end counts to the end only.
        low = differ & (~differ + np.uint64(1))
        gained = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        room = n - np.maximum(at, phi[at]) - k
        plcp[at] = np.minimum(k + np.minimum(gained, room), most)
        at = at[(differ == 0) & (room > 8)]
        k += 8
    return phi, plcp
