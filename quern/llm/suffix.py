"""Suffix arrays by Larsson-Sadakane refinement and common prefixes after Kasai, in numpy."""

from __future__ import annotations

import numpy as np

#: A sort key packs two ranks and an index into 63 bits.
BITS = 21
LIMIT = (1 << BITS) - 2


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8, at most LIMIT) sorted by their first ``depth`` bytes.

    Groups of suffixes that agree in h bytes carry their first place as rank;
    each step sorts only the groups of more than one member by the rank h
    places on, which doubles h.
    """
    n = len(text)
    if n > LIMIT:
        raise ValueError("shard too long")
    pad = np.zeros(n + 4, np.int64)
    pad[:n] = text.astype(np.int64) + 1
    h = min(4, depth)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key * 257 + pad[j : j + n]
    order = np.argsort(key, kind="stable")
    sa = order
    new = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    place = np.arange(n)
    head = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = head
    while h < depth:
        single = new & np.r_[new[1:], True]
        active = np.flatnonzero(~single)
        if not len(active):
            break
        step = min(h, depth - h)
        own = sa[active]
        first, second = rank[own], rank[np.minimum(own + step, n)] + 1
        packed = np.sort((first << (2 * BITS)) | (second << BITS) | np.arange(len(own)))
        moved = own[packed & ((1 << BITS) - 1)]
        pair = packed >> BITS
        sa[active] = moved
        differs = np.r_[True, pair[1:] != pair[:-1]]
        new[active] = differs
        rank[moved] = np.maximum.accumulate(np.where(differs, active, 0))
        h += step
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``sa``: bytes shared with the suffix before it, at most ``most``.

    Kasai's observation: if suffix i-1 stands behind j-1 and suffix i behind j,
    and the two bytes before them agree, the common prefix of i and j is one
    less than that of i-1 and j-1.  Only the other, irreducible places are
    compared; each hands its value on to the places that follow it.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.flatnonzero(before >= 0)
    if not len(i):
        return np.zeros(n, np.int64)
    j = before[i]
    i = i[(i == 0) | (j == 0) | (text[i - 1] != text[j - 1]) | (before[i - 1] != j - 1)]
    j = before[i]
    wide = np.zeros(n + 16, np.uint8)
    wide[:n] = text
    eight = np.lib.stride_tricks.as_strided(wide, (n + 8, 8), (1, 1))
    length = np.zeros(len(i), np.int64)
    room = n - np.maximum(i, j)
    live = np.arange(len(i))
    while len(live):
        same = eight[i[live] + length[live]] == eight[j[live] + length[live]]
        run = np.where(same.all(1), 8, same.argmin(1))
        length[live] += run
        live = live[(run == 8) & (length[live] < room[live])]
    value = np.zeros(n, np.int64)
    value[i] = np.minimum(length, room)
    source = np.zeros(n, np.int64)
    source[i] = i
    source = np.maximum.accumulate(source)
    prefix = value[source] - (np.arange(n) - source)
    return np.where(before >= 0, np.clip(prefix, 0, most), 0)[sa]


def repeated(text: np.ndarray, eligible: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, class) of the eligible suffixes in suffix order; one class for equal first ``n`` bytes."""
    sa = suffix_array(text, n)
    kind = np.cumsum(common_prefixes(text, sa, n) < n)
    keep = eligible[sa]
    return sa[keep], kind[keep]
