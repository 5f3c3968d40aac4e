"""Content-defined anchors over sequences of symbols (bytes or words).

A window is ``n`` consecutive symbols, a gram ``k`` of them.  The anchor of a
window is its leftmost gram of least hash, so equal windows have equal anchors
at equal offsets wherever they stand.  Consecutive windows with one anchor form
a run; its context is all symbols that these windows cover.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
POS_BITS = 20
PIECE = 1 << 19  # window starts handled at once: bounds memory for very long texts
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: A random odd-looking value for each byte.
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _powers[which] = tuple(made)
    up, down = _powers[which]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hashes:
    """Hashes of any range of ``values`` in constant time, by prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = powers(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = np.asarray(end - start).astype(U)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + mix(length))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def runs(values: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram hash, context hash) of every run of ``values``."""
    out = []
    for at in range(0, len(values) - n + 1, PIECE):
        v = values[at : at + PIECE + n - 1]
        one, two = Hashes(v, 0), Hashes(v, 1)
        i = np.arange(len(v) - k + 1)
        gram = one.of(i, i + k)
        least = sliding_min((gram >> U(POS_BITS) << U(POS_BITS)) | i.astype(U), n - k + 1)
        anchor = (least & U((1 << POS_BITS) - 1)).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut - 1, len(anchor) - 1]
        out.append((first + at, last + at, anchor[first] + at, gram[anchor[first]].view(np.int64), two.of(first, last + n).view(np.int64)))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def byte_values(text: bytes) -> np.ndarray:
    return BYTE_VALUES[np.frombuffer(text, np.uint8)]


def word_values(text: bytes) -> np.ndarray:
    """A hash of every word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 ``text``, in order."""
    raw = np.frombuffer(text, np.uint8)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_SPACE[raw]
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Hashes(BYTE_VALUES[raw]).of(start, end)
