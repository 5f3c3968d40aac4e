"""Zero-byte packing: a tag byte for each 8-byte word, then its non-zero bytes; runs of words are counted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.presence import little_endian
from quern.sources.columnar import Ragged, fixed, inside, of_array, of_bytes, pieces, to_array, word_at

#: Header: unpacked and packed size, 8 bytes each.
HEADER = 16
MOST = 255


class PackError(ValueError):
    pass


def _words(size: np.ndarray) -> np.ndarray:
    if (size % 8).any():
        raise PackError("length is not a multiple of 8")
    return size // 8


def _stretches(flag: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the maximal stretches of ``flag`` that cross no ``first`` word of a row."""
    start = np.flatnonzero(flag & (first | ~np.r_[False, flag[:-1]]))
    last = np.flatnonzero(flag & np.r_[first[1:] | ~flag[1:], True])
    return start, last + 1


def pack_all(rows: Ragged) -> Ragged:
    """Packed form of every row; nothing for nothing.

    A word's tag has a bit for each byte that is not zero.  A word of zeros, and
    one without zeros, takes the words after it along: up to MOST of zeros, or
    of at most one zero byte, which stay as they are.
    """
    count = _words(rows.size)
    words = rows.data.reshape(-1, 8)
    n = len(words)
    full = words != 0
    tags = np.packbits(full, axis=1, bitorder="little").ravel()
    filled = full.sum(1)
    first = np.zeros(n + 1, bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    first = first[:n]
    taken = np.zeros(n, np.int64)  # words that a word takes along
    alone = np.ones(n, bool)  # words with a tag of their own
    start, end = _stretches(tags == 0, first)
    zeros = tags == 0
    place = inside(end - start, np.zeros(len(start), np.int64))
    leads = np.zeros(n, bool)
    leads[zeros] = place % (MOST + 1) == 0
    alone[zeros] = leads[zeros]
    ends = np.repeat(end, end - start)
    at = np.flatnonzero(leads)
    taken[at] = np.minimum(MOST, ends[leads[zeros]] - at - 1)
    # from the first word without zeros of a stretch on, in rounds of as many words as one may take
    start, end = _stretches(filled > 6, first)
    whole = np.append(np.where(tags == 255, np.arange(n), n), n)
    coming = np.minimum.accumulate(whole[::-1])[::-1]
    while len(start):
        at = coming[start]
        live = at < end
        at, end = at[live], end[live]
        start = np.minimum(at + 1 + MOST, end)
        taken[at] = start - at - 1
        alone[inside(taken[at], at + 1)] = False
    counted = alone & ((tags == 0) | (tags == 255))
    literal = np.where(tags == 255, taken, 0)
    size = np.where(alone, 1 + filled + counted + 8 * literal, 0)
    row = np.repeat(np.arange(len(count)), count)
    body = np.bincount(row, size, len(count)).astype(np.int64)
    total = np.where(count > 0, body + HEADER, 0)
    out = np.empty(int(total.sum()), np.uint8)
    base = np.cumsum(total) - total
    some = count > 0
    fixed(out, base[some], rows.size[some].astype("<u8"))
    fixed(out, base[some] + 8, body[some].astype("<u8"))
    within = np.cumsum(size) - size
    before = np.cumsum(body) - body
    place = (base + HEADER - before)[row] + within
    out[place[alone]] = tags[alone]
    own = full & alone[:, None]
    rank = np.cumsum(full, axis=1)
    out[(place[:, None] + rank)[own]] = words[own]
    out[(place + 1 + filled)[counted]] = taken[counted]
    long = np.flatnonzero(literal)
    out[inside(8 * literal[long], place[long] + 10)] = words[inside(literal[long], long + 1)].ravel()
    return Ragged(total, out)


def unpack_all(rows: Ragged) -> Ragged:
    """The data of every packed row, one tag of all rows a step; PackError if one is not whole."""
    some = np.flatnonzero(rows.size)
    start = rows.start[some]
    if (rows.size[some] < HEADER).any():
        raise PackError("header is short")
    size, packed = word_at(rows.data, start).astype(np.int64), word_at(rows.data, start + 8).astype(np.int64)
    if (size % 8).any() or (size < 0).any() or (packed != rows.size[some] - HEADER).any():
        raise PackError("sizes do not agree")
    if (size > packed * 8 * (MOST + 1)).any():
        raise PackError("less data than stated")
    out = np.zeros(int(size.sum()), np.uint8)
    to = np.cumsum(size) - size
    stop, at = to + size, start + HEADER
    end = start + rows.size[some]
    data = np.append(rows.data, np.zeros(16, np.uint8))
    while True:
        live = at < end
        if not live.any():
            break
        if not live.all():
            if (to[~live] != stop[~live]).any():
                raise PackError("less data than stated")
            at, to, end, stop = at[live], to[live], end[live], stop[live]
        tag = data[at]
        bits = np.unpackbits(tag[:, None], axis=1, bitorder="little").astype(bool)
        used = np.bitwise_count(tag).astype(np.int64)
        if (at + 1 + used > end).any():
            raise PackError("data ends inside a word")
        if (to + 8 > stop).any():
            raise PackError("more data than stated")
        out[(to[:, None] + np.arange(8))[bits]] = data[(at[:, None] + np.cumsum(bits, axis=1))[bits]]
        at, to = at + 1 + used, to + 8
        run = np.flatnonzero((tag == 0) | (tag == 255))
        if len(run):
            if (at[run] >= end[run]).any():
                raise PackError("data ends before a count")
            span = data[at[run]].astype(np.int64) * 8
            at[run] += 1
            if (to[run] + span > stop[run]).any():
                raise PackError("more data than stated")
            whole = tag[run] == 255
            copied, width = run[whole], span[whole]
            if (at[copied] + width > end[copied]).any():
                raise PackError("data ends inside a run")
            out[inside(width, to[copied])] = data[inside(width, at[copied])]
            at[copied] += width
            to[run] += span
    if (to != stop).any():
        raise PackError("less data than stated")
    total = np.zeros(len(rows.size), np.int64)
    total[some] = size
    return Ragged(total, out)


def _one(f, data: bytes | None) -> bytes | None:
    return f(of_bytes([bytes(data)])).data.tobytes() if data else None


def pack(data: bytes | None) -> bytes | None:
    """Packed form with its header; nothing for nothing."""
    return _one(pack_all, data)


def unpack(data: bytes | None) -> bytes | None:
    return _one(unpack_all, data)


def _udf(f):
    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        return pa.concat_arrays(map(one, pieces(x))) if len(x) else pa.array([], pa.binary())

    def one(x: pa.Array) -> pa.Array:
        made = f(of_array(x))
        full = to_array(made, pa.binary())
        return full if made.size.all() else pc.if_else(pa.array(made.size > 0), full, pa.scalar(None, pa.binary()))

    return run


def packed(col: Column) -> Column:
    return _udf(pack_all)(col)


def unpacked(col: Column) -> Column:
    return _udf(unpack_all)(col)


def unpacked_size(col: Column) -> Column:
    """From the header, 0 if it is short; native."""
    return F.when(F.octet_length(col) >= HEADER, little_endian(col, 0, 7)).otherwise(0).cast("long")


def packed_size(col: Column) -> Column:
    return F.when(F.octet_length(col) >= HEADER, little_endian(col, 8, 7)).otherwise(0).cast("long")


def ratio(col: Column) -> Column:
    """Packed by unpacked size, 0 without data."""
    n = unpacked_size(col)
    return F.when(n > 0, packed_size(col) / n).otherwise(0.0)


def tag_of(word: Column) -> Column:
    """Tag of an 8-byte word given as 16 hex digits, native."""
    tag = F.lit(0)
    for i in range(8):
        tag = tag + F.when(F.substring(word, 2 * i + 1, 2) != "00", 1 << i).otherwise(0)
    return tag
