"""Whole Arrow batches of records to and from their binary form, in numpy.

Values of a batch are handled column by column.  What differs in length is a
``Ragged``: all bytes in one buffer, row after row, and a size for each row.
Reading goes in lockstep: one step looks at the next stored field (or list
item) of every record at once.  Maps and polymorphic values, whose form depends
on each value, are left to the row functions of ``binary``.
"""

from __future__ import annotations

import struct as _struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.functions.schema import Schema, Struct
from quern.functions.types import LIST_ANY, LIST_BOOL, MAP, SCALARS, STRUCT, WIDTH, Ref, range_of

_DTYPE = {"bool": "u1", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float32": "<f4", "float64": "<f8"}
U = np.uint64


@dataclass
class Ragged:
    size: np.ndarray
    data: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def inside(size: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For rows of ``size`` bytes: the place of every byte, rows beginning at ``base``."""
    return np.repeat(base - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def gathered(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> Ragged:
    return Ragged(size, buf[inside(size, at)])


def put(out: np.ndarray, at: np.ndarray, part: Ragged) -> None:
    out[inside(part.size, at)] = part.data


def fixed(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Write the bytes of each item of ``rows`` from its place in ``at`` on."""
    if not len(at):
        return
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(at), -1)
    for k in range(raw.shape[1]):
        out[at + k] = raw[:, k]


#: Bytes of a batch that are worked on at once; places of bytes take eight times that.
PIECE = 8 << 20


def pieces(batch):
    """A batch or array in slices of about PIECE bytes, a row at least."""
    n = batch.num_rows if isinstance(batch, pa.RecordBatch) else len(batch)
    rows = max(1, PIECE // (batch.nbytes // max(n, 1) + 1))
    for at in range(0, n, rows):
        yield batch.slice(at, rows)


def of_bytes(values: list[bytes]) -> Ragged:
    return Ragged(np.fromiter(map(len, values), np.int64, len(values)), np.frombuffer(b"".join(values), np.uint8))


def of_array(arr: pa.Array) -> Ragged:
    """The bytes of a string or binary array; null is empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if not len(arr):
        return Ragged(np.zeros(0, np.int64), np.zeros(0, np.uint8))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Ragged(np.diff(at), raw[at[0] : at[-1]])


def to_array(part: Ragged, kind: pa.DataType) -> pa.Array:
    if part.size.sum() > 2**31 - 1:
        raise ValueError("a batch holds over 2 GiB of text")
    at = np.zeros(len(part.size) + 1, np.int32)
    np.cumsum(part.size, out=at[1:])
    arr = pa.Array.from_buffers(kind, len(part.size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(part.data))])
    if pa.types.is_string(kind):
        arr.validate(full=True)
    return arr


# Writing


def numbers_of(arr: pa.Array, scalar: str) -> np.ndarray:
    """The values of a number column in their wire width; null is zero; values out of range are refused."""
    from .binary import RecordError

    n = len(arr)
    if pa.types.is_decimal(arr.type):
        arr = arr.cast(pa.decimal128(20, 0))
        arr = pc.fill_null(arr, 0) if arr.null_count else arr
        low, high = np.frombuffer(arr.buffers()[1], np.int64).reshape(-1, 2)[arr.offset : arr.offset + n].T if n else (np.zeros(0, np.int64),) * 2
        if high.any():
            raise RecordError(f"a value is no {scalar}")
        return low.astype(_DTYPE[scalar])
    if arr.null_count:
        arr = pc.fill_null(arr, False if pa.types.is_boolean(arr.type) else 0)
    values = arr.to_numpy(zero_copy_only=False)
    limits = range_of(scalar)
    if limits and n and (int(values.min()) < limits[0] or int(values.max()) > limits[1]):
        raise RecordError(f"a value is no {scalar}")
    return values.astype(_DTYPE[scalar])


def heads(num, type_id: int, payload: np.ndarray) -> np.ndarray:
    from .binary import RecordError

    payload = np.asarray(payload).astype(U)
    if len(payload) and payload.max() >= 1 << 40:
        raise RecordError("payload exceeds 40 bits")
    return (np.asarray(num).astype(U) & U(0xFFFF)) | U(type_id << 16) | payload << U(24)


def _lists(arr: pa.Array) -> tuple[np.ndarray, pa.Array]:
    size = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, arr.flatten()


def _sum_by(size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive groups of ``size`` items."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(size)
    return total[end] - total[end - size]


def _framed(num: int, type_id: int, payload: np.ndarray, body: Ragged, tail: np.ndarray | None = None) -> Ragged:
    """Fields of a header and a body each; rows without a body have no field; ``tail`` bytes of padding."""
    from .binary import padding_byte

    there = body.size > 0
    pad = np.zeros(len(body.size), np.int64) if tail is None else tail
    size = np.where(there, 8 + body.size + pad, 0)
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    fixed(out, at[there], heads(num, type_id, payload[there]))
    put(out, at + 8, body)
    if tail is not None and padding_byte(type_id):
        long = there & (pad >= 4)
        out[inside(pad[long], (at + 8 + body.size)[long])] = padding_byte(type_id)
    return Ragged(size, out)


def _lengths(items: Ragged) -> Ragged:
    """Each item after its size in four bytes."""
    size = items.size + 4
    out = np.empty(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    fixed(out, at, items.size.astype("<u4"))
    put(out, at + 4, items)
    return Ragged(size, out)


def field(num: int, arr: pa.Array, ref: Ref, schema: Schema) -> Ragged:
    """The stored field of every row, empty where it is absent."""
    t, n = ref.type_id, len(arr)
    if ref.scalar in ("string", "bytes"):
        body = of_array(arr)
        return _framed(num, t, body.size, body, -body.size % 8)
    if ref.scalar:
        v = numbers_of(arr, ref.scalar)
        there = v != 0
        own = v[there]
        if WIDTH[ref.scalar] == 8:
            words = np.stack([heads(num, t, np.zeros(len(own))), own.view("<u8")], 1).ravel()
            return Ragged(there * 16, words.view(np.uint8))
        return Ragged(there * 8, heads(num, t, own.view(f"<u{WIDTH[ref.scalar]}")).view(np.uint8))
    if ref.kind == "struct":
        child = records(arr.flatten(), n, schema.structs[ref.name], schema, np.full(n, num))
        keep = pc.is_valid(arr).to_numpy(zero_copy_only=False) & (child.size > 8)
        return Ragged(child.size * keep, child.data[np.repeat(keep, child.size)])
    if ref.kind == "list" and ref.item.kind not in ("any", "map", "list"):
        count, items = _lists(arr)
        item = ref.item
        if items.null_count and item.kind != "struct":
            from .binary import RecordError

            raise RecordError("a list has null items")
        if item.scalar == "bool":
            width = -(-count // 64) * 8
            bits = np.zeros(int(width.sum()) * 8, np.uint8)
            bits[inside(count, (np.cumsum(width) - width) * 8)] = numbers_of(items, "bool")
            return _framed(num, t, count, Ragged(width, np.packbits(bits, bitorder="little")))
        if item.scalar in ("string", "bytes"):
            made = _lengths(of_array(items))
            size = _sum_by(count, made.size)
            pad = -size % 8
            return _framed(num, t, 8 + size + pad, Ragged(size, made.data), pad)
        if item.scalar:
            size = count * WIDTH[item.scalar]
            return _framed(num, t, 8 + size, Ragged(size, numbers_of(items, item.scalar).view(np.uint8)))
        place = np.arange(len(items)) - np.repeat(np.cumsum(count) - count, count)
        made = records(items.flatten(), len(items), schema.structs[item.name], schema, place)
        size = _sum_by(count, made.size)
        return _framed(num, t, 8 + size, Ragged(size, made.data))
    from . import binary

    return of_bytes([binary._field(num, v, ref, schema) for v in arr.to_pylist()])


def records(columns: list[pa.Array], n: int, struct: Struct, schema: Schema, num: np.ndarray | int = 0) -> Ragged:
    """The records of ``n`` rows, whose headers carry ``num``; ``columns`` are the struct's fields in order."""
    parts = [field(f.num, c, f.ref, schema) for f, c in zip(struct.fields, columns, strict=True)]
    size = np.full(n, 8, np.int64)
    for p in parts:
        size += p.size
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    fixed(out, at, heads(np.broadcast_to(num, n), STRUCT, size))
    at = at + 8
    for p in parts:
        even = p.size[0] if len(p.size) and (p.size == p.size[0]).all() else 0
        if 0 < even <= 16:
            fixed(out, at, p.data.reshape(n, -1))
        else:
            put(out, at, p)
        at = at + p.size
    return Ragged(size, out)


# Reading


def word_at(buf: np.ndarray, at: np.ndarray, width: int = 8) -> np.ndarray:
    raw = np.empty((len(at), width), np.uint8)
    for k in range(width):
        raw[:, k] = buf[at + k]
    return raw.view(f"<u{width}").ravel()


def _extents(buf: np.ndarray, at: np.ndarray, kind: np.ndarray, payload: np.ndarray, raw: bytes) -> np.ndarray:
    """Bytes of the stored fields at ``at``; types unknown to the schema are skipped by size."""
    from . import binary

    out = payload.copy()
    eight = (kind == SCALARS["int64"]) | (kind == SCALARS["uint64"]) | (kind == SCALARS["float64"])
    out[kind <= SCALARS["float64"]] = 8
    out[eight] = 16
    text = (kind == SCALARS["string"]) | (kind == SCALARS["bytes"])
    out[text] = (8 + payload + -payload % 8)[text]
    bits = kind == LIST_BOOL
    out[bits] = (8 + -(-payload // 64) * 8)[bits]
    maps = kind == MAP
    out[maps] = payload[maps] >> 16
    for i in np.flatnonzero(kind == LIST_ANY):
        out[i] = binary._extent(raw, int(at[i]), LIST_ANY)
    return out


def read(buf: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray, struct: Struct, schema: Schema, shape, fields: set[str] | None) -> dict[str, pa.Array]:
    """Arrays of the wanted fields (Arrow types by ``shape``) of the records that lie at [start, stop)."""
    from . import binary
    from .binary import RecordError

    names = None if fields is None else {f.split(".", 1)[0] for f in fields}
    wanted = [f for f in struct.fields if names is None or f.name in names]
    n = len(start)
    found = {f.num: (np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)) for f in wanted}
    kinds = {f.num: f.ref.type_id for f in wanted}
    row, at = np.arange(n), start + 8
    while True:
        live = at + 8 <= stop[row]
        live[live] = buf[at[live] + 2] != 0
        if not live.all():
            row, at = row[live], at[live]
        if not len(row):
            break
        head = word_at(buf, at)
        num, kind, payload = (head & U(0xFFFF)).astype(np.int64), (head >> U(16) & U(0xFF)).astype(np.int64), (head >> U(24)).astype(np.int64)
        extent = _extents(buf, at, kind, payload, raw)
        if (extent <= 0).any() or (at + extent > stop[row]).any():
            raise RecordError("field runs over its record")
        for k in np.unique(num).tolist():
            if k in found:
                m = (num == k) & (kind == kinds[k])
                place, size, value = found[k]
                place[row[m]], size[row[m]], value[row[m]] = at[m], extent[m], payload[m]
        at = at + extent
    out = {}
    for f in wanted:
        inner = None if fields is None or f.name in fields else {x.split(".", 1)[1] for x in fields if x.startswith(f.name + ".")}
        out[f.name] = _column(buf, raw, *found[f.num], f.ref, schema, shape.field(f.name).type, inner)
    return out


def _numbers(values: np.ndarray, scalar: str, kind: pa.DataType) -> pa.Array:
    if scalar == "uint64":
        pair = np.zeros((len(values), 2), np.uint64)
        pair[:, 0] = values
        return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(pair)])
    return pa.array(values != 0 if scalar == "bool" else values).cast(kind)


def _listed(count: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values, type=kind)


def _walk(buf: np.ndarray, at: np.ndarray, stop: np.ndarray, step):
    """(row, place, size) of the items of every list, by row; ``step`` tells the sizes of headers at given places, or -1 to end."""
    rows, places, sizes = [], [], []
    row = np.arange(len(at))
    while len(row):
        skip, size = step(at, stop)
        live = size >= 0
        row, at, stop, size = row[live], at[live], stop[live], size[live]
        rows.append(row)
        places.append(at + skip)
        sizes.append(size)
        at = at + skip + size
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(places)[order], np.concatenate(sizes)[order]


def _column(buf, raw: bytes, place, size, payload, ref: Ref, schema: Schema, kind: pa.DataType, inner) -> pa.Array:
    from . import binary
    from .binary import RecordError

    there = place >= 0
    at, n = place[there], len(place)
    if ref.scalar in ("string", "bytes"):
        return to_array(gathered(buf, np.where(there, place + 8, 0), np.where(there, payload, 0)), kind)
    if ref.scalar:
        values = np.zeros(n, _DTYPE[ref.scalar])
        width = WIDTH[ref.scalar]
        own = word_at(buf, at + 8) if width == 8 else payload[there].astype(f"<u{width}")
        values[there] = own.view(_DTYPE[ref.scalar])
        return _numbers(values, ref.scalar, kind)
    if ref.kind == "struct":
        parts = read(buf, raw, at, at + size[there], schema.structs[ref.name], schema, _Fields(kind), inner)
        take = pa.array(np.cumsum(there) - 1, mask=~there)
        return _structs({k: p.take(take) for k, p in parts.items()}, n, kind, pa.array(~there))
    if ref.kind == "list" and ref.item.kind not in ("any", "map", "list"):
        item, count = ref.item, np.zeros(n, np.int64)
        if item.scalar == "bool":
            count[there] = payload[there]
            bits = np.unpackbits(gathered(buf, at + 8, -(-payload[there] // 8)).data, bitorder="little")
            width = -(-payload[there] // 8) * 8
            return _listed(count, pa.array(bits[inside(payload[there], np.cumsum(width) - width)] != 0), kind)
        if item.scalar and item.scalar not in ("string", "bytes"):
            count[there] = (payload[there] - 8) // WIDTH[item.scalar]
            data = gathered(buf, at + 8, count[there] * WIDTH[item.scalar]).data
            return _listed(count, _numbers(data.view(_DTYPE[item.scalar]), item.scalar, kind.value_type), kind)
        stop = at + size[there]
        if item.scalar:

            def step(p, end):
                got = np.full(len(p), -1, np.int64)
                room = p + 4 <= end
                got[room] = word_at(buf, p[room], 4).astype(np.int64)
                return 4, np.where(p + 4 + got <= end, got, -1)

            row, p, length = _walk(buf, at + 8, stop, step)
            values = to_array(gathered(buf, p, length), kind.value_type)
        else:

            def step(p, end):
                got = np.full(len(p), -1, np.int64)
                room = p < end
                if (p[room] + 8 > end[room]).any():
                    raise RecordError("list item runs over its list")
                got[room] = (word_at(buf, p[room]) >> U(24)).astype(np.int64)
                if (got[room] < 8).any() or (p[room] + got[room] > end[room]).any():
                    raise RecordError("list item runs over its list")
                return 0, got

            row, p, length = _walk(buf, at + 8, stop, step)
            parts = read(buf, raw, p, p + length, schema.structs[item.name], schema, _Fields(kind.value_type), inner)
            values = _structs(parts, len(p), kind.value_type)
        count[there] = np.bincount(row, minlength=len(at))
        return _listed(count, values, kind)
    empty = binary.empty(ref, schema)
    values = [binary._value(raw, p, p + s, ref, schema, inner) if p >= 0 else empty for p, s in zip(place.tolist(), size.tolist(), strict=True)]
    return pa.array(values, kind)


def _structs(parts: dict[str, pa.Array], n: int, kind: pa.DataType, absent: pa.Array | None = None) -> pa.Array:
    """A struct array; fields that were not asked for are null."""
    own = [kind.field(i) for i in range(kind.num_fields)]
    return pa.StructArray.from_arrays([parts[f.name] if f.name in parts else pa.nulls(n, f.type) for f in own], fields=own, mask=absent)


class _Fields:
    """A struct type asked for its fields like a schema."""

    def __init__(self, kind: pa.DataType):
        self.kind = kind

    def field(self, name: str) -> pa.Field:
        return self.kind.field(self.kind.get_field_index(name))


def encode(batch: pa.RecordBatch, struct: Struct, schema: Schema) -> pa.Array:
    """A binary array: the record of every row."""
    made = records([batch.column(batch.schema.get_field_index(f.name)) for f in struct.fields], batch.num_rows, struct, schema)
    return to_array(made, pa.binary())


def decode(column: pa.Array, struct: Struct, schema: Schema, shape: pa.Schema, fields: set[str] | None) -> list[pa.Array]:
    """Arrays of the wanted fields; RecordError if a value is no whole record."""
    from .binary import RecordError

    part = of_array(column)
    start = part.start
    if (part.size < 8).any():
        raise RecordError("not a whole record")
    head = word_at(part.data, start)
    size = (head >> U(24)).astype(np.int64)
    if ((head >> U(16) & U(0xFF)) != STRUCT).any() or (size < 8).any() or (size > part.size).any():
        raise RecordError("not a whole record")
    try:
        return list(read(part.data, part.data.tobytes(), start, start + size, struct, schema, shape, fields).values())
    except (_struct.error, IndexError) as e:
        raise RecordError(f"a value runs over its record: {e}") from e
