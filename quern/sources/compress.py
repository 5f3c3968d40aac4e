"""Compression by name: none, gzip, snappy and zstd, and codecs that users register."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codec numbers on the wire.
NONE, GZIP, SNAPPY, ZSTD = range(4)
NAMES = {NONE: "none", GZIP: "gzip", SNAPPY: "snappy", ZSTD: "zstd"}


def _sized(name: str):
    """pyarrow's raw codecs need the size; it goes in front."""
    return (lambda b: len(b).to_bytes(8, "little") + pa.compress(b, name, asbytes=True)), (lambda b: pa.decompress(b[8:], int.from_bytes(b[:8], "little"), name, asbytes=True))


_codecs = {"none": (lambda b: b, lambda b: b), "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress), "snappy": _sized("snappy"), "zstd": _sized("zstd")}


def register(name: str, compress, decompress) -> None:
    _codecs[name] = (compress, decompress)


def codec(name: str):
    if name not in _codecs:
        raise ValueError(f"codec {name!r} is not known")
    return _codecs[name]


def _apply(col: Column, name: str, which: int, strict: bool = True) -> Column:
    f = codec(name)[which]

    def one(v: bytes | None) -> bytes | None:
        if not v:
            return v
        try:
            return f(v)
        except Exception:  # codecs, registered ones too, fail with errors of many kinds
            if strict:
                raise
            return None

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        return pa.array(map(one, x.to_pylist()), pa.binary())

    return run(col)


def compressed(col: Column, name: str) -> Column:
    """Empty and null values pass through."""
    return _apply(col, name, 0)


def decompressed(col: Column, name: str) -> Column:
    return _apply(col, name, 1)


def try_decompressed(col: Column, name: str) -> Column:
    """Null where the codec fails."""
    return _apply(col, name, 1, False)
