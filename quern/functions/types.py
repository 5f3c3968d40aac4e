"""Wire types: numbers, widths, zero values and Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Type numbers of the wire format, and bytes of a number in a list or map.
SCALARS = {"bool": 1, "int8": 2, "int16": 3, "int32": 4, "int64": 5, "uint8": 6, "uint16": 7, "uint32": 8, "uint64": 9, "float32": 10, "float64": 11, "string": 12, "bytes": 13}
STRUCT, ANY, LIST_BOOL, LIST_BYTES, LIST_STRING, LIST_STRUCT, MAP, LIST_ANY = 14, 15, 41, 52, 53, 54, 55, 56
WIDTH = {"bool": 1, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "float32": 4, "float64": 8}

#: Unsigned numbers widen, so that no value wraps.
_SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(),
}
ANY_TYPE = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("data", T.BinaryType())])


@dataclass(frozen=True)
class Ref:
    """A field's type: a scalar name, "enum", "struct", "any", "list" (of item) or "map" (key, item)."""

    kind: str
    name: str = ""
    item: Ref | None = None
    key: Ref | None = None
    width: str = ""  # of an enum: uint8 or uint16

    @property
    def scalar(self) -> str:
        """The scalar that carries the value, "" for composites."""
        return self.width if self.kind == "enum" else self.kind if self.kind in SCALARS else ""

    @property
    def type_id(self) -> int:
        if self.scalar:
            return SCALARS[self.scalar]
        if self.kind == "list":
            inner = self.item
            if inner.scalar:
                return {"bool": LIST_BOOL, "bytes": LIST_BYTES, "string": LIST_STRING}.get(inner.scalar) or LIST_BOOL + SCALARS[inner.scalar] - 1
            return LIST_ANY if inner.kind == "any" else LIST_STRUCT
        return {"struct": STRUCT, "any": ANY, "map": MAP}[self.kind]


def spark_type(ref: Ref, structs: dict[str, object] | None = None, depth: int = 3) -> T.DataType:
    """Spark's type of ``ref``; a struct inside itself is expanded ``depth`` times, then kept as bytes."""
    if ref.scalar:
        return _SPARK[ref.scalar]
    if ref.kind == "any":
        return ANY_TYPE
    if ref.kind == "list":
        return T.ArrayType(spark_type(ref.item, structs, depth))
    if ref.kind == "map":
        return T.MapType(spark_type(ref.key, structs, depth), spark_type(ref.item, structs, depth))
    if depth < 0:
        return T.BinaryType()
    return struct_type(structs[ref.name], structs, depth - 1)


def struct_type(struct, structs, depth: int = 3) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.ref, structs, depth), True, {"num": f.num}) for f in struct.fields])


def range_of(scalar: str) -> tuple[int, int] | None:
    """Smallest and largest value of an integer type."""
    if "int" not in scalar:
        return None
    bits = WIDTH[scalar] * 8
    return (0, 2**bits - 1) if scalar[0] == "u" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
