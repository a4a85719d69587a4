"""Which field names and values entities may hold, and the column type that holds them.

A field is a typed column where its values have one type; where entities disagree (a number here, text there), the
column is a VARIANT.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import types as T

from ..errors import InvalidDataType

FIELD = re.compile(r"[a-zA-Z][a-zA-Z0-9_]*\Z")
#: Columns that a graph's frames have besides fields.
SYSTEM = frozenset(("id", "src", "dst"))


def column_of(field: str) -> str:
    """The column that holds a field: fields that bear a system column's name, in any case, get the underscore that no
    field may end with."""
    return f"{field}_" if field.lower() in SYSTEM else field


def field_of(column: str) -> str:
    return column.removesuffix("_")


def check_name(name: object) -> None:
    if not isinstance(name, str) or not FIELD.match(name) or "__" in name or name.endswith("_"):
        raise InvalidDataType(f"invalid field name {name!r}")


def check_value(value: object) -> None:
    if isinstance(value, list):
        for v in value:
            check_value(v)
    elif isinstance(value, dict):
        check_data(value)
    elif value is not None and not isinstance(value, (bool, int, float, str)):
        raise InvalidDataType(f"invalid value of type {type(value).__name__}")


def check_data(data: object) -> None:
    if not isinstance(data, Mapping):
        raise InvalidDataType("data must be a dict")
    for k, v in data.items():
        check_name(k)
        check_value(v)


def _whole(t: T.DataType) -> T.DataType:
    """A type with a VARIANT anywhere inside is a VARIANT altogether."""
    inner = [t.elementType] if isinstance(t, T.ArrayType) else [f.dataType for f in t.fields] if isinstance(t, T.StructType) else []
    return T.VariantType() if any(isinstance(x, T.VariantType) for x in inner) else t


def type_of(values: Iterable[object]) -> T.DataType:
    """The one Spark type that holds all values; ints widen to double, dicts become structs."""
    found: T.DataType = T.NullType()
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            t: T.DataType = T.BooleanType()
        elif isinstance(v, int):
            t = T.LongType()
        elif isinstance(v, float):
            t = T.DoubleType()
        elif isinstance(v, str):
            t = T.StringType()
        elif isinstance(v, list):
            t = _whole(T.ArrayType(type_of(v)))
        else:
            t = _whole(T.StructType([T.StructField(k, type_of([x])) for k, x in v.items()]))
        found = widen(found, t)
    return found


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType() if any(isinstance(x, T.FractionalType) for x in (a, b)) else T.LongType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _whole(T.ArrayType(widen(a.elementType, b.elementType)))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.names, *b.names]))
        of = lambda s, n: s[n].dataType if n in s.names else T.NullType()
        return _whole(T.StructType([T.StructField(n, widen(of(a, n), of(b, n))) for n in names]))
    return T.VariantType()


def solid(t: T.DataType) -> T.DataType:
    """Types that Parquet can hold: a field that was never anything but null is a string."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(solid(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, solid(f.dataType)) for f in t.fields])
    return t
