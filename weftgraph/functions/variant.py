"""Fields whose entities disagree about the type: VARIANT columns, read by what each value is.

Spark's casts out of VARIANT coerce (text to numbers, numbers to text), so every reading is gated by the value's own
type first.
"""

from __future__ import annotations

import decimal
import json
from collections.abc import Mapping

from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .validate import field_of

_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"


def put(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """``col`` in a type that is as wide or wider."""
    if not isinstance(want, T.VariantType) or isinstance(have, (T.VariantType, T.NullType)):
        return col.cast(want)
    return F.to_variant_object(col) if isinstance(have, (T.ArrayType, T.MapType, T.StructType)) else col.cast(want)


def text_of(value: object) -> str:
    """JSON with keys in the order that VARIANT keeps them."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def constant(value: object) -> Column:
    return F.parse_json(F.lit(text_of(value)))


def number(col: Column) -> Column:
    """The value as a double where it is a number or a boolean, else null."""
    return F.when(F.schema_of_variant(col).rlike(_NUMBERS), F.try_variant_get(col, "$", "double"))


def whole(col: Column) -> Column:
    """The value as a long where it is an integer, else null."""
    return F.when(F.schema_of_variant(col) == "BIGINT", F.try_variant_get(col, "$", "bigint"))


def text(col: Column) -> Column:
    """The value where it is text, else null."""
    return F.when(F.schema_of_variant(col) == "STRING", F.try_variant_get(col, "$", "string"))


def items(col: Column) -> Column:
    """The value as an array of VARIANT where it is a list, else null."""
    return F.when(F.schema_of_variant(col).startswith("ARRAY"), F.try_variant_get(col, "$", "array<variant>"))


def keys(col: Column) -> Column:
    """The keys where the value is a dict, else null."""
    return F.when(F.schema_of_variant(col).startswith("OBJECT"), F.map_keys(F.try_variant_get(col, "$", "map<string,variant>")))


def sort_keys(col: Column) -> list[Column]:
    """Null, then numbers, then text, then the rest; nulls inside a key belong to other kinds."""
    kind = F.when(col.isNull(), 0).when(number(col).isNotNull(), 1).when(text(col).isNotNull(), 2).otherwise(3)
    return [kind, F.coalesce(number(col), F.lit(0.0)), F.coalesce(text(col), F.lit(""))]


def plain(value: object) -> object:
    """What Python code sees of a cell."""
    if isinstance(value, T.VariantVal):
        value = value.toPython()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def data_of(row: Row, hidden: frozenset[str] | set[str] = frozenset()) -> dict:
    """The fields that an entity has, by their columns; a null is an absent field."""
    return {field_of(k): plain(v) for k, v in row.asDict().items() if v is not None and k not in hidden}
