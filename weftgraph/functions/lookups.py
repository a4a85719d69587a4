"""Keyword predicates (``field__lookup=value``) compiled to Columns by the column's type.

Python's rules hold: null fails everything but ``isnull``, bool equals int, and comparisons of
unlike types match nothing. No implicit cast of Spark's is ever relied on.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidLookup, SubLookupNotImplemented
from . import variant
from .validate import column_of

LOOKUPS = frozenset("exact iexact contains icontains in gt gte lt lte startswith istartswith endswith iendswith isnull".split())


def parse(key: str) -> tuple[str, str]:
    """Field and lookup; ``_id`` is a field."""
    if key == "_id" or key.startswith("_id__"):
        parts = ["_id", *key[5:].split("__")] if len(key) > 3 else ["_id"]
    else:
        parts = key.split("__")
    if len(parts) > 2:
        raise SubLookupNotImplemented(key)
    lookup = parts[1] if len(parts) == 2 else "exact"
    if lookup not in LOOKUPS:
        raise InvalidLookup(lookup)
    return parts[0], lookup


def _number(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def _plain(col: Column, t: T.DataType) -> Column:
    return col.cast("int") if isinstance(t, T.BooleanType) else col


def _ok(col: Column, t: T.DataType) -> Column:
    return ~F.isnan(col) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(True)


def exact(col: Column, t: T.DataType, v: object) -> Column:
    if v is None or (isinstance(v, float) and v != v):
        return F.lit(False)
    if isinstance(t, T.VariantType):
        return _variant_exact(col, v)
    if isinstance(v, (bool, int, float)):
        if not _number(t):
            return F.lit(False)
        n = int(v) if isinstance(v, bool) else v
        if isinstance(n, int) and not -(2**63) <= n < 2**63:
            return F.lit(False)
        return (_plain(col, t) == F.lit(n)) & _ok(col, t)
    if isinstance(v, str):
        return col == F.lit(v) if isinstance(t, T.StringType) else F.lit(False)
    if isinstance(v, (list, tuple)):
        if not isinstance(t, T.ArrayType) or isinstance(v, tuple):
            return F.lit(False)
        same = [_same(col[i], t.elementType, x) for i, x in enumerate(v)]
        return F.when(F.size(col) == len(v), reduce(Column.__and__, same, F.lit(True))).otherwise(False) & col.isNotNull()
    if isinstance(v, Mapping):
        if isinstance(t, T.MapType):
            each = [_same(F.try_element_at(col, F.lit(k)), t.valueType, x) for k, x in v.items()]
            return col.isNotNull() & (F.size(F.map_keys(col)) == len(v)) & reduce(Column.__and__, each, F.lit(True))
        if isinstance(t, T.StructType) and set(v) <= set(t.names):
            each = [_same(col[f.name], f.dataType, v.get(f.name)) for f in t.fields]
            return col.isNotNull() & reduce(Column.__and__, each, F.lit(True))
    return F.lit(False)


def _variant_exact(col: Column, v: object) -> Column:
    if isinstance(v, (bool, int, float)):
        if isinstance(v, int) and -(2**63) <= v < 2**63:
            return F.coalesce(variant.whole(col) == int(v), variant.number(col) == float(v), F.lit(False))
        return F.coalesce(variant.number(col) == float(v), F.lit(False))
    if isinstance(v, str):
        return F.coalesce(variant.text(col) == v, F.lit(False))
    return F.coalesce(F.to_json(col) == variant.text_of(v), F.lit(False)) if isinstance(v, (list, Mapping)) else F.lit(False)


def _same(col: Column, t: T.DataType, v: object) -> Column:
    """Inside structures null equals null."""
    return col.isNull() if v is None else F.coalesce(exact(col, t, v), F.lit(False))


def _order(col: Column, t: T.DataType, v: object, op: str) -> Column:
    how = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}[op]
    if isinstance(t, T.VariantType):
        if isinstance(v, (bool, int, float)) and v == v:
            return F.coalesce(how(variant.number(col), F.lit(float(v))), F.lit(False))
        return F.coalesce(how(variant.text(col), F.lit(v)), F.lit(False)) if isinstance(v, str) else F.lit(False)
    if isinstance(v, (bool, int, float)) and _number(t) and v == v:
        return how(_plain(col, t), F.lit(int(v) if isinstance(v, bool) else v)) & _ok(col, t)
    if isinstance(v, str) and isinstance(t, T.StringType):
        return how(col, F.lit(v))
    if isinstance(v, list) and isinstance(t, T.ArrayType) and v:
        kinds = {str: T.StringType, int: T.IntegralType, float: T.NumericType}
        if all(isinstance(t.elementType, kinds.get(type(x), ())) for x in v):
            return how(col, F.array(*map(F.lit, v)).cast(t))
    return F.lit(False)


def _contains(col: Column, t: T.DataType, v: object) -> Column:
    if isinstance(t, T.VariantType):
        found = F.exists(variant.items(col), lambda x: _variant_exact(x, v)) if v is not None else F.lit(False)
        if isinstance(v, str):
            return F.coalesce(variant.text(col).contains(v), F.array_contains(variant.keys(col), v), found, F.lit(False))
        return F.coalesce(found, F.lit(False))
    if isinstance(t, T.StringType):
        return col.contains(F.lit(v)) if isinstance(v, str) else F.lit(False)
    if isinstance(t, T.ArrayType):
        if v is None:
            return F.exists(col, lambda x: x.isNull())
        return F.exists(col, lambda x: F.coalesce(exact(x, t.elementType, v), F.lit(False)))
    if isinstance(t, T.MapType):
        return F.map_contains_key(col, F.lit(v)) if isinstance(v, str) and isinstance(t.keyType, T.StringType) else F.lit(False)
    if isinstance(t, T.StructType):
        return col[v].isNotNull() if isinstance(v, str) and v in t.names else F.lit(False)
    return F.lit(False)


def _within(col: Column, t: T.DataType, v: object) -> Column:
    if isinstance(v, str):
        col = variant.text(col) if isinstance(t, T.VariantType) else col
        return F.coalesce(F.lit(v).contains(col), F.lit(False)) if isinstance(t, (T.StringType, T.VariantType)) else F.lit(False)
    if not isinstance(v, (list, tuple, set, frozenset, Mapping)):
        return F.lit(False)
    values = list(v)
    if isinstance(t, T.StringType):
        values = [x for x in values if isinstance(x, str)]
        return col.isin(values) if values else F.lit(False)
    if isinstance(t, T.IntegralType):
        whole = [int(x) for x in values if isinstance(x, (bool, int, float)) and x == x and abs(x) < 2**63 and x == int(x)]
        return col.isin(whole) if whole else F.lit(False)
    return reduce(Column.__or__, [exact(col, t, x) for x in values], F.lit(False))


def predicate(col: Column | None, t: T.DataType | None, lookup: str, v: object) -> Column:
    """``col`` is None for a field that no entity has."""
    if lookup == "isnull":
        if isinstance(v, (bool, int, float)) and v in (0, 1):
            return (F.lit(True) if v else F.lit(False)) if col is None else col.isNull() if v else col.isNotNull()
        return F.lit(False)
    if col is None:
        return F.lit(False)
    if lookup == "exact":
        return exact(col, t, v)
    if lookup == "in":
        return _within(col, t, v)
    if lookup in ("gt", "gte", "lt", "lte"):
        return _order(col, t, v, lookup)
    if lookup == "contains":
        return _contains(col, t, v)
    if not isinstance(t, (T.StringType, T.VariantType)) or not isinstance(v, str):
        return F.lit(False)
    col = variant.text(col) if isinstance(t, T.VariantType) else col
    fold = lookup.startswith("i")
    own, other, name = (F.lower(col), F.lower(F.lit(v)), lookup[1:]) if fold else (col, F.lit(v), lookup)
    return {"exact": lambda: own == other, "contains": lambda: own.contains(other), "startswith": lambda: own.startswith(other), "endswith": lambda: own.endswith(other)}[name]()


def condition(schema: T.StructType, filters: Mapping[str, object], reserved: frozenset[str] = frozenset()) -> Column | None:
    """All filters together; errors in keys surface here, when the plan is built."""
    out = []
    for key, value in filters.items():
        field, lookup = parse(key)
        name = "id" if field == "_id" else column_of(field)
        known = name in schema.names and (field == "_id" or name not in reserved)
        out.append(predicate(F.col(name) if known else None, schema[name].dataType if known else None, lookup, value))
    return reduce(Column.__and__, out) if out else None
