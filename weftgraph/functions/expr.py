"""The aggregation language: a whitelist of Python expression nodes compiled to a Column.

Numbers, ``+ - * / // **``, ``< <= > >= ==`` (chains fold from the left), ``a if c else b``, fields of the
current entity, ``_.alias.field`` (0 where missing) and ``field.sub`` (0 where missing).
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidExpression
from . import variant
from .validate import FIELD

Resolver = Callable[[str], tuple[Column, T.DataType] | None]


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, TypeError) as e:
        raise InvalidExpression(str(text)) from e


def names(node: ast.expr) -> tuple[set[str], set[tuple[str, str]]]:
    """Fields of the current entity, and (alias, field) pairs, that an expression reads."""
    fields, pairs = set(), set()
    for n in ast.walk(node):
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Attribute) and isinstance(n.value.value, ast.Name) and n.value.value.id == "_":
            pairs.add((n.value.attr, n.attr))
        elif isinstance(n, ast.Name) and n.id != "_":
            fields.add(n.id)
    return fields, pairs


def _as_number(v: tuple[Column, str]) -> tuple[Column, str]:
    return (v[0].cast("long"), "int") if v[1] == "bool" else v


def power(a: tuple[Column, str], b: tuple[Column, str]) -> tuple[Column, str]:
    """Whole powers, exact or an error: squares of the base, one for each binary digit of the exponent.

    An exponent of 64 or more leaves only 0, 1 and -1 within a long; a negative exponent is an error, as its value is no
    whole number.
    """
    base, n = a[0], b[0]
    out, square = F.lit(1).cast("long"), base
    for bit in range(6):
        out = F.when(F.shiftright(n, bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.try_multiply(out, square)).otherwise(out)
        square = F.try_multiply(square, square)
    small = F.when(base == 0, F.lit(0)).when(base == 1, F.lit(1)).when(base == -1, F.when(n % 2 == 0, 1).otherwise(-1))
    out = F.when(n < 64, out).otherwise(small.cast("long"))
    failed = F.raise_error(F.when(n < 0, F.lit("a negative exponent: write the base as a float")).otherwise(F.lit("a power beyond 64 bits"))).cast("long")
    return F.when(base.isNull() | n.isNull(), F.lit(None).cast("long")).when((n < 0) | out.isNull(), failed).otherwise(out), "int"


def _leaf(col: Column, t: T.DataType, what: str) -> tuple[Column, str]:
    if isinstance(t, T.BooleanType):
        return col, "bool"
    if isinstance(t, T.IntegralType):
        return col.cast("long"), "int"
    if isinstance(t, T.NumericType):
        return col.cast("double"), "float"
    if isinstance(t, T.VariantType):
        return variant.number(col), "float"
    raise InvalidExpression(f"{what} is no number")


def build(node: ast.expr, field: Resolver, alias: Callable[[str, str], tuple[Column, T.DataType] | None]) -> tuple[Column, str]:
    """The Column and its kind: int, float or bool."""

    def go(n: ast.expr) -> tuple[Column, str]:
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return F.lit(n.value).cast("long" if type(n.value) is int else "double"), type(n.value).__name__
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            c, k = _as_number(go(n.operand))
            return -c, k
        if isinstance(n, ast.BinOp):
            return binary(n.op, _as_number(go(n.left)), _as_number(go(n.right)))
        if isinstance(n, ast.Compare):
            return compare(n)
        if isinstance(n, ast.IfExp):
            c, k = go(n.test)
            yes, no = _as_number(go(n.body)), _as_number(go(n.orelse))
            kind = "float" if "float" in (yes[1], no[1]) else "int"
            to = "double" if kind == "float" else "long"
            return F.when(c if k == "bool" else c != 0, yes[0].cast(to)).otherwise(no[0].cast(to)), kind
        if isinstance(n, ast.Name):
            if n.id == "_" or not FIELD.match(n.id):
                raise InvalidExpression(n.id)
            found = field(n.id)
            if found is None:
                raise InvalidExpression(f"unknown field {n.id}")
            return _leaf(*found, n.id)
        if isinstance(n, ast.Attribute):
            return attribute(n)
        raise InvalidExpression(type(n).__name__)

    def attribute(n: ast.Attribute) -> tuple[Column, str]:
        if not FIELD.match(n.attr):
            raise InvalidExpression(n.attr)
        v = n.value
        if isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.value.id == "_" and FIELD.match(v.attr):
            found = alias(v.attr, n.attr)
        elif isinstance(v, ast.Name) and v.id != "_" and FIELD.match(v.id):
            outer = field(v.id)
            if outer is None:
                raise InvalidExpression(f"unknown field {v.id}")
            t = outer[1]
            found = (outer[0][n.attr], t[n.attr].dataType) if isinstance(t, T.StructType) and n.attr in t.names else (F.try_element_at(outer[0], F.lit(n.attr)), t.valueType) if isinstance(t, T.MapType) else None
        else:
            raise InvalidExpression(n.attr)
        if found is None:
            return F.lit(0).cast("long"), "int"
        c, k = _as_number(_leaf(*found, n.attr))
        return F.coalesce(c, F.lit(0)), k

    def binary(op: ast.operator, a: tuple[Column, str], b: tuple[Column, str]) -> tuple[Column, str]:
        whole = a[1] == b[1] == "int"
        if isinstance(op, ast.Add):
            return a[0] + b[0], "int" if whole else "float"
        if isinstance(op, ast.Sub):
            return a[0] - b[0], "int" if whole else "float"
        if isinstance(op, ast.Mult):
            return a[0] * b[0], "int" if whole else "float"
        if isinstance(op, ast.Div):
            return a[0].cast("double") / b[0].cast("double"), "float"
        if isinstance(op, ast.FloorDiv):
            if whole:  # exact for longs: the remainder's sign tells whether truncation went up
                q = F.call_function("div", a[0], b[0])
                return q - F.when((a[0] % b[0] != 0) & ((a[0] < 0) != (b[0] < 0)), 1).otherwise(0), "int"
            return F.floor(a[0] / b[0]).cast("double"), "float"
        if isinstance(op, ast.Pow):
            return power(a, b) if whole else (F.pow(a[0].cast("double"), b[0].cast("double")), "float")
        raise InvalidExpression(type(op).__name__)

    def compare(n: ast.Compare) -> tuple[Column, str]:
        how = {ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__, ast.Eq: Column.__eq__}
        left = go(n.left)
        for op, right in zip(n.ops, n.comparators, strict=True):
            if type(op) not in how:
                raise InvalidExpression(type(op).__name__)
            left = (how[type(op)](_as_number(left)[0], _as_number(go(right))[0]), "bool")
        return left

    return _as_number(go(node))
