"""Scalar functions and operators of the dialect as Spark columns.

A value is a ``Typed``: a column and its kind (string, long, double, bool, json or
null).  Kinds decide at planning time what Spark would only find at run time:
comparisons across kinds, arithmetic on what isn't a number, total conversions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sql.ast import SqlError


class Typed(NamedTuple):
    col: Column
    kind: str


NUMBERS = ("long", "double")
LEAST = -(1 << 63)
SPARK = {"string": "string", "long": "bigint", "double": "double", "bool": "boolean", "json": "string", "timestamp": "bigint", "null": "string"}


def null(kind: str = "null") -> Typed:
    return Typed(F.lit(None).cast(SPARK[kind]), kind)


def literal(value) -> Typed:
    if value is None:
        return null()
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "long")
    if isinstance(value, float):
        return Typed(F.lit(value), "double")
    return Typed(F.lit(value), "string")


def leaf_number(x: Typed) -> Typed:
    """A JSON leaf as a number if it is one; JSON text of numbers starts with a digit or a sign."""
    if x.kind == "variant":
        number = F.schema_of_variant(x.col).rlike("^(BIGINT|DOUBLE|DECIMAL)")
        return Typed(F.when(number, F.try_variant_get(x.col, "$", "double")), "double")
    if x.kind != "json":
        return x
    return Typed(F.when(x.col.rlike(r"^-?\d"), x.col.try_cast("double")), "double")


def plain(x: Typed) -> Typed:
    """A variant as the text of its JSON value."""
    return Typed(F.to_json(x.col), "json") if x.kind == "variant" else x


def guard_json(op: str, a: Typed, b: Typed) -> None:
    if {"json", "variant"} & {a.kind, b.kind}:
        raise SqlError(f"A JSON value can't stand in '{op}'; take a value out of it with ->> first")


def negate(x: Typed) -> Typed:
    """The least whole number is its own negation."""
    return Typed(F.when(x.col == LEAST, x.col).otherwise(-x.col) if x.kind == "long" else -x.col, x.kind)


def wrapped_sum(total, value: Column) -> Column:
    """The sum of whole numbers modulo 2^64; ``total`` sums a column.  Parts of 21 bits don't overflow below 2^42 rows."""
    parts = [value.bitwiseAND((1 << 21) - 1), F.shiftright(value, 21).bitwiseAND((1 << 21) - 1), F.shiftright(value, 42)]
    low, middle, high = (F.coalesce(total(p), F.lit(0).cast("bigint")).cast("decimal(38,0)") for p in parts)
    exact = (low + (middle * F.lit(1 << 21).cast("decimal(8,0)")).cast("decimal(38,0)")).cast("decimal(38,0)")
    exact = (exact + (high * F.lit(1 << 42).cast("decimal(14,0)")).cast("decimal(38,0)")).cast("decimal(38,0)")
    return wrap(exact)


def wrap(exact: Column) -> Column:
    half, full = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    return (F.pmod(exact + half, full) - half).cast("bigint")


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = leaf_number(a), leaf_number(b)
    if op == "/":
        if a.kind not in NUMBERS or b.kind not in NUMBERS:
            return null("double")
        return Typed(F.try_divide(a.col.cast("double"), b.col.cast("double")), "double")
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return null("long")
    kind = "double" if "double" in (a.kind, b.kind) else "long"
    x, y = (c.col.cast(SPARK[kind]) for c in (a, b))
    if op == "%":
        return Typed(F.when(y != 0, F.try_mod(x, y)), kind)
    if kind == "double":
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op], kind)
    # Whole numbers wrap; in wider decimals the remainder of 2^64 is exact.
    wide = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    dx, dy = x.cast("decimal(38,0)"), y.cast("decimal(38,0)")
    exact = {"+": dx + dy, "-": dx - dy, "*": dx * dy}[op]
    return Typed(F.when(wide.isNotNull() | x.isNull() | y.isNull(), wide).otherwise(wrap(exact.cast("decimal(38,0)"))), "long")


def compare(op: str, a: Typed, b: Typed) -> Typed:
    """NULL with NULL; numbers as doubles; across kinds = is FALSE and < is NULL."""
    if "null" in (a.kind, b.kind):
        return null("bool")
    ka, kb = ("number" if k in NUMBERS else k for k in (a.kind, b.kind))
    if ka != kb:
        if op in ("=", "!="):
            return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!=")), "bool")
        return null("bool")
    x, y = a.col, b.col
    if a.kind != b.kind:
        x, y = x.cast("double"), y.cast("double")
    out = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Typed(out, "bool")


def truth(x: Typed) -> Column:
    """A condition; what isn't a truth value is NULL."""
    return x.col if x.kind == "bool" else F.lit(None).cast("boolean")


def to_long(x: Typed) -> Typed:
    c = x.col
    if x.kind in ("long", "null"):
        return Typed(c.cast("bigint"), "long")
    if x.kind == "bool":
        return Typed(c.cast("bigint"), "long")
    if x.kind == "double":
        return Typed(F.when(~F.isnan(c), c.try_cast("bigint")), "long")
    if x.kind == "json":
        number = F.when(c.rlike(r"^-?\d"), c.try_cast("double")).try_cast("bigint")
        return Typed(F.coalesce(F.when(c.rlike(r"^-?\d+$"), c.try_cast("bigint")), number, F.when(c == "true", 1).when(c == "false", 0)), "long")
    return Typed(F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint")), "long")


def to_double(x: Typed) -> Typed:
    if x.kind in ("string", "json"):
        text = F.regexp_replace(F.trim(x.col), ",", "")
        return Typed(F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")), "double")
    return Typed(x.col.cast("double"), "double")


def to_bool(x: Typed) -> Typed:
    if x.kind in NUMBERS:
        return Typed(x.col != 0, "bool")
    if x.kind in ("string", "json"):
        text = F.lower(F.trim(x.col))
        return Typed(F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False)).otherwise(~x.col.isin("", "0")), "bool")
    return Typed(x.col.cast("boolean"), "bool")


def to_timestamp(x: Typed) -> Typed:
    if x.kind in NUMBERS:
        return Typed(to_long(x).col, "long")
    if x.kind in ("string", "json"):
        iso = F.unix_millis(x.col.try_cast("timestamp"))
        return Typed(F.coalesce(to_long(Typed(x.col, "string")).col, F.when(x.col.rlike(r"^\d{4}-\d{2}"), iso)), "long")
    return null("long")


def to_string(x: Typed, timestamp: bool = False) -> Typed:
    c = x.col
    if timestamp:
        return Typed(F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "string")
    if x.kind == "double":
        # Whole doubles print without a fraction; the rest as the shortest text that reads back.
        whole = (F.abs(c) < 1e15) & (c == F.floor(c))
        return Typed(F.when(whole, c.cast("bigint").cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"\.0E|E(?=\d)", "E+")), "string")
    return Typed(c.cast("string"), "string")


def conversion(kind: str, x: Typed) -> Typed:
    return {"string": to_string, "double": to_double, "long": to_long, "bool": to_bool, "timestamp": to_timestamp}[kind](x)


def unify(a: Typed, b: Typed) -> tuple[Typed, Typed]:
    if a.kind == b.kind:
        return a, b
    if a.kind == "null":
        return null(b.kind), b
    if b.kind == "null":
        return a, null(a.kind)
    if {a.kind, b.kind} <= set(NUMBERS):
        return Typed(a.col.cast("double"), "double"), Typed(b.col.cast("double"), "double")
    raise SqlError(f"Branches of kinds {a.kind} and {b.kind} don't agree")


def call(name: str, args: list[Typed], syntax: list) -> Typed:
    n, first = len(args), args[0] if args else None
    arity = {"ABS": (1,), "ROUND": (1, 2), "UPPER": (1,), "LOWER": (1,), "TO_LONG": (1,), "TO_DOUBLE": (1,), "TO_BOOL": (1,), "TO_TIMESTAMP": (1,), "TO_STRING": (1,)}
    if name in arity and n not in arity[name]:
        raise SqlError(f"{name} takes {' or '.join(map(str, arity[name]))} argument(s)")
    if name == "ABS":
        x = leaf_number(first)
        if x.kind not in NUMBERS:
            return null("long")
        return Typed(F.when(x.col < 0, negate(x).col).otherwise(x.col) if x.kind == "long" else F.abs(x.col), x.kind)
    if name == "ROUND":
        x = leaf_number(first)
        if x.kind not in NUMBERS:
            return null("double")
        digits = max(0, getattr(syntax[1], "value", 0) or 0) if n == 2 else 0
        return Typed(F.round(x.col.cast("double"), digits), "double")
    if name in ("UPPER", "LOWER"):
        return Typed((F.upper if name == "UPPER" else F.lower)(first.col), "string") if first.kind == "string" else null("string")
    if name == "COALESCE":
        if not args:
            raise SqlError("COALESCE takes arguments")
        kinds = [a.kind for a in args if a.kind != "null"]
        if len(set(kinds)) > 1 and set(kinds) != set(NUMBERS):
            # Values of different kinds meet as their texts, so none is lost.
            return Typed(F.coalesce(*[to_string(a).col for a in args]), "string")
        kind = "double" if len(set(kinds)) > 1 else kinds[0] if kinds else "null"
        return Typed(F.coalesce(*[a.col.cast(SPARK[kind]) for a in args]), kind)
    if name == "TO_STRING":
        return to_string(first, timestamp=getattr(syntax[0], "name", "") == "TO_TIMESTAMP")
    if name in ("TO_LONG", "TO_DOUBLE", "TO_BOOL", "TO_TIMESTAMP"):
        return {"TO_LONG": to_long, "TO_DOUBLE": to_double, "TO_BOOL": to_bool, "TO_TIMESTAMP": to_timestamp}[name](first)
    raise SqlError(f"Unknown function '{name}'")


def json_path(base: Column, steps: list, text: bool) -> Typed:
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)
    return Typed(F.get_json_object(base, path), "string" if text else "json")


def variant_path(base: Column, steps: list, text: bool) -> Typed:
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)
    found = F.try_variant_get(base, path, "variant")
    if not text:
        return Typed(found, "variant")
    return Typed(F.when(~F.is_variant_null(found), F.coalesce(F.try_variant_get(base, path, "string"), F.to_json(found))), "string")
