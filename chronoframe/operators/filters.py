"""Conditions as Columns: Influx-like two-valued logic that still reaches the scan."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Measurement
from ..ql.parser import Both, Compare, Either, Not, Now, QueryError

ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double")


def time_literal(value, now_ns: int) -> int:
    """Nanoseconds from an integer, now() with an offset, a duration or an RFC 3339 text."""
    if isinstance(value, Now):
        return now_ns + value.offset
    if isinstance(value, tuple):
        return value[1]
    if isinstance(value, bool):
        raise QueryError("time can't be compared with a boolean")
    if isinstance(value, (int, float)):
        return int(value)
    try:
        t = datetime.datetime.fromisoformat(value)
    except ValueError as e:
        raise QueryError(f"bad time {value!r}") from e
    t = t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)
    return (t - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1) * 1000


def compare(m: Measurement, c: Compare, now_ns: int) -> Column:
    """A comparison that is null or false where it doesn't hold; ``!=`` is true where the value is missing."""
    if c.name == "time":
        return m.time_is(c.op, time_literal(c.value, now_ns))
    if c.name in m.tags:
        col, value = m.tag(c.name), str(c.value)
        if c.op in ("=~", "!~"):
            found = F.coalesce(col, F.lit("")).rlike(value)
            return found if c.op == "=~" else ~found
        if c.op == "=":
            return col == value
        if c.op == "!=":
            return ~col.eqNullSafe(value)
        return F.lit(False)
    if c.name not in m.fields:
        return F.lit(c.op == "!=")  # a missing field differs from every value
    col, kind = m.value(c.name), m.field_type(c.name)
    numeric = kind in ORDERED or kind.startswith("decimal")
    value = c.value
    if isinstance(value, (Now, tuple)):
        raise QueryError(f"{c.name} can't be compared with a time")
    fits = numeric and isinstance(value, (int, float)) and not isinstance(value, bool) or kind == "string" and isinstance(value, str) or kind == "boolean" and isinstance(value, bool)
    if c.op in ("=~", "!~"):
        return (col.rlike(str(value)) if c.op == "=~" else ~F.coalesce(col.rlike(str(value)), F.lit(False))) if kind == "string" else F.lit(c.op == "!~")
    if not fits:
        return F.lit(c.op == "!=")
    if c.op == "=":
        return col == value
    if c.op == "!=":
        return ~col.eqNullSafe(F.lit(value))
    if not numeric:
        return F.lit(False)
    found = {"<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[c.op]
    # NaN is greater than all in Spark; here it compares with nothing
    return found & ~F.isnan(col) if kind in ("float", "double") and c.op in (">", ">=") else found


def _names(tree) -> set[str]:
    if isinstance(tree, Compare):
        return {tree.name}
    return _names(tree.inner) if isinstance(tree, Not) else _names(tree.left) | _names(tree.right)


def on_keys(tree, keys: set[str]):
    """The conjuncts of a condition that look at ``keys`` alone; None without any."""
    if isinstance(tree, Both):
        left, right = on_keys(tree.left, keys), on_keys(tree.right, keys)
        return Both(left, right) if left is not None and right is not None else left if right is None else right
    return tree if tree is not None and _names(tree) <= keys else None


def time_bounds(tree, now_ns: int) -> tuple[int | None, int | None]:
    """The least and the greatest time (both included) that the conjuncts of a condition allow; None where there is no bound."""
    if isinstance(tree, Both):
        (a, b), (c, d) = time_bounds(tree.left, now_ns), time_bounds(tree.right, now_ns)
        return max((x for x in (a, c) if x is not None), default=None), min((x for x in (b, d) if x is not None), default=None)
    if isinstance(tree, Compare) and tree.name == "time":
        t = time_literal(tree.value, now_ns)
        return {"=": (t, t), ">": (t + 1, None), ">=": (t, None), "<": (None, t - 1), "<=": (None, t)}.get(tree.op, (None, None))
    return None, None


def condition(m: Measurement, tree, now_ns: int, strict: bool = False) -> Column:
    """``strict`` below NOT: a null must count as false before it is negated."""
    if isinstance(tree, Both):
        return condition(m, tree.left, now_ns, strict) & condition(m, tree.right, now_ns, strict)
    if isinstance(tree, Either):
        return condition(m, tree.left, now_ns, strict) | condition(m, tree.right, now_ns, strict)
    if isinstance(tree, Not):
        return ~condition(m, tree.inner, now_ns, True)
    found = compare(m, tree, now_ns)
    return F.coalesce(found, F.lit(False)) if strict else found
