"""Statements to DataFrames: names become columns, Catalyst does the rest."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Measurement
from ..operators import aggregates, filters, limits
from .parser import Item, QueryError, Select, parse

DEFAULT_LIMIT = 1000


def _names(items: list[Item]) -> list[str]:
    """Output names: the function's, with the field where that would not be unique."""
    made = [i.alias or (i.func or i.name).lower() if i.func else i.alias or i.name for i in items]
    return [f"{n}_{i.name}" if i.func and not i.alias and made.count(n) > 1 else n for n, i in zip(made, items)]


def bind(q: Select, m: Measurement, now_ns: int | None = None, default_limit: int | None = None) -> DataFrame:
    """``default_limit`` holds for raw rows only; aggregates always see every row."""
    now_ns = time.time_ns() if now_ns is None else now_ns
    if q.where is not None:
        m = m.where(filters.condition(m, q.where, now_ns))
    tags = [t for x in q.tags for t in (sorted(m.tags) if x == "*" else [x])]
    for t in tags:
        if t not in m.tags and t not in m.fields:
            raise QueryError(f"unknown tag {t}")
    if q.order not in (None, "time"):
        raise QueryError("only time can be ordered by")
    if q.slimit is not None or q.soffset:
        keyed = m.df.withColumn("_series", m.series_key())
        m = Measurement(m.name, limits.series_page(keyed, "_series", q.slimit, q.soffset), m.time, m.tags, m.fields)
    if any(i.func for i in q.items):
        return _aggregate(q, m, tags)
    if q.interval:
        raise QueryError("GROUP BY time needs an aggregate")
    names = [n for i in q.items for n in (sorted([*m.fields, *m.tags]) if i.name == "*" else [i.name])]
    names = list(dict.fromkeys(n for n in [*tags, *names] if n != "time"))
    for n in names:
        if n not in m.fields and n not in m.tags:
            raise QueryError(f"unknown field {n}")
    out = m.df.select(m.time_ns().alias("time"), *[(m.value(n) if n in m.fields else m.tag(n)).alias(n) for n in names], m.series_key().alias("_key"))
    order = [F.desc("time") if q.descending else F.asc("time"), F.asc("_key")]
    limit = q.limit if q.limit is not None else default_limit
    if limit is not None or q.offset or q.order:
        out = limits.page(out, order, limit, q.offset)
    return out.drop("_key")


def _aggregate(q: Select, m: Measurement, tags: list[str]) -> DataFrame:
    names = _names(q.items)
    wanted, raw = [], []
    for i, out in zip(q.items, names):
        if i.func:
            wanted.append((i.func, i.name, out))
        elif i.name in tags:
            continue
        elif i.name in m.fields:
            raw.append(("FIRST", i.name, out))  # a raw column beside aggregates is its first value
        elif i.name in m.tags:
            raw.append(("TAG", i.name, out))
        elif i.name != "time":
            raise QueryError(f"unknown field {i.name}")
    fields = dict(m.fields) | {f"_tag_{n}": m.tags[n] for f, n, _ in raw if f == "TAG"}
    wide = Measurement(m.name, m.df, m.time, m.tags, fields)
    listed = wanted + [("FIRST", f"_tag_{n}" if f == "TAG" else n, out) for f, n, out in raw]
    out = aggregates.group(wide, listed, tags, q.interval)
    order = [F.desc("time") if q.descending else F.asc("time")] * bool(q.interval) + [F.asc(t) for t in tags]
    if order and (q.limit is not None or q.offset or q.order):
        out = limits.page(out, order, q.limit, q.offset)
    return out


def query(text: str, m: Measurement, now_ns: int | None = None, default_limit: int | None = None) -> DataFrame:
    """A SELECT over one measurement."""
    q = parse(text)
    if not isinstance(q, Select):
        raise QueryError("not a SELECT")
    return bind(q, m, now_ns, default_limit)
