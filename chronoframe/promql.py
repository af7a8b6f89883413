"""PromQL selectors: instant values, and nearest-sample values on a grid of steps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import Measurement

_SELECTOR = re.compile(r"\s*([A-Za-z_:][\w:]*)?\s*(?:\{(.*)\})?\s*", re.S)
_MATCHER = re.compile(r'\s*([A-Za-z_]\w*)\s*(=~|!~|!=|=)\s*"((?:[^"\\]|\\.)*)"\s*(?:,|$)')
MS = 1_000_000


def parse(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """Metric and matchers (label, operator, value). Anything with a call in it is the metric ``unknown``."""
    if re.match(r"[^{]*\(", text):
        return "unknown", []
    m = _SELECTOR.fullmatch(text)
    if not m or not (m[1] or m[2]):
        raise ValueError(f"bad selector {text!r}")
    found, at, body = [], 0, (m[2] or "").strip()
    while at < len(body):
        x = _MATCHER.match(body, at)
        if not x:
            raise ValueError(f"bad matcher in {text!r}")
        found.append((x[1], x[2], re.sub(r"\\(.)", r"\1", x[3])))
        at = x.end()
    name = m[1] or next((v for k, op, v in found if k == "__name__" and op == "="), "unknown")
    return name, [x for x in found if x[0] != "__name__"]


def matches(m: Measurement, matchers: list[tuple[str, str, str]]) -> Column:
    """All matchers hold; a label that a series lacks is the empty string."""
    out = F.lit(True)
    for label, op, value in matchers:
        if label in m.tags and op == "=" and value:
            out = out & (m.tag(label) == value)  # reaches the scan
            continue
        col = F.coalesce(m.tag(label).cast("string"), F.lit("")) if label in m.tags else F.lit("")
        test = col.rlike(f"^(?:{value})$") if op in ("=~", "!~") else col == value
        out = out & (test if op in ("=", "=~") else ~test)
    return out


def instant(m: Measurement, matchers: list[tuple[str, str, str]], field: str = "value") -> DataFrame:
    """The latest value (time, value); 0 where there is none."""
    picked = m.where(matches(m, matchers))
    v = picked.value(field)
    t = F.when(v.isNotNull(), F.struct(picked.time_ns(), picked.series_key()))
    return picked.df.agg(F.max(F.when(v.isNotNull(), picked.time_ns())).alias("time"), F.coalesce(F.max_by(v, t), F.lit(0.0)).alias("value"))


def nearest(m: Measurement, matchers: list[tuple[str, str, str]], start_ms: int, end_ms: int, step_ms: int, field: str = "value", by_series: bool = False) -> DataFrame:
    """(time in ms, value) for each step: the nearest sample at any distance, the earlier one of two; NaN without samples.

    Samples are first reduced to the last before and the first after each cell
    between two steps (two aggregates, before any shuffle of rows), so what is left
    for the window is no longer than the grid, however many samples there are.
    """
    if step_ms <= 0:
        raise ValueError("step must be positive")
    spark = m.df.sparkSession
    steps = (end_ms - start_ms) // step_ms + 1 if end_ms >= start_ms else 0
    picked = m.where(matches(m, matchers))
    keys = ["series"] if by_series else []
    rows = picked.df.select(picked.time_ns().alias("t"), picked.value(field).cast("double").alias("v"), *([picked.series_key().alias("series")] if by_series else [])).where("v IS NOT NULL")
    # cell i lies between step i - 1 (excluded) and step i (included); the ends are open
    cell = F.greatest(F.lit(0), F.least(F.lit(steps), F.ceil((F.col("t") - start_ms * MS) / F.lit(float(step_ms * MS))).cast("bigint")))
    exact = F.when(F.col("t") <= start_ms * MS + (cell - 1) * step_ms * MS, cell - 1).when((F.col("t") > start_ms * MS + cell * step_ms * MS) & (cell < steps), cell + 1).otherwise(cell)
    cells = rows.withColumn("i", F.greatest(F.lit(0), exact)).groupBy("i", *keys).agg(
        F.min(F.struct("t", "v")).alias("first"), F.max("t").alias("late_t"), F.min_by("v", F.struct(-F.col("t"), F.col("v"))).alias("late_v")
    )
    cells = cells.select("i", *keys, "first", F.struct(F.col("late_t").alias("t"), F.col("late_v").alias("v")).alias("late"))
    grid = spark.range(0, steps).select(F.col("id").alias("i"))
    if by_series:
        names = rows.select("series").distinct()
        grid = names.select("series", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, steps - 1)).cast("bigint"))).alias("i")).where(F.col("i") < steps)
    both = grid.join(cells, ["i", *keys], "full_outer")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # a sample of cell i lies at or before step i and after step i - 1
    back = F.last("late", ignorenulls=True).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("first", ignorenulls=True).over(w.orderBy("i").rowsBetween(1, Window.unboundedFollowing))
    t = (F.lit(start_ms) + F.col("i") * step_ms) * MS
    framed = both.withColumns({"back": back, "ahead": ahead}).where(F.col("i") < steps)
    closer = F.when(F.col("back").isNull(), F.col("ahead.v")).when(F.col("ahead").isNull() | (t - F.col("back.t") <= F.col("ahead.t") - t), F.col("back.v")).otherwise(F.col("ahead.v"))
    return framed.select(*keys, (F.lit(start_ms) + F.col("i") * step_ms).alias("time"), F.coalesce(closer, F.lit(float("nan"))).alias("value"))


def remote_read(m: Measurement, matchers: list[tuple[str, str, str]], start_ms: int, end_ms: int, field: str = "value") -> DataFrame:
    """One row a series: labels and samples in time order, both ends included."""
    from .sources.prometheus import to_series

    picked = m.where(matches(m, matchers) & m.time_is(">=", start_ms * MS) & m.time_is("<", (end_ms + 1) * MS))
    tags = F.create_map(*[x for t in sorted(m.tags) for x in (F.lit(t), m.tag(t).cast("string"))]) if m.tags else F.expr("cast(map() as map<string,string>)")
    rows = picked.df.select(F.lit(m.name).alias("measurement"), F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"), picked.series_key().alias("series_key"), picked.time_ns().alias("time_ns"), picked.value(field).cast("double").alias("value"))
    return to_series(rows)
