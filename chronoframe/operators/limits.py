"""Order, limit, offset, and their counterparts for series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows in order; the offset is skipped before the limit counts."""
    out = df.orderBy(*order) if order else df
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def series_page(df: DataFrame, key: str, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows of the series from ``offset`` on, ``limit`` of them, by series key.

    The distinct keys are ranked (top-k, with map-side limits), then joined back;
    the rows themselves are not brought together.
    """
    keys = page(df.select(key).distinct(), [F.col(key)], limit, offset)
    return df.join(keys, key, "left_semi")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in ``order``, all columns; a maximum that is aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_row"))
    return last.select(*[F.col(f"`{c}`") if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
