"""The seven aggregates, by tags and by time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import time_bucket
from ..model import Measurement

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def aggregate(m: Measurement, func: str, name: str) -> Column:
    """COUNT and SUM of nothing are 0, the others null. FIRST and LAST skip missing values, by time and series."""
    if func == "COUNT" and name == "*":
        return F.count(F.lit(1))
    if name not in m.fields:
        return F.lit(0).cast("bigint") if func in ("COUNT", "SUM") else F.lit(None).cast("double")
    col, kind = m.value(name), m.field_type(name)
    if func == "COUNT":
        return F.count(col)
    numeric = kind in NUMBERS or kind.startswith("decimal")
    if func == "SUM":
        if not numeric:
            return F.lit(0).cast("bigint")
        return F.coalesce(F.sum(col), F.lit(0).cast("double" if kind in ("float", "double") else "bigint"))
    if func == "MEAN":
        if kind == "boolean":
            return F.avg(col.cast("int"))
        if kind == "string":  # numeric strings count; Spark alone would also take 1d for a number
            return F.avg(F.when(F.trim(col).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr(f"try_cast({m.fields[name]} AS DOUBLE)")))
        return F.avg(col)
    order = F.when(col.isNotNull(), F.struct(m.time_ns(), m.series_key()))
    return {"MIN": lambda: F.min(col), "MAX": lambda: F.max(col), "FIRST": lambda: F.min_by(col, order), "LAST": lambda: F.max_by(col, order)}[func]()


def group(m: Measurement, wanted: list[tuple[str, str, str]], tags: list[str], interval_ns: int | None) -> DataFrame:
    """``wanted``: (function, field, output name). Missing tags are the empty string; ``time`` is the bucket's start."""
    keys = [F.coalesce(m.tag(t).cast("string"), F.lit("")).alias(t) if t in m.tags else F.lit("").alias(t) for t in tags]
    if interval_ns:
        keys = [time_bucket(m.time_ns(), interval_ns).alias("time"), *keys]
    made = [aggregate(m, f, c).alias(out) for f, c, out in wanted]
    return m.df.groupBy(*keys).agg(*made) if keys else m.df.agg(*made)


def group_by_time(m: Measurement, interval_ns: int) -> DataFrame:
    """Mean of every number field (first of others) for each bucket, over all fields of the measurement."""
    wanted = [("MEAN" if m.field_type(c) in NUMBERS or m.field_type(c).startswith("decimal") else "FIRST", c, c) for c in sorted(m.fields)]
    if interval_ns <= 0:
        return m.df.select(m.time_ns().alias("time"), *[m.value(c).alias(c) for c in sorted(m.fields)])
    return group(m, wanted, [], interval_ns)


def integer_sums(m: Measurement, tags: list[str]) -> DataFrame:
    """Sum of each integer field by tags."""
    fields = [c for c in sorted(m.fields) if m.field_type(c) in ("bigint", "int")]
    return group(m, [("SUM", c, c) for c in fields], tags, None)


def series_cardinality(m: Measurement, approximate: bool = False) -> DataFrame:
    key = m.series_key().alias("k")
    return m.df.select(key).agg((F.approx_count_distinct("k") if approximate else F.countDistinct("k")).alias("series"))


def series_bitmap(ids: DataFrame, column: str = "id") -> DataFrame:
    """Series numbers as bitmaps; counts and membership without the ids themselves."""
    bit = F.col(column) + 1  # bit positions begin at 1
    return ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("cardinality"))


def bitmap_ids(bitmaps: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The series numbers (``id``) of bitmaps, in [low, high) where given; whole buckets outside are left out first."""
    size = 32768  # bits of a bucket
    if low is not None:
        bitmaps = bitmaps.where(F.col("bucket") >= F.bitmap_bucket_number(F.lit(low + 1)))
    if high is not None:
        bitmaps = bitmaps.where(F.col("bucket") <= F.bitmap_bucket_number(F.lit(high)))
    byte = bitmaps.select("bucket", F.posexplode(F.sequence(F.lit(0), F.length("bits") - 1)).alias("at", "_"), "bits").select("bucket", "at", F.conv(F.hex(F.expr("substring(bits, at + 1, 1)")), 16, 10).cast("int").alias("byte")).where("byte <> 0")
    bit = byte.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("(byte >> bit) & 1 = 1")
    ids = bit.select(((F.col("bucket") - 1) * size + F.col("at") * 8 + F.col("bit")).alias("id"))
    return ids.where((F.lit(low).isNull() | (F.col("id") >= F.lit(low))) & (F.lit(high).isNull() | (F.col("id") < F.lit(high))))


def bitmap_contains(bitmaps: DataFrame, number: int) -> DataFrame:
    """One row ``contains``: whether a series number is in the bitmaps."""
    return bitmap_ids(bitmaps, number, number + 1).agg((F.count(F.lit(1)) > 0).alias("contains"))


def bitmap_remove(bitmaps: DataFrame, gone: DataFrame, column: str = "id") -> DataFrame:
    """The bitmaps without some series numbers; only buckets that hold one are built anew."""
    marks = gone.select(F.bitmap_bucket_number(F.col(column) + 1).alias("bucket")).distinct()
    left = bitmap_ids(bitmaps.join(marks, "bucket", "left_semi")).join(gone.select(F.col(column).alias("id")), "id", "left_anti")
    return bitmaps.join(marks, "bucket", "left_anti").union(series_bitmap(left))
