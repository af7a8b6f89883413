"""Downsampling rules over (time, value) and their seven aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div, time_bucket


class Interval(IntEnum):
    """Seconds of the intervals that rules may use."""

    MIN1 = 60
    MIN5 = 300
    MIN15 = 900
    MIN30 = 1800
    HOUR1 = 3600
    HOUR6 = 21600
    DAY1 = 86400

    @classmethod
    def of(cls, seconds: int) -> Interval | None:
        return cls(seconds) if seconds in cls._value2member_map_ else None


@dataclass(frozen=True)
class Rule:
    """What becomes of a measurement: its field in buckets of ``interval`` seconds, by one aggregate, kept for ``retention`` seconds (0: for ever)."""

    name: str
    source: str
    target: str
    interval: int
    aggregate: str = "mean"
    retention: int = 0

    def __post_init__(self):
        if Interval.of(self.interval) is None or self.aggregate not in AGGREGATES:
            raise ValueError(f"bad rule {self.name}: {self.interval} s, {self.aggregate}")


AGGREGATES = ("sum", "min", "max", "mean", "first", "last", "count")


def apply_rule(df: DataFrame, rule: Rule, value: str = "value", time: str = "time", unit: int = 10**9) -> DataFrame:
    """(time, value) of the rule's target; ``unit`` time units are a second."""
    return downsample_all(df, rule.interval * unit, value, time).select("time", F.col(rule.aggregate).alias("value"))


def aggregates(df: DataFrame, value: str = "value", time: str = "time", keys: list | None = None) -> DataFrame:
    """sum, min, max, mean (integer, truncated), first, last, count; zeros where there is nothing."""
    v = F.col(value).cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    made = [
        zero(F.sum(v)).alias("sum"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"),
        zero(F.call_function("div", F.sum(v), F.nullif(F.count(v), F.lit(0)))).alias("mean"),
        zero(F.min_by(v, F.col(time))).alias("first"), zero(F.max_by(v, F.col(time))).alias("last"), F.count(v).alias("count"),
    ]
    return df.groupBy(*(keys or [])).agg(*made)


def downsample(df: DataFrame, target: int, value: str = "value", time: str = "time") -> DataFrame:
    """(time, value): the truncated integer mean of each bucket of ``target`` time units."""
    bucket = time_bucket(F.col(time), int(target)).alias("time")
    v = F.col(value).cast("bigint")
    return df.groupBy(bucket).agg(F.call_function("div", F.sum(v), F.count(v)).alias("value"))


def downsample_all(df: DataFrame, target: int, value: str = "value", time: str = "time") -> DataFrame:
    """Every aggregate of each bucket."""
    marked = df.withColumn("bucket", div(F.col(time), int(target)) * F.lit(int(target)))
    return aggregates(marked, value, time, ["bucket"]).withColumnRenamed("bucket", "time")
