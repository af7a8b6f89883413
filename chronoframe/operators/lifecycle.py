"""Upserts, deletes, retention, tiers, shards and compaction, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import shard_id

KEY = ["measurement", "time_ns", "series_key"]


def last_write_wins(points: DataFrame, keys: list[str] | None = None, order: str = "ingest_seq") -> DataFrame:
    """The whole row with the highest ``order`` of each key; only its maximum is aggregated before the shuffle."""
    keys = keys or KEY
    rest = [c for c in points.columns if c not in keys]
    best = points.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in points.columns])


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of hot and cold stores together; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """What is left after a delete; rows for which the condition is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def drop_series(df: DataFrame, tombstones: DataFrame, key: str = "series_key") -> DataFrame:
    """Rows of series that have no tombstone. AQE broadcasts the tombstones when their measured size allows."""
    return df.join(tombstones.select(key).distinct(), key, "left_anti")


def unexpired(df: DataFrame, ttl_seconds: int, now_ns: int, time: str = "time_ns") -> DataFrame:
    """Rows younger than the TTL; 0 keeps all, times ahead of now stay."""
    return df.where(F.col(time) > now_ns - ttl_seconds * 10**9) if ttl_seconds else df


def policy_expired(time_s: Column, duration_s: int, now_s: int) -> Column:
    return F.lit(now_s) - time_s > duration_s if duration_s else F.lit(False)


def tier(time_ns: Column, now_ns: int, hot_s: int = 3600, warm_s: int = 7 * 86400) -> Column:
    age = F.lit(now_ns) - time_ns
    return F.when(age < hot_s * 10**9, "hot").when(age < (hot_s + warm_s) * 10**9, "warm").otherwise("cold")


def next_tier(current: Column, time_ns: Column, now_ns: int, hot_s: int = 3600, warm_s: int = 7 * 86400) -> Column:
    """The tier a row should move to, or null where it stays."""
    due = tier(time_ns, now_ns, hot_s, warm_s)
    return F.when(due != current, due)


def tier_path(base: str, tier_name: str, database: str, policy: str, shard: int, cold: str | None = None) -> str:
    """Hot and warm shards share a folder; cold ones have their own base."""
    root = (cold or f"{base}/cold") if tier_name == "cold" else base
    return f"{root}/{database}/{policy}/{shard}"


def with_shard(df: DataFrame, duration_s: int, time: str = "time_ns") -> DataFrame:
    return df.withColumn("shard_id", shard_id(F.col(time), duration_s * 10**9))


def shard_bounds(shards: DataFrame, duration_ns: int) -> DataFrame:
    return shards.withColumns({"start_ns": F.col("shard_id") * duration_ns, "end_ns": (F.col("shard_id") + 1) * duration_ns})


def find_shard(shards: DataFrame, time_ns: int) -> DataFrame:
    """The shard with start <= time < end; the first if several."""
    return shards.where((F.col("start_ns") <= time_ns) & (F.lit(time_ns) < F.col("end_ns"))).orderBy("start_ns", "shard_id").limit(1)


def shard_stats(shards: DataFrame) -> DataFrame:
    """By status: number, rows, bytes, mean bytes."""
    return shards.groupBy("status").agg(F.count(F.lit(1)).alias("shards"), F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.avg("size").alias("average_size"))


def split_shard(df: DataFrame, shard: int, duration_s: int, parts: int = 2, time: str = "time_ns") -> DataFrame:
    """Rows of one shard with finer shard numbers: those of a duration ``parts`` times shorter."""
    return with_shard(df.where(F.col("shard_id") == shard).drop("shard_id"), duration_s // parts, time)


def compaction_plan(files: DataFrame, most: int = 8, least: int = 3) -> DataFrame:
    """Groups of up to ``most`` files of a partition, largest first, then oldest; groups of under ``least`` stay.

    ``files``: partition, file_id, size, min_time, max_time. File metadata only.
    """
    order = Window.partitionBy("partition").orderBy(F.desc("size"), "min_time", "file_id")
    grouped = files.withColumn("chunk", F.call_function("div", F.row_number().over(order) - 1, F.lit(most)))
    plan = grouped.groupBy("partition", "chunk").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"),
        F.sum(F.col("max_time") - F.col("min_time")).alias("spans"),
    )
    span = F.col("max_time") - F.col("min_time")
    return plan.where(F.col("files") >= least).withColumn("overlap_ratio", F.when(span > 0, F.greatest(F.lit(0.0), (F.col("spans") - span) / span)).otherwise(0.0)).drop("spans")


def overlap_ratio(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Common time over the shorter span; 0 where a span is empty."""
    common = F.least(a_max, b_max) - F.greatest(a_min, b_min)
    shorter = F.least(a_max - a_min, b_max - b_min)
    return F.when((common > 0) & (shorter > 0), common / shorter).otherwise(0.0)


def compact(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a key, sorted by series and time inside each partition, ready to be written."""
    return last_write_wins(df, keys).repartition("shard_id").sortWithinPartitions("series_key", "time_ns") if "shard_id" in df.columns else last_write_wins(df, keys).sortWithinPartitions("time_ns")


def migrate_shard(shards: DataFrame, shard: int, node: int) -> DataFrame:
    """The shard table (shard_id, node, status) with one shard on another node, being migrated."""
    here = F.col("shard_id") == shard
    return shards.withColumns({"node": F.when(here, F.lit(node)).otherwise(F.col("node")), "status": F.when(here, "migrating").otherwise(F.col("status"))})


def set_status(shards: DataFrame, shard: int, status: str) -> DataFrame:
    """The shard table with a new status of one shard: active, closed, migrating or deleted."""
    if status not in ("active", "closed", "migrating", "deleted"):
        raise ValueError(f"unknown status {status!r}")
    return shards.withColumn("status", F.when(F.col("shard_id") == shard, status).otherwise(F.col("status")))
