"""Registered time-series queries and their SQL twins over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import promql
from ..functions import scalars
from ..model import Measurement, points, value_struct, widen
from ..operators import aggregates, downsample, lifecycle, limits
from ..ql.binder import query
from ..sources import arrow, lineprotocol, otel, prometheus
from ..streaming import continuous

FLAGSHIP = "group_by_time_and_tag"
NOW = 1_706_745_600 * 10**9  # 2024-02-01: the clock of the queries that need one
HOUR, DAY = 3600 * 10**9, 86400 * 10**9
TIME = "epoch_us(ts) * 1000"


def events(spark: SparkSession, sf: str) -> Measurement:
    df = spark.read.parquet(f"{sf}/events.parquet")
    return Measurement("events", df, "ts", {"event_type": "event_type", "user_id": "cast(user_id as string)"}, {"value": "value", "event_id": "event_id", "props": "props"})


def lineitem(spark: SparkSession, sf: str) -> Measurement:
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    return Measurement("lineitem", df, "l_shipdate", {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, {c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")})


def orders(spark: SparkSession, sf: str) -> Measurement:
    df = spark.read.parquet(f"{sf}/orders.parquet")
    return Measurement("orders", df, "o_orderdate", {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}, {"o_totalprice": "o_totalprice", "o_custkey": "o_custkey"})


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    m = events(spark, sf)
    fields = F.create_map(F.lit("value"), value_struct("f", F.col("value")), F.lit("event_id"), value_struct("i", F.col("event_id")))
    return points(m.df, F.lit("events"), m.time_ns(), F.create_map(F.lit("event_type"), F.col("event_type")), fields)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def text(name: str, q: str, sql: str, of=events, rounded: tuple[str, ...] = (), limit: int | None = None):
    """A query text over one measurement; sums and means are rounded, as their order is not fixed."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(q, of(spark, sf), NOW, limit)
        return df.withColumns({c: F.round(c, 4) for c in rounded}) if rounded else df

    register(name, sql)(run)


RAW = f"SELECT {TIME} AS time, value FROM events"
text("select_star_limit", "SELECT * FROM events", f"SELECT {TIME} AS time, event_id, event_type, props, user_id::VARCHAR AS user_id, value FROM events ORDER BY ts LIMIT 1000", limit=1000)
text("select_fields", "SELECT value, event_id FROM events", f"SELECT {TIME} AS time, value, event_id FROM events")
for _op, _name in ((">", "gt"), (">=", "gte"), ("<", "lt"), ("<=", "lte"), ("=", "eq")):
    text(f"select_where_field_{_name}", f"SELECT value FROM events WHERE value {_op} 50.0", f"{RAW} WHERE value {_op} 50.0")
text("select_where_field_ne", "SELECT value FROM events WHERE value != 50.0", f"{RAW} WHERE value IS DISTINCT FROM 50.0")
text("select_where_field_int", "SELECT event_id FROM events WHERE event_id <= 100", f"SELECT {TIME} AS time, event_id FROM events WHERE event_id <= 100")
text("where_tag_eq", "SELECT value FROM events WHERE event_type = 'error'", f"{RAW} WHERE event_type = 'error'")
text("where_tag_ne_regex", "SELECT value FROM events WHERE event_type != 'error' AND user_id =~ '^1'", f"{RAW} WHERE event_type <> 'error' AND regexp_matches(user_id::VARCHAR, '^1')")
text("where_and_or_precedence", "SELECT value FROM events WHERE event_type = 'error' OR event_type = 'click' AND value > 80", f"{RAW} WHERE event_type = 'error' OR event_type = 'click' AND value > 80")
text("where_parens", "SELECT value FROM events WHERE (event_type = 'error' OR event_type = 'click') AND value > 80", f"{RAW} WHERE (event_type = 'error' OR event_type = 'click') AND value > 80")
text("where_not", "SELECT value FROM events WHERE NOT (event_type = 'error' OR value > 20)", f"{RAW} WHERE NOT (event_type = 'error' OR value > 20)")
text("where_string_order_is_false", "SELECT COUNT(*) FROM events WHERE props > 'a'", "SELECT 0::BIGINT AS count")
text("where_time_range_halfopen", "SELECT value FROM events WHERE time >= '2024-01-05' AND time < '2024-01-06T12:00:00Z'", f"{RAW} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06 12:00:00'")
text("where_now_minus", "SELECT value FROM events WHERE time >= now() - 3w AND time < now() - 10d", f"{RAW} WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-22'")
text("count_star", "SELECT COUNT(*) FROM events", "SELECT count(*) AS count FROM events")
text("count_field", "SELECT COUNT(value) FROM events", "SELECT count(value) AS count FROM events")
text("count_missing_field", "SELECT COUNT(nothing) FROM events", "SELECT 0::BIGINT AS count")
text("sum", "SELECT SUM(value) FROM events", "SELECT round(sum(value), 4) AS sum FROM events", rounded=("sum",))
text("sum_int", "SELECT SUM(event_id) FROM events", "SELECT sum(event_id)::BIGINT AS sum FROM events")
text("mean", "SELECT MEAN(value) FROM events", "SELECT round(avg(value), 4) AS mean FROM events", rounded=("mean",))
text("min", "SELECT MIN(value) FROM events", "SELECT min(value) AS min FROM events")
text("max", "SELECT MAX(value) FROM events", "SELECT max(value) AS max FROM events")
text("first", "SELECT FIRST(value) FROM events", "SELECT arg_min(value, ts) AS first FROM events")
text("last", "SELECT LAST(value) FROM events", "SELECT arg_max(value, ts) AS last FROM events")
text("aggregate_and_raw", "SELECT COUNT(value), event_id FROM events", "SELECT count(value) AS count, arg_min(event_id, ts) AS event_id FROM events")
text(
    "multi_agg", "SELECT COUNT(value), SUM(value), MEAN(value), MIN(value), MAX(value), FIRST(value), LAST(value) FROM events WHERE value > 10",
    "SELECT count(value) AS count, round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events WHERE value > 10", rounded=("sum", "mean"),
)
text("group_by_tag", "SELECT COUNT(value), MEAN(value) FROM events GROUP BY event_type", "SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean FROM events GROUP BY 1", rounded=("mean",))
text(
    "group_by_two_tags", "SELECT SUM(l_quantity), MEAN(l_extendedprice), COUNT(*) FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum, round(avg(l_extendedprice), 4) AS mean, count(*) AS count FROM lineitem GROUP BY 1, 2", of=lineitem, rounded=("sum", "mean"),
)
text("group_by_all_tags", "SELECT COUNT(*) FROM events GROUP BY *", "SELECT event_type, user_id::VARCHAR AS user_id, count(*) AS count FROM events GROUP BY 1, 2")
text("group_by_time_1h", "SELECT MEAN(value) FROM events GROUP BY time(1h)", f"SELECT ({TIME}) // {HOUR} * {HOUR} AS time, round(avg(value), 4) AS mean FROM events GROUP BY 1", rounded=("mean",))
text(
    FLAGSHIP, "SELECT MEAN(value) FROM events WHERE event_type = 'error' AND value > 10 GROUP BY time(1h), event_type",
    f"SELECT ({TIME}) // {HOUR} * {HOUR} AS time, event_type, round(avg(value), 4) AS mean FROM events WHERE event_type = 'error' AND value > 10 GROUP BY 1, 2", rounded=("mean",),
)
text("group_by_time_first_last", "SELECT FIRST(value), LAST(value) FROM events GROUP BY time(6h)", f"SELECT ({TIME}) // {6 * HOUR} * {6 * HOUR} AS time, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY 1")
text("int_sum_by_tag", "SELECT SUM(o_custkey) FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT o_orderstatus, o_orderpriority, sum(o_custkey)::BIGINT AS sum FROM orders GROUP BY 1, 2", of=orders)
text("order_by_time_desc_limit_offset", "SELECT value FROM events ORDER BY time DESC LIMIT 20 OFFSET 5", f"{RAW} ORDER BY ts DESC LIMIT 20 OFFSET 5")
text(
    "slimit_soffset", "SELECT value FROM events GROUP BY event_type, user_id SLIMIT 10 SOFFSET 5",
    f"WITH k AS (SELECT *, 'event_type=' || event_type || ',user_id=' || user_id AS s FROM events), p AS (SELECT DISTINCT s FROM k ORDER BY s LIMIT 10 OFFSET 5) SELECT {TIME} AS time, event_type, user_id::VARCHAR AS user_id, value FROM k JOIN p USING (s)",
)
text("aggregate_limit", "SELECT COUNT(*) FROM events GROUP BY time(1d) ORDER BY time DESC LIMIT 7", f"SELECT ({TIME}) // {DAY} * {DAY} AS time, count(*) AS count FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7")


@register("group_by_time_all_fields", f"SELECT ({TIME}) // {DAY} * {DAY} AS time, round(avg(event_id), 4) AS event_id, arg_min(props, ts) AS props, round(avg(value), 4) AS value FROM events GROUP BY 1")
def _(spark, sf):
    out = aggregates.group_by_time(events(spark, sf), DAY)
    return out.withColumns({"value": F.round("value", 4), "event_id": F.round("event_id", 4)})


@register("integer_sums", "SELECT o_orderpriority, sum(o_custkey)::BIGINT AS o_custkey FROM orders GROUP BY 1")
def _(spark, sf):
    return aggregates.integer_sums(orders(spark, sf), ["o_orderpriority"])


@register("show_measurements", "SELECT * FROM (VALUES ('events'), ('lineitem'), ('orders')) t(name)")
def _(spark, sf):
    return spark.createDataFrame([(m(spark, sf).name,) for m in (events, lineitem, orders)], "name string")


@register("show_tag_keys", "SELECT * FROM (VALUES ('event_type'), ('l_linestatus'), ('l_returnflag'), ('o_orderpriority'), ('o_orderstatus'), ('user_id')) t(tag_key)")
def _(spark, sf):
    each = [spark.createDataFrame([(t,) for t in m(spark, sf).tags], "tag_key string") for m in (events, lineitem, orders)]
    return lifecycle.union_all(*each).distinct()


@register("show_field_keys", "SELECT * FROM (VALUES ('event_id', 'bigint'), ('props', 'string'), ('value', 'double')) t(field_key, field_type)")
def _(spark, sf):
    m = events(spark, sf)
    return spark.createDataFrame([(f, m.field_type(f)) for f in sorted(m.fields)], "field_key string, field_type string")


@register("show_tag_values", "SELECT DISTINCT 'event_type' AS key, event_type AS value FROM events")
def _(spark, sf):
    m = events(spark, sf)
    return m.df.select(F.lit("event_type").alias("key"), m.tag("event_type").alias("value")).distinct()


@register("show_series", "SELECT DISTINCT 'event_type=' || event_type || ',user_id=' || user_id AS series FROM events")
def _(spark, sf):
    m = events(spark, sf)
    return m.df.select(m.series_key().alias("series")).distinct()


@register("series_cardinality", "SELECT count(DISTINCT (event_type, user_id)) AS series FROM events")
def _(spark, sf):
    return aggregates.series_cardinality(events(spark, sf))


@register("series_bitmap_cardinality", "SELECT count(DISTINCT user_id) AS cardinality FROM events")
def _(spark, sf):
    return aggregates.bitmap_cardinality(aggregates.series_bitmap(events(spark, sf).df, "user_id")).select(F.col("cardinality").cast("bigint").alias("cardinality"))


@register("lineprotocol_roundtrip", "SELECT event_type, count(*) AS count, sum(event_id)::BIGINT AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def _(spark, sf):
    parsed = lineprotocol.good(lineprotocol.parse(lineprotocol.render(event_points(spark, sf))))
    m = widen(parsed, "events", ["event_type"], {"value": "double", "event_id": "bigint"})
    return query("SELECT COUNT(value), SUM(event_id), MIN(value), MAX(value) FROM events GROUP BY event_type", m, NOW)


@register("points_to_wide", f"SELECT {TIME} AS time, event_type, value, event_id FROM events")
def _(spark, sf):
    m = widen(event_points(spark, sf), "events", ["event_type"], {"value": "double", "event_id": "bigint"})
    return query("SELECT event_type, value, event_id FROM events", m, NOW)


@register("dedup_last_write_wins", f"SELECT time_ns, event_type, value FROM (SELECT ({TIME}) // {HOUR} * {HOUR} AS time_ns, event_type, value, row_number() OVER (PARTITION BY ({TIME}) // {HOUR}, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf):
    m = events(spark, sf)
    rows = m.df.select(scalars.time_bucket(m.time_ns(), HOUR).alias("time_ns"), "event_type", "value", "event_id")
    return lifecycle.last_write_wins(rows, ["time_ns", "event_type"], "event_id").drop("event_id")


@register("latest_per_series", f"SELECT event_type, {TIME} AS time, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1")
def _(spark, sf):
    m = events(spark, sf)
    return limits.latest(m.df.select("event_type", m.time_ns().alias("time"), "value"), ["event_type"], ["time"])


@register("union_hot_cold", f"SELECT {TIME} AS time, value, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN event_id ELSE -1 END AS event_id FROM events")
def _(spark, sf):
    m = events(spark, sf)
    hot = query("SELECT value, event_id FROM events WHERE time >= '2024-01-15'", m, NOW)
    cold = query("SELECT value FROM events WHERE time < '2024-01-15'", m, NOW)
    return lifecycle.union_all(hot, cold).fillna(-1, ["event_id"])


@register("promql_instant", f"SELECT max({TIME}) AS time, arg_max(value, ts) AS value FROM events WHERE event_type = 'click'")
def _(spark, sf):
    _, matchers = promql.parse('events{event_type="click"}')
    return promql.instant(events(spark, sf), matchers)


GRID = f"SELECT ({1_704_067_200_000} + i * 21600000) AS time FROM range(0, 121) t(i)"


@register("promql_range_nearest", f"WITH g AS ({GRID}), s AS (SELECT {TIME} AS t, value FROM events) SELECT time, arg_min(value, (abs(t - time * 1000000), t)) AS value FROM g, s GROUP BY time")
def _(spark, sf):
    return promql.nearest(events(spark, sf), [], 1_704_067_200_000, 1_704_067_200_000 + 120 * 21_600_000, 21_600_000)


@register(
    "promql_range_by_series",
    f"WITH g AS ({GRID}), s AS (SELECT 'event_type=' || event_type AS series, {TIME} AS t, value FROM events) SELECT series, time, arg_min(value, (abs(t - time * 1000000), t)) AS value FROM g, s GROUP BY series, time",
)
def _(spark, sf):
    m = events(spark, sf)
    m = Measurement(m.name, m.df, m.time, {"event_type": "event_type"}, m.fields)
    return promql.nearest(m, [], 1_704_067_200_000, 1_704_067_200_000 + 120 * 21_600_000, 21_600_000, by_series=True)


@register("promql_label_filter", "SELECT event_type, count(*) AS count FROM events WHERE regexp_full_match(event_type, 'cl.*|err.*') AND user_id <> 7 GROUP BY 1")
def _(spark, sf):
    _, matchers = promql.parse('events{event_type=~"cl.*|err.*", user_id!="7"}')
    m = events(spark, sf)
    return m.where(promql.matches(m, matchers)).df.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))


@register("remote_read_series", "SELECT user_id::VARCHAR AS user_id, event_type, count(*) AS samples, arg_min(value, ts) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY ALL")
def _(spark, sf):
    rows = promql.remote_read(events(spark, sf), [], 1_704_240_000_000, 1_704_844_800_000 - 1)
    label = F.map_from_entries(F.transform("labels", lambda x: F.struct(x["name"], x["value"])))
    return rows.select(label["user_id"].alias("user_id"), label["event_type"].alias("event_type"), F.size("samples").cast("bigint").alias("samples"), F.col("samples")[0]["value"].alias("first"))


@register("remote_write_points", "SELECT event_type, count(*) AS count, max(value) AS max FROM events GROUP BY 1")
def _(spark, sf):
    """Series out of the table, through the protobuf codec, and back to points."""
    series = promql.remote_read(events(spark, sf), [], 0, 4_000_000_000_000)

    def encode(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"body": [prometheus.encode_write([{"labels": list(a), "samples": list(b)}]) for a, b in zip(pdf["labels"], pdf["samples"])]})

    back = prometheus.to_points(prometheus.decode_requests(series.mapInPandas(encode, "body binary")))
    return back.groupBy(F.col("tags")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("count"), F.max(F.col("fields")["value"]["f"]).alias("max"))


for _i in downsample.Interval:

    def _make(i=_i):
        def run(spark, sf):
            m = events(spark, sf)
            df = m.df.select((F.call_function("div", m.time_ns(), F.lit(10**9).cast("long"))).alias("time"), F.col("event_id").alias("value"))
            return downsample.downsample(df, i)

        return run

    register(f"downsample_{_i.name.lower()}", f"SELECT ({TIME}) // 1000000000 // {int(_i)} * {int(_i)} AS time, (sum(event_id) // count(event_id))::BIGINT AS value FROM events GROUP BY 1")(_make())


@register("downsample_all_aggs", f"SELECT ({TIME}) // {DAY} * {DAY} AS time, sum(event_id)::BIGINT AS sum, min(event_id) AS min, max(event_id) AS max, (sum(event_id) // count(*))::BIGINT AS mean, arg_min(event_id, ts) AS first, arg_max(event_id, ts) AS last, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    m = events(spark, sf)
    return downsample.downsample_all(m.df.select(m.time_ns().alias("time"), F.col("event_id").alias("value")), DAY)


@register("ttl_filter", "SELECT count(*) AS count FROM events WHERE ts > TIMESTAMP '2024-01-22'")
def _(spark, sf):
    m = events(spark, sf)
    return lifecycle.unexpired(m.df.select(m.time_ns().alias("time_ns")), 10 * 86400, NOW).agg(F.count(F.lit(1)).alias("count"))


@register("tier_distribution", "SELECT CASE WHEN ts > TIMESTAMP '2024-01-31' THEN 'hot' WHEN ts > TIMESTAMP '2024-01-17' THEN 'warm' ELSE 'cold' END AS tier, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    m = events(spark, sf)
    return m.df.groupBy(lifecycle.tier(m.time_ns(), NOW, 86400, 14 * 86400).alias("tier")).agg(F.count(F.lit(1)).alias("count"))


SHARDS = f"SELECT ({TIME}) // {7 * DAY} AS shard_id, count(*) AS rows, sum(length(props))::BIGINT AS size, CASE WHEN ({TIME}) // {7 * DAY} % 2 = 0 THEN 'active' ELSE 'closed' END AS status FROM events GROUP BY ALL"


def _shards(spark, sf):
    m = events(spark, sf)
    rows = lifecycle.with_shard(m.df.select(m.time_ns().alias("time_ns"), "props"), 7 * 86400)
    made = rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("props")).alias("size"))
    return lifecycle.shard_bounds(made.withColumn("status", F.when(F.col("shard_id") % 2 == 0, "active").otherwise("closed")), 7 * DAY)


@register("shard_stats", f"SELECT status, count(*) AS shards, sum(rows)::BIGINT AS rows, sum(size)::BIGINT AS size, avg(size) AS average_size FROM ({SHARDS}) GROUP BY 1")
def _(spark, sf):
    return lifecycle.shard_stats(_shards(spark, sf))


@register("find_shard_by_time", f"SELECT shard_id, rows, size, status, shard_id * {7 * DAY} AS start_ns, (shard_id + 1) * {7 * DAY} AS end_ns FROM ({SHARDS}) WHERE shard_id = {1_705_000_000 * 10**9 // (7 * DAY)}")
def _(spark, sf):
    return lifecycle.find_shard(_shards(spark, sf), 1_705_000_000 * 10**9)


@register("delete_by_tag", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value > 50)")
def _(spark, sf):
    return lifecycle.delete_where(events(spark, sf).df, (F.col("event_type") == "error") & (F.col("value") > 50)).select("event_id")


@register("drop_series_antijoin", "SELECT event_id FROM events WHERE user_id % 3 <> 0")
def _(spark, sf):
    m = events(spark, sf)
    keyed = m.df.withColumn("series_key", m.series_key())
    return lifecycle.drop_series(keyed, keyed.where("user_id % 3 = 0").select("series_key")).select("event_id")


@register(
    "compaction_plan",
    "WITH f AS (SELECT user_id % 4 AS partition, user_id AS file_id, count(*) AS size, min(event_id) AS min_time, max(event_id) AS max_time FROM events GROUP BY user_id), r AS (SELECT *, (row_number() OVER (PARTITION BY partition ORDER BY size DESC, min_time, file_id) - 1) // 8 AS chunk FROM f), p AS (SELECT partition, chunk, count(*) AS files, sum(size)::BIGINT AS size, min(min_time) AS min_time, max(max_time) AS max_time, sum(max_time - min_time)::BIGINT AS spans FROM r GROUP BY 1, 2 HAVING count(*) >= 3) SELECT partition, chunk, files, size, min_time, max_time, round(CASE WHEN max_time > min_time THEN greatest(0.0::DOUBLE, (spans - (max_time - min_time))::DOUBLE / (max_time - min_time)) ELSE 0.0 END, 6) AS overlap_ratio FROM p",
)
def _(spark, sf):
    e = events(spark, sf).df
    files = e.groupBy((F.col("user_id") % 4).alias("partition"), F.col("user_id").alias("file_id")).agg(F.count(F.lit(1)).alias("size"), F.min("event_id").alias("min_time"), F.max("event_id").alias("max_time"))
    return lifecycle.compaction_plan(files).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


@register("otel_spans_to_points", f"SELECT {TIME} AS time_ns, 'service=' || event_type || ',span_name=' || 'user' || user_id AS series_key, (event_id * 1000) AS duration_ns FROM events")
def _(spark, sf):
    m = events(spark, sf)
    spans = m.df.select(
        F.create_map(F.lit("service"), "event_type").alias("resource"), F.expr("cast(map() as map<string,string>)").alias("attributes"), F.concat(F.lit("user"), F.col("user_id")).alias("name"),
        F.unhex(F.lpad(F.hex("event_id"), 16, "0")).alias("trace_id"), F.unhex(F.lpad(F.hex("event_id"), 8, "0")).alias("span_id"), F.lit(None).cast("binary").alias("parent_span_id"),
        m.time_ns().alias("start_ns"), (m.time_ns() + F.col("event_id") * 1000).alias("end_ns"), F.lit(1).alias("status"),
    )
    return otel.spans_to_points(spans).select("time_ns", "series_key", F.col("fields")["duration_ns"]["i"].alias("duration_ns"))


@register("otel_logs_severity", "SELECT CASE user_id % 8 WHEN 1 THEN 'TRACE' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO' WHEN 4 THEN 'WARN' WHEN 5 THEN 'ERROR' WHEN 6 THEN 'FATAL' ELSE 'UNKNOWN' END AS severity, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    m = events(spark, sf)
    none = F.expr("cast(map() as map<string,string>)")
    logs = m.df.select(none.alias("resource"), none.alias("attributes"), m.time_ns().alias("time_ns"), (F.col("user_id") % 8).cast("int").alias("severity"), F.col("props").alias("body"), F.lit(None).cast("binary").alias("trace_id"), F.lit(None).cast("binary").alias("span_id"))
    return otel.logs_to_points(logs).groupBy(F.col("tags")["severity"].alias("severity")).agg(F.count(F.lit(1)).alias("count"))


@register("otel_metrics_gauge", "SELECT 'otel_metrics_' || event_type AS measurement, count(*) AS count, max(value) AS max FROM events GROUP BY 1")
def _(spark, sf):
    m = events(spark, sf)
    none = F.expr("cast(map() as map<string,string>)")
    point = F.struct(none.alias("attributes"), m.time_ns().alias("time_ns"), m.time_ns().alias("start_ns"), F.col("value").alias("value"), F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("double").alias("sum"), F.expr("cast(null as array<struct<count:bigint,sum:double>>)").alias("buckets"), F.expr("cast(null as array<struct<quantile:double,value:double>>)").alias("quantiles"))
    metrics = m.df.select(none.alias("resource"), F.col("event_type").alias("name"), F.lit("gauge").alias("kind"), F.array(point).alias("data_points"))
    return otel.metrics_to_points(metrics).groupBy("measurement").agg(F.count(F.lit(1)).alias("count"), F.max(F.col("fields")["value"]["f"]).alias("max"))


@register("json_points", f"SELECT {TIME} AS time_ns, 'event_type=' || event_type AS series_key, value FROM events")
def _(spark, sf):
    m = events(spark, sf)
    body = F.to_json(F.struct(F.lit("events").alias("measurement"), F.create_map(F.lit("event_type"), "event_type").alias("tags"), F.create_map(F.lit("value"), "value").alias("fields"), m.time_ns().alias("timestamp")))
    return arrow.json_points(m.df.select(body.alias("body")), "body", NOW).select("time_ns", "series_key", F.col("fields")["value"]["f"].alias("value"))


@register("output_precision", f"SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS h FROM events")
def _(spark, sf):
    m = events(spark, sf)
    return m.df.select("event_id", *[scalars.to_precision(m.time_ns(), u).alias(u) for u in ("s", "ms", "us", "h")])


@register("stream_downsample", f"SELECT ({TIME}) // {HOUR} * {HOUR} AS time, event_type, count(*) AS count, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2")
def _(spark, sf):
    """All available rows through the streaming job, in complete mode: the same as the batch."""
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = continuous.read_table(spark, sf, batch, pathGlobFilter="events.parquet")
    made = continuous.downsample(stream, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("count"), F.round(F.sum("value"), 4).alias("sum")], None)
    return continuous.run_to_table(made, f"stream_{uuid.uuid4().hex}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import stored  # noqa: F401 (registers its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import stored  # noqa: F401

    return dict(SQL)
