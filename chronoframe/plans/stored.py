"""Registered queries that go through stored measurements, codecs and the catalog, with their SQL twins."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import promql, server
from ..api import Engine
from ..functions import scalars
from ..model import points, value_struct
from ..operators import aggregates, lifecycle
from ..operators.downsample import Rule
from ..session import fresh_dir
from ..sources import arrow, otel, prometheus
from .catalogue import DAY, HOUR, NOW, TIME, event_points, events, register

#: What is left of the events where the last write of each (time, event_type) wins.
LAST = "(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY ts, event_type ORDER BY event_id DESC) = 1)"


def engine(spark: SparkSession, **how) -> Engine:
    return Engine(spark, fresh_dir(spark, "engine"), clock=lambda: NOW, **how)


def stored(spark: SparkSession, sf: str, **how) -> Engine:
    """An engine that holds the events, written in the order of event_id."""
    e = engine(spark, **how)
    e.write(event_points(spark, sf).withColumn("ingest_seq", F.col("fields")["event_id"]["i"]))
    return e


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


@register("stored_select", f"SELECT {TIME} AS time, event_id, event_type, value FROM {LAST}")
def _(spark, sf):
    return stored(spark, sf).query("SELECT event_id, event_type, value FROM events", default_limit=None)


@register("stored_time_and_tag", f"SELECT ({TIME}) // {DAY} * {DAY} AS time, count(value) AS count, sum(event_id)::BIGINT AS sum FROM {LAST} WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND value > 10 GROUP BY 1")
def _(spark, sf):
    return stored(spark, sf).query("SELECT COUNT(value), SUM(event_id) FROM events WHERE event_type = 'error' AND time >= '2024-01-05' AND time < '2024-01-20' AND value > 10 GROUP BY time(1d)")


@register("stored_overwrite", f"SELECT event_type, count(*) AS count, round(sum(CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END), 4) AS sum FROM {LAST} GROUP BY 1")
def _(spark, sf):
    """A second write of half the keys, in a bloom-filtered, compressed table."""
    e = stored(spark, sf, compression="zstd", bloom=100)
    m = e.measurement("events")
    again = m.df.where("event_id % 2 = 0")
    fields = F.create_map(F.lit("value"), value_struct("f", F.col("value") + 1), F.lit("event_id"), value_struct("i", F.col("event_id")))
    e.write(points(again, F.lit("events"), F.col("time_ns"), F.create_map(F.lit("event_type"), F.col("event_type")), fields))
    return rounded(e.query("SELECT COUNT(*), SUM(value) FROM events GROUP BY event_type"), "sum")


@register("stored_delete", f"SELECT event_type, count(*) AS count FROM {LAST} WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-15') GROUP BY 1")
def _(spark, sf):
    e = stored(spark, sf)
    e.query("DELETE FROM events WHERE event_type = 'error' AND time < '2024-01-15'")
    return e.query("SELECT COUNT(*) FROM events GROUP BY event_type")


@register("stored_drop_series", f"SELECT event_type, count(*) AS count FROM {LAST} WHERE event_type <> 'click' GROUP BY 1")
def _(spark, sf):
    e = stored(spark, sf)
    e.query("DROP SERIES FROM events WHERE event_type = 'click'")
    return e.query("SELECT COUNT(*) FROM events GROUP BY event_type")


@register("stored_drop_measurement", "SELECT 'other' AS name")
def _(spark, sf):
    e = stored(spark, sf)
    e.query("INSERT other,host=a v=1i 1000")
    e.query("DROP MEASUREMENT events")
    return e.query("SHOW MEASUREMENTS")


@register("stored_compact", f"SELECT event_type, count(*) AS count, min(value) AS min, max(value) AS max FROM {LAST} GROUP BY 1")
def _(spark, sf):
    e = stored(spark, sf)
    e.write(event_points(spark, sf).withColumn("ingest_seq", F.col("fields")["event_id"]["i"]))
    e.compact("events")
    return e.query("SELECT COUNT(*), MIN(value), MAX(value) FROM events GROUP BY event_type")


@register("stored_retention", f"SELECT count(*) AS count FROM {LAST} WHERE ts > TIMESTAMP '2024-01-22'")
def _(spark, sf):
    e = stored(spark, sf)
    e.query("CREATE RETENTION POLICY ten ON default DURATION 10d DEFAULT")
    e.enforce_retention()
    return e.query("SELECT COUNT(*) FROM events")


@register("stored_snapshot_restore", f"SELECT event_type, count(*) AS count FROM {LAST} GROUP BY 1")
def _(spark, sf):
    e = stored(spark, sf)
    name = e.snapshot("default")
    e.query("DELETE FROM events")
    e.restore("default", name)
    return e.query("SELECT COUNT(*) FROM events GROUP BY event_type").where(F.lit(e.verify_snapshot("default", name)))


@register("stored_backup_restore", f"SELECT event_type, count(*) AS count, max(event_id) AS max FROM {LAST} GROUP BY 1")
def _(spark, sf):
    e, folder = stored(spark, sf), fresh_dir(spark, "backup")
    e.backup("default", folder)
    other = engine(spark)
    other.restore_backup(folder, "copy")
    return other.query("SELECT COUNT(*), MAX(event_id) FROM events GROUP BY event_type", "copy")


@register("stored_rules", f"SELECT ({TIME}) // {HOUR} * {HOUR} AS time, max(event_id) AS value FROM {LAST} GROUP BY 1")
def _(spark, sf):
    e = stored(spark, sf)
    e.add_rule(Rule("hourly", "events", "events_1h", 3600, "max"))
    e.run_rules("event_id")
    return e.query("SELECT value FROM events_1h", default_limit=None)


@register("stored_cache", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    e = engine(spark)
    e.register(events(spark, sf))
    text = "SELECT COUNT(*) FROM events GROUP BY event_type"
    return e.cached(text) if e.cached(text) is e.cached(text) else spark.createDataFrame([], "event_type string, count bigint")


@register("stored_show", "SELECT * FROM (SELECT DISTINCT 'series' AS what, 'events,event_type=' || event_type AS name FROM events UNION ALL SELECT DISTINCT 'value', event_type FROM events UNION ALL SELECT * FROM (VALUES ('tag', 'event_type'), ('field', 'event_id bigint'), ('field', 'value double'), ('measurement', 'events'), ('database', 'default')) t(what, name))")
def _(spark, sf):
    """Every SHOW statement on a stored measurement."""
    e = stored(spark, sf)
    shown = [
        e.query("SHOW SERIES FROM events").select(F.lit("series").alias("what"), F.col("series").alias("name")),
        e.query("SHOW TAG VALUES FROM events WITH KEY = event_type").select(F.lit("value").alias("what"), F.col("value").alias("name")),
        e.query("SHOW TAG KEYS FROM events").select(F.lit("tag").alias("what"), F.col("tag_key").alias("name")),
        e.query("SHOW FIELD KEYS FROM events").select(F.lit("field").alias("what"), F.concat_ws(" ", "field_key", "field_type").alias("name")),
        e.query("SHOW MEASUREMENTS").select(F.lit("measurement").alias("what"), "name"),
        e.query("SHOW DATABASES").select(F.lit("database").alias("what"), "name"),
    ]
    return lifecycle.union_all(*shown)


@register("catalog_statements", "SELECT * FROM (VALUES ('a', 3600::BIGINT, true), ('b', 1209600::BIGINT, false)) t(name, duration, \"default\")")
def _(spark, sf):
    e = engine(spark)
    for text in ("CREATE DATABASE d", "CREATE DATABASE gone", "DROP DATABASE gone", "CREATE RETENTION POLICY a ON d DURATION 1h", "CREATE RETENTION POLICY b ON d DURATION 1w", "ALTER DATABASE d SET RETENTION POLICY b DURATION 2w", "USE d"):
        e.query(text)
    return e.query("SHOW RETENTION POLICIES").select("name", "duration", "default")


@register("stored_stats", f"SELECT 1::BIGINT AS measurements, count(*) AS points, count(DISTINCT event_type) AS series FROM {LAST}")
def _(spark, sf):
    s = stored(spark, sf).stats()
    return spark.createDataFrame([(s["measurements"], s["points"], s["series"])], "measurements bigint, points bigint, series bigint")


@register("http_write_query", "SELECT event_type AS host, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    """Counts go in by /write and come back by /query; a ping in between."""
    e = engine(spark)
    rows = events(spark, sf).df.groupBy("event_type").count().collect()  # a row a type
    body = "\n".join(f"n,host={r[0]} count={r[1]}i 1000" for r in rows)
    assert server.answer(e, "POST", "/write", body.encode())[0] == server.answer(e, "GET", "/ping", b"")[0] == 204
    found = json.loads(server.answer(e, "GET", "/query?q=SELECT%20count,host%20FROM%20n", b"")[1])["results"][0]["series"][0]
    at = {c: k for k, c in enumerate(found["columns"])}
    return spark.createDataFrame([(v[at["host"]], int(v[at["count"]])) for v in found["values"]], "host string, count bigint")


@register("prometheus_stored", "SELECT event_type, count(*) AS count, max(value) AS max FROM (SELECT event_type, epoch_us(ts) // 1000 AS ms, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL) GROUP BY 1")
def _(spark, sf):
    """Remote write into a stored measurement, the largest of equal keys last, through the codec."""
    series = promql.remote_read(events(spark, sf), [], 0, 1_704_844_800_000 - 1)
    rows = series.select(F.filter("labels", lambda x: x["name"] != "user_id").alias("labels"), "samples")

    def encode(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"body": [prometheus.encode_write([{"labels": list(a), "samples": list(b)}]) for a, b in zip(pdf["labels"], pdf["samples"])]})

    e = engine(spark)
    e.catalog.create_database(prometheus.DATABASE)
    written = prometheus.to_points(prometheus.decode_requests(rows.mapInPandas(encode, "body binary")))
    e.write(lifecycle.last_write_wins(written.withColumn("value", F.col("fields")["value"]["f"]), order="value").drop("value"), prometheus.DATABASE)
    m = e.measurement("events", prometheus.DATABASE)
    return m.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"), F.max("value").alias("max"))


@register("flight_roundtrip", f"SELECT event_type, count(*) AS count, max(value) AS max, sum(event_id)::BIGINT AS sum FROM events GROUP BY 1")
def _(spark, sf):
    """Record batches out of a query, into points, and what the tables' list says of them."""
    m = events(spark, sf)
    out = m.df.select(m.time_ns().alias("time"), F.col("event_type").alias("tag_event_type"), "value", "event_id")
    back = arrow.put(spark, pa.Table.from_batches(list(arrow.batches(out))), "events")
    return back.groupBy(F.col("tags")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("count"), F.max(F.col("fields")["value"]["f"]).alias("max"), F.sum(F.col("fields")["event_id"]["i"]).alias("sum"))


@register("list_tables", "SELECT 'default' AS \"database\", 'events' AS measurement, 'event_id,value' AS fields")
def _(spark, sf):
    return stored(spark, sf).list_tables().withColumn("fields", F.array_join("fields", ","))


def _otlp(spark, rows: DataFrame, body, schema: str) -> DataFrame:
    return rows.select(F.from_json(F.to_json(body), schema).alias("j")).select("j.*")


def _kv(key: str, value) -> object:
    return F.array(F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value")))


@register("otlp_spans_json", f"SELECT {TIME} AS time_ns, 'service=' || event_type || ',span_name=s' AS series_key, event_id AS duration_ns, 'm' || event_id AS status_message FROM events")
def _(spark, sf):
    m = events(spark, sf)
    span = F.struct(F.lit("0102").alias("traceId"), F.lit("03").alias("spanId"), F.lit("s").alias("name"), m.time_ns().cast("string").alias("startTimeUnixNano"), (m.time_ns() + F.col("event_id")).cast("string").alias("endTimeUnixNano"), F.struct(F.lit(1).alias("code"), F.concat(F.lit("m"), "event_id").alias("message")).alias("status"))
    body = F.struct(F.array(F.struct(F.struct(_kv("service", F.col("event_type")).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    made = otel.spans_to_points(otel.span_rows(_otlp(spark, m.df, body, otel.OTLP_SPANS)))
    return made.select("time_ns", "series_key", F.col("fields")["duration_ns"]["i"].alias("duration_ns"), F.col("fields")["status_message"]["s"].alias("status_message"))


@register("otlp_metrics_json", f"SELECT 'otel_metrics_' || event_type AS measurement, {TIME} AS time_ns, event_id AS count, event_id AS bucket FROM events")
def _(spark, sf):
    m = events(spark, sf)
    point = F.struct(m.time_ns().cast("string").alias("timeUnixNano"), F.col("event_id").cast("string").alias("count"), F.col("value").alias("sum"), F.array(F.col("event_id").cast("string")).alias("bucketCounts"))
    metric = F.struct(F.col("event_type").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("histogram"))
    body = F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    made = otel.metrics_to_points(otel.metric_rows(_otlp(spark, m.df, body, otel.OTLP_METRICS)))
    return made.select("measurement", "time_ns", F.col("fields")["count"]["i"].alias("count"), F.col("fields")["bucket_0"]["i"].alias("bucket"))


@register("otlp_logs_json", f"SELECT {TIME} AS time_ns, event_type AS body, 'severity=ERROR' AS series_key FROM events")
def _(spark, sf):
    m = events(spark, sf)
    record = F.struct(m.time_ns().cast("string").alias("timeUnixNano"), F.lit(5).alias("severityNumber"), F.struct(F.col("event_type").alias("stringValue")).alias("body"))
    body = F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    made = otel.logs_to_points(otel.log_rows(_otlp(spark, m.df, body, otel.OTLP_LOGS)))
    return made.select("time_ns", F.col("fields")["body"]["s"].alias("body"), "series_key")


@register("bitmap_sets", "SELECT count(DISTINCT user_id) FILTER (WHERE user_id >= 10 AND user_id < 50)::BIGINT AS in_range, bool_or(user_id = 7) AS has_seven, count(DISTINCT user_id) FILTER (WHERE user_id % 2 = 1)::BIGINT AS left_over FROM events")
def _(spark, sf):
    bits = aggregates.series_bitmap(events(spark, sf).df, "user_id")
    even = events(spark, sf).df.where("user_id % 2 = 0").select(F.col("user_id").alias("id"))
    left = aggregates.bitmap_cardinality(aggregates.bitmap_remove(bits, even)).select(F.col("cardinality").cast("bigint").alias("left_over"))
    ranged = aggregates.bitmap_ids(bits, 10, 50).agg(F.count(F.lit(1)).alias("in_range"))
    return ranged.crossJoin(aggregates.bitmap_contains(bits, 7).withColumnRenamed("contains", "has_seven")).crossJoin(left)  # three tables of one row


@register("shard_nodes", f"SELECT ({TIME}) // {7 * DAY} % 3 AS node, count(DISTINCT ({TIME}) // {7 * DAY}) AS shards, max(CASE WHEN ({TIME}) // {7 * DAY} = 2818 THEN 'migrating' ELSE 'active' END) AS status FROM events GROUP BY 1")
def _(spark, sf):
    m = events(spark, sf)
    shards = lifecycle.with_shard(m.df.select(m.time_ns().alias("time_ns")), 7 * 86400).select("shard_id").distinct()
    made = shards.withColumns({"node": scalars.shard_node(F.col("shard_id"), 3), "status": F.lit("active")})
    moved = lifecycle.migrate_shard(lifecycle.set_status(made, 0, "closed"), 2818, 2818 % 3)
    return moved.groupBy("node").agg(F.count(F.lit(1)).alias("shards"), F.max("status").alias("status"))


@register("scalar_functions", "SELECT event_id, lower(hex(event_type)) AS hex, coalesce(value / nullif(event_id % 3, 0), 0) AS ratio, coalesce('event_type=' || event_type, '') AS series_key FROM events")
def _(spark, sf):
    m = events(spark, sf)
    return m.df.select("event_id", scalars.hex_lower(F.col("event_type").cast("binary")).alias("hex"), scalars.ratio(F.col("value"), F.col("event_id") % 3).alias("ratio"), scalars.series_key(F.create_map(F.lit("event_type"), "event_type")).alias("series_key"))


@register("tag_set_exact", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def _(spark, sf):
    m = events(spark, sf)
    return m.where(m.series_key() == scalars.series_key_of("events", {"user_id": "7", "event_type": "click"})).df.select("event_id")


@register("next_tiers", "SELECT CASE WHEN ts > TIMESTAMP '2024-01-31' THEN NULL WHEN ts > TIMESTAMP '2024-01-17' THEN 'warm' ELSE 'cold' END AS due, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    m = events(spark, sf)
    return m.df.groupBy(lifecycle.next_tier(F.lit("hot"), m.time_ns(), NOW, 86400, 14 * 86400).alias("due")).agg(F.count(F.lit(1)).alias("count"))


@register("split_shard", f"SELECT ({TIME}) // {7 * DAY // 2} AS shard_id, count(*) AS count FROM events WHERE ({TIME}) // {7 * DAY} = 2818 GROUP BY 1")
def _(spark, sf):
    m = events(spark, sf)
    rows = lifecycle.with_shard(m.df.select(m.time_ns().alias("time_ns")), 7 * 86400)
    return lifecycle.split_shard(rows, 2818, 7 * 86400).groupBy("shard_id").agg(F.count(F.lit(1)).alias("count"))


@register("statement_insert", "SELECT 1000::BIGINT AS time, 'a' AS host, 0.5::DOUBLE AS v UNION ALL SELECT 2000, 'b', 2.5")
def _(spark, sf):
    e = engine(spark)
    e.query("INSERT cpu,host=a v=0.5 1000")
    e.query("INSERT cpu,host=b v=1.5 2000")
    e.query("INSERT cpu,host=b v=2.5 2000")
    return e.query("SELECT host, v FROM cpu")
