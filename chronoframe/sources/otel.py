"""OpenTelemetry records as points: spans, metrics and logs, and OTLP JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import points, value_struct

DATABASE = "_otel"
ATTRS = "map<string,string>"
SPANS = f"resource {ATTRS}, attributes {ATTRS}, name string, trace_id binary, span_id binary, parent_span_id binary, start_ns bigint, end_ns bigint, status int, status_message string"
METRICS = f"resource {ATTRS}, name string, kind string, data_points array<struct<attributes:{ATTRS},time_ns:bigint,start_ns:bigint,value:double,count:bigint,sum:double,buckets:array<struct<count:bigint,sum:double>>,quantiles:array<struct<quantile:double,value:double>>>>"
LOGS = f"resource {ATTRS}, attributes {ATTRS}, time_ns bigint, severity int, body string, trace_id binary, span_id binary"


def _fields(**made):
    return F.create_map(*[x for name, (kind, col) in made.items() for x in (F.lit(name), F.when(col.isNotNull(), value_struct(kind, col)))])


def spans_to_points(df: DataFrame, database: str = DATABASE) -> DataFrame:
    """Measurement ``otel_traces`` at the span's start, in nanoseconds."""
    tags = F.map_concat("resource", "attributes", F.create_map(F.lit("span_name"), "name"))
    fields = _fields(
        trace_id=("s", scalars.hex_lower(F.col("trace_id"))), span_id=("s", scalars.hex_lower(F.col("span_id"))), parent_span_id=("s", scalars.hex_lower(F.col("parent_span_id"))),
        start_time=("i", F.col("start_ns")), end_time=("i", F.col("end_ns")), duration_ns=("i", F.col("end_ns") - F.col("start_ns")), status_code=("i", F.col("status").cast("bigint")), status_message=("s", F.col("status_message") if "status_message" in df.columns else F.lit(None).cast("string")),
    )
    return points(df, F.lit("otel_traces"), F.col("start_ns"), tags, fields, F.lit(database))


def metrics_to_points(df: DataFrame, database: str = DATABASE) -> DataFrame:
    """Measurement ``otel_metrics_<name>``: gauges and counters, histogram buckets, summary quantiles."""
    each = df.select("resource", "name", "kind", F.explode("data_points").alias("p"))
    entry = lambda name, kind, col: F.struct(name.alias("key"), value_struct(kind, col).alias("value"))
    simple = F.array(entry(F.lit("value"), "f", F.col("p.value")))
    totals = F.array(entry(F.lit("count"), "i", F.col("p.count")), entry(F.lit("sum"), "f", F.col("p.sum")))
    bucket = F.flatten(F.transform("p.buckets", lambda b, i: F.array(entry(F.concat(F.lit("bucket_"), i.cast("string")), "i", b["count"]), entry(F.concat(F.lit("bucket_"), i.cast("string"), F.lit("_sum")), "f", b["sum"]))))
    quantile = F.transform("p.quantiles", lambda q: entry(F.concat(F.lit("quantile_"), q["quantile"].cast("string")), "f", q["value"]))
    made = F.when(F.col("kind") == "histogram", F.concat(bucket, totals)).when(F.col("kind") == "summary", F.concat(quantile, totals)).otherwise(simple)
    return points(each, F.concat(F.lit("otel_metrics_"), F.col("name")), F.col("p.time_ns"), F.map_concat("resource", "p.attributes"), F.map_from_entries(made), F.lit(database))


def logs_to_points(df: DataFrame, database: str = DATABASE) -> DataFrame:
    """Measurement ``otel_logs``; the severity's text follows from its number."""
    tags = F.map_concat("resource", "attributes", F.create_map(F.lit("severity"), scalars.severity_text(F.col("severity"))))
    fields = _fields(body=("s", F.col("body")), severity_number=("i", F.col("severity").cast("bigint")), trace_id=("s", scalars.hex_lower(F.col("trace_id"))), span_id=("s", scalars.hex_lower(F.col("span_id"))))
    return points(df, F.lit("otel_logs"), F.col("time_ns"), tags, fields, F.lit(database))


_KV = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
OTLP_SPANS = f"resourceSpans array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},status:struct<code:int,message:string>>>>>>>"


def _attributes(kv):
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.coalesce(F.map_from_entries(F.transform(kv, lambda e: F.struct(e["key"], text(e["value"])))), F.expr("cast(map() as map<string,string>)"))


def read_otlp_spans(spark: SparkSession, path: str) -> DataFrame:
    """OTLP/JSON trace exports as rows for ``spans_to_points``."""
    return span_rows(spark.read.schema(OTLP_SPANS).json(path))


def span_rows(raw: DataFrame) -> DataFrame:
    """Rows for ``spans_to_points`` from the OTLP structure ``resourceSpans``."""
    raw = raw.select(F.explode("resourceSpans").alias("r")).select("r.resource", F.explode("r.scopeSpans").alias("x")).select("resource", F.explode("x.spans").alias("s"))
    return raw.select(
        _attributes(F.col("resource.attributes")).alias("resource"), _attributes(F.col("s.attributes")).alias("attributes"), F.col("s.name").alias("name"),
        F.unhex("s.traceId").alias("trace_id"), F.unhex("s.spanId").alias("span_id"), F.unhex("s.parentSpanId").alias("parent_span_id"),
        F.col("s.startTimeUnixNano").cast("bigint").alias("start_ns"), F.col("s.endTimeUnixNano").cast("bigint").alias("end_ns"), F.col("s.status.code").alias("status"), F.col("s.status.message").alias("status_message"),
    )


_POINT = f"struct<attributes:{_KV},timeUnixNano:string,startTimeUnixNano:string,asDouble:double,asInt:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,quantileValues:array<struct<quantile:double,value:double>>>"
_DATA = f"struct<dataPoints:array<{_POINT}>>"
OTLP_METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_KV}>,scopeMetrics:array<struct<metrics:array<struct<name:string,gauge:{_DATA},sum:{_DATA},histogram:{_DATA},summary:{_DATA}>>>>>>"
OTLP_LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,severityNumber:int,body:struct<stringValue:string>,traceId:string,spanId:string,attributes:{_KV}>>>>>>"


def metric_rows(raw: DataFrame) -> DataFrame:
    """Rows for ``metrics_to_points`` from the OTLP structure ``resourceMetrics``."""
    each = raw.select(F.explode("resourceMetrics").alias("r")).select("r.resource", F.explode("r.scopeMetrics").alias("x")).select("resource", F.explode("x.metrics").alias("m"))
    kinds = ("gauge", "sum", "histogram", "summary")
    kind = F.coalesce(*[F.when(F.col(f"m.{k}").isNotNull(), "counter" if k == "sum" else k) for k in kinds])
    none = "cast(null as array<struct<count:bigint,sum:double>>)"
    point = lambda p: F.struct(
        _attributes(p["attributes"]).alias("attributes"), p["timeUnixNano"].cast("bigint").alias("time_ns"), p["startTimeUnixNano"].cast("bigint").alias("start_ns"),
        F.coalesce(p["asDouble"], p["asInt"].cast("double")).alias("value"), p["count"].cast("bigint").alias("count"), p["sum"].alias("sum"),
        F.coalesce(F.transform(p["bucketCounts"], lambda c: F.struct(c.cast("bigint").alias("count"), F.lit(None).cast("double").alias("sum"))), F.expr(none)).alias("buckets"),
        p["quantileValues"].alias("quantiles"),
    )
    points_ = F.coalesce(*[F.col(f"m.{k}.dataPoints") for k in kinds])
    return each.select(_attributes(F.col("resource.attributes")).alias("resource"), F.col("m.name").alias("name"), kind.alias("kind"), F.transform(points_, point).alias("data_points"))


def log_rows(raw: DataFrame) -> DataFrame:
    """Rows for ``logs_to_points`` from the OTLP structure ``resourceLogs``."""
    each = raw.select(F.explode("resourceLogs").alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("x")).select("resource", F.explode("x.logRecords").alias("l"))
    return each.select(
        _attributes(F.col("resource.attributes")).alias("resource"), _attributes(F.col("l.attributes")).alias("attributes"), F.col("l.timeUnixNano").cast("bigint").alias("time_ns"),
        F.col("l.severityNumber").alias("severity"), F.col("l.body.stringValue").alias("body"), F.unhex("l.traceId").alias("trace_id"), F.unhex("l.spanId").alias("span_id"),
    )


def read_otlp_metrics(spark: SparkSession, path: str) -> DataFrame:
    """OTLP/JSON metric exports as rows for ``metrics_to_points``."""
    return metric_rows(spark.read.schema(OTLP_METRICS).json(path))


def read_otlp_logs(spark: SparkSession, path: str) -> DataFrame:
    """OTLP/JSON log exports as rows for ``logs_to_points``."""
    return log_rows(spark.read.schema(OTLP_LOGS).json(path))
