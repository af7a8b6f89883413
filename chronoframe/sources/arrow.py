"""Arrow record batches out and in, as a flight endpoint hands them on."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import points, value_struct

BATCH_ROWS = 10_000


def batches(df: DataFrame, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The result as record batches, a partition at a time; nulls stay null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def encode(parts):
        for b in parts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    for row in df.mapInArrow(encode, "ipc binary").toLocalIterator():
        for b in pa.ipc.open_stream(row[0]):
            for lo in range(0, b.num_rows, rows):
                yield b.slice(lo, rows).cast(schema) if b.schema != schema else b.slice(lo, rows)


def put(spark: SparkSession, table: pa.Table, measurement: str, database: str = "default") -> DataFrame:
    """``time`` is the timestamp, ``tag_*`` are tags, everything else fields."""
    df = spark.createDataFrame(table)
    tags = [c for c in df.columns if c.startswith("tag_")]
    fields = [c for c in df.columns if c not in tags and c != "time"]

    def kind(c: str) -> str:
        t = df.schema[c].dataType.simpleString()
        return "f" if t in ("double", "float") else "b" if t == "boolean" else "s" if t == "string" else "u" if t.startswith("decimal") else "i"

    made = F.create_map(*[x for c in fields for x in (F.lit(c), F.when(F.col(c).isNotNull(), value_struct(kind(c), F.col(c))))])
    tagged = F.create_map(*[x for c in tags for x in (F.lit(c.removeprefix("tag_")), F.col(c).cast("string"))]) if tags else F.expr("cast(map() as map<string,string>)")
    return points(df, F.lit(measurement), F.col("time"), tagged, made, F.lit(database))


def json_points(df: DataFrame, column: str, now_ns: int, database: str = "default") -> DataFrame:
    """JSON write requests {measurement, tags, fields (numbers), timestamp}; a missing timestamp is now."""
    r = df.select(F.from_json(column, "measurement string, tags map<string,string>, fields map<string,double>, timestamp bigint").alias("r")).where("r IS NOT NULL")
    fields = F.map_from_entries(F.transform(F.map_entries("r.fields"), lambda e: F.struct(e["key"], value_struct("f", e["value"]))))
    return points(r, F.col("r.measurement"), F.coalesce("r.timestamp", F.lit(now_ns)), F.coalesce("r.tags", F.expr("cast(map() as map<string,string>)")), fields, F.lit(database))
