"""Prometheus remote write and read: protobuf codec, points, and series of samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import points, value_struct

SERIES = "labels array<struct<name:string,value:string>>, samples array<struct<value:double,timestamp:bigint>>"
DATABASE = "_prometheus"


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("varint too long")


def _message(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a message."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = read_varint(data, at)
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("message is cut")
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, wire, value


def _signed(wire: int, value) -> int:
    n = int.from_bytes(value, "little") if wire == 1 else value
    return n - (1 << 64) if n >= 1 << 63 else n


def decode_series(data: bytes) -> dict:
    labels, samples = [], []
    for number, _, value in _message(data):
        if number == 1:
            parts = {n: v.decode(errors="replace") for n, _, v in _message(value)}
            labels.append({"name": parts.get(1, ""), "value": parts.get(2, "")})
        elif number == 2:
            sample = {"value": 0.0, "timestamp": 0}
            for n, wire, v in _message(value):
                if n == 1:
                    sample["value"] = struct.unpack("<d", v)[0]
                elif n == 2:
                    sample["timestamp"] = _signed(wire, v)  # fixed64 and varint are both in use
            samples.append(sample)
    return {"labels": labels, "samples": samples}


def decode_write(data: bytes) -> list[dict]:
    return [decode_series(v) for n, _, v in _message(data) if n == 1]


def decode_read(data: bytes) -> list[dict]:
    """Queries: start_ms, end_ms and matchers (op, name, value)."""
    out = []
    for number, _, query in _message(data):
        if number != 1:
            continue
        q = {"start_ms": 0, "end_ms": 0, "matchers": []}
        for n, wire, v in _message(query):
            if n in (1, 2):
                q["start_ms" if n == 1 else "end_ms"] = _signed(wire, v)
            elif n == 3:
                m = {k: x for k, _, x in _message(v)}
                q["matchers"].append((("=", "!=", "=~", "!~")[m.get(1, 0)], m.get(2, b"").decode(), m.get(3, b"").decode()))
        out.append(q)
    return out


def _bytes(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def encode_series(series: dict) -> bytes:
    out = b"".join(_bytes(1, _bytes(1, x["name"].encode()) + _bytes(2, x["value"].encode())) for x in series["labels"])
    return out + b"".join(_bytes(2, b"\x09" + struct.pack("<d", x["value"]) + b"\x10" + varint(x["timestamp"])) for x in series["samples"])


def encode_write(series: list[dict]) -> bytes:
    return b"".join(_bytes(1, encode_series(s)) for s in series)


def encode_read_response(results: list[list[dict]]) -> bytes:
    return b"".join(_bytes(1, encode_write(r)) for r in results)


def decode_requests(df: DataFrame, column: str = "body") -> DataFrame:
    """A row a series from binary write requests, decoded on the executors."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([s for body in pdf[column] for s in decode_write(bytes(body))], columns=["labels", "samples"])

    return df.select(column).mapInPandas(run, SERIES)


def to_points(series: DataFrame, database: str = DATABASE) -> DataFrame:
    """``__name__`` is the measurement, labels without ``__`` in front are tags, samples the field ``value``."""
    each = series.select("labels", F.explode("samples").alias("sample"))
    name = F.try_element_at(F.filter("labels", lambda x: x["name"] == "__name__"), F.lit(-1))["value"]
    tags = F.map_from_entries(F.transform(F.filter("labels", lambda x: ~x["name"].startswith("__")), lambda x: F.struct(x["name"], x["value"])))
    fields = F.create_map(F.lit("value"), value_struct("f", F.col("sample.value")))
    return points(each, F.coalesce(name, F.lit("unknown")), F.col("sample.timestamp") * 1_000_000, tags, fields, F.lit(database))


def to_series(df: DataFrame) -> DataFrame:
    """From measurement, tags, series_key, time_ns, value: one row a series, samples in time order."""
    named = F.concat(F.array(F.struct(F.lit("__name__").alias("name"), F.col("measurement").alias("value"))), F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
    sample = F.struct(F.expr("time_ns div 1000000").alias("timestamp"), F.col("value").alias("value"))
    grouped = df.where("value IS NOT NULL").withColumn("labels", named).groupBy("measurement", "series_key").agg(F.any_value("labels").alias("labels"), F.array_sort(F.collect_list(sample)).alias("s"))
    return grouped.select("labels", F.transform("s", lambda x: F.struct(x["value"].alias("value"), x["timestamp"].alias("timestamp"))).alias("samples"))
