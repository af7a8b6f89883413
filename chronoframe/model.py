"""Measurements: points as they are ingested, and the wide tables that queries read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars

VALUE = "struct<kind:string,i:bigint,u:decimal(20,0),f:double,s:string,b:boolean>"
POINTS = f"database string, measurement string, time_ns bigint, tags map<string,string>, fields map<string,{VALUE}>, series_key string, ingest_seq bigint"


@dataclass(frozen=True)
class Measurement:
    """A wide table with the roles of its columns.

    ``time`` is a column of nanoseconds (bigint) or a timestamp; predicates on time
    are put on that column itself, so that they reach the Parquet scan. ``tags`` and
    ``fields`` map names to column expressions.
    """

    name: str
    df: DataFrame
    time: str = "time_ns"
    tags: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)

    @property
    def native_time(self) -> bool:
        return not self.df.schema[self.time].dataType.simpleString().startswith("timestamp")

    def time_ns(self) -> Column:
        return F.col(self.time) if self.native_time else F.unix_micros(F.col(self.time).cast("timestamp")) * 1000

    def time_is(self, op: str, ns: int) -> Column:
        """The comparison on the column as it is stored."""
        if self.native_time:
            bound, col = F.lit(ns), F.col(self.time)
        else:
            micros, rest = divmod(ns, 1000)
            if op == "=" and rest:
                return F.lit(False)
            if rest and op in (">=", "<"):
                micros += 1
            kind = self.df.schema[self.time].dataType.simpleString()
            bound, col = F.timestamp_micros(F.lit(micros)).cast(kind), F.col(self.time)
        return {"=": col == bound, "!=": col != bound, "<": col < bound, "<=": col <= bound, ">": col > bound, ">=": col >= bound}[op]

    def tag(self, name: str) -> Column:
        return F.expr(self.tags[name])

    def value(self, name: str) -> Column:
        return F.expr(self.fields[name])

    def field_type(self, name: str) -> str:
        return self.df.select(self.value(name).alias("x")).schema["x"].dataType.simpleString()

    def series_key(self) -> Column:
        """Only tags that a point has are part of its series."""
        parts = [F.when(self.tag(t).isNotNull(), F.concat(F.lit(f"{t}="), self.tag(t).cast("string"))) for t in sorted(self.tags)]
        return F.concat_ws(",", *parts) if parts else F.lit("")

    def where(self, condition: Column) -> Measurement:
        return Measurement(self.name, self.df.where(condition), self.time, self.tags, self.fields)


def infer(points: DataFrame) -> tuple[list[str], dict[str, str], list[str]]:
    """Tag keys, field types and fields of conflicting kinds; one pass, kept in the catalog afterwards.

    Integer, unsigned and float kinds of one field become double; a mix with
    strings or booleans becomes string.
    """
    tags = [r[0] for r in points.select(F.explode(F.map_keys("tags")).alias("k")).distinct().collect()]
    kinds: dict[str, set] = {}
    for k, kind in points.select(F.explode("fields").alias("k", "v")).select("k", "v.kind").distinct().collect():
        kinds.setdefault(k, set()).add(kind)
    numeric = {"i", "u", "f"}
    single = {"i": "bigint", "u": "decimal(20,0)", "f": "double", "s": "string", "b": "boolean"}
    types = {k: single[next(iter(v))] if len(v) == 1 else "double" if v <= numeric else "string" for k, v in sorted(kinds.items())}
    return sorted(tags), types, sorted(k for k, v in kinds.items() if len(v) > 1 and not v <= numeric)


def widen(points: DataFrame, name: str, tags: list[str], fields: dict[str, str], database: str | None = None) -> Measurement:
    """The wide, typed table of one measurement. A field named like a tag gets the suffix ``_field``."""
    rows = points.where(F.col("measurement") == name)
    if database is not None:
        rows = rows.where(F.col("database") == database)

    def typed(key: str, kind: str) -> Column:
        v = F.col("fields")[key]
        as_text = F.coalesce(v["s"], v["i"].cast("string"), v["u"].cast("string"), v["f"].cast("string"), v["b"].cast("string"))
        as_double = F.coalesce(v["f"], v["i"].cast("double"), v["u"].cast("double"))
        return {"double": as_double, "bigint": v["i"], "decimal(20,0)": v["u"], "boolean": v["b"]}.get(kind, as_text)

    column = {k: f"{k}_field" if k in tags or k in ("time_ns", "series_key", "ingest_seq") else k for k in fields}
    wide = rows.select(
        "time_ns", "series_key", "ingest_seq", *[F.col("tags")[t].alias(t) for t in tags], *[typed(k, kind).alias(column[k]) for k, kind in fields.items()]
    )
    return Measurement(name, wide, "time_ns", {t: f"`{t}`" for t in tags}, {k: f"`{c}`" for k, c in column.items()})


def value_struct(kind: str, column: Column) -> Column:
    """One field value: ``kind`` says which member is set."""
    types = {"i": "bigint", "u": "decimal(20,0)", "f": "double", "s": "string", "b": "boolean"}
    parts = [F.lit(kind).alias("kind")] + [(column.cast(t) if k == kind else F.lit(None).cast(t)).alias(k) for k, t in types.items()]
    return F.struct(*parts)


def points(df: DataFrame, measurement: Column, time_ns: Column, tags: Column, fields: Column, database: Column | None = None) -> DataFrame:
    """The ingest form, with null tags and null fields left out."""
    kept = F.map_filter(tags, lambda _, v: v.isNotNull())
    return df.select(
        (F.lit("default") if database is None else database).alias("database"), measurement.alias("measurement"), time_ns.cast("bigint").alias("time_ns"), kept.alias("tags"),
        F.map_filter(fields, lambda _, v: v.isNotNull()).alias("fields"), scalars.series_key(kept).alias("series_key"), F.monotonically_increasing_id().alias("ingest_seq"),
    )
