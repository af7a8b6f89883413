"""Line protocol text to points, with built-in string functions.

``measurement[,tag=v]* SP field=v[,field=v]* [SP timestamp]``: the first space ends
the key, the last one precedes the timestamp; commas separate and the first ``=``
splits, also inside quotes; there is no escaping in names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import VALUE

NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"


def _kind(v: Column) -> Column:
    low = F.lower(v)
    return (
        F.when(v.rlike(r"^[+-]?\d+[iI]$"), "i")
        .when(v.rlike(r"^\+?\d+[uU]$"), "u")
        .when(low.isin("t", "true", "f", "false"), "b")
        .when(low.rlike(NUMBER), "f")
        .when((v.rlike(r'^"[\s\S]*"$') | v.rlike(r"^'[\s\S]*'$")) & (F.length(v) >= 2), "s")
    )


def _digits(text: Column) -> Column:
    """A run of digits as a number; null if it has more than twenty."""
    return F.when(F.length(text) <= 21, F.try_to_number(F.lpad(F.regexp_replace(text, "^[+-]", ""), 20, "0"), F.lit("9" * 20)) * F.when(text.startswith("-"), -1).otherwise(1)).cast("decimal(20,0)")


def parse(lines: DataFrame, column: str = "value", default_tags: dict[str, str] | None = None, default_time: int = 0, precision: str = "ns", database: str = "default") -> DataFrame:
    """One row a line: the point's columns and ``error`` (null where the line is good). Blank lines and # lines go."""
    text = F.trim(F.col(column))
    df = lines.where((text != "") & ~text.startswith("#")).select(text.alias("line"))
    df = df.withColumn("cut", F.locate(" ", "line"))
    df = df.withColumns({"head": F.when(F.col("cut") > 0, F.expr("substring(line, 1, cut - 1)")).otherwise(F.col("line")), "body": F.when(F.col("cut") > 0, F.trim(F.expr("substring(line, cut + 1)"))).otherwise("")})
    last = F.expr("substring_index(body, ' ', -1)")
    stamped = F.col("body").contains(" ") & last.rlike(r"^-?\d+$")
    df = df.withColumns({"stamp": F.when(stamped, last), "payload": F.when(stamped, F.rtrim(F.expr("substring(body, 1, length(body) - length(substring_index(body, ' ', -1)) - 1)"))).otherwise(F.col("body"))})
    df = df.withColumns({"parts": F.split("head", ","), "pairs": F.split("payload", ",")})
    df = df.withColumns({"measurement": F.col("parts")[0], "tag_parts": F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), "time_ns": F.expr("try_cast(stamp AS BIGINT)")})

    def key(p):
        return F.substring_index(p, "=", 1)

    def val(p):
        return F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))

    values = F.transform("pairs", lambda p: F.struct(key(p).alias("k"), val(p).alias("v"), _kind(val(p)).alias("kind"), p.contains("=").alias("ok")))
    df = df.withColumn("values", values)
    number = lambda x: F.substring(x["v"], 1, F.length(x["v"]) - 1)
    null = lambda t: F.lit(None).cast(t)
    made = lambda x: F.struct(
        x["kind"].alias("kind"),
        F.when(x["kind"] == "i", _digits(number(x))).otherwise(null("decimal(20,0)")).alias("i0"),
        F.when(x["kind"] == "u", _digits(number(x))).otherwise(null("decimal(20,0)")).alias("u"),
        F.when(x["kind"] == "f", F.regexp_replace(F.lower(x["v"]), "^([+-]?)inf$", "$1infinity").cast("double")).otherwise(null("double")).alias("f"),
        F.when(x["kind"] == "s", scalars.unescape(F.substring(x["v"], 2, F.length(x["v"]) - 2))).otherwise(null("string")).alias("s"),
        F.when(x["kind"] == "b", F.lower(x["v"]).isin("t", "true")).otherwise(null("boolean")).alias("b"),
    )
    df = df.withColumn("typed", F.transform("values", lambda x: F.struct(x["k"].alias("k"), made(x).alias("x"))))
    low, high = F.lit(str(-(2**63))).cast("decimal(20,0)"), F.lit(str(2**63 - 1)).cast("decimal(20,0)")
    bad_number = lambda e: ((e["x"]["kind"] == "i") & (e["x"]["i0"].isNull() | (e["x"]["i0"] < low) | (e["x"]["i0"] > high))) | ((e["x"]["kind"] == "u") & (e["x"]["u"].isNull() | (e["x"]["u"] > F.lit(str(2**64 - 1)).cast("decimal(20,0)"))))
    error = (
        F.when(F.col("cut") == 0, "missing fields")
        .when(F.col("measurement") == "", "empty measurement")
        .when(F.exists("tag_parts", lambda p: ~p.contains("=") | (key(p) == "") | (val(p) == "")), "bad tag")
        .when(F.col("payload") == "", "no fields")
        .when(F.exists("values", lambda x: ~x["ok"] | (x["k"] == "") | (x["v"] == "")), "bad field")
        .when(F.exists("values", lambda x: x["kind"].isNull()), "bad value")
        .when(F.exists("typed", bad_number), "number out of range")
        .when(F.col("stamp").isNotNull() & F.col("time_ns").isNull(), "bad timestamp")
    )
    df = df.withColumn("error", error)
    given = F.map_from_entries(F.transform("tag_parts", lambda p: F.struct(key(p), val(p))))
    usual = F.create_map(*[F.lit(x) for kv in (default_tags or {}).items() for x in kv]) if default_tags else F.expr("cast(map() as map<string,string>)")
    tags = F.map_concat(usual, given)
    final = lambda e: F.struct(e["x"]["kind"].alias("kind"), e["x"]["i0"].cast("bigint").alias("i"), e["x"]["u"].alias("u"), e["x"]["f"].alias("f"), e["x"]["s"].alias("s"), e["x"]["b"].alias("b")).cast(VALUE)
    good = F.col("error").isNull()
    df = df.withColumns({
        "tags": F.when(good, tags),
        "fields": F.when(good, F.map_from_entries(F.transform("typed", lambda e: F.struct(e["k"], final(e))))),
        "time_ns": F.when(good, F.coalesce(scalars.from_precision(F.col("time_ns"), precision), F.lit(default_time))),
    })
    # a filter on an error that isn't deterministic stays above: below, the optimiser would write the whole parser into it
    return df.select(F.lit(database).alias("database"), "measurement", "time_ns", "tags", "fields", scalars.series_key(F.col("tags")).alias("series_key"), F.monotonically_increasing_id().alias("ingest_seq"), "line", F.when(F.monotonically_increasing_id() >= 0, F.col("error")).alias("error"))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").drop("line", "error")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select("line", "error")


def render(points: DataFrame) -> DataFrame:
    """Points back to lines."""
    text = lambda v: F.when(v["kind"] == "i", F.concat(v["i"].cast("string"), F.lit("i"))).when(v["kind"] == "u", F.concat(v["u"].cast("string"), F.lit("u"))).when(v["kind"] == "f", v["f"].cast("string")).when(v["kind"] == "b", v["b"].cast("string")).otherwise(F.concat(F.lit('"'), F.replace(F.replace(v["s"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    fields = F.array_join(F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(k, F.lit("="), text(F.col("fields")[k]))), ",")
    head = F.when(F.col("series_key") == "", F.col("measurement")).otherwise(F.concat_ws(",", "measurement", "series_key"))
    return points.select(F.concat_ws(" ", head, fields, F.col("time_ns").cast("string")).alias("value"))
