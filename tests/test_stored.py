"""Stored measurements: plans, replacements, backups, the HTTP endpoint."""

import json

import pytest
from pyspark.sql import functions as F

from chronoframe import render, server
from chronoframe.api import Engine
from chronoframe.functions import scalars
from chronoframe.operators import aggregates, limits
from chronoframe.operators.downsample import Rule
from chronoframe.plans import catalogue
from chronoframe.ql.parser import parse_condition
from chronoframe.operators import filters
from chronoframe.sources import lineprotocol

WEEK = 7 * 86400 * 10**9


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db", clock=lambda: 5 * WEEK)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_go_to_the_shards_and_push_down(engine):
    engine.write_lines("\n".join(f"cpu,host=h{i % 3} v={i}i {i * WEEK}" for i in range(6)))
    df = engine.query(f"SELECT v FROM cpu WHERE host = 'h1' AND time >= {WEEK} AND time < {3 * WEEK}", default_limit=None)
    text = plan(df)
    assert "SortAggregate" not in text and "HashAggregate" not in text  # one write: one row a key
    assert "shard_id" in text.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(host,h1)" in text
    assert [r.v for r in df.collect()] == [1]
    engine.write_lines(f"cpu,host=h1 v=9i {WEEK}")
    again = engine.query(f"SELECT v FROM cpu WHERE host = 'h1' AND time < {3 * WEEK}", default_limit=None)
    text = plan(again)
    assert text.index("Aggregate") < text.index("EqualTo(host,h1)")  # the filter is in the scan, below the aggregate
    assert [r.v for r in again.collect()] == [9]
    engine.compact("cpu")
    assert "Aggregate" not in plan(engine.query("SELECT v FROM cpu", default_limit=None)) and engine.query("SELECT COUNT(*) FROM cpu").first()[0] == 6


def test_conditions_on_keys():
    tree = parse_condition("host = 'a' AND v > 1 AND (time > 5 OR host = 'b') AND time <= 9")
    assert filters.time_bounds(tree, 0) == (None, 9)
    assert filters._names(filters.on_keys(tree, {"time", "host"})) == {"time", "host"}
    assert filters.on_keys(parse_condition("v = 1 OR host = 'a'"), {"host"}) is None and filters.on_keys(None, {"host"}) is None


def test_a_failed_replacement_leaves_the_table(engine, monkeypatch):
    engine.write_lines("cpu,host=a v=1i 1000\ncpu,host=b v=2i 2000")
    monkeypatch.setattr(engine, "_save", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.delete("cpu")
    monkeypatch.undo()
    other = Engine(engine.spark, engine.base)
    assert other.query("SELECT COUNT(*) FROM cpu").first()[0] == 2
    other.query("DELETE FROM cpu WHERE host = 'a'")
    assert Engine(engine.spark, engine.base).query("SELECT COUNT(*) FROM cpu").first()[0] == 1


def test_backups_full_and_incremental(engine, tmp_path):
    engine.write_lines("cpu,host=a v=1i 1000\ncpu,host=b v=2i 2000")
    engine.query("CREATE RETENTION POLICY p ON default DURATION 0s DEFAULT")
    engine.backup("default", f"file://{tmp_path}/full")
    mark = engine.batch + 1
    engine.write_lines("cpu,host=a v=7i 1000\ncpu,host=c v=3i 3000")
    engine.backup("default", f"file://{tmp_path}/more", mark)
    other = Engine(engine.spark, f"file://{tmp_path}/other")
    other.restore_backup(f"file://{tmp_path}/full", "copy")
    assert other.catalog.database("copy").default == "p" and other.query("SELECT SUM(v) FROM cpu", "copy").first()[0] == 3
    other.restore_backup(f"file://{tmp_path}/more", "copy")
    assert other.query("SELECT SUM(v) FROM cpu", "copy").first()[0] == 12


def test_rules(engine):
    with pytest.raises(ValueError):
        Rule("r", "cpu", "cpu_5m", 301)
    engine.write_lines("\n".join(f"cpu,host=a v={i}i {i * 100 * 10**9}" for i in range(6)))
    engine.add_rule(Rule("r", "cpu", "cpu_5m", 300, "sum"))
    engine.run_rules("v")
    assert [r.value for r in engine.query("SELECT value FROM cpu_5m ORDER BY time").collect()] == [3, 12]
    assert Engine(engine.spark, engine.base).catalog.database("default").rules["r"]["interval"] == 300
    engine.drop_rule("r")
    assert not engine.catalog.database("default").rules


def test_http(engine):
    assert server.answer(engine, "GET", "/ping", b"") == (204, b"")
    assert server.answer(engine, "POST", "/write?precision=ms", b"cpu,host=a v=1.5 1\nbad")[0] == 400
    status, body = server.answer(engine, "GET", "/query?q=SELECT+v+FROM+cpu", b"")
    assert status == 200 and json.loads(body)["results"][0]["series"][0]["values"] == [["1000000", "1.5"]]
    assert server.answer(engine, "GET", "/query?q=SELECT+v+FROM+nothing", b"")[0] == 400
    assert server.answer(engine, "GET", "/other", b"")[0] == 404 and b"points 1" in server.answer(engine, "GET", "/metrics", b"")[1]


def test_answers_are_whole_or_marked(spark):
    df = spark.range(30).select(F.col("id").alias("time"), F.col("id").cast("double").alias("value"))
    whole, cut = json.loads(render.influx_json(df, "x")), json.loads(render.influx_json(df, "x", 10))
    assert len(whole["results"][0]["series"][0]["values"]) == 30 and "partial" not in whole["results"][0]["series"][0]
    assert len(cut["results"][0]["series"][0]["values"]) == 10 and cut["results"][0]["series"][0]["partial"]
    assert "warnings" not in json.loads(render.prometheus_matrix({}, df)) and "warnings" in json.loads(render.prometheus_matrix({}, df, 29))


def test_bitmaps(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 7, 8, 32767, 32768, 100000)], "id long")
    bits = aggregates.series_bitmap(ids)
    assert sorted(r.id for r in aggregates.bitmap_ids(bits).collect()) == [0, 7, 8, 32767, 32768, 100000]
    assert sorted(r.id for r in aggregates.bitmap_ids(bits, 8, 32768).collect()) == [8, 32767]
    assert [aggregates.bitmap_contains(bits, n).first()[0] for n in (7, 9, 100000, 32768)] == [True, False, True, True]
    left = aggregates.bitmap_remove(bits, spark.createDataFrame([(7,), (32768,)], "id long"))
    assert sorted(r.id for r in aggregates.bitmap_ids(left).collect()) == [0, 8, 32767, 100000]


def test_latest_and_units(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, t long, v string")
    assert sorted(tuple(r) for r in limits.latest(df, ["k"], ["t"]).collect()) == [("a", 3, "y"), ("b", 2, "z")]
    assert scalars.duration_seconds("2hr") == 7200 and scalars.duration_seconds("1wk") == 604800
    parsed = lineprotocol.parse(spark.createDataFrame([("m s='it is' 5",)], "value string"))
    assert lineprotocol.good(parsed).first().fields["s"].s == "it is"


def test_flagship(spark):
    assert catalogue.queries()[catalogue.FLAGSHIP](spark, "/root/testdata/sf0.001").count() > 0
