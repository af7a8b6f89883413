"""Anchor results on small tables, parser tables, and plans."""

import math

import pytest
from pyspark.sql import functions as F

from chronoframe import promql
from chronoframe.api import Engine, QueryRequest
from chronoframe.catalog import Catalog, CatalogError, Policy
from chronoframe.functions import scalars
from chronoframe.model import Measurement
from chronoframe.operators import downsample, lifecycle
from chronoframe.plans import catalogue
from chronoframe.ql.binder import query
from chronoframe.ql.parser import Both, Compare, Either, Not, QueryError, parse, parse_condition
from chronoframe.sources import lineprotocol, prometheus


def cpu(spark, rows):
    return Measurement("cpu", spark.createDataFrame(rows, "time_ns bigint, host string, value double"), "time_ns", {"host": "host"}, {"value": "value"})


@pytest.fixture(scope="module")
def ten(spark):
    return cpu(spark, [(1000 + 100 * i, "server1" if i < 5 else "server2", i * 10.0) for i in range(10)])


@pytest.mark.parametrize("where,n", [("value > 25.0", 7), ("value > 25", 7), ("host = 'server1'", 5), ("time >= 1300 AND time < 1700", 4), ("NOT value > 25", 3), ("missing = 1", 0), ("missing != 1", 10), ("host > 'a'", 0), ("value = 10 OR value = 20 AND host = 'server2'", 1), ("(value = 10 OR value = 20) AND host = 'server1'", 2)])
def test_filters(ten, where, n):
    assert query(f"SELECT COUNT(*) FROM cpu WHERE {where}", ten).first()[0] == n


def test_nan_compares_with_nothing(spark):
    m = cpu(spark, [(1, "a", float("nan")), (2, "a", 1.0)])
    assert query("SELECT COUNT(*) FROM cpu WHERE value > 0", m).first()[0] == 1


def test_aggregates_and_buckets(ten):
    r = query("SELECT SUM(value), MEAN(value), MIN(value), MAX(value), FIRST(value), LAST(value), COUNT(value) FROM cpu", ten).first()
    assert tuple(r) == (450.0, 45.0, 0.0, 90.0, 0.0, 90.0, 10)
    none = query("SELECT SUM(value), COUNT(value), MAX(value) FROM cpu WHERE value > 1000", ten).first()
    assert tuple(none) == (0.0, 0, None)
    rows = query("SELECT MEAN(value) FROM cpu GROUP BY time(300ns)", ten).orderBy("time").collect()
    assert [tuple(r) for r in rows] == [(900, 5.0), (1200, 30.0), (1500, 60.0), (1800, 85.0)]


def test_order_limit_offset(ten):
    assert [r[0] for r in query("SELECT value FROM cpu ORDER BY time DESC LIMIT 2 OFFSET 1", ten).collect()] == [1800, 1700]
    assert query("SELECT value FROM cpu SLIMIT 1 SOFFSET 1", ten).count() == 5


def test_parser_trees():
    assert parse_condition("a = 1 OR b = 2 AND NOT c = 'x'") == Either(Compare("a", "=", 1), Both(Compare("b", "=", 2), Not(Compare("c", "=", "x"))))
    q = parse("select MEAN(Value) as m from cpu where host = 'x' group by time(1h), host order by time desc limit 5 slimit 2")
    assert (q.items[0].name, q.items[0].alias, q.interval, q.tags, q.descending, q.limit, q.slimit) == ("Value", "m", 3600 * 10**9, ["host"], True, 5, 2)
    assert parse("SHOW TAG VALUES FROM cpu WITH KEY = host").args["key"] == "host"
    assert parse("CREATE RETENTION POLICY rp ON db DURATION 30d REPLICATION 2 DEFAULT").args == {"name": "rp", "database": "db", "duration": 30 * 86400, "replication": 2, "default": True}
    for bad in ("", "SELECT", "SELECT value", "SELECT MEDIAN(x) FROM cpu", "SELECT * FROM cpu WHERE", "FROB", "SELECT * FROM cpu LIMIT x"):
        with pytest.raises(QueryError):
            parse(bad)


def test_scalars(spark):
    assert [scalars.duration_seconds(x) for x in ("5m", "= 2h", "90", "1w", "m")] == [300, 7200, 90, 604800, 0]
    with pytest.raises(ValueError):
        scalars.duration_ns("5 parsecs")
    assert [scalars.field_text(x) for x in (1.0, 0.5, True, 3, None, 1e20)] == ["1", "0.5", "true", "3", "", "100000000000000000000"]
    r = spark.range(1).select(scalars.time_bucket(F.lit(-7).cast("long"), 2), scalars.shard_id(F.lit(-1).cast("long"), 10), scalars.crc32_hex(F.lit("a"))).first()
    assert tuple(r) == (-6, -1, "e8b7be43")
    assert scalars.url_decode("hello%20world+x%2Fy") == "hello world x/y"


def test_line_protocol(spark):
    text = [
        'cpu,host=a,region=w usage=50.0,n=100i,u=18446744073709551615u,ok=true,msg="hello world" 1234567890', 'm s="a\\"b" 5', "cpu,host=a usage=1", "x v=inf 1", "x v=-7i -3",
        ",host=a v=1", "cpu,host=a", "# note", "", "x v=1d 1", "x v=abc 1", "x v=99999999999999999999i 1", "x,h= v=1 1", "x v= 1", "x v=1 2 3x",
    ]
    parsed = lineprotocol.parse(spark.createDataFrame([(t,) for t in text], "value string"))
    rows = lineprotocol.good(parsed).orderBy("ingest_seq").collect()
    assert [(r.measurement, r.time_ns, r.series_key) for r in rows] == [("cpu", 1234567890, "host=a,region=w"), ("m", 5, ""), ("cpu", 0, "host=a"), ("x", 1, ""), ("x", -3, "")]
    f = rows[0].fields
    assert (f["usage"].f, f["n"].i, int(f["u"].u), f["ok"].b, f["msg"].s) == (50.0, 100, 2**64 - 1, True, "hello world")
    assert rows[1].fields["s"].s == 'a"b' and rows[3].fields["v"].f == math.inf and rows[4].fields["v"].i == -7
    assert lineprotocol.errors(parsed).count() == 8


def test_prometheus_codec():
    assert [prometheus.varint(n).hex() for n in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]
    s = {"labels": [{"name": "__name__", "value": "up"}, {"name": "host", "value": "é"}], "samples": [{"value": 0.75, "timestamp": -5}, {"value": 1.5, "timestamp": 1234567890}]}
    assert prometheus.decode_write(prometheus.encode_write([s, s])) == [s, s]


def test_nearest_sample(spark):
    m = cpu(spark, [(0, "a", 1.0), (10 * promql.MS, "a", 2.0)])
    assert [r.value for r in promql.nearest(m, [], 0, 10, 5).orderBy("time").collect()] == [1.0, 1.0, 2.0]
    assert math.isnan(promql.nearest(m, [("host", "=", "zz")], 0, 0, 5).first().value)
    assert promql.parse('up{host="a",x!~"b.*"}') == ("up", [("host", "=", "a"), ("x", "!~", "b.*")]) and promql.parse("rate(up[5m])")[0] == "unknown"


def test_downsample_and_lifecycle(spark):
    df = spark.createDataFrame([(60 * i, 10 * (i + 1)) for i in range(8)], "time bigint, value bigint")
    assert [tuple(r) for r in downsample.downsample(df, 300).orderBy("time").collect()] == [(0, 30), (300, 70)]
    assert tuple(downsample.aggregates(df.limit(0)).first()) == (0,) * 7
    assert downsample.Interval.of(3600) == downsample.Interval.HOUR1 and downsample.Interval.of(999) is None
    now = 10**15
    t = spark.createDataFrame([(now,), (now - 10_000 * 10**9,), (now - 200_000 * 10**9,), (now + 1,)], "time_ns bigint")
    assert [r[0] for r in t.select(lifecycle.tier(F.col("time_ns"), now, 7200, 86400)).collect()] == ["hot", "warm", "cold", "hot"]
    assert lifecycle.unexpired(t, 20_000, now).count() == 3 and lifecycle.unexpired(t, 0, now).count() == 4


def test_catalog():
    c = Catalog()
    c.create_database("d")
    with pytest.raises(CatalogError):
        c.create_database("d")
    c.put_policy("d", Policy("a"))
    c.put_policy("d", Policy("b"))
    assert c.database("d").default == "a"
    assert c.learn("d", "m", ["x"], {"v": "bigint"}) and c.learn("d", "m", [], {"v": "double"})["fields"] == {"v": "double"}
    assert Catalog.load(c.dump()).database("d").measurements == c.database("d").measurements
    assert not Policy("p", 100).expired(2000, 1000) and Policy("p", 100).expired(800, 1000)


def test_engine_life(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db", clock=lambda: 5_000)
    n, errors = e.write_lines("cpu,host=a v=1i 1000\ncpu,host=b v=2i 2000\nbad line here x")
    assert n == 2 and len(errors) == 1
    e.write_lines("cpu,host=a v=9i 1000\ncpu,host=c v=0.5 3000")
    rows = e.query("SELECT v, host FROM cpu ORDER BY time").collect()
    assert [(r.time, r.v, r.host) for r in rows] == [(1000, 9.0, "a"), (2000, 2.0, "b"), (3000, 0.5, "c")]
    assert e.query("SHOW SERIES CARDINALITY FROM cpu").first()[0] == 3
    assert {r[0] for r in e.query("SHOW TAG KEYS").collect()} == {"host"}
    name = e.snapshot("default")
    e.query("DELETE FROM cpu WHERE host = 'a'")
    assert e.query("SELECT COUNT(*) FROM cpu").first()[0] == 2 and e.verify_snapshot("default", name)
    e.compact("cpu")
    e.restore("default", name)
    assert e.query("SELECT COUNT(v) FROM cpu").first()[0] == 3
    e.query("CREATE RETENTION POLICY rp ON default DURATION 30d")
    assert e.execute(QueryRequest("cpu").with_filter("host = 'b'").with_fields(["v"])).first().v == 2.0
    e.query("DROP MEASUREMENT cpu")
    with pytest.raises(CatalogError):
        e.query("SELECT * FROM cpu")


def test_predicates_reach_the_scan(spark):
    df = query("SELECT value FROM events WHERE event_type = 'error' AND time >= '2024-01-05'", catalogue.events(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_registered_queries_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_points_to_wide_widens_all_points(spark):
    sf = "/root/testdata/sf0.001"
    assert catalogue.queries()["points_to_wide"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count() > 500
