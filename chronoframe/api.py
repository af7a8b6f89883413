"""The engine: statements, writes and reads over Parquet tables in a folder.

Every measurement is a Parquet table in wide form, partitioned by shard, under
``base/database/measurement/generation``. Writes append. A read goes to the shards
that the time bounds allow, with the conditions on time and tags (the key) before
anything else, and takes the last write of each (time, series) in the shards that
were written more than once. Deletes, retention and compaction write a new
generation, which the catalog, replaced as a whole, then points to.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import promql, render
from .catalog import Catalog, CatalogError, Policy
from .model import Measurement, infer, points, value_struct, widen
from .operators import filters, lifecycle
from .operators.downsample import Rule, apply_rule
from .ql.binder import DEFAULT_LIMIT, bind
from .ql.parser import Command, QueryError, Select, parse
from .sources import lineprotocol, prometheus
from .store import Files


class QueryRequest:
    """A query put together in code."""

    def __init__(self, measurement: str, database: str = "default"):
        self.measurement, self.database = measurement, database
        self.fields: list[str] = []
        self.group_by: list[str] = []
        self.condition: str | None = None
        self.limit: int | None = None
        self.offset = 0
        self.range: tuple[int, int] | None = None

    def _with(self, **kw) -> QueryRequest:
        self.__dict__.update(kw)
        return self

    def with_fields(self, fields: list[str]) -> QueryRequest:
        return self._with(fields=fields)

    def with_filter(self, condition: str) -> QueryRequest:
        return self._with(condition=condition)

    def with_group_by(self, tags: list[str]) -> QueryRequest:
        return self._with(group_by=tags)

    def with_limit(self, n: int) -> QueryRequest:
        return self._with(limit=n)

    def with_offset(self, n: int) -> QueryRequest:
        return self._with(offset=n)

    def with_range(self, start_ns: int, end_ns: int) -> QueryRequest:
        return self._with(range=(start_ns, end_ns))


class Engine:
    def __init__(self, spark: SparkSession, base: str, clock: Callable[[], int] = time.time_ns, compression: str = "snappy", bloom: int = 0):
        """``compression``: a Parquet codec. ``bloom``: how many series a file's Bloom filter expects; 0 for none."""
        self.compression, self.bloom = compression, bloom
        self.spark, self.base, self.clock, self.files = spark, base.rstrip("/"), clock, Files(spark)
        saved = self.files.read(f"{self.base}/_catalog.json")
        self.catalog = Catalog.load(saved) if saved else Catalog()
        self.current, self.batch = "default", 0
        self.external: dict[tuple[str, str], Measurement] = {}
        self.cache: dict[tuple, tuple[float, DataFrame]] = {}

    # --- catalog

    def _save(self) -> None:
        self.files.write(f"{self.base}/_catalog.json", self.catalog.dump())
        for _, df in self.cache.values():
            df.unpersist()
        self.cache.clear()

    def _database(self, name: str | None) -> str:
        name = name or self.current
        if name == "default" and name not in self.catalog.databases:
            self.catalog.create_database(name)
        self.catalog.database(name)
        return name

    def register(self, m: Measurement, database: str | None = None) -> None:
        """A typed table from elsewhere as a measurement."""
        db = self._database(database)
        self.external[db, m.name] = m
        self.catalog.learn(db, m.name, list(m.tags), {k: m.field_type(k) for k in m.fields})

    def path(self, database: str, measurement: str) -> str:
        return f"{self.base}/{database}/{measurement}/g{self.catalog.measurement(database, measurement)['generation']}"

    def measurement(self, name: str, database: str | None = None, where=None) -> Measurement:
        """The rows of a measurement that the part of ``where`` on time and tags allows."""
        db = self._database(database)
        if (db, name) in self.external:
            return self.external[db, name]
        known = self.catalog.measurement(db, name)
        tags, fields = known["tags"], known["fields"]
        column = {k: f"{k}_field" if k in tags or k in ("time_ns", "series_key", "ingest_seq") else k for k in fields}
        schema = ", ".join(["time_ns bigint", "series_key string", "ingest_seq bigint", *[f"`{t}` string" for t in tags], *[f"`{column[k]}` {v}" for k, v in fields.items()], "shard_id bigint"])
        path = self.path(db, name)
        df = self._read(path, schema) if self.files.exists(path) else self.spark.createDataFrame([], schema)
        m = Measurement(name, df, "time_ns", {t: f"`{t}`" for t in tags}, {k: f"`{c}`" for k, c in column.items()})
        now = self.clock()
        low, high = filters.time_bounds(where, now)
        wide = self.catalog.database(db).shard_duration * 10**9
        shards = {int(s): n for s, n in known["writes"].items() if (low is None or int(s) >= low // wide) and (high is None or int(s) <= high // wide)}
        if low is not None or high is not None:
            m = m.where(F.col("shard_id").isin(list(shards)) if shards else F.lit(False))
        keys = filters.on_keys(where, {"time", *tags} - set(fields))
        if keys is not None:
            m = m.where(filters.condition(m, keys, now))
        again = sorted(s for s, n in shards.items() if n > 1)
        if again:
            twice = F.col("shard_id").isin(again)
            rows = lifecycle.last_write_wins(m.df.where(twice), ["shard_id", "time_ns", "series_key"])
            m = Measurement(name, rows if len(again) == len(shards) else rows.union(m.df.where(~twice)), m.time, m.tags, m.fields)
        return m

    def _read(self, path: str, schema: str) -> DataFrame:
        """Files written before a field changed its type are cast to the type it has now."""
        wanted = self.spark.createDataFrame([], schema).schema
        parts = []
        for folder in self.files.folders(path):  # one folder for each set of types
            df = self.spark.read.parquet(f"{path}/{folder}")
            parts.append(df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]))
        return lifecycle.union_all(*parts) if parts else self.spark.createDataFrame([], wanted)

    # --- writes

    def _write(self, rows: DataFrame, folder: str, mode: str = "errorifexists") -> None:
        """By shard, with the engine's compression, and Bloom filters on the series."""
        w = rows.write.mode(mode).option("compression", self.compression)
        if self.bloom:
            w = w.option("parquet.bloom.filter.enabled#series_key", "true").option("parquet.bloom.filter.expected.ndv#series_key", str(self.bloom))
        w.partitionBy("shard_id").parquet(folder)

    def write(self, points: DataFrame, database: str | None = None) -> int:
        """Append points (the ingest form); the number of points."""
        db = self._database(database)
        self.batch = max(self.clock(), self.batch + 1)  # later writes win, and within this one later rows
        batch = lifecycle.last_write_wins(points).withColumn("ingest_seq", F.lit(self.batch).cast("bigint")).persist()
        try:
            names = [r[0] for r in batch.select("measurement").distinct().collect()]
            for name in names:
                own = batch.where(F.col("measurement") == name)
                tags, fields, _ = infer(own)
                self.catalog.learn(db, name, tags, fields)
                known = self.catalog.measurement(db, name)
                wide = widen(own, name, known["tags"], known["fields"]).df
                kinds = json.dumps([known["tags"], known["fields"]], sort_keys=True)
                folder = f"v{len(known['tags'])}_{len(known['fields'])}_{abs(hash_text(kinds)):x}"
                rows = lifecycle.with_shard(wide, self.catalog.database(db).shard_duration)
                self._write(rows, f"{self.path(db, name)}/{folder}", "append")
                for r in rows.select("shard_id").distinct().collect():  # a row a shard
                    known["writes"][str(r[0])] = known["writes"].get(str(r[0]), 0) + 1
            n = batch.count()
        finally:
            batch.unpersist()
        self._save()
        return n

    def write_lines(self, text: str | DataFrame, database: str | None = None, precision: str = "ns", default_tags: dict[str, str] | None = None) -> tuple[int, list[str]]:
        """(points written, first errors). Good lines are written even if others are not."""
        lines = self.spark.createDataFrame([(x,) for x in text.splitlines()], "value string") if isinstance(text, str) else text
        parsed = lineprotocol.parse(lines, default_tags=default_tags, precision=precision)
        n = self.write(lineprotocol.good(parsed), database)
        return n, [f"{r[1]}: {r[0]}" for r in lineprotocol.errors(parsed).limit(100).collect()]

    def write_prometheus(self, body: bytes) -> int:
        if prometheus.DATABASE not in self.catalog.databases:
            self.catalog.create_database(prometheus.DATABASE)
        rows = self.spark.createDataFrame([(bytearray(body),)], "body binary")
        return self.write(prometheus.to_points(prometheus.decode_requests(rows)), prometheus.DATABASE)

    def read_prometheus(self, body: bytes) -> bytes:
        out = []
        for q in prometheus.decode_read(body):
            name = next((v for op, k, v in q["matchers"] if k == "__name__" and op == "="), "")
            rest = [(k, op, v) for op, k, v in q["matchers"] if k != "__name__"]
            rows = promql.remote_read(self.measurement(name, prometheus.DATABASE), rest, q["start_ms"], q["end_ms"]).collect()
            out.append([r.asDict(recursive=True) for r in rows])
        return prometheus.encode_read_response(out)

    # --- queries

    def query(self, text: str, database: str | None = None, default_limit: int | None = DEFAULT_LIMIT) -> DataFrame:
        """Any statement. SELECT and SHOW give their rows, the others one row ``status``."""
        q = parse(text)
        if isinstance(q, Select):
            return bind(q, self.measurement(q.measurement, database, q.where), self.clock(), default_limit)
        return self._command(q, database)

    def execute(self, r: QueryRequest) -> DataFrame:
        """Validated: the measurement has a name, the database exists and has a policy."""
        if not r.measurement:
            raise QueryError("measurement must not be empty")
        if not self.catalog.database(r.database).policies:
            raise CatalogError(f"database {r.database} has no retention policy")
        fields = r.fields or ["*"]
        conditions = [f"({r.condition})"] * bool(r.condition) + ([f"time >= {r.range[0]} AND time < {r.range[1]}"] if r.range else [])
        quoted = ", ".join(f'SUM("{f}") AS "{f}"' if r.group_by else "*" if f == "*" else f'"{f}"' for f in (sorted(self.catalog.measurement(r.database, r.measurement)["fields"]) if r.group_by and fields == ["*"] else fields))
        text = f'SELECT {quoted} FROM "{r.measurement}"' + (" WHERE " + " AND ".join(conditions) if conditions else "") + (" GROUP BY " + ", ".join(f'"{t}"' for t in r.group_by) if r.group_by else "")
        text += (f" LIMIT {r.limit}" if r.limit is not None else "") + (f" OFFSET {r.offset}" if r.offset else "")
        return self.query(text, r.database, None)

    def cached(self, text: str, database: str | None = None, ttl_s: float = 300, most: int = 1000) -> DataFrame:
        """A result kept in executors' storage for ``ttl_s``; writes drop all of them, the oldest goes beyond ``most``."""
        key, now = (text, database or self.current), time.monotonic()
        if key in self.cache and now - self.cache[key][0] < ttl_s:
            return self.cache[key][1]
        if len(self.cache) >= most:
            self.cache.pop(min(self.cache, key=lambda k: self.cache[k][0]))[1].unpersist()
        self.cache[key] = (now, self.query(text, database).persist())
        return self.cache[key][1]

    def prom_instant(self, selector: str, database: str = prometheus.DATABASE) -> str:
        name, matchers = promql.parse(selector)
        r = promql.instant(self.measurement(name, database), matchers).first()
        return render.prometheus_vector({"__name__": name} | {k: v for k, op, v in matchers if op == "="}, (r["time"] or 0) / 1e9, r["value"])

    def prom_range(self, selector: str, start_ms: int, end_ms: int, step_ms: int, database: str = prometheus.DATABASE) -> str:
        name, matchers = promql.parse(selector)
        rows = promql.nearest(self.measurement(name, database), matchers, start_ms, end_ms, step_ms)
        return render.prometheus_matrix({"__name__": name} | {k: v for k, op, v in matchers if op == "="}, rows)

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _command(self, c: Command, database: str | None) -> DataFrame:
        a = c.args
        if c.kind.startswith("show_"):
            return self._show(c.kind[5:], a, database)
        if c.kind == "insert":
            n, errors = self.write_lines(a["line"], database)
            if errors:
                raise QueryError(errors[0])
        elif c.kind == "create_database":
            self.catalog.create_database(a["name"])
        elif c.kind == "drop_database":
            self.catalog.drop_database(a["name"])
            self.files.delete(f"{self.base}/{a['name']}")
        elif c.kind in ("create_policy", "alter_policy"):
            if c.kind == "create_policy" or "duration" in a:
                old = self.catalog.database(a["database"]).policies.get(a["name"], Policy(a["name"]))
                self.catalog.put_policy(a["database"], Policy(a["name"], a.get("duration", old.duration), a.get("replication", old.replication), a.get("shard_duration", old.shard_duration)), a.get("default", False))
        elif c.kind == "drop_measurement":
            db = self._database(database)
            self.catalog.measurement(db, a["name"])
            del self.catalog.database(db).measurements[a["name"]]
            self.files.delete(f"{self.base}/{db}/{a['name']}")
        elif c.kind in ("drop_series", "delete"):
            db = self._database(database)
            for name in [a["measurement"]] if a["measurement"] else list(self.catalog.database(db).measurements):
                self.delete(name, a["where"], db)
        elif c.kind == "use":
            self._database(a["database"])
            self.current = a["database"]
        self._save()
        return self._rows([("ok",)], "status string")

    def _show(self, what: str, a: dict, database: str | None) -> DataFrame:
        if what == "databases":
            return self._rows([(n,) for n in sorted(self.catalog.databases)], "name string")
        if what == "retention_policies":
            db = self.catalog.database(a["database"] or self.current)
            return self._rows([(p.name, p.duration, p.shard_duration, p.replication, p.name == db.default) for p in db.policies.values()], "name string, duration bigint, shard_duration bigint, replication int, `default` boolean")
        db = self._database(database)
        known = self.catalog.database(db).measurements
        if what == "measurements":
            return self._rows([(n,) for n in sorted(known)], "name string")
        names = [a["measurement"]] if a.get("measurement") else sorted(known)
        if a.get("measurement"):
            self.catalog.measurement(db, a["measurement"])
        if what == "tag_keys":
            return self._rows(sorted({(t,) for n in names for t in known[n]["tags"]}), "tag_key string")
        if what == "field_keys":
            return self._rows(sorted({(f, k) for n in names for f, k in known[n]["fields"].items()}), "field_key string, field_type string")
        parts = []
        for n in names:
            m = self.measurement(n, db)
            if a.get("where") is not None:
                m = m.where(filters.condition(m, a["where"], self.clock()))
            if what == "tag_values":
                keys = [k for k in ([a["key"]] if a.get("key") else sorted(m.tags)) if k in m.tags]
                pairs = [F.struct(F.lit(k).alias("key"), m.tag(k).cast("string").alias("value")) for k in keys]
                parts += [m.df.select(F.explode(F.array(*pairs)).alias("p")).select("p.key", "p.value").where("value IS NOT NULL").distinct()] if pairs else []
            else:
                parts.append(m.df.select(F.concat_ws(",", F.lit(n), F.nullif(m.series_key(), F.lit(""))).alias("series")).distinct())
        out = lifecycle.union_all(*parts).distinct() if parts else self._rows([], "key string, value string" if what == "tag_values" else "series string")
        return out.agg(F.count(F.lit(1)).alias("series")) if what == "series_cardinality" else out

    # --- maintenance

    def _replace(self, database: str, name: str, df: DataFrame) -> None:
        """A new generation; until the catalog is written, the old one is the table."""
        old, known = self.path(database, name), self.catalog.measurement(database, name)
        number = known["generation"] + 1
        self.files.delete(f"{self.base}/{database}/{name}/g{number}")  # of a replacement that failed
        self._write(df, f"{self.base}/{database}/{name}/g{number}/v0")
        known["generation"], known["writes"] = number, {f.partition("=")[2]: 1 for f in self.files.folders(f"{self.base}/{database}/{name}/g{number}/v0") if "=" in f}
        self._save()
        self.files.delete(old)

    def delete(self, name: str, where=None, database: str | None = None) -> None:
        """Remove the rows for which the condition holds; all of them without one."""
        db = self._database(database)
        if not self.files.exists(self.path(db, name)):
            return
        m = self.measurement(name, db)
        condition = F.lit(True) if where is None else filters.condition(m, where, self.clock())
        self._replace(db, name, lifecycle.delete_where(m.df, condition))

    def compact(self, name: str, database: str | None = None) -> None:
        """One row a key and few files a shard."""
        db = self._database(database)
        self._replace(db, name, lifecycle.compact(self.measurement(name, db).df, ["time_ns", "series_key"]))

    def enforce_retention(self, database: str | None = None) -> None:
        db = self._database(database)
        d = self.catalog.database(db)
        policy = d.policies.get(d.default or "")
        if policy and policy.duration:
            for name in d.measurements:
                if self.files.exists(self.path(db, name)):
                    self._replace(db, name, lifecycle.unexpired(self.measurement(name, db).df, policy.duration, self.clock()))

    def snapshot(self, database: str, keep: int = 10) -> str:
        """Copies of a database's tables and a manifest; the oldest beyond ``keep`` go."""
        root = f"{self.base}/_snapshots/{database}"
        name = f"{self.clock():020d}"
        manifest = {"name": name, "measurements": {}}
        for m in self.catalog.database(database).measurements:
            df = self.measurement(m, database).df
            self._write(df, f"{root}/{name}/{m}/v0")
            stored = self.spark.read.parquet(f"{root}/{name}/{m}/v0")
            manifest["measurements"][m] = {"rows": stored.count(), "checksum": table_checksum(stored), **self.catalog.measurement(database, m)}
        self.files.write(f"{root}/{name}/manifest.json", json.dumps(manifest))
        for old in self.snapshots(database)[:-keep]:
            self.files.delete(f"{root}/{old}")
        return name

    def snapshots(self, database: str) -> list[str]:
        return self.files.folders(f"{self.base}/_snapshots/{database}")

    def verify_snapshot(self, database: str, name: str) -> bool:
        root = f"{self.base}/_snapshots/{database}/{name}"
        manifest = json.loads(self.files.read(f"{root}/manifest.json") or "{}")
        return all(table_checksum(self.spark.read.parquet(f"{root}/{m}/v0")) == x["checksum"] for m, x in manifest.get("measurements", {}).items())

    def restore(self, database: str, name: str) -> None:
        """The tables as they were in a snapshot."""
        root = f"{self.base}/_snapshots/{database}/{name}"
        manifest = json.loads(self.files.read(f"{root}/manifest.json"))
        if database not in self.catalog.databases:
            self.catalog.create_database(database)
        for m in set(self.catalog.database(database).measurements) - set(manifest["measurements"]):
            del self.catalog.database(database).measurements[m]
        for m, x in manifest["measurements"].items():
            known = self.catalog.learn(database, m, [], {})
            known["tags"], known["fields"] = x["tags"], x["fields"]
            self._replace(database, m, self.spark.read.parquet(f"{root}/{m}/v0"))
        self._save()

    def backup(self, database: str, folder: str, since_ns: int | None = None) -> None:
        """Full, or the rows ingested since a time, with a manifest beside them."""
        for m in self.catalog.database(database).measurements:
            df = self.measurement(m, database).df
            df = df if since_ns is None else df.where(F.col("ingest_seq") >= since_ns)
            self._write(df, f"{folder}/{m}", "overwrite")
        known = self.catalog.database(database)
        self.files.write(f"{folder}/manifest.json", json.dumps({"database": database, "since": since_ns, "policies": {n: asdict(p) for n, p in known.policies.items()}, "default": known.default, "measurements": known.measurements}))

    def restore_backup(self, folder: str, database: str | None = None) -> None:
        """A full backup as a database, or an incremental one on top of what there is (its rows are later writes)."""
        manifest = json.loads(self.files.read(f"{folder}/manifest.json"))
        db = database or manifest["database"]
        if db not in self.catalog.databases:
            self.catalog.create_database(db)
            for p in manifest["policies"].values():
                self.catalog.put_policy(db, Policy(**p), p["name"] == manifest["default"])
        for m, x in manifest["measurements"].items():
            df = self.spark.read.parquet(f"{folder}/{m}")
            if manifest["since"] is not None and m in self.catalog.database(db).measurements:
                self.catalog.learn(db, m, x["tags"], x["fields"])
                old = self.measurement(m, db).df
                df = lifecycle.last_write_wins(old.unionByName(df, allowMissingColumns=True), ["shard_id", "time_ns", "series_key"])
            else:
                known = self.catalog.learn(db, m, [], {})
                known["tags"], known["fields"] = x["tags"], x["fields"]
            self._replace(db, m, df)

    def add_rule(self, rule: Rule, database: str | None = None) -> None:
        """A downsampling rule of a database; one of the same name is replaced."""
        self.catalog.database(self._database(database)).rules[rule.name] = asdict(rule)
        self._save()

    def drop_rule(self, name: str, database: str | None = None) -> None:
        self.catalog.database(self._database(database)).rules.pop(name)
        self._save()

    def run_rules(self, field: str, database: str | None = None) -> None:
        """Every rule's target measurement, written from a field of its source; rows past the rule's retention are left out."""
        db = self._database(database)
        for r in list(self.catalog.database(db).rules.values()):
            rule = Rule(**r)
            m = self.measurement(rule.source, db)
            made = apply_rule(m.df.select(m.time_ns().alias("time"), m.value(field).alias("value")), rule)
            made = lifecycle.unexpired(made, rule.retention, self.clock(), "time")
            self.write(points(made, F.lit(rule.target), F.col("time"), F.create_map(F.lit("rule"), F.lit(rule.name)), F.create_map(F.lit("value"), value_struct("i", F.col("value"))), F.lit(db)), db)

    def list_tables(self) -> DataFrame:
        """database, measurement and fields of every table, as a flight endpoint lists them."""
        rows = [(d.name, n, sorted(x["fields"])) for d in self.catalog.databases.values() for n, x in d.measurements.items()]
        return self._rows(rows, "database string, measurement string, fields array<string>")

    def stats(self) -> dict[str, int]:
        out = {"databases": len(self.catalog.databases), "measurements": 0, "series": 0, "points": 0, "tag_keys": 0, "field_keys": 0}
        for db in self.catalog.databases.values():
            for name, known in db.measurements.items():
                m = self.measurement(name, db.name)
                r = m.df.select(m.series_key().alias("k")).agg(F.count(F.lit(1)), F.countDistinct("k")).first()
                out["measurements"] += 1
                out["points"] += r[0]
                out["series"] += r[1]
                out["tag_keys"] += len(known["tags"])
                out["field_keys"] += len(known["fields"])
        return out

    def metrics(self) -> str:
        return render.metrics_text(self.stats())


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def table_checksum(df: DataFrame) -> str:
    """The same for the same rows in any order."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    r = df.agg(F.sum(F.crc32(row)), F.count(F.lit(1))).first()
    return f"{r[0] or 0:x}-{r[1]}"


__all__ = ["Engine", "QueryRequest"]
