"""Databases, retention policies, measurements and their keys."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


class CatalogError(ValueError):
    pass


@dataclass
class Policy:
    name: str
    duration: int = 7 * 86400  # seconds; 0 keeps for ever
    replication: int = 1
    shard_duration: int = 7 * 86400

    def expired(self, time_s: int, now_s: int) -> bool:
        return bool(self.duration) and now_s - time_s > self.duration


@dataclass
class Database:
    name: str
    policies: dict[str, Policy] = field(default_factory=dict)
    default: str | None = None
    rules: dict[str, dict] = field(default_factory=dict)
    #: name: tags, fields (name: type), generation (the table's folder), writes (shard: how many since it had one row a key)
    measurements: dict[str, dict] = field(default_factory=dict)

    @property
    def shard_duration(self) -> int:
        return self.policies[self.default].shard_duration if self.default else Policy("").shard_duration


class Catalog:
    def __init__(self):
        self.databases: dict[str, Database] = {}

    def database(self, name: str) -> Database:
        if name not in self.databases:
            raise CatalogError(f"database not found: {name}")
        return self.databases[name]

    def create_database(self, name: str) -> Database:
        if name in self.databases:
            raise CatalogError(f"database exists: {name}")
        self.databases[name] = Database(name)
        return self.databases[name]

    def drop_database(self, name: str) -> None:
        self.database(name)
        del self.databases[name]

    def put_policy(self, database: str, policy: Policy, default: bool = False) -> None:
        """The first policy of a database is its default, later ones only on request."""
        db = self.database(database)
        db.policies[policy.name] = policy
        if default or db.default is None:
            db.default = policy.name

    def learn(self, database: str, measurement: str, tags: list[str], fields: dict[str, str]) -> dict:
        """Add keys; a number field that has been of another number type becomes double, any other mix string."""
        known = self.database(database).measurements.setdefault(measurement, {"tags": [], "fields": {}, "generation": 0, "writes": {}})
        known["tags"] = sorted({*known["tags"], *tags})
        for name, kind in fields.items():
            old = known["fields"].get(name, kind)
            numbers = ("bigint", "double", "decimal(20,0)")
            known["fields"][name] = kind if old == kind else "double" if old in numbers and kind in numbers else "string"
        return known

    def measurement(self, database: str, name: str) -> dict:
        found = self.database(database).measurements.get(name)
        if found is None:
            raise CatalogError(f"measurement not found: {name}")
        return found

    def dump(self) -> str:
        return json.dumps({n: asdict(d) for n, d in self.databases.items()})

    @classmethod
    def load(cls, text: str) -> Catalog:
        out = cls()
        for n, d in json.loads(text).items():
            out.databases[n] = Database(n, {k: Policy(**p) for k, p in d["policies"].items()}, d["default"], d.get("rules", {}), d["measurements"])
        return out
