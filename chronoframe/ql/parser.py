"""Statements of the query language: lexer and recursive-descent parser, to dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.scalars import duration_ns

AGGREGATES = ("COUNT", "SUM", "MEAN", "MIN", "MAX", "FIRST", "LAST")
_TOKEN = re.compile(
    r"""\s*(?:(?P<dur>\d+(?:ns|us|ms|[uµsmhdw])(?![\w.]))|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)
    |'(?P<str>(?:[^'\\]|\\.)*)'|"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<word>[A-Za-z_][\w.:\-]*(?<!-)|[A-Za-z_]\w*)|(?P<op><>|!=|>=|<=|=~|!~|[=<>+\-*(),;]))""",
    re.X,
)


class QueryError(ValueError):
    """A statement that can't be parsed or bound."""


@dataclass
class Compare:
    name: str
    op: str
    value: object


@dataclass
class Not:
    inner: object


@dataclass
class Both:
    left: object
    right: object


@dataclass
class Either:
    left: object
    right: object


@dataclass
class Now:
    """now() plus an offset in nanoseconds."""

    offset: int = 0


@dataclass
class Item:
    """A raw column, ``*``, or an aggregate of one."""

    name: str
    func: str | None = None
    alias: str | None = None


@dataclass
class Select:
    items: list[Item]
    measurement: str
    where: object | None = None
    tags: list[str] = field(default_factory=list)
    interval: int | None = None
    descending: bool = False
    order: str | None = None
    limit: int | None = None
    offset: int = 0
    slimit: int | None = None
    soffset: int = 0


@dataclass
class Command:
    """Any other statement: its kind and its arguments."""

    kind: str
    args: dict = field(default_factory=dict)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            if text[at:].strip():
                raise QueryError(f"unexpected {text[at:at + 20]!r}")
            break
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.t, self.i = text, tokens(text), 0

    def peek(self, *words: str) -> bool:
        for k, w in enumerate(words):
            if self.i + k >= len(self.t) or self.t[self.i + k][0] not in ("word", "op") or self.t[self.i + k][1].upper() != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            found = self.t[self.i][1] if self.i < len(self.t) else "the end"
            raise QueryError(f"expected {' '.join(words)}, found {found}")

    def name(self) -> str:
        if self.i < len(self.t) and self.t[self.i][0] in ("word", "quoted"):
            self.i += 1
            return self.t[self.i - 1][1]
        raise QueryError("expected a name")

    def integer(self) -> int:
        if self.i < len(self.t) and self.t[self.i][0] == "num" and self.t[self.i][1].isdigit():
            self.i += 1
            return int(self.t[self.i - 1][1])
        raise QueryError("expected an integer")

    def duration(self) -> int:
        if self.i < len(self.t) and self.t[self.i][0] in ("dur", "num"):
            self.i += 1
            return duration_ns(self.t[self.i - 1][1])
        raise QueryError("expected a duration")

    # conditions: NOT binds tighter than AND, AND tighter than OR
    def condition(self):
        left = self.conjunction()
        while self.take("OR"):
            left = Either(left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("AND"):
            left = Both(left, self.negation())
        return left

    def negation(self):
        if self.take("NOT"):
            return Not(self.negation())
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        name = self.name()
        if self.i >= len(self.t) or self.t[self.i][0] != "op" or self.t[self.i][1] not in ("=", "!=", "<>", "<", "<=", ">", ">=", "=~", "!~"):
            raise QueryError(f"expected a comparison after {name}")
        op = self.t[self.i][1]
        self.i += 1
        return Compare(name, "!=" if op == "<>" else op, self.literal())

    def literal(self):
        if self.take("NOW", "(", ")"):
            offset = 0
            while self.peek("+") or self.peek("-"):
                sign = 1 if self.take("+") else -1
                if sign < 0:
                    self.need("-")
                offset += sign * self.duration()
            return Now(offset)
        negative = self.take("-")
        if self.i >= len(self.t):
            raise QueryError("expected a value")
        kind, v = self.t[self.i]
        self.i += 1
        if kind == "num":
            number = int(v) if v.isdigit() else float(v)
            return -number if negative else number
        if kind == "dur":
            return ("duration", -duration_ns(v) if negative else duration_ns(v))
        if negative:
            raise QueryError("expected a number after -")
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", v)
        if kind == "word" and v.lower() in ("true", "false"):
            return v.lower() == "true"
        if kind in ("word", "quoted"):
            return v
        raise QueryError(f"unexpected {v!r}")

    def item(self) -> Item:
        if self.take("*"):
            return Item("*")
        name = self.name()
        if self.take("("):
            if name.upper() not in AGGREGATES:
                raise QueryError(f"unknown function {name}")
            arg = "*" if self.take("*") else self.name()
            self.need(")")
            if arg == "*" and name.upper() != "COUNT":
                raise QueryError(f"{name} needs a field")
            out = Item(arg, name.upper())
        else:
            out = Item(name)
        if self.take("AS"):
            out.alias = self.name()
        return out

    def select(self) -> Select:
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("FROM")
        out = Select(items, self.name())
        while self.i < len(self.t):
            if self.take("WHERE"):
                out.where = self.condition()
            elif self.take("GROUP", "BY"):
                while True:
                    if self.take("TIME", "("):
                        out.interval = self.duration()
                        self.need(")")
                    else:
                        out.tags.append("*" if self.take("*") else self.name())
                    if not self.take(","):
                        break
            elif self.take("ORDER", "BY"):
                out.order = self.name()
                out.descending = self.take("DESC") or (self.take("ASC") and False)
            elif self.take("LIMIT"):
                out.limit = self.integer()
            elif self.take("OFFSET"):
                out.offset = self.integer()
            elif self.take("SLIMIT"):
                out.slimit = self.integer()
            elif self.take("SOFFSET"):
                out.soffset = self.integer()
            else:
                raise QueryError(f"unexpected {self.t[self.i][1]!r}")
        return out

    def statement(self):
        if self.take("SELECT"):
            return self.select()
        out = self.command()
        if self.i < len(self.t):
            raise QueryError(f"unexpected {self.t[self.i][1]!r}")
        return out

    def where(self):
        return self.condition() if self.take("WHERE") else None

    def optional(self, word: str) -> str | None:
        return self.name() if self.take(word) else None

    def policy(self, args: dict) -> dict:
        while self.i < len(self.t):
            if self.take("DURATION"):
                self.take("=")
                args["duration"] = self.duration() // 10**9
            elif self.take("REPLICATION"):
                self.take("=")
                args["replication"] = self.integer()
            elif self.take("SHARD", "DURATION"):
                args["shard_duration"] = self.duration() // 10**9
            elif self.take("DEFAULT"):
                args["default"] = True
            else:
                break
        return args

    def command(self) -> Command:
        if self.take("CREATE", "DATABASE"):
            return Command("create_database", {"name": self.name()})
        if self.take("CREATE", "RETENTION", "POLICY"):
            args = {"name": self.name()}
            self.need("ON")
            return Command("create_policy", self.policy(args | {"database": self.name()}))
        if self.take("ALTER", "DATABASE"):
            args = {"database": self.name()}
            self.need("SET", "RETENTION", "POLICY")
            return Command("alter_policy", self.policy(args | {"name": self.name()}))
        if self.take("DROP", "DATABASE"):
            return Command("drop_database", {"name": self.name()})
        if self.take("DROP", "MEASUREMENT"):
            return Command("drop_measurement", {"name": self.name()})
        if self.take("DROP", "SERIES"):
            return Command("drop_series", {"measurement": self.optional("FROM"), "where": self.where()})
        if self.take("DELETE"):
            return Command("delete", {"measurement": self.optional("FROM"), "where": self.where()})
        for words in ("DATABASES", "MEASUREMENTS", "SERIES", "SERIES CARDINALITY", "RETENTION POLICIES", "TAG KEYS", "TAG VALUES", "FIELD KEYS")[::-1]:
            if self.take("SHOW", *words.split()):
                args: dict = {}
                if words == "RETENTION POLICIES":
                    self.take("ON")
                    args["database"] = self.name() if self.i < len(self.t) else None
                else:
                    args["measurement"] = self.optional("FROM")
                    if self.take("WITH", "KEY"):
                        self.need("=")
                        args["key"] = self.name()
                    elif words == "TAG VALUES" and self.i < len(self.t) and not self.peek("WHERE"):
                        args["key"] = self.name()
                    args["where"] = self.where()
                return Command("show_" + words.lower().replace(" ", "_"), args)
        if self.take("USE"):
            return Command("use", {"database": self.name()})
        if self.peek("SET") or self.peek("GRANT") or self.peek("REVOKE"):
            kind = self.t[self.i][1].lower()
            rest = [v for _, v in self.t[self.i + 1 :]]
            self.i = len(self.t)
            return Command(kind, {"args": rest})
        raise QueryError(f"unknown statement: {self.text[:40]!r}")


def parse(text: str) -> Select | Command:
    """One statement. Keywords are case-insensitive, names keep their case."""
    insert = re.match(r"\s*INSERT\s+(?:INTO\s+\S+\s+)?(.+)", text, re.I | re.S)
    if insert:
        return Command("insert", {"line": insert[1].strip().rstrip(";")})
    if not text.strip():
        raise QueryError("empty statement")
    p = _Parser(text)
    out = p.statement()
    return out


def parse_condition(text: str):
    p = _Parser(text)
    out = p.condition()
    if p.i < len(p.t):
        raise QueryError(f"unexpected {p.t[p.i][1]!r}")
    return out


