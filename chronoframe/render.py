"""Results as the HTTP endpoints answer them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .functions.scalars import field_text


def _rows(df: DataFrame, most: int | None) -> tuple[list, bool]:
    """All rows, or the first ``most``, and whether there are more."""
    rows = df.collect() if most is None else df.limit(most + 1).collect()
    return (rows, False) if most is None else (rows[:most], len(rows) > most)


def influx_json(df: DataFrame, name: str, most: int | None = None, zero_when_empty: bool = False) -> str:
    """Series JSON; with ``most`` rows at most, marked ``partial`` if there are more. An empty aggregate shows as 0."""
    rows, partial = _rows(df, most)
    empty = lambda v: "0" if v is None and zero_when_empty else field_text(v)
    series = {"name": name, "columns": df.columns, "values": [[empty(v) for v in r] for r in rows]} | ({"partial": True} if partial else {})
    return json.dumps({"results": [{"series": [series]}]})


def prometheus_vector(labels: dict[str, str], time_s: float, value: float) -> str:
    return json.dumps({"status": "success", "data": {"resultType": "vector", "result": [{"metric": labels, "value": [time_s, field_text(float(value))]}]}})


def prometheus_matrix(labels: dict[str, str], df: DataFrame, most: int | None = None) -> str:
    """(time in ms, value) rows as a matrix of one series; with ``most`` steps at most, and a warning if there are more."""
    rows, partial = _rows(df.select("time", "value").orderBy("time"), most)
    out = {"status": "success", "data": {"resultType": "matrix", "result": [{"metric": labels, "values": [[t / 1000, field_text(v)] for t, v in rows]}]}}
    return json.dumps(out | ({"warnings": [f"only the first {most} steps"]} if partial else {}))


def metrics_text(stats: dict[str, int]) -> str:
    """Gauges in the exposition format."""
    return "".join(f"# HELP {k} {k.replace('_', ' ')}\n# TYPE {k} gauge\n{k} {v}\n" for k, v in stats.items())
