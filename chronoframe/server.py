"""A thin HTTP endpoint over an engine: one process, requests in turn."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from . import render
from .api import Engine
from .catalog import CatalogError
from .ql.parser import QueryError


def answer(engine: Engine, method: str, target: str, body: bytes) -> tuple[int, bytes]:
    """Status and body for a request: /ping, /write, /query, /metrics and the Prometheus paths."""
    url = urlsplit(target)
    args = {k: v[-1] for k, v in parse_qs(url.query).items()}
    if method == "POST" and url.path == "/query":
        args |= {k: v[-1] for k, v in parse_qs(body.decode()).items()}
    try:
        if url.path == "/ping":
            return 204, b""
        if url.path == "/metrics":
            return 200, engine.metrics().encode()
        if url.path == "/write" and method == "POST":
            n, errors = engine.write_lines(body.decode(), args.get("db"), args.get("precision", "ns"))
            return (204, b"") if not errors else (400, "\n".join(errors).encode())
        if url.path == "/query" and "q" in args:
            return 200, render.influx_json(engine.query(args["q"], args.get("db")), "results").encode()
        if url.path == "/api/v1/write" and method == "POST":
            engine.write_prometheus(body)
            return 204, b""
        if url.path == "/api/v1/read" and method == "POST":
            return 200, engine.read_prometheus(body)
        if url.path == "/api/v1/query" and "query" in args:
            return 200, engine.prom_instant(args["query"]).encode()
        if url.path == "/api/v1/query_range" and {"query", "start", "end", "step"} <= args.keys():
            start, end, step = (round(float(args[k]) * 1000) for k in ("start", "end", "step"))
            return 200, engine.prom_range(args["query"], start, end, step).encode()
    except (QueryError, CatalogError, ValueError) as e:
        return 400, str(e).encode()
    return 404, b"not found"


def serve(engine: Engine, port: int = 8086, host: str = "127.0.0.1") -> HTTPServer:
    """A server that is ready to ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            status, out = answer(engine, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _do

    return HTTPServer((host, port), Handler)
