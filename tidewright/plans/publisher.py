"""The dashboard over HTTP: GET a path of operators.serving.endpoints, with ?date=yyyyMMdd or today."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..operators.serving import endpoints


def answer(tables: dict[str, DataFrame], url: str) -> tuple[int, str]:
    """(status, JSON) of a request."""
    parts = urlsplit(url)
    date = parse_qs(parts.query).get("date", [None])[0]
    if date is not None and not (date.isdigit() and len(date) == 8):
        return 400, json.dumps({"status": 1, "msg": "date is yyyyMMdd", "data": None})
    found = endpoints(tables, date).get(parts.path)
    if found is None:
        return 404, json.dumps({"status": 1, "msg": "no such path", "data": None})
    return 200, json.dumps(found(), default=str)


def server(tables: Callable[[], dict[str, DataFrame]], host: str = "127.0.0.1", port: int = 8070) -> ThreadingHTTPServer:
    """A server, not yet started; tables are read anew for each request, so that new windows show."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(tables(), self.path)
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
