"""The engine over HTTP: /status, /user/<login>/recommend, /userid/<id>/recommend, /gather, /train."""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from .engine import Engine


def respond(engine: Engine, path: str) -> tuple[int, str]:
    """(status code, body) of a GET."""
    url = urlparse(path)
    limit = parse_qs(url.query).get("limit", [None])[0]
    if url.path == "/status":
        return 200, engine.status
    if url.path == "/gather":
        return 200, engine.gather()
    if url.path == "/train":
        if reason := engine.can_train():
            return 406, reason
        threading.Thread(target=engine.train, daemon=True).start()
        return 200, "ok"
    if m := re.fullmatch(r"/(user|userid)/([^/]+)/recommend", url.path):
        try:
            who = {"login": unquote(m[2])} if m[1] == "user" else {"user_id": int(m[2])}
            return 200, json.dumps(engine.recommend(**who, limit=int(limit) if limit else None))
        except KeyError:
            return 404, "User not found"
        except (RuntimeError, ValueError) as e:
            return 406, str(e)
    return 404, "Not found"


def serve(engine: Engine, port: int = 8080) -> ThreadingHTTPServer:
    """A server bound to ``port`` (0: any free one); call serve_forever on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            code, body = respond(engine, self.path)
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json" if body[:1] in "[{" else "text/plain")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
