"""/health and /datasets of an engine over HTTP."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from veridex.operators.engine import Engine


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is not yet running; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = {"/health": engine.health, "/datasets": engine.datasets}.get(self.path.split("?")[0])
            body = json.dumps(found() if found else {"error": "not found"}, default=str).encode()
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
