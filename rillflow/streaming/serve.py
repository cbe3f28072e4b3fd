"""Small HTTP pages: monitor (JSON of processors and views), query (one key), actions (start, stop), index."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote


class Action:
    """A named job that runs in a thread; it gets a stop event and a value."""

    def __init__(self, description: str, actor: Callable[[threading.Event, str], None]):
        self.description, self.actor = description, actor
        self.error: Exception | None = None
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def start(self, value: str = "") -> None:
        if self.running:
            return
        self._stop.clear()
        self.error = None

        def run() -> None:
            try:
                self.actor(self._stop, value)
            except Exception as e:
                self.error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self, timeout: float = 10.0) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join(timeout)


class Pages:
    """Answers paths with JSON; can be mounted on any HTTP server, or served by ``serve``."""

    def __init__(self, humanize: Callable[[object], str] = lambda v: json.dumps(v, default=str)):
        self.humanize = humanize
        self.processors: dict[str, Callable[[], dict]] = {}
        self.views: dict[str, Callable[[], dict]] = {}
        self.sources: dict[str, Callable[[str], object | None]] = {}
        self.actions: dict[str, Action] = {}

    def attach_source(self, name: str, getter: Callable[[str], object | None]) -> None:
        if name in self.sources:
            raise ValueError(f"source {name} is attached already")
        self.sources[name] = getter

    def attach_action(self, name: str, action: Action) -> None:
        if name in self.actions:
            raise ValueError(f"action {name} is attached already")
        self.actions[name] = action

    def answer(self, path: str) -> tuple[int, str]:
        parts = [unquote(p) for p in path.split("?")[0].strip("/").split("/") if p]
        match parts:
            case []:
                return 200, json.dumps({"pages": ["monitor", "query", "actions"]})
            case ["monitor"]:
                return 200, json.dumps({"processors": {n: f() for n, f in self.processors.items()}, "views": {n: f() for n, f in self.views.items()}}, default=str)
            case ["query"]:
                return 200, json.dumps(sorted(self.sources))
            case ["query", name, key] if name in self.sources:
                value = self.sources[name](key)
                return (404, json.dumps(None)) if value is None else (200, self.humanize(value))
            case ["actions"]:
                return 200, json.dumps({n: {"description": a.description, "running": a.running, "error": a.error and str(a.error)} for n, a in self.actions.items()})
            case ["actions", name, "start", *value] if name in self.actions:
                self.actions[name].start(value[0] if value else "")
                return 200, "true"
            case ["actions", name, "stop"] if name in self.actions:
                self.actions[name].stop()
                return 200, "true"
        return 404, json.dumps({"error": f"no page {path}"})

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        pages = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                code, body = pages.answer(self.path)
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args: object) -> None:
                pass

        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
