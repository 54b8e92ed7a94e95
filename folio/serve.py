"""A small HTTP surface over a folder of results: lists, downloads, status, and runs of the command line."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession


class Service:
    """What the routes do; one run at a time, its lines kept for the log."""

    def __init__(self, spark: SparkSession, folder: str, run: Callable[[list[str]], int]):
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), run
        self.lines: list[str] = []
        self.state, self.lock = "idle", threading.Lock()

    def tables(self) -> list[str]:
        """Results: folders (of any depth) below the folder that hold a table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(path, True)
        root, found = path.toUri().getPath(), set()
        while files.hasNext():
            name = files.next().getPath()
            if name.getName().startswith("part-"):
                found.add(name.getParent().toUri().getPath()[len(root) :].strip("/"))
        return sorted(found)

    def table(self, name: str, limit: int = 1000) -> list[dict] | None:
        """A result's first rows; null if there is no such result (names outside the folder are none)."""
        if name not in self.tables():
            return None
        return [r.asDict() for r in self.spark.read.option("header", True).csv(f"{self.folder}/{name}").limit(limit).collect()]

    def start(self, argv: list[str]) -> bool:
        """Begins a run; false while another goes on."""
        with self.lock:
            if self.state == "running":
                return False
            self.state = "running"

        def work() -> None:
            try:
                self.lines.append("start " + " ".join(argv))
                code = self.run(argv)
                self.lines.append(f"end {code}")
                self.state = "done" if code == 0 else "failed"
            except (Exception, SystemExit) as error:  # whatever ends a run is its outcome
                self.lines.append(f"error {error}")
                self.state = "failed"

        threading.Thread(target=work, daemon=True).start()
        return True

    def stop(self) -> str:
        """Asks Spark to cancel what a run has begun."""
        self.spark.sparkContext.cancelAllJobs()
        return self.state

    def get(self, route: str, query: dict[str, list[str]]):
        name = query.get("name", [""])[0]
        routes = {
            "/": lambda: {"routes": sorted(routes)},
            "/api/status": lambda: {"state": self.state},
            "/api/logs": lambda: {"lines": self.lines[-200:]},
            "/api/results": lambda: {"tables": self.tables()},
            "/api/downloads": lambda: {"tables": self.tables()},
            "/api/download": lambda: self.table(name),
            "/api/figures": lambda: {"tables": [t for t in self.tables() if t.rsplit("/", 1)[-1].startswith("fig")]},
        }
        return routes[route]() if route in routes else None

    def post(self, route: str, body: dict):
        if route == "/api/run":
            return {"started": self.start([str(a) for a in body.get("argv", [])])}
        if route == "/api/stop":
            return {"state": self.stop()}
        if route == "/api/validate_query":
            text = str(body.get("query", ""))
            return {"ok": bool(text.strip()) and text.count("(") == text.count(")") and text.count('"') % 2 == 0}
        return None


def server(service: Service, port: int = 8765) -> ThreadingHTTPServer:
    """Serves on this machine alone."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, found) -> None:
            data = json.dumps(found if found is not None else {"error": "not found"}, default=str).encode()
            self.send_response(200 if found is not None else 404)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            self.answer(service.get(url.path, parse_qs(url.query)))

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self.answer(service.post(self.path, json.loads(raw or b"{}")))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
