"""A thin HTTP door to engines, one tenant each: JSON in and out, one pass at a time for a tenant."""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Batch, Engine, Result
from .functions.calendar import WindowError
from .lang.checker import compile_source
from .lang.nodes import DefinitionError
from .lang.source import about, source_of
from .operators import facts as ops
from .sources.schemas import Refused
from .sources.store import FolderStore

#: Rows that one answer carries; it says whether there are more. Records of a page.
MOST_ROWS, PAGE = 10_000, 50


def _plain(x: object) -> object:
    return x.isoformat() if isinstance(x, (dt.datetime, dt.date)) else x.asDict(True) if hasattr(x, "asDict") else str(x)


class Doors:
    """The routes, apart from any socket: call(method, path, query, body) gives (status, answer)."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], dt.datetime] | None = None):
        self.spark, self.folder = spark, folder
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self.engines: dict[str, tuple[Engine, str]] = {}
        self.locks: dict[str, threading.Lock] = {}

    def engine(self, tenant: str) -> Engine:
        if tenant not in self.engines:
            raise KeyError(f"tenant {tenant!r} has no definitions")
        return self.engines[tenant][0]

    def call(self, method: str, path: str, query: dict[str, list[str]] | None = None, body: object = None) -> tuple[int, object]:
        query = query or {}
        steps = [s for s in path.split("/") if s]
        if steps == ["health"]:
            return 200, {"ok": True, "tenants": sorted(self.engines)}
        if len(steps) < 2 or steps[0] != "tenants":
            return 404, {"error": "no such route"}
        tenant, rest = steps[1], steps[2:]
        with self.locks.setdefault(tenant, threading.Lock()):
            try:
                return self.route(method, tenant, rest, query, body)
            except (KeyError, IndexError) as e:
                return 404, {"error": str(e)}
            except (DefinitionError, Refused, WindowError, ValueError) as e:
                return 422, {"error": str(e)}

    def route(self, method: str, tenant: str, rest: list[str], query: dict[str, list[str]], body: object) -> tuple[int, object]:
        if method == "PUT" and rest == ["definitions"]:
            library = compile_source(body["source"])
            held = self.engines.get(tenant)
            store = held[0].store if held else FolderStore(self.spark, self.folder, tenant)
            self.engines[tenant] = Engine(self.spark, library, store), body["source"]
            return 200, {"names": [*library.figures, *library.readings, *library.projections, *library.summaries, *library.bundles]}
        if method == "DELETE" and not rest:
            self.engine(tenant).store.delete_tenant()
            self.engines.pop(tenant)
            return 200, {"deleted": tenant}
        engine = self.engine(tenant)
        if method == "GET" and rest == ["definitions"]:
            return 200, {"source": self.engines[tenant][1]}
        if method == "POST" and rest == ["facts"]:
            stamps = {k: {i: dt.datetime.fromisoformat(s) for i, s in v.items()} for k, v in body.get("stamps", {}).items()}
            out = engine.apply(Batch(body.get("writes", {}), stamps, body.get("deletes", {}), bool(body.get("full")), bool(body.get("defer"))), self.clock())
            return 200, {"full": out.full, "impacted": out.impacted}
        if method != "GET" or not rest:
            return 404, {"error": "no such route"}
        if rest == ["runs"]:
            return 200, [r.asDict() for r in engine.runs().collect()]
        if rest[0] == "about":
            return 200, about(engine.library, rest[1]) | {"source": source_of(self.engines[tenant][1], rest[1]), "version": engine.versions.of(rest[1])}
        if rest == ["kinds"]:
            return 200, [{"kind": k, "records": df.count(), "name": engine.kinds[k][1]} for k, df in engine.records().items()]
        if rest[0] == "records" and len(rest) == 2:
            n = min(int(query.get("n", [PAGE])[0]), MOST_ROWS)
            found = ops.page(engine.records()[rest[1]], query.get("after", [None])[0], n, query.get("contains", [None])[0]).collect()
            return 200, {"rows": [r.asDict(True) for r in found[:n]], "more": len(found) > n}
        if rest[0] == "records":
            found = engine.records()[rest[1]].where(F.col("key") == rest[2]).first()
            if found is None:
                raise KeyError(f"{rest[1]} has no record {rest[2]!r}")
            return 200, found.asDict(True) | {"member_of": self.some(engine.member_of(rest[1], rest[2]))}
        if rest[0] == "evidence":
            return 200, self.some(engine.evidence(rest[1], rest[2], rest[3] if len(rest) > 3 else None, self.clock()))
        if rest[0] == "working":
            w = engine.working(rest[1], rest[2], self.clock())
            return 200, w | {k: [[*key, v] for key, v in w[k].items()] for k in ("value", "stored")}
        if rest[0] == "results":
            at = engine.anchor(dt.date.fromisoformat(query["at"][0])) if "at" in query else self.clock()
            windows = query["over"][0].split(",") if "over" in query else None
            scope = (query["scope"][0], query["bucket"][0]) if "scope" in query else None
            got = engine.answer(rest[1], windows, at, query.get("subject"), len(query.get("subject", [])) > 1, scope)
            return 200, {slot: self.told(r) for slot, r in got.items()} if isinstance(got, dict) else self.told(got)
        return 404, {"error": "no such route"}

    @staticmethod
    def some(df: DataFrame) -> dict:
        """The first MOST_ROWS rows, and whether there are more."""
        found = df.limit(MOST_ROWS + 1).collect()
        return {"rows": [x.asDict(True) for x in found[:MOST_ROWS]], "more": len(found) > MOST_ROWS}

    def told(self, r: Result) -> dict:
        rows = {"rows": [], "more": False} if r.rows is None else self.some(r.rows)
        return {"name": r.name, "version": r.version, "state": r.state, "unit": r.unit, "display": r.display} | rows


def serve(doors: Doors, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound and not yet started; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            url = urlsplit(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else None
                status, out = doors.call(self.command, url.path, parse_qs(url.query), body)
            except json.JSONDecodeError as e:
                status, out = 400, {"error": str(e)}
            data = json.dumps(out, default=_plain).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_POST = do_DELETE = answer

        def log_message(self, *args: object) -> None:
            """Silent."""

    return ThreadingHTTPServer((host, port), Handler)
