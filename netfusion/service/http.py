"""The case engine over HTTP, with the standard library's server: accounts, cases and every data route.

``Api.answer`` maps a method, a path and a body to a status and an answer, and does no input or output of its own, so it can sit behind
another server too. DataFrames go out as lists of rows, PAGE at most.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame

from netfusion.operators import ledger
from netfusion.service import accounts, store
from netfusion.service.engine import Case
from netfusion.sources import sinks

PAGE = 1000
ANY, VIEW, ADMIN = frozenset(accounts.ROLES), accounts.CAN_VIEW_GRAPH, accounts.CAN_ADMIN


class Problem(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def rows(df: DataFrame) -> list[dict]:
    """A table's first PAGE rows; if there are more, the last entry says where they were cut."""
    found = [json.loads(x) for x in df.limit(PAGE + 1).toJSON().collect()]
    return found if len(found) <= PAGE else [*found[:PAGE], {"cut_at": PAGE}]


def number(q: dict, name: str) -> int | None:
    if (value := q.get(name)) in (None, ""):
        return None
    try:
        return int(value)
    except ValueError:
        raise Problem(400, f"{name} is no number") from None


#: Answers about a case: path, who may ask, and what is asked of the case with the query's values and the body.
ANSWERS: list[tuple[str, str, frozenset[str], Callable]] = [
    ("GET", "stats", ANY, lambda c, q, b: c.stats()),
    ("GET", "graph", VIEW, lambda c, q, b: dict(zip(("nodes", "edges"), map(rows, c.graph if number(q, "day") is None else c.snapshot(number(q, "day"))), strict=True))),
    ("GET", "whatif", VIEW, lambda c, q, b: c.what_if(q["node"])),
    ("GET", "bridges", ANY, lambda c, q, b: c.bridges()),
    ("GET", "bursts", VIEW, lambda c, q, b: c.bursts()),
    ("GET", "structuring", ANY, lambda c, q, b: c.structuring()),
    ("GET", "communities", ANY, lambda c, q, b: c.communities()),
    ("GET", "centrality", ANY, lambda c, q, b: c.centrality.orderBy("betweenness", "id", ascending=[False, True])),
    ("GET", "towers", VIEW, lambda c, q, b: c.schematic()),
    ("GET", "leads", ANY, lambda c, q, b: c.leads(number(q, "limit") or 10, q.get("priority"))),
    ("GET", "anomalies", ANY, lambda c, q, b: c.anomalies()),
    ("GET", "cross-case", ANY, lambda c, q, b: c.cross_case()),
    ("GET", "temporal", ANY, lambda c, q, b: c.temporal()),
    ("GET", "connections/explain", ANY, lambda c, q, b: c.explain(q["src"], q["dst"])),
    ("GET", "recommendations", ANY, lambda c, q, b: c.recommendations()),
    ("GET", "ledger", ANY, lambda c, q, b: c.ledger()[1]),
    ("GET", "certificate", ANY, lambda c, q, b: c.certificate(q.get("case", "Case"), q.get("issued", ""), q.get("officer", "Investigating Officer"), q.get("station", ""))),
    ("POST", "verify", ANY, lambda c, q, b: ledger.verify(*c.ledger(), b["hash"])),
    ("GET", "geospatial/towers", ANY, lambda c, q, b: c.towers()),
    ("GET", "geospatial/trajectories", ANY, lambda c, q, b: c.trajectories(number(q, "from"), number(q, "to"), q.get("person"))),
    ("GET", "geospatial/hotspots", ANY, lambda c, q, b: c.hotspots()),
    ("GET", "people/search", ANY, lambda c, q, b: c.search(q["q"])),
    ("GET", r"why/([^/]+)", ANY, lambda c, q, b, node: {"facts": rows(c.why(node)), "sources": rows(c.sources(node))}),
    ("GET", "takedown/strategies", ANY, lambda c, q, b: c.strategies()),
    ("POST", "takedown/simulate", ANY, lambda c, q, b: c.takedown([*b["targets"]])),
    ("POST", "takedown/operation-order", ANY, lambda c, q, b: c.operation_order(b.get("strategy") or [*b["targets"]], b.get("codename", "OPERATION THUNDERCLAP"))),
    ("GET", "ask", VIEW, lambda c, q, b: c.ask(q["q"])),
]


class Api:
    """cases: open ones by id, of which '' is the default; book: accounts; audit: where the audit log goes."""

    def __init__(self, cases: dict[str, Case], book: accounts.Accounts, audit: str, spark=None):
        self.cases, self.book, self.audit = cases, book, audit
        self.spark = spark or next(iter(cases.values())).spark

    def answer(self, method: str, target: str, body: dict | None = None, token: str = "") -> tuple[int, object]:
        url = urlparse(target)
        q, path, body = {k: v[-1] for k, v in parse_qs(url.query).items()}, unquote(url.path).strip("/"), body or {}
        try:
            return 200, self._open(method, path, body) or self._guarded(method, path, q, body, token)
        except Problem as e:
            return e.status, {"error": str(e)}
        except PermissionError as e:
            return 403, {"error": str(e)}
        except (KeyError, TypeError) as e:
            return 400, {"error": f"missing or bad value: {e}"}
        except ValueError as e:
            return 400, {"error": str(e)}

    def _open(self, method: str, path: str, body: dict) -> object:
        if (method, path) in (("GET", ""), ("GET", "health")):
            return {"status": "ok", "cases": len(self.cases)}
        if (method, path) == ("POST", "login"):
            return {"token": self.book.login(body["name"], body["password"])}
        if (method, path) == ("POST", "register"):
            return self.book.register(body["name"], body["password"])  # waits for a supervisor
        if (method, path) == ("GET", "templates/schema"):
            return sinks.catalogue()
        if method == "GET" and (m := re.fullmatch(r"templates/(\w+)\.csv", path)):
            if m[1] not in sinks.COLUMNS:
                raise Problem(404, "no such template")
            return sinks.template(m[1])
        return None

    def _guarded(self, method: str, path: str, q: dict, body: dict, token: str) -> object:
        user = self.book.check(token)
        if (method, path) == ("GET", "me"):
            return user
        if path == "admin/users" and method == "GET":
            self.book.check(token, ADMIN)
            return self.book.list(q.get("state"))
        if method == "PATCH" and (m := re.fullmatch(r"admin/users/([^/]+)", path)):
            self.book.check(token, ADMIN)
            return self.book.set_state(m[1], body["state"])
        if (method, path) == ("GET", "admin/audit-trail"):
            self.book.check(token, ADMIN)
            return rows(store.audit_trail(self.spark, self.audit, q.get("contains", ""), number(q, "limit") or 100))
        if (method, path) == ("GET", "investigations"):
            return sorted(x for x in self.cases if x)
        case = ""
        if m := re.fullmatch(r"investigations/([^/]+)(?:/(.*))?", path):
            case, path = m[1], m[2] or ""
        if case not in self.cases:
            raise Problem(404, "no such case")
        if case and method == "DELETE" and not path:
            del self.cases[case]
            return {"deleted": case}
        for verb, pattern, allowed, act in ANSWERS:
            if verb == method and (m := re.fullmatch(pattern, path)):
                self.book.check(token, allowed)
                out = act(self.cases[case], q, body, *m.groups())
                out = rows(out) if isinstance(out, DataFrame) else out
                store.audit(self.spark, self.audit, user["name"], f"{method} /{path}", [str(r.get("id", "")) for r in out if isinstance(r, dict)] if isinstance(out, list) else [])
                return out
        raise Problem(404, "no such route")


def serve(api: Api, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that answers with JSON; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                status, out = api.answer(self.command, self.path, body, self.headers.get("Authorization", "").removeprefix("Bearer "))
            except json.JSONDecodeError:
                status, out = 400, {"error": "the body is no JSON"}
            data = out.encode() if isinstance(out, str) else json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/csv" if isinstance(out, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PATCH = do_DELETE = _do

        def log_message(self, *args: object) -> None:  # the audit log tells
            pass

    return ThreadingHTTPServer((host, port), Handler)
