"""A small web server for looking into a store: sessions over a version of it, nodes, path queries and their proofs, as JSON.

For debugging on one's own machine: it listens on the loopback address
unless told otherwise, and knows no users.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from uuid import uuid4

from pyspark.sql import DataFrame

from ..errors import ForestError, InvalidInput
from ..model import ELEMENT_COLUMNS, NAMES
from ..plans.compile import query_raw
from ..plans.query import PathQuery, Query, QueryItem
from ..sources.store import Store
from .integrity import Hashes, get_proved_path_query, hash_forest, node_hashes_at, root_hash_of, root_key
from .read import get_raw_optional

MOST_ROWS = 1000  # of a query's result in one answer; ``more`` says whether there are others


def query_of(told: dict) -> Query:
    """A query from JSON: items (kind, start, end in hexadecimal), left_to_right, subquery (path, query)."""
    raw = lambda v: None if v is None else bytes.fromhex(v)
    items = []
    for i in told.get("items", [{"kind": "range_full"}]):
        start, end = raw(i.get("start")), raw(i.get("end"))
        items.append(QueryItem.key(start) if i["kind"] == "key" else QueryItem(i["kind"], start, end))
    out = Query(items, left_to_right=told.get("left_to_right", True))
    if (sub := told.get("subquery")) is not None:
        path = sub.get("path")
        out.subquery(query_of(sub["query"]) if sub.get("query") is not None else None, None if path is None else [bytes.fromhex(p) for p in path])
    return out


def path_query_of(told: dict) -> PathQuery:
    return PathQuery(tuple(bytes.fromhex(p) for p in told.get("path", [])), query_of(told.get("query", {})), told.get("limit"), told.get("offset"))


def told(row) -> dict:
    """An element's row as JSON."""
    plain = lambda v: bytes(v).hex() if isinstance(v, bytes | bytearray) else v if v is None or isinstance(v, int) else str(v)
    out = {c: plain(row[c]) for c in ELEMENT_COLUMNS if c != "ref" and row[c] is not None}
    if row["ref"] is not None:
        out["ref"] = {"kind": row["ref"]["kind"], "n": row["ref"]["n"], "path": [bytes(s).hex() for s in row["ref"]["segs"]]}
    return {"path": [bytes(p).hex() for p in row["path"]], "key": bytes(row["key"]).hex(), "kind": NAMES[row["element_type"]], **out}


class Server:
    """Serves a store until ``close``; ``address`` is where."""

    def __init__(self, store: Store, host: str = "127.0.0.1", port: int = 0):
        self.store = store
        self.sessions: dict[str, tuple[DataFrame, dict[str, Hashes]]] = {}
        routes: dict[str, Callable[[dict], dict]] = {"/" + f.__name__: f for f in (self.new_session, self.drop_session, self.fetch_node, self.fetch_root_node, self.prove_path_query, self.fetch_with_path_query)}

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                route = routes.get(self.path)
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                    code, out = (200, route(body)) if route else (404, {"error": "there is no such route"})
                except (ForestError, KeyError, ValueError, TypeError) as e:
                    code, out = 400, {"error": f"{type(e).__name__}: {e}"}
                data = json.dumps(out).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_) -> None:
                pass

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.address = f"http://{host}:{self.http.server_address[1]}"
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)
        self.thread.start()

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()
        self.sessions.clear()

    def _nodes(self, body: dict) -> DataFrame:
        if body["session"] not in self.sessions:
            raise InvalidInput("there is no such session")
        return self.sessions[body["session"]][0]

    def _hashes(self, body: dict) -> Hashes:
        nodes = self._nodes(body)
        known = self.sessions[body["session"]][1]
        if "hashes" not in known:
            known["hashes"] = hash_forest(nodes)
        return known["hashes"]

    def new_session(self, body: dict) -> dict:
        """A view of the store's version as it is, or of an earlier one."""
        version = self.store.head(body.get("version"))[0]
        name = uuid4().hex
        self.sessions[name] = (self.store.read(version=version) if version >= 0 else self.store.read(), {})
        return {"session": name, "version": version}

    def drop_session(self, body: dict) -> dict:
        return {"dropped": self.sessions.pop(body["session"], None) is not None}

    def _node(self, body: dict, path: tuple[bytes, ...], key: bytes | None) -> dict:
        row = None if key is None else get_raw_optional(self._nodes(body), path, key).first()
        if row is None or row["element_type"] is None:
            return {"node": None}
        value, kv = node_hashes_at(self._hashes(body), path, [key])[key]
        return {"node": told(row) | {"value_hash": value.hex(), "kv_hash": kv.hex()}}

    def fetch_node(self, body: dict) -> dict:
        """The element at a path and key, with its hashes."""
        return self._node(body, tuple(bytes.fromhex(p) for p in body.get("path", [])), bytes.fromhex(body["key"]))

    def fetch_root_node(self, body: dict) -> dict:
        """The element at the root of the topmost tree, and the forest's root hash."""
        return self._node(body, (), root_key(self._nodes(body))) | {"root_hash": root_hash_of(self._hashes(body)).hex()}

    def prove_path_query(self, body: dict) -> dict:
        return {"proof": get_proved_path_query(self._nodes(body), path_query_of(body["query"]), self._hashes(body)).hex()}

    def fetch_with_path_query(self, body: dict) -> dict:
        rows = query_raw(self._nodes(body), path_query_of(body["query"])).limit(MOST_ROWS + 1).collect()
        return {"rows": [told(r) for r in rows[:MOST_ROWS]], "more": len(rows) > MOST_ROWS}
