"""The manager's operations over HTTP, with the standard library's server."""

from __future__ import annotations

import argparse
import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from lexmill.manager import IndexInUseError, IndexManager, NoSuchIndexError
from lexmill.operators.indexing import DocumentError
from lexmill.plans.ast import QueryError
from lexmill.schema import SchemaError
from lexmill.storage.index import EmptyCommitError, IndexBusyError

_INDEX = re.compile(r"/indexes/([^/]+)(?:/(documents|commit|search))?\Z")
_STATUS = [
    (NoSuchIndexError, 404), (FileExistsError, 409), (IndexBusyError, 503),
    ((SchemaError, DocumentError, QueryError, EmptyCommitError, IndexInUseError, ValueError), 400),
]


def answer(manager: IndexManager, method: str, target: str, body: bytes) -> tuple[int, dict]:
    """Status and JSON of one request; errors are ``{"error": {"message": ...}}``."""
    url = urlsplit(target)
    try:
        return _route(manager, method, url.path.rstrip("/") or "/", parse_qs(url.query), body)
    except Exception as e:  # noqa: BLE001 - every error has an answer
        status = next((s for kinds, s in _STATUS if isinstance(e, kinds)), 500)
        message = f"no index {e}" if isinstance(e, NoSuchIndexError) else str(e)
        return status, {"error": {"message": message}}


def _json(body: bytes) -> dict:
    try:
        got = json.loads(body or b"{}")
    except ValueError as e:
        raise QueryError(f"body is no JSON: {e}") from e
    if not isinstance(got, dict):
        raise QueryError("body is no JSON object")
    return got


def _route(m: IndexManager, method: str, path: str, args: dict, body: bytes) -> tuple[int, dict]:
    if method == "GET" and path in ("/", "/health", "/ready"):
        return 200, {"status": "ok"} if path != "/" else {"name": "lexmill", "indexes": len(m.list_indexes())}
    if path == "/indexes":
        if method == "GET":
            return 200, {"indexes": m.list_indexes()}
        if method == "POST":
            got = _json(body)
            m.create_index(got.get("name", ""), got)
            return 201, {"status": "created", "name": got["name"]}
        return 405, {"error": {"message": "method not allowed"}}
    found = _INDEX.match(path)
    if not found:
        return 404, {"error": {"message": "no such path"}}
    name, part = found.groups()
    match method, part:
        case "GET", None:
            return 200, m.index_info(name)
        case "PUT", None:
            m.create_index(name, _json(body))
            return 201, {"status": "created", "name": name}
        case "DELETE", None:
            m.delete_index(name)
            return 200, {"status": "deleted", "name": name}
        case "POST", "documents":
            docs = _json(body).get("documents")
            if not docs or not isinstance(docs, list):
                raise DocumentError("documents is missing or empty")
            m.get(name)
            return 200, {"status": "accepted", "documents_received": m.ingest(name, docs)}
        case "DELETE", "documents":
            got = _json(body)
            ids = got.get("ids") or ([got["id"]] if got.get("id") else [])
            m.get(name)
            if not ids or not all(isinstance(i, str) for i in ids):
                raise DocumentError("id is missing")
            m.delete(name, ids)
            return 200, {"status": "accepted", "ids": ids}
        case "POST", "commit":
            r = m.commit(name)
            return 200, {"status": "committed", "generation": r.generation, "segment_id": r.segment_id, "docs": r.docs}
        case "POST", "search":
            explain = args.get("explain", ["false"])[0].lower() in ("1", "true")
            generation = int(args["generation"][0]) if "generation" in args else None
            return 200, m.search(name, _json(body), explain, generation=generation)
    return 405, {"error": {"message": "method not allowed"}}


def serve(manager: IndexManager, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server over the manager; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, got = answer(manager, self.command, self.path, body)
            data = json.dumps(got, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    p = argparse.ArgumentParser()
    p.add_argument("--data", default="data")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    a = p.parse_args()
    serve(IndexManager(SparkSession.builder.getOrCreate(), a.data), a.host, a.port).serve_forever()
