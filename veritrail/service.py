"""HTTP routes over workspaces, on the standard library's server. `Service.respond` holds all of them; it needs no socket."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.sources import store
from veritrail.sources.models import Client
from veritrail.workspace import SCHEMAS, Workspace

#: What an assisting answer comes with.
CAVEAT = "This answer goes beyond the sources; it is not verified against them."
#: Bytes of a request that are read.
MOST_BYTES = 16 << 20


class Refused(Exception):
    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


def _rows(df: DataFrame) -> list[dict]:
    """One workspace's rows; a reply holds them all."""
    return [json.loads(x) for x in df.toJSON().toLocalIterator()]


class Service:
    def __init__(self, spark: SparkSession, root: str, make_client: Callable[[], Client], fetch: Callable[[str], dict]) -> None:
        self.spark, self.root, self.make_client, self.fetch = spark, root.rstrip("/"), make_client, fetch
        one = r"([^/]+)"
        self.routes = [
            ("GET", "/", self.root_page), ("GET", "/health", self.health), ("GET", "/workspaces", self.all_workspaces), ("GET", f"/workspaces/{one}", self.detail), ("POST", "/add", self.add), ("POST", "/chat", self.chat),
            ("GET", f"/report/{one}", self.report), ("GET", f"/themes/{one}", self.themes), ("GET", f"/claims/{one}", self.claims), ("GET", f"/messages/{one}", self.messages), ("DELETE", f"/workspaces/{one}", self.delete),
            ("POST", "/transcribe", self.transcribe),
        ]

    def respond(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        """(status, reply). A refusal's reply is {detail}; any other failure is a 500."""
        path = path.split("?")[0].rstrip("/") or "/"
        fits = [(m, f, x.groups()) for m, p, f in self.routes if (x := re.fullmatch(p, path))]
        try:
            if not fits:
                raise Refused(404, "Not Found")
            for m, f, given in fits:
                if m == method:
                    return 200, f(*given) if method != "POST" else f(body if isinstance(body, dict) else {})
            raise Refused(405, "Method Not Allowed")
        except Refused as e:
            return e.status, {"detail": str(e)}
        except Exception as e:
            return 500, {"detail": f"{type(e).__name__}: {e}"[:500]}

    def _workspace(self, workspace_id: str, must_exist: bool = True) -> Workspace:
        try:
            w = Workspace(self.spark, self.root, workspace_id)
        except ValueError as e:
            raise Refused(404, str(e)) from e
        if must_exist and not w.known():
            raise Refused(404, f"Workspace '{workspace_id}' not found")
        return w

    @staticmethod
    def _given(body: dict, *names: str) -> list[str]:
        for n in names:
            if not isinstance(body.get(n), str):
                raise Refused(422, f"{n} must be a string")
        return [body[n] for n in names]

    def root_page(self) -> dict:
        return {"message": "Veritrail", "routes": [f"{m} {p}" for m, p, _ in self.routes]}

    def health(self) -> dict:
        return {"status": "ok"}

    def all_workspaces(self) -> dict:
        """Every workspace with its videos, claims and whether it has something to report."""
        tables = {name: store.read_optional(self.spark, f"{self.root}/{name}", SCHEMAS[name]) for name in ("videos", "chunks", "claim_cache")}
        videos = tables["videos"].groupBy("workspace_id").agg(F.count("*").alias("videos"))
        met = tables["chunks"].select("workspace_id", "content_hash").join(tables["claim_cache"], ["workspace_id", "content_hash"])
        claims = met.groupBy("workspace_id").agg(F.sum(F.size("claims")).alias("claims"))
        rows = videos.join(claims, "workspace_id", "left").select(F.col("workspace_id").alias("id"), "videos", F.coalesce("claims", F.lit(0)).alias("claims"), F.lit(True).alias("has_report"))
        return {"workspaces": _rows(rows.orderBy("id"))}

    def detail(self, workspace_id: str) -> dict:
        w = self._workspace(workspace_id)
        videos = w.table("videos").orderBy("ord").select("video_id", "title", "channel", "duration_seconds")
        return {"workspace_id": workspace_id, "videos": _rows(videos), "claim_count": w.claims().count(), "theme_count": w.table("themes").count(), "has_report": True}

    def add(self, body: dict) -> dict:
        url, workspace_id = self._given(body, "url", "workspace_id")
        w = self._workspace(workspace_id, must_exist=False)
        try:
            payload = self.fetch(url)
        except Exception as e:
            raise Refused(500, f"Scraping failed: {str(e)[-500:]}") from e
        w.add(payload, self.make_client)
        return {"status": "ok", "workspace_id": workspace_id}

    def transcribe(self, body: dict) -> dict:
        return self.fetch(*self._given(body, "url"))

    def chat(self, body: dict) -> dict:
        """An answer to one question; it is not stored."""
        workspace_id, question = self._given(body, "workspace_id", "question")
        mode, history = body.get("mode", "grounded"), body.get("history")
        if mode not in ("grounded", "assist") or not (history is None or (isinstance(history, list) and all(isinstance(m, dict) for m in history))):
            raise Refused(422, "mode is grounded or assist; history is a list of messages")
        got = self._workspace(workspace_id).ask(question, self.make_client, mode, history or [], keep=False)
        if got["answer"] is None:
            raise Refused(500, f"no model answered: {got['error']}")
        check = got["citation_check"]
        return {
            "answer": got["answer"], "sources": got["source_map"] or {}, "citations_valid": check["all_valid"], "cited_count": check["cited_count"], "mode": mode, "verified": got["verified"],
            "caveat": CAVEAT if mode == "assist" else None,
        }

    def report(self, workspace_id: str) -> dict:
        return {"workspace_id": workspace_id, "markdown": self._workspace(workspace_id).report()}

    def themes(self, workspace_id: str) -> dict:
        rows = self._workspace(workspace_id, must_exist=False).table("themes").drop("workspace_id").orderBy("theme_no")
        return {"workspace_id": workspace_id, "themes": _rows(rows)}

    def claims(self, workspace_id: str) -> dict:
        w = self._workspace(workspace_id, must_exist=False)
        if w.table("claim_cache").isEmpty():
            raise Refused(404, "Claims not extracted yet.")
        return {"workspace_id": workspace_id, "claims": _rows(w.claims().orderBy("ord").drop("ord"))}

    def messages(self, workspace_id: str) -> dict:
        rows = self._workspace(workspace_id, must_exist=False).table("messages").orderBy("ord").select("role", "content", "mode")
        return {"workspace_id": workspace_id, "messages": _rows(rows)}

    def delete(self, workspace_id: str) -> dict:
        removed = self._workspace(workspace_id).delete()
        return {"status": "deleted", "workspace_id": workspace_id, "vectors_removed": removed["vectors"]}


def serve(service: Service, port: int, host: str = "127.0.0.1") -> None:
    """Answers one request at a time until the process ends."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                if size > MOST_BYTES:
                    status, reply, self.close_connection = 413, {"detail": f"a body has {MOST_BYTES} bytes at most"}, True
                else:
                    status, reply = service.respond(self.command, self.path, json.loads(self.rfile.read(size)) if size > 0 else {})
            except ValueError:
                status, reply = 422, {"detail": "the body must be JSON"}
            raw = json.dumps(reply, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = answer

    HTTPServer((host, port), Handler).serve_forever()
