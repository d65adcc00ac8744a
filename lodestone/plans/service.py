"""HTTP service on the standard library: GET /health, POST /ask, /ask/stream and /reindex."""

from __future__ import annotations

import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lodestone.plans import llm_client
from lodestone.plans.engine import Engine
from lodestone.sources import files

log = logging.getLogger(__name__)


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    busy = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            pass

        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def body(self) -> dict | None:
            try:
                got = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                return got if isinstance(got, dict) else None
            except ValueError:
                return None

        def do_GET(self) -> None:
            if self.path != "/health":
                return self.reply(404, {"detail": "not found"})
            self.reply(200, {"status": "ok"} | engine.health().first().asDict())

        def do_POST(self) -> None:
            body = self.body()
            if self.path == "/reindex":
                return self.reindex(body)
            if self.path not in ("/ask", "/ask/stream"):
                return self.reply(404, {"detail": "not found"})
            question = (body or {}).get("question")
            if not isinstance(question, str) or not 1 <= len(question) <= 10_000:
                return self.reply(422, {"detail": "question must have 1 to 10000 characters"})
            try:
                if self.path == "/ask":
                    return self.reply(200, engine.ask(question))
                contexts, parts = engine.ask_stream(question)
            except llm_client.LLMError:
                log.exception("the language model failed")
                return self.reply(502, {"detail": "the language model failed"})
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            for event in llm_client.events(contexts, parts):
                self.wfile.write(event.encode())

        def reindex(self, body: dict | None) -> None:
            if not busy.acquire(blocking=False):
                return self.reply(409, {"detail": "an index run is under way"})
            try:
                rows = engine.sync(full=bool((body or {}).get("full_rebuild"))).collect()
                self.reply(200, {a: sorted(r["doc_name"] for r in rows if r["action"] == a) for a in ("added", "updated", "removed", "unchanged", "failed")})
            except files.MissingFolder:
                self.reply(400, {"detail": "the documents folder cannot be read"})
            except Exception:
                log.exception("the index run failed")
                self.reply(500, {"detail": "the index run failed"})
            finally:
                busy.release()

    return Handler


def serve(engine: Engine, host: str, port: int) -> None:
    engine.one.warm()
    ThreadingHTTPServer((host, port), handler(engine)).serve_forever()
