from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loamdex.sources.web import fetch, fetch_pages


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        moved = self.path == "/old"
        self.send_response(301 if moved else 404 if self.path == "/gone" else 204 if self.path == "/nothing" else 200)
        if moved:
            self.send_header("Location", "/new")
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        if self.path != "/nothing":
            self.wfile.write(f"<h1>página {self.path}</h1>".encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_are_fetched_under_the_url_asked_for(spark, site):
    urls = [f"{site}/{p}" for p in ("a", "b", "old", "gone", "nothing", "a")] + ["http://127.0.0.1:9/closed", "mailto:x", "http://[bad"]
    got = {r["url"]: r["html"] for r in fetch_pages(spark, urls, 2).collect()}
    assert got == {f"{site}/a": "<h1>página /a</h1>", f"{site}/b": "<h1>página /b</h1>", f"{site}/old": "<h1>página /new</h1>"}
    assert fetch_pages(spark, []).count() == 0
    assert fetch("ftp://x", 1) is None
