"""The WebDAV source against a server in the test's own process."""

import hashlib
import http.server
import threading
import urllib.parse

import pytest

from lodewell.sources import webdav

FILES = {"a.md": b"one", "notes/b c.md": b"two", "notes/deep/é.md": b"three", "empty/": None, "other/x.bin": b"\x00\xff"}


class Server(http.server.BaseHTTPRequestHandler):
    files: dict = {}
    asked: list = []

    def log_message(self, *_):
        pass

    def _answer(self, code, body=b""):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        path = urllib.parse.unquote(self.path).removeprefix("/dav/")
        self.asked.append(path)
        self._answer(*((200, self.files[path]) if path in self.files else (404,)))

    def do_PROPFIND(self):
        self.rfile.read(int(self.headers.get("Content-Length") or 0))
        if self.headers.get("Authorization") != "Basic dTpw":  # u:p
            return self._answer(401)
        folder = urllib.parse.unquote(self.path).removeprefix("/dav").strip("/")
        start = folder + "/" if folder else ""
        children = {(start + (rest := f.removeprefix(start)).split("/")[0], "/" in rest) for f in self.files if f.startswith(start) and f != start}
        rows = [(f"{start}", True), *children]
        body = "".join(
            f"<d:response><d:href>/dav/{urllib.parse.quote(p)}</d:href><d:propstat><d:prop>"
            + ("<d:resourcetype><d:collection/></d:resourcetype>" if is_folder else f'<d:resourcetype/><d:getetag>"{hashlib.md5(self.files[p]).hexdigest()}"</d:getetag><d:getcontentlength>{len(self.files[p])}</d:getcontentlength>')
            + "</d:prop></d:propstat></d:response>"
            for p, is_folder in rows
        )
        self._answer(207, f'<?xml version="1.0"?><d:multistatus xmlns:d="DAV:">{body}</d:multistatus>'.encode())


@pytest.fixture
def address():
    Server.files = dict(FILES)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/dav"
    server.shutdown()


def test_listing_and_incremental_reads(spark, address):
    webdav.register(spark)
    listed = webdav.listing(spark, address, "u", "p")
    rows = {r["path"]: r for r in listed.collect()}
    assert set(rows) == {"a.md", "notes/b c.md", "notes/deep/é.md", "other/x.bin"} and rows["a.md"]["size"] == 3
    assert listed.rdd.getNumPartitions() == 4  # the root's files, and each folder
    stored = spark.createDataFrame([(p, r["etag"]) for p, r in rows.items()] + [("gone.md", "x")], "path string, etag string")
    Server.files["notes/b c.md"] = b"changed"
    Server.files["new.md"] = b"new"
    plan = webdav.changed(webdav.listing(spark, address, "u", "p"), stored)
    assert {r["path"]: r["action"] for r in plan.collect()} == {"a.md": "keep", "notes/b c.md": "fetch", "notes/deep/é.md": "keep", "other/x.bin": "keep", "new.md": "fetch", "gone.md": "drop"}
    Server.asked.clear()
    got = {r["path"]: bytes(r["content"]) for r in webdav.fetched(plan.where("action = 'fetch'"), address, "u", "p").collect()}
    assert got == {"notes/b c.md": b"changed", "new.md": b"new"} and sorted(Server.asked) == ["new.md", "notes/b c.md"]
    lost = spark.createDataFrame([("nowhere.md", None)], "path string, etag string")
    assert webdav.fetched(lost, address).first()["content"] is None
