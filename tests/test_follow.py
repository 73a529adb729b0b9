"""The log data source: batch tails, pieces, streams over growing files, HTTP and SFTP, restarts."""

import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest

from timberline.sources import follow
from timberline.sources.follow import FORMAT, LocalFiles, Piece, line_end, lines_in, pieces, register


def sftp(options):
    """A fake client over local files."""
    assert options["username"] == "u"

    def stat(path):
        s = os.stat(path)
        return SimpleNamespace(st_size=s.st_size, st_mtime=s.st_mtime)

    return SimpleNamespace(stat=stat, open=open, close=lambda: None)


@pytest.fixture(scope="module")
def known(spark):
    register(spark)
    return spark


@pytest.mark.parametrize("text", [b"", b"\n", b"one", b"one\n", b"one\r\ntwo\n\nthree", b"a\n" * 50, b"x" * 300 + b"\nlast\n"])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 1000])
def test_pieces_hold_each_line_once(tmp_path, monkeypatch, text, size):
    monkeypatch.setattr(follow, "STEP", 5)
    (tmp_path / "a").write_bytes(text)
    files = LocalFiles({"path": str(tmp_path)})
    found = [r for p in pieces("a", 0, len(text), size) for r in lines_in(files, p)]
    ended = text.split(b"\n")
    expected = [x.removesuffix(b"\r").decode() for x in (ended if ended[-1] else ended[:-1])]
    assert [r[2] for r in found] == expected
    assert all(text[s : s + len(x)] == x.encode() for _, s, x in found)
    assert line_end(files, "a", 0, len(text)) == text.rfind(b"\n") + 1
    assert [r[2] for r in lines_in(files, Piece("a", 0, len(text), len(text), True, 2))] == expected[-2:]


def test_tails_and_whole_files(known, tmp_path):
    for k in range(25):
        (tmp_path / f"f{k:02}.log").write_text(f"first {k}\nsecond {k}\n")
        os.utime(tmp_path / f"f{k:02}.log", (1000 + k, 1000 + k))
    (tmp_path / "big.log").write_text("".join(f"line {k} {'y' * 90}\n" for k in range(9000)))
    tails = known.read.format(FORMAT).load(str(tmp_path))
    counts = {r.file: r["count"] for r in tails.groupBy("file").count().collect()}
    assert len(counts) == 20 and "f05.log" not in counts and counts["f24.log"] == 2 and counts["big.log"] == 3000
    whole = known.read.format(FORMAT).option("whole", "true").option("piece", 50_000).load(str(tmp_path / "big.log"))
    assert whole.count() == 9000 and whole.rdd.getNumPartitions() > 10 and whole.select("line").distinct().count() == 9000


def stream(known, path, out, checkpoint, **options):
    query = known.readStream.format(FORMAT).options(**options).load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r.file, r.line) for r in known.read.schema("file string, start long, line string").parquet(out).collect())


def run(known, path, tmp_path, grow, **options):
    """Whole lines are given once, over three runs from one checkpoint."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    grow("one\ntwo\nthr")
    name = path.rsplit("/", 1)[-1]
    assert stream(known, path, out, checkpoint, **options) == [(name, "one"), (name, "two")]
    grow("ee\nfour\n")
    assert stream(known, path, out, checkpoint, **options) == [(name, x) for x in ("four", "one", "three", "two")]
    assert len(stream(known, path, out, checkpoint, **options)) == 4


def appender(path):
    def grow(text):
        with open(path, "a") as file:
            file.write(text)

    return grow


def test_stream_of_a_growing_file(known, tmp_path):
    run(known, str(tmp_path / "a.log"), tmp_path, appender(tmp_path / "a.log"), type="LOCAL_FILE", piece="3")


def test_stream_of_sftp(known, tmp_path):
    run(known, str(tmp_path / "a.log"), tmp_path, appender(tmp_path / "a.log"), type="SFTP", client="tests.test_follow:sftp", username="u")


@pytest.mark.parametrize("ranges", [True, False])
def test_stream_of_http(known, tmp_path, ranges):
    held = []

    class Handler(BaseHTTPRequestHandler):
        def reply(self, body=True):
            data, status = b"".join(held), 200
            size = len(data)
            if ranges and "Range" in self.headers:
                a, b = self.headers["Range"].removeprefix("bytes=").split("-")
                data, status = data[int(a) : int(b) + 1], 206
            self.send_response(status)
            self.send_header("Content-Length", str(len(data) if body else size))
            self.end_headers()
            if body:
                self.wfile.write(data)

        do_GET = reply

        def do_HEAD(self):
            self.reply(False)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        run(known, f"http://127.0.0.1:{server.server_port}/x.log", tmp_path, lambda text: held.append(text.encode()))
    finally:
        server.shutdown()


def test_stream_of_a_directory_with_rotation(known, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    (logs / "a").write_text("a1\na2\na3\n")
    (logs / "b").write_text("b1\n")
    options = {"from": "end"}
    assert stream(known, str(logs), out, checkpoint, **options) == []
    (logs / "a").write_text("new\n")  # shorter than before: started anew
    (logs / "b").write_text("b1\nb2\n")
    (logs / "c").write_text("c1\n")
    assert stream(known, str(logs), out, checkpoint, **options) == [("a", "new"), ("b", "b2"), ("c", "c1")]
    (logs / "a").write_text("n\n")  # and again, while nothing ran
    assert [x for x in stream(known, str(logs), out, checkpoint, **options) if x[0] == "a"] == [("a", "n"), ("a", "new")]
