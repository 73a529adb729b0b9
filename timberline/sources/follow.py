"""Log files as a Spark data source: ``spark.read`` and ``spark.readStream`` of format ``timberline_log``.

Rows are (file, start, line): the file's name, the line's first byte, the line
without its end. Local files and directories, HTTP(S) and SFTP are read alike,
by byte ranges. A partition is a byte range of one file, so that files are read
side by side and a long one in pieces.

A stream's offset is, for each file, the byte behind the last whole line; it is
in the stream's checkpoint, so every line is given once, over restarts too. A
line without an end waits for it. A file that ends before its offset has been
started anew and is read from its start; one that is started anew and outgrows
its offset between two looks can't be told from one that grew. A batch read gives the tails (MAX_BYTES, MAX_LINES, the newest
MAX_FILES), or everything with ``whole`` set.

Options: path (or load(path)); type (LOCAL_DIRECTORY, LOCAL_FILE, HTTP, SFTP;
by default told by the path); whole; piece (bytes of a partition); from
(``start`` or ``end``: where a stream begins in files that are there already);
host, port, username, password; client (module:name of a function that opens an
SFTP client from these, in place of paramiko).
"""

from __future__ import annotations

import importlib
import json
import os
import urllib.request
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .tails import HTTP_TIMEOUT_S, MAX_BYTES, MAX_FILES, MAX_LINES, SFTP_TIMEOUT_S

FORMAT = "timberline_log"
#: Bytes of a partition, and of a step that looks for the end of a line.
PIECE, STEP = 16 << 20, 64 << 10


class LocalFiles:
    """The files of a directory (not of those below it), or one file."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def sizes(self) -> dict[str, tuple[int, float]]:
        """Name -> (size, time of the last change)."""
        if os.path.isdir(self.path):
            found = [e for e in os.scandir(self.path) if e.is_file()]
            return {e.name: (e.stat().st_size, e.stat().st_mtime) for e in found}
        s = os.stat(self.path)
        return {os.path.basename(self.path): (s.st_size, s.st_mtime)}

    def read(self, name: str, start: int, end: int) -> bytes:
        path = os.path.join(self.path, name) if os.path.isdir(self.path) else self.path
        with open(path, "rb") as file:
            file.seek(start)
            return file.read(end - start)


class HttpFile:
    """One URL; a server that knows no ranges sends all, of which the range is cut."""

    def __init__(self, options: dict):
        self.url = options["path"]
        self.name = self.url.rstrip("/").rsplit("/", 1)[-1]

    def sizes(self) -> dict[str, tuple[int, float]]:
        with urllib.request.urlopen(urllib.request.Request(self.url, method="HEAD"), timeout=HTTP_TIMEOUT_S) as answer:
            return {self.name: (int(answer.headers.get("Content-Length") or 0), 0.0)}

    def read(self, name: str, start: int, end: int) -> bytes:
        if end <= start:
            return b""
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{end - 1}"})
        with urllib.request.urlopen(request, timeout=HTTP_TIMEOUT_S) as answer:
            if answer.status == 206:
                return answer.read(end - start)
            for _ in range(start // STEP):
                answer.read(STEP)
            answer.read(start % STEP)
            return answer.read(end - start)


def paramiko_client(options: dict):
    """An SFTP client of paramiko's, which is optional."""
    try:
        import paramiko
    except ImportError as error:
        raise OSError("SFTP needs the paramiko package") from error
    client = paramiko.SSHClient()
    client.set_missing_host_key_policy(paramiko.AutoAddPolicy())
    client.connect(options["host"], int(options.get("port", 22)), options["username"], options["password"], timeout=SFTP_TIMEOUT_S)
    return client.open_sftp()


class SftpFile:
    """One file over SFTP: a client with stat and open, as paramiko's."""

    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.name = self.path.rstrip("/").rsplit("/", 1)[-1]

    def _client(self):
        module, _, name = self.options.get("client", f"{__name__}:paramiko_client").partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def sizes(self) -> dict[str, tuple[int, float]]:
        client = self._client()
        try:
            s = client.stat(self.path)
            return {self.name: (s.st_size, float(s.st_mtime or 0))}
        finally:
            client.close()

    def read(self, name: str, start: int, end: int) -> bytes:
        client = self._client()
        try:
            with client.open(self.path, "rb") as file:
                file.seek(start)
                return file.read(end - start)
        finally:
            client.close()


KINDS = {"LOCAL_DIRECTORY": LocalFiles, "LOCAL_FILE": LocalFiles, "HTTP": HttpFile, "SFTP": SftpFile}


def files_of(options: dict):
    path = options.get("path", "")
    kind = options.get("type") or ("HTTP" if path.startswith(("http://", "https://")) else "LOCAL_DIRECTORY")
    if not path or kind not in KINDS:
        raise ValueError(f"no path, or an unknown type: {kind}")
    return KINDS[kind](options)


@dataclass
class Piece(InputPartition):
    """The lines that begin in bytes start to stop of a file; none reaches beyond ``end``."""

    file: str
    start: int
    stop: int
    end: int
    #: Whether a line begins at ``start``, or may have begun before.
    whole: bool = True
    #: Only the last lines, as many.
    last: int | None = None

    def __post_init__(self):
        self.value = None


def lines_in(files, piece: Piece):
    """(file, start, line) of a piece, reading a step at a time; a piece's first line is that which begins in it."""
    at, held, begin, out = piece.start, b"", piece.start, []
    skip = not piece.whole
    if skip:  # a line begins here if the byte before ends one
        skip = files.read(piece.file, at - 1, at) != b"\n" if at else False
    while at < piece.end and begin < piece.stop:
        data = files.read(piece.file, at, min(at + STEP, piece.end))
        if not data:
            break
        at += len(data)
        *ended, held = (held + data).split(b"\n")
        for raw in ended:
            if not skip and begin < piece.stop:
                out.append((piece.file, begin, raw.removesuffix(b"\r").decode("utf-8", "replace")))
            begin, skip = begin + len(raw) + 1, False
        if piece.last is None:
            yield from out
            out = []
        else:
            out = out[-piece.last :]
    if held and not skip and begin < piece.stop and at >= piece.end:  # the last line of a file may have no end
        out.append((piece.file, begin, held.removesuffix(b"\r").decode("utf-8", "replace")))
    yield from out if piece.last is None else out[-piece.last :]


def pieces(file: str, start: int, end: int, size: int, whole: bool = True) -> list[Piece]:
    """Byte ranges of about ``size``; all but the first may begin within a line."""
    cuts = [*range(start, end, size), end]
    return [Piece(file, a, b, end, whole if a == start else False) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def line_end(files, file: str, low: int, high: int) -> int:
    """The byte behind the last whole line that ends in low to high; low if none does."""
    while high > low:
        begin = max(low, high - STEP)
        at = files.read(file, begin, high).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        high = begin
    return low


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, start long, line string"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(dict(self.options))


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Piece]:
        files = files_of(self.options)
        found, size = files.sizes(), int(self.options.get("piece", PIECE))
        if self.options.get("whole", "false").lower() == "true":
            return [p for name, (end, _) in sorted(found.items()) for p in pieces(name, 0, end, size)]
        latest = sorted(found, key=lambda n: (-found[n][1], n))[:MAX_FILES]
        return [Piece(n, start, end, end, start == 0, MAX_LINES) for n in latest for end in [found[n][0]] for start in [max(0, end - MAX_BYTES)] if end]

    def read(self, partition: Piece):
        return lines_in(files_of(self.options), partition)


class LogStream(DataSourceStreamReader):
    """It keeps nothing between calls: where to go on is in the offsets, which Spark keeps."""

    def __init__(self, options: dict):
        self.options, self.size = options, int(options.get("piece", PIECE))

    def latestOffset(self) -> dict:
        files = files_of(self.options)
        return {"files": json.dumps({n: line_end(files, n, 0, size) for n, (size, _) in files.sizes().items()}, sort_keys=True)}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.options.get("from", "start") == "end" else {"files": "{}"}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, out = json.loads(start["files"]), []
        for name, stop in sorted(json.loads(end["files"]).items()):
            at = before.get(name, 0)
            out += pieces(name, at if at <= stop else 0, stop, self.size)
        return out

    def read(self, partition: Piece):
        return lines_in(files_of(self.options), partition)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(LogSource)
