"""Reading log texts: local files and directories, HTTP(S) and SFTP tails.

Large histories are read line by line with Spark's text source; tails of a
bounded size are read for live views. A source that can't be read gives one
ERROR entry instead of an exception.
"""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_LINES, MAX_FILES = 512 * 1024, 3000, 20
HTTP_TIMEOUT_S, HTTP_CHECK_TIMEOUT_S, SFTP_TIMEOUT_S = 10, 5, 5


@dataclass(frozen=True)
class Tail:
    """The last bytes of a file, and whether they are all of it."""

    data: bytes
    from_start: bool


@dataclass(frozen=True)
class Fingerprint:
    size: int
    last_modified: object = None


def base_name(path) -> F.Column:
    """The last part of a path or URL."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def line_places() -> list[F.Column]:
    """Where a line of Spark's text source stands: its file and the start of its split."""
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]


def placed_lines(lines: DataFrame, source: str) -> DataFrame:
    """(source, file, pos, line) of (value, path, start) rows as they were read.

    ``pos`` is a struct that orders the lines of a file: the split's start,
    then Spark's row id, which ascends within a split.
    """
    pos = F.struct("start", F.monotonically_increasing_id().alias("id"))
    return lines.select(F.lit(source).alias("source"), base_name(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("file"), pos.alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))


def history(spark: SparkSession, path: str, source: str) -> DataFrame:
    """All lines under a path as (source, file, pos, line), read in splits."""
    return placed_lines(spark.read.option("lineSep", "\n").text(path).select("value", *line_places()), source)


def lines_of(spark: SparkSession, paths: list[str], source: str) -> DataFrame:
    """As history, for files by name."""
    return placed_lines(spark.read.option("lineSep", "\n").text(paths).select("value", *line_places()), source)


def newest(files: DataFrame, n: int = MAX_FILES, by: str = "path") -> DataFrame:
    """The ``n`` files that changed last, of (path, modified) rows."""
    return files.orderBy(F.desc("modified"), by).limit(n)


def local_tails(spark: SparkSession, path: str, source: str, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """(source, file, text, from_start, size, modified) of a file or of a directory's newest files; not recursive.

    Of the files only the tails are read: a task opens a file and seeks, so
    executors must see the path as the driver does.
    """
    found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))  # without contents

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                with open(urllib.parse.unquote(urllib.parse.urlparse(row["path"]).path), "rb") as file:
                    file.seek(max(0, row["size"] - max_bytes))
                    data = file.read(max_bytes)
                out = {"path": row["path"], "text": data.decode("utf-8", "replace"), "from_start": row["size"] <= max_bytes, "size": row["size"], "modified": row["modified"]}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("path", pa.string()), ("text", pa.string()), ("from_start", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]))

    tails = newest(found, max_files).mapInArrow(read, "path string, text string, from_start boolean, size long, modified timestamp")
    return tails.select(F.lit(source).alias("source"), base_name(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("file"), "text", "from_start", "size", "modified")


def http_tail(url: str, max_bytes: int = MAX_BYTES, timeout: float = HTTP_TIMEOUT_S) -> Tail:
    """The last bytes by a range request; a server without ranges gives the first bytes instead."""
    request = urllib.request.Request(url, headers={"Range": f"bytes=-{max_bytes}"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        data = answer.read(max_bytes)
        if answer.status == 206:
            return Tail(data, (answer.headers.get("Content-Range") or "bytes 0-").startswith("bytes 0-"))
        if answer.status == 200:
            return Tail(data, True)
    raise OSError(f"HTTP status {answer.status}")


def http_probe(url: str, timeout: float = HTTP_CHECK_TIMEOUT_S) -> Fingerprint:
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
        modified = answer.headers.get("Last-Modified")
        return Fingerprint(int(answer.headers.get("Content-Length") or -1), parsedate_to_datetime(modified) if modified else None)


def http_reachable(url: str) -> tuple[str, str]:
    """REACHABLE or UNREACHABLE, and why; tries HEAD, then a ranged GET."""
    try:
        http_probe(url)
        return "REACHABLE", "ok"
    except (OSError, ValueError):
        try:
            http_tail(url, 1, HTTP_CHECK_TIMEOUT_S)
            return "REACHABLE", "ok"
        except (OSError, ValueError) as error:
            return "UNREACHABLE", str(error)


def sftp_tail(host: str, port: int, username: str, password: str, path: str, max_bytes: int = MAX_BYTES) -> Tail:
    """The last bytes over SFTP; needs paramiko, which is optional."""
    try:
        import paramiko
    except ImportError as error:
        raise OSError("SFTP needs the paramiko package") from error
    client = paramiko.SSHClient()
    client.set_missing_host_key_policy(paramiko.AutoAddPolicy())
    client.connect(host, port, username, password, timeout=SFTP_TIMEOUT_S)
    try:
        with client.open_sftp().open(path, "rb") as file:
            size = file.stat().st_size
            file.seek(max(0, size - max_bytes))
            return Tail(file.read(max_bytes), size <= max_bytes)
    finally:
        client.close()


def sftp_probe(host: str, port: int, username: str, password: str, path: str) -> Fingerprint:
    """Size and time of a file over SFTP; needs paramiko."""
    import datetime

    try:
        import paramiko
    except ImportError as error:
        raise OSError("SFTP needs the paramiko package") from error
    client = paramiko.SSHClient()
    client.set_missing_host_key_policy(paramiko.AutoAddPolicy())
    client.connect(host, port, username, password, timeout=SFTP_TIMEOUT_S)
    try:
        found = client.open_sftp().stat(path)
        return Fingerprint(found.st_size, datetime.datetime.fromtimestamp(found.st_mtime, datetime.UTC))
    finally:
        client.close()


def remote_tail(spark: SparkSession, source: str, label: str, read) -> DataFrame:
    """(source, file, text, from_start) of one remote tail: read in a task, on whichever machine has it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _ in range(batch.num_rows):
                tail = read()
                yield pa.RecordBatch.from_pylist([{"source": source, "file": label, "text": tail.data.decode("utf-8", "replace"), "from_start": tail.from_start}])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "source string, file string, text string, from_start boolean")


def error_entry(spark: SparkSession, source: str, error: Exception | str, as_of: str) -> DataFrame:
    """The one entry that stands for a source that couldn't be read."""
    return spark.range(1).select(F.lit(source).alias("source"), F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("pos"), F.lit(as_of).cast("timestamp").alias("ts"), F.lit("ERROR").alias("level"), F.lit(f"Failed to read log source: {error}").alias("message"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of local files; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(base_name(F.col("path")).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files that are new or whose size or time changed; ones that went away aren't reported."""
    before = previous.select("file", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.lit(True).alias("_known"))
    joined = current.join(before, "file", "left")
    return joined.where(F.col("_known").isNull() | ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")))).select(*current.columns)


def ungated(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch (source, file, size, modified) to index: fingerprint not stored yet, or unknown."""
    s = stored.select(F.col("source").alias("_source"), F.col("file").alias("_file"), F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    same = (F.col("source") == F.col("_source")) & (F.col("file") == F.col("_file")) & (F.col("size") == F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    return batch.join(s, same, "left_anti")
