"""The entry store: Parquet by source and file, replaced file by file, with a token index and the fingerprints of what was ingested."""

from __future__ import annotations

import hashlib
import hmac
import json
import queue
import threading
import urllib.parse
import urllib.request
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import composite, has_any_token, has_phrase, tokens

EMPTY = "__none__"
KEYS = ["source_key", "file_key"]
#: Folders of the token index; one look-up reads the folders of its words only.
BUCKETS = 64
#: A search that more parts may answer reads the whole store: naming parts no longer helps.
MAX_PARTS = 10_000
#: Parts that one job indexes.
PARTS_AT_ONCE = 10_000
FINGERPRINT = "source string, file string, size long, modified timestamp"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the one that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named.rstrip('/')}/stores/{uuid.uuid4().hex}"


def searchable(rows: DataFrame) -> Column:
    """The text that bare words and phrases search, of the columns that there are."""
    fields = [F.array_join(F.map_values("fields"), " ")] if "fields" in rows.columns else []
    return composite(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("message", "source", "level", "file") if c in rows.columns], *fields)


class EntryStore:
    """Entries under ``path``; a batch replaces all entries of the (source, file) pairs in it.

    Partition pruning by source and file, and pushed filters on level and ts,
    keep reads small; rows are clustered by time within a part. Three tables
    stand beside the entries, in folders that Spark's listing leaves out:

    * ``_tokens``: for each part the hashes of the tokens in it, by bucket of
      the hash and sorted, so a search for a word opens one bucket and then
      only the parts that may hold the word;
    * ``_parts``: the parts that are indexed. A part that isn't (the writer
      stopped in between) is read by every search;
    * ``_files``: fingerprints of the files whose entries are stored, which
      tell what an ingest may skip.

    The first two only grow, as each write gives its parts new names; rows of
    parts that are gone are ignored, and ``index(anew=True)`` drops them.
    """

    def __init__(self, spark: SparkSession, path: str, indexed: bool = True):
        self.spark, self.path, self.schema, self.indexed = spark, path, None, indexed

    def replace(self, entries: DataFrame) -> None:
        """Write a batch. Only the partitions it has are overwritten, so repeating a batch changes nothing.

        The shuffle before the write is a rebalance: small days share a part, a
        day of a busy file that is too large for one task is split.
        """
        keyed = entries.withColumns({"source_key": F.coalesce("source", F.lit(EMPTY)), "file_key": F.coalesce("file", F.lit(EMPTY)), "_day": F.floor(F.unix_seconds("ts") / 86400)})
        rows = keyed.hint("rebalance", *KEYS, "_day").drop("_day").sortWithinPartitions(*KEYS, "ts")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path)
        if self.indexed:
            self.index()

    def _side(self, name: str, schema: str) -> DataFrame:
        """A table beside the entries; empty if there is none."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    # Token index

    def parts(self) -> list[str]:
        """The store's part files, as Spark's own planning lists them."""
        return sorted(self.spark.read.parquet(self.path).inputFiles())

    def index(self, anew: bool = False) -> int:
        """Index the parts that aren't yet, or all; the number of parts indexed."""
        known = set() if anew else {r.part for r in self._side("_parts", "part string").toLocalIterator()}
        fresh = [p for p in self.parts() if p not in known]
        for k in range(0, len(fresh), PARTS_AT_ONCE):
            some = fresh[k : k + PARTS_AT_ONCE]
            rows = self._of(some)
            hashes = F.transform(F.array_distinct(tokens(searchable(rows))), lambda t: F.xxhash64(t))
            found = rows.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("part"), F.explode(hashes).alias("hash")).distinct().withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
            mode = "overwrite" if anew and k == 0 else "append"
            found.repartition("bucket").sortWithinPartitions("bucket", "hash", "part").write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/_tokens")
            self.spark.createDataFrame([(p,) for p in some], "part string").write.mode(mode).parquet(f"{self.path}/_parts")
        return len(fresh)

    def _of(self, parts: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*map(urllib.parse.unquote, parts))

    def parts_holding(self, words: str, every: bool = False) -> DataFrame:
        """(part) of the indexed parts that may hold any token of ``words``, or every one."""
        one = self.spark.range(1).select(F.transform(F.array_distinct(tokens(F.lit(words))), lambda t: F.xxhash64(t)).alias("h"))
        hashes = one.first().h
        rows = self._side("_tokens", "part string, hash long, bucket int").where(F.col("bucket").isin(*{h % BUCKETS for h in hashes}) & F.col("hash").isin(*hashes))
        return rows.groupBy("part").agg(F.count_distinct("hash").alias("n")).where(F.col("n") >= (len(hashes) if every else 1)).select("part")

    def _candidates(self, words: str, every: bool) -> DataFrame | None:
        """The entries of parts that may match; None if that is most of the store."""
        found = [r.part for r in self.parts_holding(words, every).limit(MAX_PARTS + 1).collect()]
        if len(found) > MAX_PARTS:
            return None
        live, known = self.parts(), {r.part for r in self._side("_parts", "part string").toLocalIterator()}
        wanted = [p for p in live if p not in known]
        wanted += sorted({*found} & {*live})
        return self._of(wanted) if wanted else self.spark.read.parquet(self.path).limit(0)

    def search(self, words: str, phrase: bool = False) -> DataFrame:
        """Entries with any of the words, or with all of them side by side; only parts that may hold them are opened."""
        rows = self._candidates(words, every=phrase)
        rows = self.spark.read.parquet(self.path) if rows is None else rows
        text = searchable(rows)
        return rows.where(has_phrase(text, words) if phrase else has_any_token(text, words)).drop(*KEYS)

    # Fingerprints

    def fingerprints(self) -> DataFrame:
        """(source, file, size, modified) as last ingested."""
        rows = self._side("_files", FINGERPRINT + ", batch long")
        return rows.groupBy("source", "file").agg(F.max_by(F.struct("size", "modified"), "batch").alias("f")).select("source", "file", "f.size", "f.modified")

    def record(self, files: DataFrame) -> None:
        """Keep fingerprints of files whose entries have been stored. Call it after ``replace``: what stops in between is ingested again."""
        last = self._side("_files", FINGERPRINT + ", batch long").agg(F.max("batch")).first()[0]
        files.select("source", "file", "size", "modified").withColumn("batch", F.lit(0 if last is None else last + 1).cast("long")).write.mode("append").parquet(f"{self.path}/_files")

    def forget(self, source: str) -> None:
        """Drop a source's fingerprints, so that its files are ingested again."""
        rows = self.fingerprints().where(F.col("source") == source)
        self.record(rows.select("source", "file", F.lit(None).cast("long").alias("size"), "modified"))

    def ungated(self, files: DataFrame) -> DataFrame:
        """Of files (source, file, size, modified) those to ingest: new, or changed since."""
        from .tails import ungated

        return ungated(files, self.fingerprints())

    def read(self, source: str | None = None, file: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        out = reader.parquet(self.path)
        if source is not None:
            out = out.where(F.col("source_key") == source)
        if file is not None:
            out = out.where(F.col("file_key") == file)
        return out.drop(*KEYS)

    def _rewrite(self, keep, touched: DataFrame, to: str) -> None:
        """Write the kept rows beside the store; readers switch by path, nothing is read and overwritten at once."""
        touched.where(keep).write.mode("overwrite").partitionBy(*KEYS).parquet(to)
        files = self.fingerprints()
        self.path, self.schema = to, touched.schema  # an empty version has no file to tell its schema
        self.record(files)
        if self.indexed and touched.where(keep).take(1):
            self.index()

    def _drop_folders(self, pairs) -> None:
        """Delete the folders of the (source, file) pairs for which a condition holds; no other file is read or written."""
        context = self.spark.sparkContext
        placed = self.spark.read.parquet(self.path).select(*KEYS, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
        for row in pairs(placed).select("folder").distinct().toLocalIterator():
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(row.folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def purge_source(self, source: str, to: str | None = None) -> None:
        """Drop a source by deleting its folders, or, for readers of the old version, by writing a new one to ``to``."""
        rows = self.spark.read.parquet(self.path)
        if to is None:
            self.schema = rows.schema
            self._drop_folders(lambda placed: placed.where(F.col("source_key") == source))
        else:
            self._rewrite(F.col("source_key") != source, rows, to)
        self.forget(source)

    def purge_expired(self, as_of: str, days: int, to: str | None = None) -> None:
        """Drop entries older than ``days``; the cutoff itself stays, 0 or less keeps all.

        Folders of files that are wholly expired are deleted and files that are
        expired in part are written anew; with ``to``, a new version is written there.
        """
        if days <= 0:
            return None
        rows = self.spark.read.parquet(self.path)
        if to is not None:
            return self._rewrite(retained(as_of, days), rows, to)
        self.schema = rows.schema
        ages = rows.groupBy(*KEYS).agg(F.count_if(retained(as_of, days)).alias("_kept"), F.count_if(~retained(as_of, days)).alias("_gone")).where("_gone > 0")
        partly = rows.join(ages.where("_kept > 0").select(*KEYS), KEYS, "left_semi").where(retained(as_of, days))
        staged = f"{self.path.rstrip('/')}-purge"
        partly.write.mode("overwrite").parquet(staged)
        self._drop_folders(lambda placed: placed.join(ages.where("_kept = 0").select(*KEYS), KEYS, "left_semi"))
        self.replace(self.spark.read.schema(rows.schema).parquet(staged).drop(*KEYS))
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        return None


def retained(as_of: str, days: int):
    """Whether an entry is kept: not older than ``days``; all if days is 0 or less."""
    return F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)) if days > 0 else F.lit(True)


def reconciled(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """What the store holds after a batch: its own rows, less those of the batch's (source, file) pairs, and the batch."""
    pairs = batch.select("source", F.coalesce("file", F.lit("")).alias("file")).distinct().select(F.col("source").alias("_s"), F.col("file").alias("_f"))
    rest = stored.join(pairs, (F.col("source") == F.col("_s")) & (F.coalesce("file", F.lit("")) == F.col("_f")), "left_anti")
    return rest.unionByName(batch, allowMissingColumns=True)


def sign(secret: str, body: bytes) -> str:
    """The value of a webhook's signature header."""
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def post_webhook(url: str, payload: dict, secret: str | None = None, timeout: float = 5, header: str = "X-Signature") -> int:
    """One attempt to post an alert as JSON; the HTTP status."""
    body = json.dumps(payload, separators=(",", ":"), default=str).encode()
    headers = {"Content-Type": "application/json"} | ({header: sign(secret, body)} if secret else {})
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
        return answer.status


class Sender:
    """Posts webhooks behind the caller's back: a bounded queue, a few threads, one attempt each.

    A receiver that is down or hangs holds up one thread for as long as its
    time limit, and no caller. What doesn't fit into the queue is refused.
    """

    def __init__(self, threads: int = 2, waiting: int = 1000, post=post_webhook):
        self.post, self.queue = post, queue.Queue(waiting)
        self.threads = [threading.Thread(target=self._work, daemon=True) for _ in range(threads)]
        for thread in self.threads:
            thread.start()

    def _work(self) -> None:
        while (job := self.queue.get()) is not None:
            url, payload, secret, done = job
            try:
                status, error = self.post(url, payload, secret), None
            except Exception as failed:  # whatever it is, the thread goes on
                status, error = None, failed
            if done:
                done(status, error)
            self.queue.task_done()
        self.queue.task_done()

    def submit(self, url: str, payload: dict, secret: str | None = None, done=None) -> bool:
        """Queue a post; false if the queue is full. ``done`` gets (status, error) once, in a sender's thread."""
        try:
            self.queue.put_nowait((url, payload, secret, done))
            return True
        except queue.Full:
            return False

    def close(self) -> None:
        """Send what is queued, then stop."""
        for _ in self.threads:
            self.queue.put(None)
        for thread in self.threads:
            thread.join()
