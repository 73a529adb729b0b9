"""Continuous ingest of log lines into the entry store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import entry_ids, extract
from ..functions.lines import frame_lines, parse
from ..sources.store import EntryStore
from ..sources.tails import base_name, line_places, lines_of, placed_lines


def ingest_lines(store: EntryStore, lines: DataFrame, as_of: str) -> None:
    """Fold, parse and extract lines (source, file, pos, line), and replace those files' entries; ``pos`` is anything that orders a file's lines."""
    store.replace(entry_ids(extract(parse(lines, as_of))).drop("pos"))


def ingest_batch(store: EntryStore, texts: DataFrame, as_of: str) -> None:
    """As ingest_lines, for whole file texts (source, file, text)."""
    ingest_lines(store, frame_lines(texts), as_of)


#: Files that one job of ingest_history reads.
FILES_AT_ONCE = 10_000


def ingest_history(spark: SparkSession, store: EntryStore, path: str, source: str, as_of: str) -> int:
    """Ingest the files under a path, of any size: they are read in splits. The number of files read.

    Files whose size and time are those that the store keeps from an earlier
    ingest aren't opened. Fingerprints are written behind the entries of their
    files, so what is cut off in between is done again.
    """
    named = F.col("path")
    listed = spark.read.format("binaryFile").load(path).select("path", F.lit(source).alias("source"), base_name(named).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))  # without contents
    wanted = [tuple(r) for r in store.ungated(listed).select("path", "source", "file", "size", "modified").orderBy("path").toLocalIterator()]
    for k in range(0, len(wanted), FILES_AT_ONCE):
        some = wanted[k : k + FILES_AT_ONCE]
        ingest_lines(store, lines_of(spark, [r[0] for r in some], source), as_of)
        store.record(spark.createDataFrame([r[1:] for r in some], "source string, file string, size long, modified timestamp"))
    return len(wanted)


def ingest_stream(spark: SparkSession, directory: str, source: str, store: EntryStore, checkpoint: str, as_of=None, every: str = "5 seconds"):
    """A query that indexes new files of a directory, one micro-batch after the other.

    Files are read line by line in splits, so their size doesn't matter. A
    repeated batch after a failure replaces the same files, so entries are
    there once; files that the store has with this size and time, by whatever
    way, are left out.
    """
    rows = spark.readStream.format("text").option("lineSep", "\n").load(directory)
    named = rows.select("value", *line_places(), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))

    def batch(found: DataFrame, _: int) -> None:
        files = found.groupBy("path").agg(F.first("size").alias("size"), F.first("modified").alias("modified"))
        listed = files.select("path", F.lit(source).alias("source"), base_name(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("file"), "size", "modified")
        wanted = [tuple(r) for r in store.ungated(listed).select("path", "source", "file", "size", "modified").collect()]  # the files of one micro-batch
        if wanted:
            newest = as_of or str(max(r[4] for r in wanted))
            ingest_lines(store, placed_lines(found.where(F.col("path").isin([r[0] for r in wanted])), source), newest)
            store.record(spark.createDataFrame([r[1:] for r in wanted], "source string, file string, size long, modified timestamp"))

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def windowed_counts(entries: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Entries per tumbling window, source and level of a stream; a window closes when the watermark has passed it."""
    return entries.withWatermark("ts", late).groupBy(F.window("ts", width), "source", "level").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "source", "level", "count")
