"""The log frame: one row per log entry, and views of other tables as log frames.

Columns: doc_seq (tie-breaker), ts, level, source, file, message; entries whose
structure was extracted also have format and fields (map of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In order of severity, so that the position is the sort rank.
LEVELS = ["ERROR", "WARN", "INFO", "DEBUG"]
KEYWORD_FIELDS = ("level", "source", "file", "format")
NO_FILE = "—"

LINE_SCHEMA = "source string, file string, pos long, line string"
ENTRY_SCHEMA = "ts timestamp, level string, source string, file string, message string"


def level_ordinal(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1


def events_view(events: DataFrame) -> DataFrame:
    """The events table as a log frame; its JSON property k is a dynamic field, value a numeric column."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    return events.select(
        F.col("event_id").alias("doc_seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.concat("event_type", F.lit(".log")).alias("file"),
        F.col("props").alias("message"),
        F.lit("json").alias("format"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("fields"),
        F.col("value").alias("num_value"),
    )


def documents_view(documents: DataFrame, as_of: str) -> DataFrame:
    """The documents table as a log frame of INFO entries."""
    return documents.select(
        F.col("doc_id").alias("doc_seq"), F.lit(as_of).cast("timestamp").alias("ts"), F.lit("INFO").alias("level"),
        "source", F.concat("lang", F.lit(".log")).alias("file"), F.col("text").alias("message"),
        F.lit("unstructured").alias("format"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("fields"),
    )
