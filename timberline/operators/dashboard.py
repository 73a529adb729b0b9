"""The 24-hour dashboard. The window includes its first instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT = 10


def last_day(as_of: str) -> Column:
    return F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")


def source_counts(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count("*").alias("sources"), F.count_if(F.col("status") == "REACHABLE").alias("reachable"), F.count_if(F.col("status") == "UNREACHABLE").alias("unreachable"),
        F.count_if(F.col("status") == "UNVERIFIED").alias("unverified"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"),
    )


def totals(logs: DataFrame, as_of: str) -> DataFrame:
    """Entries, errors and warnings of the last day, in one pass."""
    return logs.where(last_day(as_of)).agg(F.count("*").alias("entries"), F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"))


def source_activity(registry: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """Every configured source with its entries and errors of the last day, quiet ones too."""
    active = logs.where(last_day(as_of)).groupBy("source").agg(F.count("*").alias("entries"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    joined = registry.withColumnRenamed("name", "source").join(active, "source", "left")
    return joined.select(*[c if c != "name" else F.col("source") for c in registry.columns], F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("errors", F.lit(0)).alias("errors"))


def file_activity(logs: DataFrame, as_of: str) -> DataFrame:
    """Entries and errors of each file of the last day; entries without a file don't count."""
    return logs.where(last_day(as_of) & F.col("file").isNotNull()).groupBy("source", "file").agg(F.count("*").alias("entries"), F.count_if(F.col("level") == "ERROR").alias("errors")).orderBy(F.desc("errors"), "source", "file")


def top_error_files(logs: DataFrame, as_of: str, n: int = 6) -> DataFrame:
    return file_activity(logs, as_of).where("errors > 0").orderBy(F.desc("errors"), "source", "file").limit(n)


def recent_issues(logs: DataFrame, n: int = RECENT, tie: str = "doc_seq") -> DataFrame:
    """The newest errors and warnings, however old."""
    return logs.where(F.col("level").isin("ERROR", "WARN")).orderBy(F.desc("ts"), tie).limit(n)
