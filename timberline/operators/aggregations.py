"""Counts, rates and numeric statistics, grouped or over time.

Time buckets are half open, counted from ``as_of`` minus the range; the last
is clipped at ``as_of``, and at most MAX_BUCKETS are kept from the oldest on.
Bucket frames are (key, count, rate, stat_value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import number, value
from ..model import NO_FILE

MAX_GROUPS, MAX_BUCKETS, DEFAULT_RANGE_MINUTES = 100, 500, 1440

STATISTICS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
RANK_BINS, BINS_PER_OCTAVE = 4096, 1024


def _magnitude_bin(x: Column) -> Column:
    """A number that ascends with ``x``: its sign and the logarithm of its size."""
    of = lambda size: F.lit(1 << 21) + F.floor(F.greatest(F.lit(-1074.0), F.least(F.log2(size), F.lit(1024.0))) * BINS_PER_OCTAVE)
    return F.when(F.isnan(x), F.lit(1 << 23)).when(x > 0, of(x)).when(x < 0, -of(-x)).otherwise(F.lit(0)).cast("long")


def nearest_rank(values: DataFrame, p: float, limit: int = MAX_GROUPS) -> DataFrame:
    """(key, count, stat_value): the exact nearest-rank percentile of the ``_value`` of the first ``limit`` keys.

    Two scans. The first counts values in bins by magnitude, which tells the
    bin that holds each key's rank. The second counts the different values of
    that bin; they are narrowed once more in linear bins. No task sorts or
    holds a group, as it would for percentile_disc; the table of bins has a
    row per key, so ``limit`` bounds what is broadcast.
    """

    def holding(bins: DataFrame) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        found = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        return found.withColumn("rank", F.col("rank") - F.col("upto") + F.col("n")).drop("upto", "n")

    ends = [F.min("_value").alias("low"), F.max("_value").alias("high")]
    bins = values.groupBy("key", _magnitude_bin(F.col("_value")).alias("bin")).agg(F.count("*").alias("n"), *ends)
    bins = bins.withColumn("count", F.sum("n").over(Window.partitionBy("key"))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("count") * p)).cast("long"))
    range_of = holding(bins).orderBy("key").limit(limit)
    inside = values.join(F.broadcast(range_of), "key").where((F.col("_value") >= F.col("low")) & (F.col("_value") <= F.col("high")))
    distinct = inside.groupBy("key", "count", "rank", "low", "high", "_value").agg(F.count("*").alias("n"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("_value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANK_BINS), F.lit(RANK_BINS - 1))).otherwise(0).cast("int")
    narrow = distinct.groupBy("key", "count", "rank", at.alias("bin")).agg(F.sum("n").alias("n"), *ends)
    part = F.broadcast(holding(narrow).select("key", F.col("rank").alias("rank_in"), F.col("low").alias("from"), F.col("high").alias("to")))
    last = distinct.join(part, "key").where((F.col("_value") >= F.col("from")) & (F.col("_value") <= F.col("to")))
    return holding(last.select("key", "count", F.col("rank_in").alias("rank"), F.col("_value").alias("bin"), "n")).select("key", "count", F.col("bin").alias("stat_value"))


def _statistic(values: DataFrame, statistic: str, limit: int) -> DataFrame:
    """(key, count, stat_value) of (key, _value) rows; ``limit`` keys at least."""
    if statistic in RANKS:
        return nearest_rank(values, RANKS[statistic], limit)
    return values.groupBy("key").agg(F.count("*").alias("count"), STATISTICS[statistic]("_value").alias("stat_value"))


def count_by(df: DataFrame, name: str, limit: int = MAX_GROUPS) -> DataFrame:
    """The largest groups of a field's values, ties by value; rows without a value form no group, a missing file is ``—``."""
    key = F.when(F.coalesce("file", F.lit("")) == "", NO_FILE).otherwise(F.col("file")) if name == "file" else value(name)
    groups = df.select(key.alias("key")).where((F.col("key").isNotNull()) & (F.col("key") != "")).groupBy("key").agg(F.count("*").alias("count"))
    return groups.orderBy(F.desc("count"), "key").limit(limit)


def _buckets(as_of: str, range_minutes: int, width_ms: int, spark: SparkSession) -> tuple[DataFrame, Column, int]:
    """The buckets (i, start), the window's first millisecond and the number of buckets."""
    span = (range_minutes if range_minutes > 0 else DEFAULT_RANGE_MINUTES) * 60_000
    n = min(MAX_BUCKETS, -(-span // max(1, width_ms)))
    first = F.unix_millis(F.lit(as_of).cast("timestamp")) - span
    return spark.range(n).select(F.col("id").alias("i"), (first + F.col("id") * width_ms).alias("start")), first, n


def count_over_time(df: DataFrame, as_of: str, range_minutes: int, width_ms: int, with_rate: bool = False) -> DataFrame:
    """Entries per bucket, empty ones included; rows outside all buckets don't count. A rate is per second of a full bucket."""
    width_ms = max(1, width_ms)
    spine, first, n = _buckets(as_of, range_minutes, width_ms, df.sparkSession)
    end = F.least(first + n * width_ms, F.unix_millis(F.lit(as_of).cast("timestamp")))
    inside = df.where((F.col("ts") >= F.timestamp_millis(first)) & (F.col("ts") < F.timestamp_millis(end)))  # constants, which reach the scan
    counted = inside.groupBy(F.floor((F.unix_millis("ts") - first) / width_ms).cast("long").alias("i")).agg(F.count("*").alias("count"))
    out = spine.join(counted, "i", "left").select("i", "start", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    rate = F.col("count") / F.lit(width_ms / 1000.0) if with_rate else F.lit(None).cast("double")
    return out.select("i", F.col("start").alias("start_ms"), "count", rate.alias("rate"))


def numeric_by(df: DataFrame, statistic: str, of: str | Column, by: str | None = None, limit: int = MAX_GROUPS) -> DataFrame:
    """A statistic of a numeric field: (key, count, stat_value), the first groups by key; one group ``all`` without ``by``.

    Rows without a number, or without a group's value, don't count; a missing
    file is a group with an empty key.
    """
    key = F.lit("all") if by is None else F.coalesce("file", F.lit("")) if by == "file" else value(by)
    numbers = df.select(key.alias("key"), (number(of) if isinstance(of, str) else of).alias("_value")).where("key IS NOT NULL AND _value IS NOT NULL")
    return _statistic(numbers, statistic, limit).orderBy("key").limit(limit)


def numeric_over_time(df: DataFrame, statistic: str, of: str | Column, as_of: str, range_minutes: int, width_ms: int) -> DataFrame:
    """A statistic per bucket; rows outside the window fall into the first or last bucket, empty buckets have no value."""
    width_ms = max(1, width_ms)
    spine, first, n = _buckets(as_of, range_minutes, width_ms, df.sparkSession)
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.unix_millis("ts") - first) / width_ms))).cast("long")
    numbers = df.select(at.alias("key"), (number(of) if isinstance(of, str) else of).alias("_value")).where("_value IS NOT NULL")
    stats = _statistic(numbers, statistic, MAX_BUCKETS).withColumnRenamed("key", "i")
    return spine.join(stats, "i", "left").select("i", F.col("start").alias("start_ms"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), "stat_value")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def bar_value(buckets: DataFrame) -> Column:
    """What a chart shows: the statistic, else the rate, else the count."""
    have = [F.col(c).cast("double") for c in ("stat_value", "rate", "count") if c in buckets.columns]
    return F.coalesce(*have)
