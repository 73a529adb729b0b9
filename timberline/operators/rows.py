"""Sorted pages of entries, and the labels to filter by."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import level_ordinal


def sort_key(sort_by: str) -> Column:
    """time, level (by severity), source or file; anything else is time."""
    return {"level": level_ordinal(F.col("level")), "source": F.col("source"), "file": F.coalesce("file", F.lit(""))}.get(sort_by, F.col("ts"))


def page(df: DataFrame, sort_by: str = "time", direction: str = "desc", number: int = 0, size: int = 10, tie: str = "doc_seq") -> DataFrame:
    """One page, by a single key with ``tie`` behind it: a top-k and no global sort."""
    key = sort_key(sort_by)
    size = max(1, size)
    return df.orderBy(key.desc() if direction.lower() == "desc" else key.asc(), F.col(tie)).offset(max(0, number) * size).limit(size)


def pages(total: int, size: int) -> int:
    return math.ceil(total / max(1, size))


def files(df: DataFrame, source: str | None = None, tie: str = "doc_seq") -> DataFrame:
    """File labels, without blanks; of spellings that differ in case the first one seen."""
    scoped = df.where(F.col("source") == source) if source else df
    named = scoped.where(F.trim(F.coalesce("file", F.lit(""))) != "")
    return named.groupBy(F.lower("file").alias("_key")).agg(F.min_by("file", tie).alias("file")).orderBy("_key").select("file")


def sources(registry: DataFrame) -> DataFrame:
    """Names of enabled sources, sorted."""
    return registry.where("enabled").select(F.col("name").alias("source")).distinct().orderBy("source")


def latest_per_key(df: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """The newest n rows of each key."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
