"""Alerts over streams: counts kept by the minute, and edges from state with a timer."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import kept_window_counts, minute_counts

EVENTS = "rule_id long, tick long, edge string, metric_value double"
TICKS = "rule_id long, tick long, triggered boolean, metric_value double, at timestamp"
#: No rule: a row of each tick that lets time pass for rules that are gone.
NO_RULE = 0
MINUTES = "ts timestamp, source string, level string, scope long, n long, day string, batch long"


class RollUp:
    """Counts of entries by minute, source, level and rule predicate, under ``path``.

    A batch writes its counts into a folder of its own within each day, so a
    repeated batch changes nothing and late entries only add rows. A tick reads
    the days of the rules' windows and no entries. ``where`` has the predicates
    of rules, by id; a rule's predicate counts from when it is there.
    """

    def __init__(self, spark: SparkSession, path: str, where: dict[int, Column] | None = None):
        self.spark, self.path, self.where = spark, path, where or {}
        self.rules: dict[int, tuple[str, str]] = {}  # the texts of the predicates, where an engine made them

    def add(self, entries: DataFrame, batch: int) -> None:
        counts = minute_counts(entries, self.where).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "batch": F.lit(batch).cast("long")})
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def follow(self, entries: DataFrame, checkpoint: str, every: str = "30 seconds"):
        """A query that adds the batches of a stream of entries."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return entries.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(MINUTES).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], MINUTES)

    def window_counts(self, rules: DataFrame, as_of: str, windows: int, disabled=(), scopes=None) -> DataFrame:
        """As operators.alerts.window_counts over all entries that were added but those of ``disabled`` sources.

        ``as_of`` is a whole minute. ``scopes`` are the rules that go by their
        predicates; without it, all that were counted.
        """
        longest = rules.agg(F.max("window_minutes")).first()[0] or 0
        now = F.lit(as_of).cast("timestamp")
        days = self.rows().where((F.col("day") >= F.date_format(now - F.make_dt_interval(mins=F.lit(longest * windows)), "yyyy-MM-dd")) & (F.col("day") <= F.date_format(now, "yyyy-MM-dd")))
        days = days.where(~F.coalesce(F.col("source").isin(*disabled), F.lit(False))) if disabled else days
        return kept_window_counts(days.select("ts", "source", "level", "scope", "n"), rules, as_of, windows, self.where if scopes is None else scopes)

    def compact(self, before: str, batch: int = -1) -> None:
        """Put the batches of days before ``before`` together, one folder a day; no batch may be on its way for those days.

        The sums are staged beside the table first, so a reader sees a day's
        batches or its sum, and a compaction that is cut off is done again.
        """
        staged, old = f"{self.path}-compact", self.rows().where(F.col("day") < before)
        days = [r.day for r in old.groupBy("day").agg(F.count_distinct("batch").alias("n")).where("n > 1").collect()]  # a row a day
        if not days:
            return
        merged = old.where(F.col("day").isin(days)).groupBy("ts", "source", "level", "scope", "day").agg(F.sum("n").alias("n"))
        merged.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").partitionBy("day").parquet(staged)
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        for day in days:
            files.delete(path(f"{self.path}/day={day}"), True)
            files.mkdirs(path(f"{self.path}/day={day}"))
            files.rename(path(f"{staged}/day={day}"), path(f"{self.path}/day={day}/batch={batch}"))
        files.delete(path(staged), True)


class Edges(StatefulProcessor):
    """The last tick, its time and metric of a rule that is firing; a timer resolves a rule whose ticks stop."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("firing", "tick long, metric_value double, timer long")

    def _rows(self, out: list) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(out, columns=["rule_id", "tick", "edge", "metric_value"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks, out = pd.concat(list(rows)).sort_values("tick"), []
        held = self.state.get() if self.state.exists() else None
        firing = held is not None
        for tick, triggered, metric in zip(ticks["tick"], ticks["triggered"], ticks["metric_value"], strict=True):
            if bool(triggered) != firing:
                firing = bool(triggered)
                out.append((key[0], tick, "open" if firing else "resolve", metric))
        if held is not None:
            self.handle.deleteTimer(held[2])
        if firing:
            timer = int(ticks["at"].iloc[-1].timestamp() * 1000) + self.silence_ms
            self.handle.registerTimer(timer)
            self.state.update((int(ticks["tick"].iloc[-1]), float(ticks["metric_value"].iloc[-1]), timer))
        elif held is not None:
            self.state.clear()
        return self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            tick, metric, timer = self.state.get()
            if timer <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], tick, "resolve", metric))
                self.state.clear()
        return self._rows(out)

    def close(self) -> None:
        pass


def alert_edges(ticks: DataFrame, silence_ms: int = 600_000, late: str = "10 seconds") -> DataFrame:
    """Open and resolve events of a streaming frame (rule_id, tick, triggered, metric_value, at).

    Ticks of a rule must come in order across batches. What is firing is in
    the query's checkpoint. A rule that is firing and whose ticks stop is
    resolved with its last one, once the ticks of other rules are ``silence_ms``
    (and ``late``) further: time is that of the ticks, so a replay gives the
    same events. Without a column ``at``, ticks are seconds. The session's
    state store must be RocksDB (``state_store``).
    """
    timed = ticks if "at" in ticks.columns else ticks.withColumn("at", F.timestamp_seconds("tick"))
    return timed.withWatermark("at", late).groupBy("rule_id").transformWithStateInPandas(Edges(silence_ms), EVENTS, "append", "eventTime")


class TickTable:
    """Evaluated rules of each tick, a folder a tick under ``path``, which ``alert_edges`` follows as a stream.

    A folder that is complete is never written again, so a tick that is
    repeated after a failure is the one that was decided first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, name: str) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def begun(self) -> bool:
        return self._exists("begin/_SUCCESS")

    def begin(self, firing: DataFrame) -> None:
        """What is firing (rule_id, metric_value) before the first tick; once."""
        self._write(firing.select("rule_id", F.lit(True).alias("triggered"), "metric_value"), None, "begin")

    def add(self, evaluated: DataFrame, as_of: str, batch: int) -> None:
        """The rules of one tick; ``batch`` names it."""
        beat = self.spark.range(1).select(F.lit(NO_RULE).cast("long").alias("rule_id"), F.lit(False).alias("triggered"), F.lit(0.0).alias("metric_value"))
        self._write(evaluated.select("rule_id", "triggered", "metric_value").unionByName(beat), as_of, f"tick-{batch:012d}")

    def _write(self, rows: DataFrame, as_of: str | None, name: str) -> None:
        if self._exists(f"{name}/_SUCCESS"):
            return
        at = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        made = rows.select("rule_id", F.unix_seconds(at).alias("tick"), "triggered", "metric_value", at.alias("at"))
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")  # a row a rule, seen by a reader at once

    def edges(self, silence_ms: int) -> DataFrame:
        return alert_edges(self.spark.readStream.schema(TICKS).parquet(f"{self.path}/*"), silence_ms)


class Watch:
    """Streaming queries that run and stop together."""

    def __init__(self, *queries):
        self.queries = queries

    @property
    def isActive(self) -> bool:
        return all(q.isActive for q in self.queries)

    def awaitTermination(self, timeout: float | None = None) -> bool:
        """Wait until one of them ends or the seconds are over; an error of one is raised and stops the others."""
        end = None if timeout is None else time.monotonic() + timeout
        while self.isActive and (end is None or time.monotonic() < end):
            time.sleep(0.1)
        if self.isActive:
            return False
        self.stop()
        for query in self.queries:
            query.awaitTermination()
        return True

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def state_store(spark: SparkSession) -> None:
    """Let the session's streams keep state of this kind."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
