"""The engine: searches, aggregations, dashboard, saved searches and alerts over log sources.

Queries are Column predicates from ``timberline.functions.filters`` (or SQL
text) and operators that return DataFrames; there is no query language of its
own to parse, since Spark SQL is one.
"""

from __future__ import annotations

import contextlib
import datetime
import os
import time
from dataclasses import asdict
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.extract import extract
from ..functions.lines import frame_lines, parse
from ..operators import aggregations, alerts, dashboard, rows
from ..sources import tails
from ..sources.store import Sender, post_webhook
from ..streaming.alerts import RollUp, TickTable, Watch, state_store
from .registry import Event, Missing, Records, Rule, Search, Source, Vault, check_local, valid_event, valid_rule, valid_search, valid_source

#: How long what was read of a live source is used.
LIVE_SECONDS = 2.0
#: How long a source isn't probed again for changes.
PROBE_SECONDS = 5.0


class Engine:
    """``state`` names a folder of the driver's that keeps sources, searches, rules and alert events over restarts; ``key`` seals the secrets in it."""

    def __init__(self, spark: SparkSession, apm_template: str | None = None, state: str | None = None, key: bytes | None = None, sender: Sender | None = None):
        self.spark, self._sender = spark, sender
        vault = Vault(spark, key) if key else None
        if state:
            os.makedirs(state, mode=0o700, exist_ok=True)
        kept = lambda name: os.path.join(state, f"{name}.json") if state else None
        self.sources, self.saved = Records(valid_source, kept("sources"), vault), Records(valid_search, kept("searches"))
        self.rules, self.events = Records(valid_rule, kept("rules"), vault), Records(valid_event, kept("events"))
        self.config = {"apm_template": apm_template or None}
        self._held: dict[int, DataFrame] = {}
        self._whole: dict[int, DataFrame] = {}
        self._read_at: dict[int, float] = {}
        self._probed_at: dict[int, float] = {}
        self._prints: dict[int, list] = {}

    # Sources

    def check(self, key: int) -> tuple[str, str]:
        source = self.sources.get(key)
        if source.type == "HTTP":
            status, why = tails.http_reachable(source.path)
        elif source.type == "SFTP":
            try:
                tails.sftp_tail(source.host, source.port, source.username, source.password, source.path, 1)
                status, why = "REACHABLE", "ok"
            except OSError as error:
                status, why = "UNREACHABLE", str(error)
        else:
            status, why = check_local(source)
        self.sources.update(key, status=status)
        return status, why

    def _texts(self, source: Source) -> DataFrame:
        label = source.path.rstrip("/\\").rsplit("/", 1)[-1]
        if source.type == "HTTP":
            return tails.remote_tail(self.spark, source.name, label, lambda url=source.path: tails.http_tail(url))
        if source.type == "SFTP":
            where = (source.host, source.port, source.username, source.password, source.path)
            return tails.remote_tail(self.spark, source.name, label, lambda where=where: tails.sftp_tail(*where))
        if check_local(source)[0] != "REACHABLE":
            raise OSError(check_local(source)[1])
        return tails.local_tails(self.spark, source.path, source.name)

    def attach(self, key: int, lines: DataFrame) -> None:
        """Have all of a source's lines, (file, pos, line) with numbers as ``pos``, read from ``lines`` from now on, instead of its tails."""
        name = self.sources.get(key).name
        self._whole[key] = lines.select(F.lit(name).alias("source"), "file", F.col("pos").cast("long").alias("pos"), "line")
        if key in self._held:
            self._held.pop(key).unpersist()

    def read(self, source: Source, as_of: str) -> DataFrame:
        """A source's entries; an error entry if it can't be read."""
        if source.id in self._whole:
            return parse(self._whole[source.id], as_of)
        try:
            texts = self._texts(source).select("source", "file", "text", "from_start")
            if source.type in ("HTTP", "SFTP"):  # fetched once, which shows a failure; one tail of bounded size
                texts = self.spark.createDataFrame(texts.collect(), texts.schema)
            entries = parse(frame_lines(texts, F.col("from_start"), tails.MAX_LINES), as_of)
        except Exception as error:
            entries = tails.error_entry(self.spark, source.name, str(error).splitlines()[0], as_of)
        return entries

    def logs(self, as_of: str) -> DataFrame:
        """The log frame of all enabled sources; live ones are read again after LIVE_SECONDS, others after reload()."""
        parts = []
        for source in self.sources.list():
            if not source.enabled:
                continue
            if source.id in self._whole:  # not of bounded size, so not kept in memory
                parts.append(self.read(source, as_of))
                continue
            if source.id in self._held and source.live and time.monotonic() - self._read_at[source.id] > LIVE_SECONDS:
                self._held.pop(source.id).unpersist()
            if source.id not in self._held:
                self._held[source.id] = self.read(source, as_of).cache()
                self._read_at[source.id] = time.monotonic()
            parts.append(self._held[source.id])
        if not parts:
            parts = [tails.error_entry(self.spark, "", "", as_of).limit(0)]
        return extract(reduce(DataFrame.unionByName, parts)).withColumn("doc_seq", F.xxhash64("source", "file", "pos"))

    def reload(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()

    def changed_files(self, key: int, known: DataFrame) -> DataFrame:
        """Files of a source that isn't live whose fingerprint differs from ``known``; one that can't be read hasn't changed."""
        source = self.sources.get(key)
        if source.live or not source.enabled:
            return known.limit(0)
        if source.type not in ("HTTP", "SFTP"):
            return tails.changed(tails.fingerprints(self.spark, source.path), known)
        try:
            print_ = tails.http_probe(source.path) if source.type == "HTTP" else tails.sftp_probe(source.host, source.port, source.username, source.password, source.path)
        except (OSError, ValueError):
            return known.limit(0)
        modified = None if print_.last_modified is None else print_.last_modified.astimezone(datetime.UTC).isoformat()
        now = self.spark.createDataFrame([(source.path.rstrip("/\\").rsplit("/", 1)[-1], print_.size, modified)], "file string, size long, modified string")
        return tails.changed(now.withColumn("modified", F.col("modified").cast("timestamp")), known)

    def probe(self, key: int) -> list[str]:
        """Names of a source's files that changed since the probe before; its newest files are looked at, every PROBE_SECONDS at most.

        The first probe only remembers. A source with changes is read again by the next logs().
        """
        now = time.monotonic()
        if now - self._probed_at.get(key, -PROBE_SECONDS) < PROBE_SECONDS:
            return []
        self._probed_at[key] = now
        schema = "file string, size long, modified timestamp"
        known = self.spark.createDataFrame(self._prints.get(key, []), schema)
        changed = [tuple(r) for r in tails.newest(self.changed_files(key, known).select("file", "size", "modified"), by="file").collect()]
        first = key not in self._prints
        held = {r[0]: tuple(r) for r in self._prints.get(key, [])} | {r[0]: r for r in changed}
        self._prints[key] = sorted(held.values(), key=lambda r: (r[2] is not None, r[2]), reverse=True)[: tails.MAX_FILES]
        if changed and not first and key in self._held:
            self._held.pop(key).unpersist()
        return [] if first else sorted(r[0] for r in changed)

    # Queries

    def _disabled(self) -> list[str]:
        return [s.name for s in self.sources.list() if not s.enabled]

    def query(self, logs: DataFrame, where: Column | str = "true", **scope) -> DataFrame:
        """Entries of ``logs`` within a scope that match a predicate."""
        condition = F.expr(where) if isinstance(where, str) else where
        return logs.where(filters.scope(disabled=self._disabled(), **scope) & condition)

    def search(self, logs: DataFrame, search: str = "", levels=(), sort_by: str = "time", direction: str = "desc", page: int = 0, size: int = 10, **scope) -> DataFrame:
        """A page of a simple search."""
        found = logs.where(filters.simple(search, levels, disabled=self._disabled(), **scope))
        return rows.page(found, sort_by, direction, page, size)

    def files(self, logs: DataFrame, source: str | None = None) -> DataFrame:
        return rows.files(logs.where(filters.scope(disabled=self._disabled())), source)

    def run_saved(self, key: int, logs: DataFrame, as_of: str, page: int = 0, size: int = 10) -> DataFrame:
        """A page of a saved search."""
        s: Search = self.saved.get(key)
        scope = {"as_of": as_of, "range_minutes": s.range_minutes, "source": s.source, "file": s.file}
        if s.where:
            return rows.page(self.query(logs, s.where, **scope), s.sort_by, s.direction, page, size)
        return self.search(logs, s.search, s.levels, s.sort_by, s.direction, page, size, **scope)

    def dashboard(self, logs: DataFrame, as_of: str) -> dict[str, DataFrame]:
        registry = self.sources.frame(self.spark)
        return {
            "sources": dashboard.source_counts(registry), "totals": dashboard.totals(logs, as_of), "source_activity": dashboard.source_activity(registry, logs, as_of),
            "file_activity": dashboard.file_activity(logs, as_of), "recent_issues": dashboard.recent_issues(logs), "top_error_files": dashboard.top_error_files(logs, as_of),
        }

    # Alerts

    def _predicates(self, logs: DataFrame) -> tuple[dict[int, Column], list[int]]:
        """The predicates of the rules that have one, and the rules whose predicate doesn't fit the log frame."""
        good, bad = {}, []
        for rule in self.rules.list():
            if rule.where or rule.search:
                where = filters.every([*([F.expr(rule.where)] if rule.where else []), *([filters.simple(rule.search)] if rule.search else [])])
                try:
                    logs.where(where)
                    good[rule.id] = where
                except (AnalysisException, ParseException):
                    bad.append(rule.id)
        return good, bad

    def roll_up(self, path: str, logs: DataFrame) -> RollUp:
        """Counts by the minute for the rules as they are now; ``logs`` shows the columns that entries have."""
        kept = RollUp(self.spark, path, self._predicates(logs)[0])
        kept.rules = {r.id: (r.where, r.search) for r in self.rules.list() if r.id in kept.where}
        return kept

    def evaluate_rules(self, logs: DataFrame, as_of: str, kept: RollUp | None = None) -> DataFrame:
        """Each rule's current window: metric_value and triggered. A rule that can't be evaluated is left out and stops no other.

        With ``kept`` (of roll_up) only its counts are read, up to the whole
        minute before ``as_of``; rules whose predicate it doesn't count, being
        newer or changed since, look at ``logs`` for the same time.
        """
        where, bad = self._predicates(logs)
        windows = 1 + max([r.baseline_windows for r in self.rules.list()], default=0)
        rules = self.rules.frame(self.spark).drop("where", "search")
        rules = rules.where(~F.col("id").isin(*bad)) if bad else rules
        disabled = self._disabled()
        entries = logs.where(filters.scope(disabled=disabled))
        if kept is None:
            counts = alerts.window_counts(entries, rules, as_of, windows, where)
        else:
            as_of = str(as_of)[:16] + ":00"
            told = {r.id: (r.where, r.search) for r in self.rules.list()}
            fresh = [k for k in where if kept.rules.get(k) != told[k]]
            counts = kept.window_counts(rules.where(~F.col("id").isin(*fresh)) if fresh else rules, as_of, windows, disabled, where.keys() - fresh)
            if fresh:
                counts = counts.unionByName(alerts.window_counts(entries, rules.where(F.col("id").isin(*fresh)), as_of, windows, {k: where[k] for k in fresh}))
        return alerts.evaluate(counts).where(F.col("window") == windows - 1)

    @property
    def sender(self) -> Sender:
        """What posts webhooks; its threads start with the first use."""
        self._sender = self._sender or Sender()
        return self._sender

    def notify(self, rule: Rule, payload: dict, event: int | None = None) -> bool:
        """Queue a rule's webhook and return at once; an event that couldn't be sent is marked so when that is known."""

        def done(status, error) -> None:
            if event is not None and (error is not None or not 200 <= status < 300):
                with contextlib.suppress(Missing):  # the event may be deleted by then
                    self.events.update(event, notified=False)

        return self.sender.submit(rule.webhook_url, payload, rule.webhook_secret or None, done)

    def test_webhook(self, key: int, timeout: float = 5) -> tuple[bool, str]:
        """Post a sample to a rule's webhook and wait for it: whether it arrived, and why not."""
        rule: Rule = self.rules.get(key)
        if not rule.webhook_url:
            return False, "the rule has no webhook"
        try:
            status = post_webhook(rule.webhook_url, {**_told(rule), "metricValue": 0.0, "test": True}, rule.webhook_secret or None, timeout)
        except (OSError, ValueError) as error:
            return False, str(error)
        return 200 <= status < 300, f"HTTP status {status}"

    def fire(self, triggered: DataFrame, firing: set[int], post=None, as_of: str | None = None) -> set[int]:
        """Open events of rules that began to trigger and notify unless muted, resolve those that stopped; returns those that trigger now.

        ``post(rule, payload)`` sends at once; without it the sender's threads do.
        """
        now = {r["rule_id"]: r for r in triggered.where("triggered").collect()}  # one row a rule
        at = as_of or datetime.datetime.now(datetime.UTC).isoformat()
        for event in self.events.list():
            if event.resolved_at is None and event.rule_id not in now:
                self.events.update(event.id, resolved_at=at)
        for rule_id in sorted(now.keys() - firing):
            self._begin(self.rules.get(rule_id), at, now[rule_id]["metric_value"], post)
        return set(now)

    def _begin(self, rule: Rule, at: str, metric: float, post) -> None:
        """Open a rule's event and notify unless muted."""
        event = self.events.create(Event(rule.id, at, None, metric, rule.threshold, not rule.muted))
        if not rule.webhook_url or rule.muted:
            return
        payload = {**_told(rule), "metricValue": metric}
        if post is None:
            if not self.notify(rule, payload, event.id):
                self.events.update(event.id, notified=False)
            return
        try:
            post(rule, payload)
        except OSError:  # a receiver that is down stops no other rule
            self.events.update(event.id, notified=False)

    def apply_edges(self, edges: DataFrame, post=None) -> None:
        """Open and resolve events by the rows of ``alert_edges``; rows that come again change nothing, and an event that is open stays the rule's only one."""
        for e in edges.orderBy("tick", F.col("edge") == "open").collect():  # a row each time a rule changes
            at = datetime.datetime.fromtimestamp(e.tick, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
            own = [x for x in self.events.list() if x.rule_id == e.rule_id]
            if e.edge == "resolve":
                for x in own:
                    if x.resolved_at is None:
                        self.events.update(x.id, resolved_at=at)
            elif not any(x.resolved_at is None or x.triggered_at == at for x in own):
                with contextlib.suppress(Missing):  # the rule may be deleted by then
                    self._begin(self.rules.get(e.rule_id), at, e.metric_value, post)

    def watch(self, logs, post, checkpoint: str, every: str = "30 seconds", kept: RollUp | None = None, silence_ms: int = 600_000) -> Watch:
        """Evaluate all rules at every tick and open and resolve their events (``post`` as in fire).

        One query evaluates the rules on ``logs()``, or on the counts of
        ``kept``, and writes a tick; another follows the ticks, with what is
        firing in its state under ``checkpoint``: a restart goes on in the
        middle of an alert. A rule that is deleted while it is firing is
        resolved once ``silence_ms`` have passed. The time of a tick is that of
        its rows, so a tick that is repeated is the same.
        """
        state_store(self.spark)
        ticks = TickTable(self.spark, f"{checkpoint}/ticks")
        if not ticks.begun():
            ticks.begin(self.spark.createDataFrame([(e.rule_id, e.metric_value) for e in self.events.list() if e.resolved_at is None], "rule_id long, metric_value double"))

        def tick(rows: DataFrame, batch: int) -> None:
            newest = rows.agg(F.max("timestamp").cast("string")).first()[0]
            if newest is not None:
                as_of = newest[:19] if kept is None else newest[:16] + ":00"
                ticks.add(self.evaluate_rules(logs(), as_of, kept), as_of, batch)

        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        ticking = clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{checkpoint}/clock").trigger(processingTime=every).start()
        try:
            firing = ticks.edges(silence_ms).writeStream.foreachBatch(lambda edges, _: self.apply_edges(edges, post)).option("checkpointLocation", f"{checkpoint}/edges").start()
        except Exception:
            ticking.stop()
            raise
        return Watch(ticking, firing)


def _told(rule: Rule) -> dict:
    """What a webhook is told of a rule: all but the secret."""
    return {k: v for k, v in asdict(rule).items() if k != "webhook_secret"}


def count_by(logs: DataFrame, where: Column, name: str) -> DataFrame:
    """The shortest path from a filter to groups."""
    return aggregations.count_by(logs.where(where), name)
