"""Sources, store, dashboard, alerts and streams."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from timberline.operators import alerts, dashboard, rows
from timberline.plans.engine import Engine
from timberline.plans.registry import Event, Missing, Records, Rule, Search, Source, browse, valid_rule, valid_source
from timberline.sources import store, tails
from timberline.streaming.alerts import EVENTS, RollUp, TickTable, alert_edges, state_store
from timberline.streaming.ingest import ingest_batch, ingest_history, ingest_stream, windowed_counts

AS_OF = "2026-08-10 12:00:00"
NOW = dt.datetime(2026, 8, 10, 12)


def write(path, *lines):
    path.write_text("".join(f"{x}\n" for x in lines))


def line(minute, level="INFO", text="ok"):
    return f"2026-08-10 11:{minute:02d}:00,000 [{level}] {text}"


def test_engine_reads_sources_and_answers(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs / "a.log", line(1), line(2, "ERROR", "level boom status=500 code=7"), "\tat x.y")
    write(logs / "b.log", line(3, "WARN", "careful"))
    engine = Engine(spark)
    one = engine.sources.create(Source("dir", "LOCAL_DIRECTORY", str(logs)))
    gone = engine.sources.create(Source("gone", "LOCAL_FILE", str(tmp_path / "none.log")))
    off = engine.sources.create(Source("off", "LOCAL_DIRECTORY", str(logs), enabled=False))
    assert engine.check(one.id)[0] == "REACHABLE" and engine.check(gone.id)[0] == "UNREACHABLE" and off.id == 3
    found = engine.logs(AS_OF)
    assert {(r.source, r.file, r.level) for r in found.collect()} == {("dir", "a.log", "INFO"), ("dir", "a.log", "ERROR"), ("dir", "b.log", "WARN"), ("gone", None, "ERROR")}
    assert [r.message for r in engine.search(found, "boom").collect()] == ["level boom status=500 code=7\n\tat x.y"]
    assert [r.file for r in engine.files(found).collect()] == ["a.log", "b.log"]
    saved = engine.saved.create(Search("errors", where="level = 'ERROR' AND source = 'dir'"))
    assert len(engine.run_saved(saved.id, found, AS_OF).collect()) == 1
    board = {k: v.collect() for k, v in engine.dashboard(found, AS_OF).items()}
    assert board["totals"][0].asDict() == {"entries": 4, "errors": 2, "warnings": 1}
    assert {r.source: r.entries for r in board["source_activity"]} == {"dir": 3, "gone": 1, "off": 0}
    assert [(r.file, r.errors) for r in board["top_error_files"]] == [("a.log", 1)]
    write(logs / "c.log", line(4))
    assert engine.logs(AS_OF).count() == 4  # held until a reload
    engine.reload()
    assert engine.logs(AS_OF).count() == 5


def test_rules_fire_once_and_resolve(spark, tmp_path):
    engine, posted = Engine(spark), []
    rule = engine.rules.create(Rule("many", threshold=2.0, window_minutes=5, level="ERROR", webhook_url="http://x"))
    muted = engine.rules.create(Rule("quiet", threshold=0.0, window_minutes=5, webhook_url="http://x", muted=True))
    made = [(i, NOW - dt.timedelta(seconds=10 * (i + 1)), "ERROR", "svc", "a.log", "m") for i in range(3)]
    logs = spark.createDataFrame(made, "doc_seq long, ts timestamp, level string, source string, file string, message string")
    state = set()
    for _ in range(2):
        state = engine.fire(engine.evaluate_rules(logs, AS_OF), state, lambda r, body: posted.append((r.id, body["metricValue"])))
    assert state == {rule.id, muted.id} and posted == [(rule.id, 3.0)]
    assert engine.fire(engine.evaluate_rules(logs.limit(0), AS_OF), state, None) == set()


def counts(spark, values, **rule):
    row = {"rule_id": 1, "source": None, "level": None, "rule_type": "ANOMALY", "window_minutes": 10, "metric": "COUNT", "comparison": "GT", "threshold": None, "baseline_windows": 4, "deviations": 3.0, "muted": False} | rule
    schema = "rule_id long, source string, level string, rule_type string, window_minutes int, metric string, comparison string, threshold double, baseline_windows int, deviations double, muted boolean, window int, count long"
    return spark.createDataFrame([(*row.values(), i, v) for i, v in enumerate(values)], schema)


@pytest.mark.parametrize(("values", "expected"), [([2, 2, 2, 2, 20], True), ([2, 3, 2, 3, 3], False), ([0, 0, 0, 0, 1], True), ([0, 0, 0, 20], False)])
def test_anomalies(spark, values, expected):
    assert alerts.evaluate(counts(spark, values)).orderBy(F.desc("window")).first().triggered is expected


@pytest.mark.parametrize(("comparison", "expected"), [("GT", False), ("GTE", True), ("LT", False), ("LTE", True), ("EQ", True)])
def test_comparisons(spark, comparison, expected):
    assert alerts.evaluate(counts(spark, [3], rule_type="THRESHOLD", comparison=comparison, threshold=3.0)).first().triggered is expected


def test_rates(spark):
    rated = counts(spark, [60], rule_type="THRESHOLD", metric="RATE", threshold=0.05, window_minutes=10)
    assert alerts.evaluate(rated).first().metric_value == 0.1
    assert alerts.evaluate(rated, rate_compat=True).first().metric_value == 60.0


def test_spans_and_stream_agree(spark, tmp_path):
    ticks = counts(spark, [1, 5, 6, 0, 9], rule_type="THRESHOLD", threshold=4.0)
    found = [(r.triggered_at, r.resolved_at, r.metric_value) for r in alerts.spans(alerts.evaluate(ticks)).orderBy("triggered_at").collect()]
    assert found == [(1, 3, 5.0), (4, None, 9.0)]
    ready = alerts.evaluate(ticks).select("rule_id", F.col("window").cast("long").alias("tick"), "triggered", "metric_value")
    assert edges_of(spark, ready, [(0, 2), (3, 4)], tmp_path) == [(1, "open"), (3, "resolve"), (4, "open")]


def edges_of(spark, ready, batches, tmp_path, silence_ms=600_000):
    """Edges of ticks that come batch by batch, each with a new query from the same checkpoint."""
    state_store(spark)
    schema, folder = ready.schema, str(tmp_path / "ticks")
    for low, high in batches:
        ready.where(F.col("tick").between(low, high)).coalesce(1).write.mode("append").parquet(folder)
        alert_edges(spark.readStream.schema(schema).parquet(folder), silence_ms).writeStream.format("parquet").option("path", str(tmp_path / "edges")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return [(r.tick, r.edge) for r in spark.read.schema(EVENTS).parquet(str(tmp_path / "edges")).orderBy("tick", "edge").collect()]


def test_a_silent_rule_is_resolved(spark, tmp_path):
    """Rule 1 stops while it is firing; ticks of another rule let time pass. The state is in the checkpoint."""
    ready = spark.createDataFrame([(1, 0, False, 0.0), (1, 1, True, 7.0), (2, 5, False, 0.0), (2, 300, False, 0.0)], "rule_id long, tick long, triggered boolean, metric_value double")
    (tmp_path / "x").mkdir()
    assert edges_of(spark, ready, [(0, 1), (5, 5)], tmp_path / "x", 60_000) == [(1, "open")]
    assert edges_of(spark, ready, [(0, 1), (5, 5), (300, 300)], tmp_path, 60_000) == [(1, "open"), (1, "resolve")]


def test_a_tick_reads_counts_only(spark, tmp_path):
    made = [(k, NOW - dt.timedelta(seconds=7 * k + 1), ["ERROR", "WARN"][k % 2], "svc", "a.log", "m") for k in range(900)]
    logs = spark.createDataFrame(made, "doc_seq long, ts timestamp, level string, source string, file string, message string")
    rules = spark.createDataFrame([(1, "svc", "ERROR", 10), (2, None, None, 30), (3, None, None, 5)], "rule_id long, source string, level string, window_minutes int")
    where = {3: F.col("doc_seq") % 5 == 0}
    kept = RollUp(spark, str(tmp_path / "roll"), where)
    logs.write.parquet(str(tmp_path / "in"))
    kept.follow(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), every="").awaitTermination()
    kept.add(logs.limit(0), 99)
    found = kept.window_counts(rules, AS_OF, 4)
    counts = lambda df: sorted((r.rule_id, r.window, r["count"]) for r in df.collect())
    assert counts(found) == counts(alerts.window_counts(logs, rules, AS_OF, 4, where))
    assert all("/roll/" in f for f in found.inputFiles())
    kept.compact("2026-08-11")
    assert counts(kept.window_counts(rules, AS_OF, 4)) == counts(found) and kept.rows().select("batch").distinct().count() == 1
    assert RollUp(spark, str(tmp_path / "none")).window_counts(rules, AS_OF, 2).agg(F.sum("count")).first()[0] == 0
    with pytest.raises(ValueError):
        kept.window_counts(rules, "2026-08-10 12:00:01", 2).collect()


def test_latest_per_key(spark):
    events = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "rule long, at long")
    assert sorted(tuple(r) for r in rows.latest_per_key(events, "rule", "at").collect()) == [(1, 9), (2, 3)]


def test_store_replaces_files_and_purges(spark, tmp_path):
    kept = store.EntryStore(spark, str(tmp_path / "v1"))

    def put(file, *texts):
        ingest_batch(kept, spark.createDataFrame([("s", file, "\n".join(texts) + "\n")], "source string, file string, text string"), AS_OF)
        return sorted(r.message for r in kept.read("s", file).collect())

    assert put("a.log", line(1, text="x"), line(2, text="y"), line(3, text="z")) == ["x", "y", "z"]
    assert put("a.log", line(9, text="only")) == ["only"]
    for _ in range(3):
        assert put("b.log", line(1, text="same")) == ["same"]
    assert kept.read().count() == 2
    kept.purge_expired("2026-09-09 11:05:00", 30, str(tmp_path / "v2"))
    assert [r.message for r in kept.read().collect()] == ["only"]
    kept.purge_source("s", str(tmp_path / "v3"))
    assert kept.read().count() == 0


def test_store_purges_in_place(spark, tmp_path):
    kept = store.EntryStore(spark, str(tmp_path / "store"))
    for source, file, texts in (("s", "old file.log", [line(1)]), ("s", "both.log", [line(2, text="gone"), line(9, text="stays")]), ("s", "new.log", [line(9, text="new")]), ("t:1", "new.log", [line(9, text="other")])):
        ingest_batch(kept, spark.createDataFrame([(source, file, "\n".join(texts) + "\n")], "source string, file string, text string"), AS_OF)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet") if "new.log" in str(p)}
    kept.purge_expired("2026-09-09 11:05:00", 30)
    assert sorted(r.message for r in kept.read().collect()) == ["new", "other", "stays"]
    assert all(p.stat().st_mtime_ns == at for p, at in before.items()) and len(before) == 2  # files that aren't expired stay as they are
    kept.purge_source("t:1")
    assert sorted(r.message for r in kept.read().collect()) == ["new", "stays"]
    kept.purge_source("s")
    assert kept.read().count() == 0


def test_history_is_ingested_whole(spark, tmp_path):
    """More lines than a tail has, in several splits, with continuation lines."""
    many = [x for k in range(4000) for x in (line(k % 60, text=f"m{k}"), "\tat x.y")]
    write(tmp_path / "h.log", *many)
    kept = store.EntryStore(spark, str(tmp_path / "store"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        ingest_history(spark, kept, str(tmp_path / "h.log"), "s", AS_OF)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.message for r in kept.read("s", "h.log").collect()} == {f"m{k}\n\tat x.y" for k in range(4000)}


def test_state_outlives_the_engine(spark, tmp_path):
    engine = Engine(spark, state=str(tmp_path), key=bytes(16))
    source = engine.sources.create(Source("a", "SFTP", "p", "h", 22, "u", "pw"))
    engine.saved.create(Search("s", levels=("ERROR", "WARN")))
    rule = engine.rules.create(Rule("r", threshold=1.0, webhook_url="http://x"))
    engine.rules.create(Rule("gone", threshold=1.0))
    engine.rules.delete(2)
    again = Engine(spark, state=str(tmp_path), key=bytes(16))
    assert again.sources.list() == [source] and again.saved.get(1).levels == ("ERROR", "WARN") and again.rules.list() == [rule]
    assert oct((tmp_path / "sources.json").stat().st_mode & 0o777) == "0o600"


def test_events_open_and_resolve(spark):
    def failing(rule, body):
        raise OSError("receiver is down")

    engine = Engine(spark)
    engine.rules.create(Rule("many", threshold=1.0, window_minutes=5, webhook_url="http://x", where="message LIKE 'm%'"))
    engine.rules.create(Rule("broken", threshold=0.0, window_minutes=5, where="nothing = 1"))
    made = [(i, NOW - dt.timedelta(seconds=10 * (i + 1)), "ERROR", "svc", "a.log", m, {}) for i, m in enumerate(("m1", "m2", "x"))]
    logs = spark.createDataFrame(made, "doc_seq long, ts timestamp, level string, source string, file string, message string, fields map<string,string>")
    state = engine.fire(engine.evaluate_rules(logs, AS_OF), set(), failing, AS_OF)
    assert state == {1} and [(e.rule_id, e.triggered_at, e.resolved_at, e.metric_value, e.notified) for e in engine.events.list()] == [(1, AS_OF, None, 2.0, False)]
    assert engine.fire(engine.evaluate_rules(logs.limit(0), AS_OF), state, failing, "later") == set()
    assert engine.events.frame(spark).select("rule_id", "resolved_at", "threshold_at_trigger").collect() == [(1, "later", 1.0)]


def test_rules_are_watched(spark, tmp_path):
    engine, posted = Engine(spark), []
    engine.rules.create(Rule("some", threshold=0.0, window_minutes=1440, webhook_url="http://x"))
    logs = spark.range(3).select(F.col("id").alias("doc_seq"), (F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit("INFO").alias("level"), F.lit("s").alias("source"), F.lit("f").alias("file"), F.lit("m").alias("message"))
    query = engine.watch(lambda: logs, lambda rule, body: posted.append(body["metricValue"]), str(tmp_path / "cp"), "1 second")
    try:
        for _ in range(60):
            if posted:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert posted == [3.0] and len(engine.events.list()) == 1


def until(query, holds):
    for _ in range(90):
        if holds():
            return
        assert not query.awaitTermination(1)
    raise AssertionError("nothing happened")


def test_a_watch_goes_on_in_the_middle_of_an_alert(spark, tmp_path):
    now = [(k, dt.datetime.now(dt.UTC).replace(tzinfo=None) - dt.timedelta(hours=1), "INFO", "s", "f", "m") for k in range(3)]
    many = spark.createDataFrame(now, "doc_seq long, ts timestamp, level string, source string, file string, message string")
    posted, current = [], [many]
    engine = Engine(spark, state=str(tmp_path / "state"))
    engine.rules.create(Rule("some", threshold=2.0, window_minutes=1440, webhook_url="http://x"))
    post = lambda rule, body: posted.append(body["metricValue"])
    ticks = lambda: len(list((tmp_path / "cp" / "ticks").glob("tick-*/_SUCCESS")))
    query = engine.watch(lambda: current[0], post, str(tmp_path / "cp"), "1 second")
    try:
        until(query, lambda: posted)
    finally:
        query.stop()
    again = Engine(spark, state=str(tmp_path / "state"))
    before = ticks()
    query = again.watch(lambda: current[0], post, str(tmp_path / "cp"), "1 second")
    try:
        until(query, lambda: ticks() >= before + 2)
        assert posted == [3.0] and [e.resolved_at for e in again.events.list()] == [None]
        current[0] = many.limit(0)
        until(query, lambda: again.events.list()[0].resolved_at)
    finally:
        query.stop()
    assert posted == [3.0] and len(again.events.list()) == 1 and not query.isActive


def test_edges_come_to_events_once(spark, tmp_path):
    """What was open before is resolved; a rule that is gone is resolved by the ticks of others; a batch that is repeated changes nothing."""
    state_store(spark)
    engine, posted = Engine(spark), []
    for name in ("old", "gone", "muted"):
        engine.rules.create(Rule(name, threshold=1.0, webhook_url="http://x", muted=name == "muted"))
    engine.events.create(Event(1, "2020-01-01 00:00:00", None, 5.0, 1.0, True))
    ticks = TickTable(spark, str(tmp_path / "ticks"))
    assert not ticks.begun()
    ticks.begin(spark.createDataFrame([(1, 5.0)], "rule_id long, metric_value double"))
    assert ticks.begun()
    seen = []

    def run():
        def apply(edges, _):
            for _ in range(2):
                engine.apply_edges(edges, lambda rule, body: posted.append((rule.id, body["metricValue"])))
            seen.extend(edges.collect())

        ticks.edges(60_000).writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return [(e.rule_id, e.resolved_at is not None) for e in engine.events.list()]

    made = lambda *rows: spark.createDataFrame(rows, "rule_id long, triggered boolean, metric_value double")
    assert run() == [(1, False)]
    later = dt.datetime.now(dt.UTC) + dt.timedelta(minutes=1)
    at = lambda minutes: (later + dt.timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S")
    ticks.add(made((1, False, 0.0), (2, True, 7.0), (3, True, 8.0)), at(0), 0)
    ticks.add(made((1, True, 9.0)), at(0), 0)
    assert run() == [(1, True), (2, False), (3, False)] and posted == [(2, 7.0)]
    engine.rules.delete(2)
    ticks.add(made((1, False, 0.0), (3, True, 8.0)), at(10), 1)
    run()
    ticks.add(made((1, False, 0.0), (3, True, 8.0)), at(20), 2)
    assert run() == [(1, True), (2, True), (3, False)] and posted == [(2, 7.0)]
    assert sorted((r.rule_id, r.edge) for r in seen) == [(1, "open"), (1, "resolve"), (2, "open"), (2, "resolve"), (3, "open")]


def test_rules_are_evaluated_on_kept_counts(spark, tmp_path):
    made = [(k, NOW - dt.timedelta(seconds=7 * k + 1), ["ERROR", "WARN"][k % 2], f"s{k % 3}", "a.log", f"m{k % 5}", {}) for k in range(300)]
    logs = spark.createDataFrame(made, "doc_seq long, ts timestamp, level string, source string, file string, message string, fields map<string,string>")
    engine = Engine(spark)
    engine.sources.create(Source("s1", "LOCAL_FILE", "/nowhere", enabled=False))
    for rule in (Rule("all", threshold=10.0), Rule("errors", level="ERROR", threshold=10.0), Rule("word", search="m3", threshold=1.0), Rule("sql", where="message = 'm1'", threshold=1.0), Rule("more", rule_type="ANOMALY", baseline_windows=3, deviations=1.0)):
        engine.rules.create(rule)
    kept = engine.roll_up(str(tmp_path / "roll"), logs)
    kept.add(logs, 0)
    found = lambda df: sorted((r.rule_id, r.metric_value, r.triggered) for r in df.collect())
    counted = engine.evaluate_rules(logs, AS_OF[:17] + "31", kept)
    assert found(counted) == found(engine.evaluate_rules(logs, AS_OF)) and len(found(counted)) == 5
    assert all("/roll/" in f for f in counted.inputFiles())
    engine.rules.update(3, search="m2 m4")
    engine.rules.update(4, where="")
    engine.rules.create(Rule("new", where="message <> 'm1'", threshold=1.0))
    assert found(engine.evaluate_rules(logs, AS_OF, kept)) == found(engine.evaluate_rules(logs, AS_OF))


def test_live_sources_are_read_again_after_a_while(spark, tmp_path, monkeypatch):
    from timberline.plans import engine as module

    write(tmp_path / "a.log", line(1))
    engine = Engine(spark)
    engine.sources.create(Source("a", "LOCAL_FILE", str(tmp_path / "a.log"), live=True))
    monkeypatch.setattr(module, "LIVE_SECONDS", 3600.0)
    assert engine.logs(AS_OF).count() == 1
    write(tmp_path / "a.log", line(1), line(2))
    assert engine.logs(AS_OF).count() == 1
    monkeypatch.setattr(module, "LIVE_SECONDS", 0.0)
    assert engine.logs(AS_OF).count() == 2


def test_changes_of_http_sources(spark):
    server = HTTPServer(("127.0.0.1", 0), Served)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    engine = Engine(spark)
    web = engine.sources.create(Source("web", "HTTP", f"http://127.0.0.1:{server.server_port}/x.log"))
    known = spark.createDataFrame([("x.log", 13, None)], "file string, size long, modified timestamp")
    assert engine.changed_files(web.id, known).count() == 0 and engine.changed_files(web.id, known.limit(0)).count() == 1
    server.shutdown()
    server.server_close()
    assert engine.changed_files(web.id, known.limit(0)).count() == 0


def test_stream_ingests_new_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    kept = store.EntryStore(spark, str(tmp_path / "store"))
    for n in (1, 2):
        write(source / f"{n}.log", line(n, text=f"m{n}"))
        ingest_stream(spark, str(source), "s", kept, str(tmp_path / "cp"), AS_OF, every="").awaitTermination()
        assert sorted(r.message for r in kept.read().collect()) == [f"m{k}" for k in range(1, n + 1)]


def test_ingest_takes_all_lines_and_a_tail_the_last(spark, tmp_path):
    lines = [line(k % 60, text=f"m{k}") for k in range(tails.MAX_LINES + 5)]
    kept = store.EntryStore(spark, str(tmp_path / "store"))
    ingest_batch(kept, spark.createDataFrame([("s", "long.log", "\n".join(lines) + "\n")], "source string, file string, text string"), AS_OF)
    assert {r.message for r in kept.read("s", "long.log").collect()} == {f"m{k}" for k in range(len(lines))}
    write(tmp_path / "long.log", *lines)
    engine = Engine(spark)
    engine.sources.create(Source("s", "LOCAL_FILE", str(tmp_path / "long.log")))
    assert {r.message for r in engine.logs(AS_OF).collect()} == {f"m{k}" for k in range(5, len(lines))}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    made = [(NOW + dt.timedelta(minutes=m), "s", "INFO") for m in (0, 1, 7, 60)]
    spark.createDataFrame(made, "ts timestamp, source string, level string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, source string, level string").parquet(str(tmp_path / "e"))
    windowed_counts(stream, "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]


def test_history_reads_lines_in_order(spark, tmp_path):
    write(tmp_path / "h.log", *[f"l{i}" for i in range(50)])
    found = tails.history(spark, str(tmp_path / "h.log"), "s")
    assert [r.line for r in found.orderBy("pos").collect()] == [f"l{i}" for i in range(50)] and found.first().file == "h.log"


def test_tail_bounds(spark, tmp_path):
    for i in range(4):
        write(tmp_path / f"{i}.log", "x" * 10)
    found = tails.local_tails(spark, str(tmp_path), "s", max_bytes=5, max_files=3).collect()
    assert len(found) == 3 and {r.text for r in found} == {"xxxx\n"} and not found[0].from_start


def test_fingerprints(spark, tmp_path):
    write(tmp_path / "a.log", "1")
    before = spark.createDataFrame(tails.fingerprints(spark, str(tmp_path)).toPandas())
    assert tails.changed(tails.fingerprints(spark, str(tmp_path)), before).count() == 0
    write(tmp_path / "a.log", "1", "2")
    write(tmp_path / "b.log", "1")
    assert sorted(r.file for r in tails.changed(tails.fingerprints(spark, str(tmp_path)), before).collect()) == ["a.log", "b.log"]
    unknown = spark.createDataFrame([("s", "a", 1, None)], "source string, file string, size long, modified timestamp")
    assert tails.ungated(unknown, unknown).count() == 0 and tails.ungated(unknown, unknown.withColumn("size", F.lit(2).cast("long"))).count() == 1


class Served(BaseHTTPRequestHandler):
    body = b"first\nsecond\n"

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.body)))
        self.end_headers()

    def do_GET(self):
        n = int(self.headers["Range"].split("-")[1])
        part = self.body[-n:]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {len(self.body) - len(part)}-{len(self.body) - 1}/{len(self.body)}")
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *_):
        pass


def test_http_tail(spark):
    server = HTTPServer(("127.0.0.1", 0), Served)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x.log"
    assert tails.http_tail(url, 8) == tails.Tail(b"\nsecond\n"[-8:], False) and tails.http_tail(url, 100).from_start
    assert tails.http_reachable(url)[0] == "REACHABLE" and tails.http_probe(url).size == 13
    engine = Engine(spark)
    engine.sources.create(Source("web", "HTTP", url))
    assert sorted(r.message for r in engine.logs(AS_OF).collect()) == ["first", "second"]
    server.shutdown()
    assert tails.http_reachable("http://127.0.0.1:9/none")[0] == "UNREACHABLE"


def test_signature():
    assert store.sign("secret", json.dumps({"a": 1}).encode()) == "sha256=" + __import__("hmac").new(b"secret", b'{"a": 1}', "sha256").hexdigest()


@pytest.mark.parametrize("source", [Source("", "HTTP", "http://x"), Source("a", "HTTP", "x"), Source("a", "SFTP", "p"), Source("a", "LOCAL_FILE"), Source("a", "OTHER", "p")])
def test_bad_sources(source):
    with pytest.raises(ValueError):
        valid_source(source)


@pytest.mark.parametrize("rule", [Rule(""), Rule("a"), Rule("a", threshold=1.0, comparison="X"), Rule("a", "ANOMALY"), Rule("a", "OTHER"), Rule("a", threshold=1.0, window_minutes=0)])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        valid_rule(rule)


def test_records():
    records = Records(valid_source)
    made = records.create(Source("a", "SFTP", "p", "h", 22, "u", "pw"))
    records.update(made.id, status="REACHABLE")
    assert records.update(made.id, enabled=False).status == "REACHABLE"
    changed = records.update(made.id, path="q", password="")
    assert (changed.password, changed.status) == ("pw", "UNVERIFIED")
    records.delete(made.id)
    with pytest.raises(Missing):
        records.get(made.id)


def test_browse(tmp_path):
    (tmp_path / "B").mkdir()
    write(tmp_path / "a.log")
    write(tmp_path / "C.log")
    assert [e["name"] for e in browse(str(tmp_path))] == ["B", "a.log", "C.log"]
    with pytest.raises(ValueError):
        browse(str(tmp_path / "none"))


def test_recent_issues_have_no_cutoff(spark):
    made = [(1, NOW - dt.timedelta(days=90), "ERROR"), (2, NOW, "INFO"), (3, NOW, "WARN")]
    found = dashboard.recent_issues(spark.createDataFrame(made, "doc_seq long, ts timestamp, level string"))
    assert [r.doc_seq for r in found.collect()] == [3, 1]
