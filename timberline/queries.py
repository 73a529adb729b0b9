"""Registered queries of the log engine over the test tables, with their DuckDB counterparts.

``AS_OF`` is later than every event, and all windows count back from it.
Queries that need log text build it from events, so that the SQL can tell the
parsed columns from the original ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters as f
from .functions import lines, text
from .functions.extract import entry_ids, extract
from .model import documents_view, events_view, level_ordinal
from .operators import aggregations as agg
from .operators import alerts, dashboard, rows
from .plans.engine import Engine
from .plans.registry import Rule, Search, Source
from .sources import store, tails
from .streaming.alerts import RollUp
from .streaming.ingest import windowed_counts

AS_OF = "2024-01-31 00:00:00"
MONTH = 30 * 1440
HOUR, DAY = 3_600_000, 86_400_000

VIEW = """logs AS (SELECT event_id AS doc_seq, ts,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  concat('svc-', user_id % 5) AS source, concat(event_type, '.log') AS file, props AS message,
  json_extract_string(props, '$.k') AS k, value AS num_value, user_id FROM events)"""
START = f"epoch_ms(TIMESTAMP '{AS_OF}') - {MONTH * 60_000}"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_view(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_view(spark.read.parquet(f"{sf_dir}/documents.parquet"), AS_OF)


def _add(name: str, run, sql: str | None = None, on=_logs) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(on(spark, sf_dir))

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {VIEW} {sql}"


# Counts by field

for _key in ("source", "level", "file"):
    _add(f"stats_count_by_{_key}", lambda df, k=_key: agg.count_by(df, k), f"SELECT {_key} AS key, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
_add("stats_count_by_field_k", lambda df: agg.count_by(df, "k"), "SELECT k AS key, count(*) AS count FROM logs WHERE k <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
_add("stats_count_errors_by_source", lambda df: agg.count_by(df.where(f.equals("level", "ERROR")), "source"), "SELECT source AS key, count(*) AS count FROM logs WHERE level = 'ERROR' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").cast("string").alias("source"))


_add("stats_top_100_groups", lambda df: agg.count_by(df, "source"), "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", on=_users)

# Numeric statistics

_SQL_STAT = {"avg": "round(avg(v), 6)", "min": "min(v)", "max": "max(v)", "sum": "round(sum(v), 4)", "p50": "quantile_disc(v, 0.5)", "p95": "quantile_disc(v, 0.95)", "p99": "quantile_disc(v, 0.99)"}


def _rounded(df: DataFrame, statistic: str) -> DataFrame:
    places = {"avg": 6, "sum": 4}.get(statistic)
    return df.withColumn("stat_value", F.round("stat_value", places)) if places else df


for _name, _sql in _SQL_STAT.items():
    _add(f"numeric_{_name}_by_source", lambda df, n=_name: _rounded(agg.numeric_by(df, n, F.col("num_value"), "source"), n), f"SELECT source AS key, count(*) AS count, {_sql} AS stat_value FROM (SELECT source, num_value AS v FROM logs WHERE num_value IS NOT NULL) GROUP BY 1 ORDER BY 1 LIMIT 100")
    _add(
        f"numeric_{_name}_over_time_1d", lambda df, n=_name: _rounded(agg.numeric_over_time(df, n, F.col("num_value"), AS_OF, MONTH, DAY), n),
        f"SELECT i, {START} + i * {DAY} AS start_ms, coalesce(count, 0) AS count, stat_value FROM range(30) r(i) LEFT JOIN (SELECT greatest(0, least(29, CAST(floor(((epoch_us(ts) // 1000) - ({START})) / {DAY}) AS BIGINT))) AS i, count(*) AS count, {_sql} AS stat_value FROM (SELECT ts, num_value AS v FROM logs WHERE num_value IS NOT NULL) GROUP BY 1) USING (i)",
    )
_add("numeric_p95_all", lambda df: agg.numeric_by(df, "p95", F.col("num_value")), "SELECT 'all' AS key, count(num_value) AS count, quantile_disc(num_value, 0.95) AS stat_value FROM logs")
_add("numeric_avg_field_k_by_level", lambda df: _rounded(agg.numeric_by(df, "avg", "k", "level"), "avg"), "SELECT level AS key, count(*) AS count, round(avg(CAST(k AS DOUBLE)), 6) AS stat_value FROM logs WHERE regexp_full_match(k, '-?[0-9]+(\\.[0-9]+)?') GROUP BY 1 ORDER BY 1")
_EDGE = f"epoch_ms(TIMESTAMP '{AS_OF}') - {10 * DAY}"
_add(
    "numeric_over_time_edges", lambda df: _rounded(agg.numeric_over_time(df, "sum", F.col("num_value"), AS_OF, 10 * 1440, DAY), "sum"),
    f"SELECT i, {_EDGE} + i * {DAY} AS start_ms, coalesce(count, 0) AS count, stat_value FROM range(10) r(i) LEFT JOIN (SELECT greatest(0, least(9, CAST(floor(((epoch_us(ts) // 1000) - ({_EDGE})) / {DAY}) AS BIGINT))) AS i, count(*) AS count, round(sum(num_value), 4) AS stat_value FROM logs WHERE num_value IS NOT NULL GROUP BY 1) USING (i)",
)

# Counts over time


def _over_time(n: int, width: int, rate: str = "CAST(NULL AS DOUBLE)", start: str = START) -> str:
    return f"SELECT i, {start} + i * {width} AS start_ms, coalesce(c, 0) AS count, {rate} AS rate FROM range({n}) r(i) LEFT JOIN (SELECT ((epoch_us(ts) // 1000) - ({start})) // {width} AS i, count(*) AS c FROM logs WHERE (epoch_us(ts) // 1000) >= {start} AND (epoch_us(ts) // 1000) < epoch_ms(TIMESTAMP '{AS_OF}') GROUP BY 1) USING (i)"


_add("count_over_time_1d", lambda df: agg.count_over_time(df, AS_OF, MONTH, DAY), _over_time(30, DAY))
_add("count_over_time_1h_capped", lambda df: agg.count_over_time(df, AS_OF, MONTH, HOUR), _over_time(500, HOUR))
_add("count_over_time_clipped", lambda df: agg.count_over_time(df, AS_OF, 10 * 1440, 7 * DAY), _over_time(2, 7 * DAY, start=_EDGE))
_add("rate_6h", lambda df: agg.count_over_time(df, AS_OF, MONTH, 6 * HOUR, with_rate=True), _over_time(120, 6 * HOUR, "coalesce(c, 0) / 21600.0"))

# Filters: ids of the rows that match


def _ids(df: DataFrame, where) -> DataFrame:
    return df.where(where).select("doc_seq")


def _filter(name: str, where, sql: str, on=_logs) -> None:
    _add(name, lambda df: _ids(df, where()), f"SELECT doc_seq FROM logs WHERE {sql}" if on is _logs else sql, on)


_filter("filter_equal", lambda: f.equals("k", "87"), "k = '87'")
_filter("filter_differs_or_missing", lambda: f.differs("k", "87"), "NOT coalesce(k = '87', false)")
_filter("filter_number_inclusive", lambda: f.between("k", 10, 20), "TRY_CAST(k AS DOUBLE) BETWEEN 10 AND 20")
_filter("filter_number_exclusive", lambda: f.between("k", 10, 20, False, False), "TRY_CAST(k AS DOUBLE) > 10 AND TRY_CAST(k AS DOUBLE) < 20")
_filter("filter_time", lambda: f.in_time("2024-01-10 00:00:00", "2024-01-12 00:00:00", True, False), "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
_filter("filter_levels", lambda: f.simple(levels=["ERROR", "WARN"]), "level IN ('ERROR', 'WARN')")
_filter("filter_nested", lambda: (f.equals("level", "ERROR") | f.equals("source", "svc-1")) & f.negate(f.equals("file", "view.log")), "(level = 'ERROR' OR source = 'svc-1') AND file <> 'view.log'")
_filter("filter_pattern_field", lambda: f.matches("svc-[12]", "source"), "regexp_full_match(source, 'svc-[12]')")
_filter("filter_pattern_both", lambda: f.matches("svc-.*&@[13]", "source"), "regexp_full_match(source, 'svc-.*') AND regexp_full_match(source, '.*[13]')")
_filter("filter_pattern_complement", lambda: f.matches("svc-~(1|3)", "source", complement=True), "starts_with(source, 'svc-') AND substr(source, 5) NOT IN ('1', '3')")
_filter("filter_pattern_number", lambda: f.matches("<5-20>", "k"), "regexp_full_match(k, '[0-9]+') AND CAST(k AS BIGINT) BETWEEN 5 AND 20")
_filter("filter_wildcard", lambda: f.wildcard("pur*.l?g", "file"), "file LIKE 'pur%.l_g'")
_filter("filter_prefix", lambda: f.prefix("svc-3", "source"), "starts_with(source, 'svc-3')")
_filter("filter_lexical_range", lambda: f.lexical_range("k", "2", "4"), "k >= '2' AND k <= '4'")
_filter("filter_fuzzy", lambda: f.fuzzy("clck.log", 1, "file"), "levenshtein(file, 'clck.log') <= 1")
_filter("filter_file_as_word", lambda: f.term("purchase.log"), "file = 'purchase.log'")
_filter("filter_clauses_must_should", lambda: f.clauses([f.equals("level", "INFO")], [f.equals("source", "svc-0")], [f.equals("file", "signup.log")]), "level = 'INFO' AND file <> 'signup.log'")
_filter("filter_clauses_should", lambda: f.clauses(should=[f.equals("level", "WARN"), f.equals("source", "svc-0")]), "level = 'WARN' OR source = 'svc-0'")
_filter("filter_clauses_only_negative", lambda: f.clauses(must_not=[f.equals("level", "ERROR")]), "false")
_filter("scope_window_and_source", lambda: f.scope(AS_OF, 3 * 1440, source="svc-2", file="click.log"), f"source = 'svc-2' AND file = 'click.log' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY")
_filter("scope_disabled_sources", lambda: f.scope(disabled=["svc-0", "svc-4"]), "source NOT IN ('svc-0', 'svc-4')")
_filter("trace_correlation", lambda: f.trace("k", "42"), "k = '42'")
_WORDS = r"(SELECT doc_id AS doc_seq, source, lang, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(\p{L})[.:''’·](\p{L})', '\1_\2', 'g'), '(\p{L})[.:''’·](\p{L})', '\1_\2', 'g'), '(\p{Nd})[.,;''’](\p{Nd})', '\1_\2', 'g'), '(\p{Nd})[.,;''’](\p{Nd})', '\1_\2', 'g'), '[\p{L}\p{N}\p{M}_]+') AS t FROM documents)"
_filter("text_any_word", lambda: text.has_any_token(F.col("message"), "haou est"), f"WITH d AS {_WORDS} SELECT doc_seq FROM d WHERE list_has_any(t, ['haou', 'est'])", _docs)
_filter("text_phrase", lambda: text.has_phrase(F.col("message"), "of the"), f"WITH d AS {_WORDS} SELECT doc_seq FROM d WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')", _docs)
_filter("text_near_phrase", lambda: text.has_near_phrase(F.col("message"), "of the", 2), f"WITH d AS {_WORDS}, w AS (SELECT doc_seq, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM d) SELECT DISTINCT a.doc_seq FROM w a JOIN w b ON a.doc_seq = b.doc_seq AND a.w = 'of' AND b.w = 'the' AND abs(b.i - 1 - a.i) <= 2", _docs)
_filter("text_pattern_token", lambda: f.matches("th[ae]t?ha.*"), f"WITH d AS {_WORDS} SELECT doc_seq FROM d WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'th[ae]t?ha.*'))) > 0", _docs)
_filter("text_pattern_inner", lambda: f.matches("(th@&@a).{2}"), f"WITH d AS {_WORDS} SELECT doc_seq FROM d WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'th.*a..'))) > 0", _docs)

# Rows


def _page(df: DataFrame) -> DataFrame:
    return df.select("doc_seq", F.unix_millis("ts").alias("ts_ms"), "level", "source", "file", "message")


_COLUMNS = "doc_seq, (epoch_us(ts) // 1000) AS ts_ms, level, source, file, message"
_RANK = "CASE level WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END"
_add("page_time_desc_2", lambda df: _page(rows.page(df, number=1, size=25)), f"SELECT {_COLUMNS} FROM logs ORDER BY ts DESC, doc_seq LIMIT 25 OFFSET 25")
_add("page_level_asc", lambda df: _page(rows.page(df, "level", "asc", 0, 50)), f"SELECT {_COLUMNS} FROM logs ORDER BY {_RANK}, doc_seq LIMIT 50")
_add("page_source_desc", lambda df: _page(rows.page(df, "source", "DESC", 2, 20)), f"SELECT {_COLUMNS} FROM logs ORDER BY source DESC, doc_seq LIMIT 20 OFFSET 40")
_add("page_file_asc", lambda df: _page(rows.page(df, "file", "asc", 0, 30)), f"SELECT {_COLUMNS} FROM logs ORDER BY file, doc_seq LIMIT 30")
_add("files_distinct", lambda df: rows.files(df), "SELECT arg_min(file, doc_seq) AS file FROM logs WHERE trim(file) <> '' GROUP BY lower(file)")
_add("total_count", lambda df: agg.total(df.where(f.equals("level", "WARN"))), "SELECT count(*) AS total FROM logs WHERE level = 'WARN'")
_add("level_ordinals", lambda df: df.select(level_ordinal(F.col("level")).alias("rank"), "level").distinct(), f"SELECT DISTINCT CAST({_RANK} AS INT) AS rank, level FROM logs")

# Dashboard


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that users of the events table belong to; the last two have no entries in the log view."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).alias("id")).distinct()
    return users.select(F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 3 == 0, "REACHABLE").when(F.col("id") % 3 == 1, "UNREACHABLE").otherwise("UNVERIFIED").alias("status"), (F.col("id") != 4).alias("enabled"), (F.col("id") == 1).alias("live"))


_REGISTRY = "registry AS (SELECT concat('svc-', id) AS name, CASE id % 3 WHEN 0 THEN 'REACHABLE' WHEN 1 THEN 'UNREACHABLE' ELSE 'UNVERIFIED' END AS status, id <> 4 AS enabled, id = 1 AS live FROM (SELECT DISTINCT user_id % 7 AS id FROM events))"
_DAY = "ts >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 24 HOUR"
_NOON = "2024-01-29 12:00:00"
_add("dashboard_source_counts", dashboard.source_counts, f"WITH {_REGISTRY} SELECT count(*) AS sources, count(*) FILTER (status = 'REACHABLE') AS reachable, count(*) FILTER (status = 'UNREACHABLE') AS unreachable, count(*) FILTER (status = 'UNVERIFIED') AS unverified, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled FROM registry", on=_sources)
_add("dashboard_totals", lambda df: dashboard.totals(df, _NOON), f"SELECT count(*) AS entries, count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARN') AS warnings FROM logs WHERE {_DAY}")
_add("dashboard_source_activity", lambda both: dashboard.source_activity(*both, _NOON), f"WITH {VIEW}, {_REGISTRY} SELECT name AS source, status, enabled, live, coalesce(entries, 0) AS entries, coalesce(errors, 0) AS errors FROM registry LEFT JOIN (SELECT source, count(*) AS entries, count(*) FILTER (level = 'ERROR') AS errors FROM logs WHERE {_DAY} GROUP BY 1) a ON name = source", on=lambda spark, sf_dir: (_sources(spark, sf_dir), _logs(spark, sf_dir)))
_add("dashboard_file_activity", lambda df: dashboard.file_activity(df, _NOON), f"SELECT source, file, count(*) AS entries, count(*) FILTER (level = 'ERROR') AS errors FROM logs WHERE {_DAY} AND file IS NOT NULL GROUP BY 1, 2")
_add("dashboard_top_error_files", lambda df: dashboard.top_error_files(df, _NOON), f"SELECT source, file, count(*) AS entries, count(*) FILTER (level = 'ERROR') AS errors FROM logs WHERE {_DAY} GROUP BY 1, 2 HAVING errors > 0 ORDER BY errors DESC, source, file LIMIT 6")
_add("dashboard_recent_issues", lambda df: _page(dashboard.recent_issues(df)), f"SELECT {_COLUMNS} FROM logs WHERE level IN ('ERROR', 'WARN') ORDER BY ts DESC, doc_seq LIMIT 10")

# Alerts

_RULES = [(1, "svc-1", "ERROR", "THRESHOLD", 1440, "COUNT", "GT", 2.0, 0, 0.0, False), (2, None, "WARN", "THRESHOLD", 1440, "COUNT", "GTE", 60.0, 0, 0.0, True), (3, None, None, "THRESHOLD", 720, "RATE", "LT", 0.004, 0, 0.0, False), (4, None, "ERROR", "ANOMALY", 1440, "COUNT", "GT", None, 4, 1.0, False)]
_RULE_COLUMNS = "rule_id long, source string, level string, rule_type string, window_minutes int, metric string, comparison string, threshold double, baseline_windows int, deviations double, muted boolean"
_WINDOWS = 20


def _evaluated(df: DataFrame) -> DataFrame:
    rules = df.sparkSession.createDataFrame(_RULES, _RULE_COLUMNS)
    return alerts.evaluate(alerts.window_counts(df, rules, AS_OF, _WINDOWS))


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)


_EVALUATED = f"""WITH {VIEW}, rules({", ".join(c.split()[0] for c in _RULE_COLUMNS.split(", "))}) AS (VALUES {", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _RULES)}),
 counts AS (SELECT r.*, w."window", (SELECT count(*) FROM logs l WHERE (r.source IS NULL OR l.source = r.source) AND (r.level IS NULL OR l.level = r.level)
   AND (epoch_us(l.ts) // 1000) >= epoch_ms(TIMESTAMP '{AS_OF}') - ({_WINDOWS} - w."window") * r.window_minutes * 60000 AND (epoch_us(l.ts) // 1000) < epoch_ms(TIMESTAMP '{AS_OF}') - ({_WINDOWS} - 1 - w."window") * r.window_minutes * 60000) AS count
   FROM rules r, (SELECT CAST(unnest(range({_WINDOWS})) AS INT) AS "window") w),
 based AS (SELECT *, CASE WHEN metric = 'RATE' THEN count / (window_minutes * 60.0) ELSE CAST(count AS DOUBLE) END AS metric_value,
   avg(count) OVER b AS m, stddev_pop(count) OVER b AS s, count(*) OVER b AS n FROM counts WINDOW b AS (PARTITION BY rule_id ORDER BY "window" ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
 evaluated AS (SELECT *, CASE WHEN rule_type = 'ANOMALY' THEN n >= 4 AND count > m + deviations * s WHEN comparison = 'GTE' THEN metric_value >= threshold WHEN comparison = 'LT' THEN metric_value < threshold ELSE metric_value > threshold END AS triggered FROM based)"""
_add("alert_windows", lambda df: _evaluated(df).select("rule_id", "window", "count", F.round("metric_value", 9).alias("metric_value"), "triggered"), _EVALUATED + ' SELECT rule_id, "window", count, round(metric_value, 9) AS metric_value, triggered FROM evaluated')
_add(
    "alert_spans", lambda df: alerts.spans(_evaluated(df)).withColumn("metric_value", F.round("metric_value", 9)),
    _EVALUATED + """, e AS (SELECT *, triggered AND NOT coalesce(lag(triggered) OVER w, false) AS opens, NOT triggered AND coalesce(lag(triggered) OVER w, false) AS closes FROM evaluated WINDOW w AS (PARTITION BY rule_id ORDER BY "window"))
 SELECT o.rule_id, o."window" AS triggered_at, (SELECT min(c."window") FROM e c WHERE c.rule_id = o.rule_id AND c.closes AND c."window" > o."window") AS resolved_at, round(o.metric_value, 9) AS metric_value, o.threshold AS threshold_at_trigger, NOT o.muted AS notified FROM e o WHERE o.opens""",
)



def _kept(df: DataFrame) -> DataFrame:
    """Windows from counts by the minute that came in three batches, one of them twice."""
    rules = df.sparkSession.createDataFrame(_RULES, _RULE_COLUMNS)
    kept = RollUp(df.sparkSession, store.scratch_dir(df.sparkSession))
    for batch in (0, 1, 1, 2):
        kept.add(df.where(F.col("doc_seq") % 3 == batch), batch)
    kept.compact("2024-01-10")
    return alerts.evaluate(kept.window_counts(rules, AS_OF, _WINDOWS))


_add("alert_windows_kept", lambda df: _kept(df).select("rule_id", "window", "count", F.round("metric_value", 9).alias("metric_value"), "triggered"), ORACLE_SQL["alert_windows"])

# Parsing and extraction of log text that is made from events


def _made(line):
    """Lines made from events, one file per source, in the order of events.

    The table may come in one split, however many rows it has. Rows are dealt
    out before lines are made of them, so that no task reads them all.
    """

    def on(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, since AQE would join parts that are small before their lines are made
        return _logs(spark, sf_dir).repartition(parts, "doc_seq").select("source", F.lit("made.log").alias("file"), F.col("doc_seq").alias("pos"), line().alias("line"))

    return on


_STAMP = lambda: F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000"))
_APP = lambda: F.concat(_STAMP(), F.lit(" ["), F.col("level"), F.lit("] Worker -  item "), F.col("doc_seq").cast("string"))
_ISO = lambda: F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z Level is "), F.lower("level"), F.lit(" for item"))
_ACCESS = lambda: F.concat(F.lit("10.0.0."), (F.col("doc_seq") % 250).cast("string"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /x HTTP/1.1" '), F.when(F.col("level") == "ERROR", "503").when(F.col("level") == "WARN", "404").otherwise("200"), F.lit(" "), F.col("doc_seq").cast("string"), F.lit(' "-" "agent 1"'))
_SYSLOG = lambda: F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host"), (F.col("doc_seq") % 9).cast("string"), F.lit(" cron["), F.col("doc_seq").cast("string"), F.lit("]: "), F.when(F.col("level") == "ERROR", "kernel panic").when(F.col("level") == "WARN", "job failed").otherwise("job done"))
_LOGFMT = lambda: F.concat(F.lit("at="), F.lower("level"), F.lit(' msg="item done" id='), F.col("doc_seq").cast("string"))
_SECOND = "epoch_ms(date_trunc('second', ts))"


def _parsed(df: DataFrame) -> DataFrame:
    return lines.parse(df, AS_OF).select("source", "pos", F.unix_millis("ts").alias("ts_ms"), "level", "message")


_add("parse_application_lines", _parsed, f"SELECT source, doc_seq AS pos, {_SECOND} AS ts_ms, level, 'Worker - item ' || doc_seq AS message FROM logs", on=_made(_APP))
_add("parse_iso_lines", _parsed, f"SELECT source, doc_seq AS pos, {_SECOND} AS ts_ms, level, 'Level is ' || lower(level) || ' for item' AS message FROM logs", on=_made(_ISO))
_HTTP_LEVEL = "CASE level WHEN 'ERROR' THEN 'ERROR' WHEN 'WARN' THEN 'WARN' ELSE 'INFO' END"
_add("parse_access_lines", _parsed, f"""SELECT source, doc_seq AS pos, {_SECOND} AS ts_ms, {_HTTP_LEVEL} AS level, '10.0.0.' || (doc_seq % 250) || ' - - "GET /x HTTP/1.1" ' || CASE level WHEN 'ERROR' THEN '503' WHEN 'WARN' THEN '404' ELSE '200' END || ' ' || doc_seq || ' "-" "agent 1"' AS message FROM logs""", on=_made(_ACCESS))
_add("parse_syslog_lines", _parsed, f"SELECT source, doc_seq AS pos, {_SECOND} AS ts_ms, {_HTTP_LEVEL} AS level, 'host' || (doc_seq % 9) || ' cron[' || doc_seq || ']: ' || CASE level WHEN 'ERROR' THEN 'kernel panic' WHEN 'WARN' THEN 'job failed' ELSE 'job done' END AS message FROM logs", on=_made(_SYSLOG))


def _folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(_APP)(spark, sf_dir)
    more = made.withColumn("line", F.explode(F.array(F.lit("\tat a.b.C"), F.lit(""), F.lit("  caused by x"))))
    heads = made.withColumn("pos", F.col("pos") * 10)
    frames = more.withColumn("pos", F.col("pos") * 10 + F.when(F.col("line") == "", 2).when(F.col("line").startswith("\t"), 1).otherwise(3))
    return heads.unionByName(frames)


_add("fold_continuations", lambda df: lines.parse(df, AS_OF).select("source", "pos", "message"), r"SELECT source, doc_seq * 10 AS pos, 'Worker - item ' || doc_seq || chr(10) || chr(9) || 'at a.b.C' || chr(10) || '  caused by x' AS message FROM logs", on=_folding)


def _extracted(*names: str):
    def run(df: DataFrame) -> DataFrame:
        found = extract(df.select("pos", F.col("line").alias("message")))
        return found.select("pos", "format", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])

    return run


_add("extract_access_log", _extracted("host", "request", "status", "bytes", "userAgent"), """SELECT doc_seq AS pos, 'accesslog' AS format, '10.0.0.' || (doc_seq % 250) AS host, 'GET /x HTTP/1.1' AS request, CASE level WHEN 'ERROR' THEN '503' WHEN 'WARN' THEN '404' ELSE '200' END AS status, CAST(doc_seq AS VARCHAR) AS bytes, 'agent 1' AS "userAgent" FROM logs""", on=_made(_ACCESS))
_add("extract_logfmt", _extracted("at", "msg", "id"), "SELECT doc_seq AS pos, 'logfmt' AS format, lower(level) AS at, 'item done' AS msg, CAST(doc_seq AS VARCHAR) AS id FROM logs", on=_made(_LOGFMT))
_add("extract_json", _extracted("k"), "SELECT doc_seq AS pos, 'json' AS format, k FROM logs", on=_made(lambda: F.col("message")))
_TAGGED = lambda: F.concat(F.lit("host"), (F.col("doc_seq") % 9).cast("string"), F.lit(" cron["), F.col("doc_seq").cast("string"), F.lit("]: job "), F.lower("level"))
_add("extract_syslog_tag", _extracted("hostname", "tag", "pid", "message"), "SELECT doc_seq AS pos, 'syslog' AS format, 'host' || (doc_seq % 9) AS hostname, 'cron' AS tag, CAST(doc_seq AS VARCHAR) AS pid, 'job ' || lower(level) AS message FROM logs", on=_made(_TAGGED))
_add("entry_ids", lambda df: entry_ids(df.select("source", "file", F.col("doc_seq").alias("pos"), F.date_trunc("day", "ts").alias("ts"), F.col("level").alias("message"))).select("pos", "doc_id"), "SELECT doc_seq AS pos, h || '::' || (row_number() OVER (PARTITION BY h ORDER BY doc_seq) - 1) AS doc_id FROM (SELECT doc_seq, sha256(source || '|' || file || '|' || epoch_ms(date_trunc('day', ts)) || '|' || level) AS h FROM logs)")

# The store

_add("retention", lambda df: df.where(store.retained(AS_OF, 7)).select("doc_seq"), f"SELECT doc_seq FROM logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")


def _reconciled(df: DataFrame) -> DataFrame:
    batch = df.where("source = 'svc-1' AND file IN ('click.log', 'view.log') AND doc_seq % 2 = 0").withColumn("message", F.lit("new"))
    return store.reconciled(df.select("doc_seq", "source", "file", "message"), batch.select("doc_seq", "source", "file", "message"))


_add("reconcile_files", _reconciled, "SELECT doc_seq, source, file, CASE WHEN source = 'svc-1' AND file IN ('click.log', 'view.log') THEN 'new' ELSE message END AS message FROM logs WHERE NOT (source = 'svc-1' AND file IN ('click.log', 'view.log')) OR doc_seq % 2 = 0")


def _fingerprints(df: DataFrame, moved: int) -> DataFrame:
    return df.groupBy("source", "file").agg(F.count("*").alias("size"), F.max("ts").alias("modified")).withColumn("size", F.col("size") + F.when((F.col("source") == "svc-2") & (F.col("file") == "view.log"), moved).otherwise(0))


def _changed(df: DataFrame) -> DataFrame:
    now, before = _fingerprints(df, 1), _fingerprints(df, 0).where("file <> 'signup.log'")
    label = F.concat_ws("/", "source", "file")
    return tails.changed(now.select(label.alias("file"), "size", "modified"), before.select(label.alias("file"), "size", "modified")).select("file")


_add("changed_files", _changed, "SELECT DISTINCT source || '/' || file AS file FROM logs WHERE file = 'signup.log' OR (source = 'svc-2' AND file = 'view.log')")
_add("index_gate", lambda df: tails.ungated(_fingerprints(df, 1), _fingerprints(df, 0)).select("source", "file"), "SELECT DISTINCT source, file FROM logs WHERE source = 'svc-2' AND file = 'view.log'")



def _stored(df: DataFrame) -> store.EntryStore:
    """Entries whose messages hold a word of their own, in a store with a token index; a second batch replaces one file."""
    kept = store.EntryStore(df.sparkSession, store.scratch_dir(df.sparkSession))
    entries = df.select("doc_seq", "ts", "level", "source", "file", F.concat(F.lit("Job no "), F.col("doc_seq").cast("string"), F.lit(" ended as "), F.col("level")).alias("message"))
    kept.replace(entries)
    kept.replace(entries.where("source = 'svc-1' AND file = 'view.log'").withColumn("message", F.concat("message", F.lit(" again"))))
    return kept


_SOME = [77, 501, 888, 999]
_add("search_indexed_words", lambda df: _stored(df).search(" ".join(map(str, _SOME))).select("doc_seq", "message"), f"SELECT doc_seq, 'Job no ' || doc_seq || ' ended as ' || level || CASE WHEN source = 'svc-1' AND file = 'view.log' THEN ' again' ELSE '' END AS message FROM logs WHERE doc_seq IN ({', '.join(map(str, _SOME))})")
_add("search_indexed_phrase", lambda df: _stored(df).search("debug AGAIN", phrase=True).select("doc_seq"), "SELECT doc_seq FROM logs WHERE level = 'DEBUG' AND source = 'svc-1' AND file = 'view.log'")


def _gated_rounds(df: DataFrame) -> DataFrame:
    """What a second round of ingest reads: files that are new or changed since the first."""
    kept = store.EntryStore(df.sparkSession, store.scratch_dir(df.sparkSession))
    kept.record(_fingerprints(df, 0).where("file <> 'signup.log'"))
    kept.record(_fingerprints(df, 1).where("source = 'svc-2' AND file = 'click.log'"))
    kept.forget("svc-3")
    return kept.ungated(_fingerprints(df, 1)).select("source", "file", "size")


_add("ingest_gate_rounds", _gated_rounds, "SELECT source, file, count(*) + CASE WHEN source = 'svc-2' AND file = 'view.log' THEN 1 ELSE 0 END AS size FROM logs GROUP BY 1, 2 HAVING file = 'signup.log' OR source = 'svc-3' OR (source = 'svc-2' AND file = 'view.log')")

# Names, links and labels


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["traceId", "trace_id", "X-Request-Id", "request-id", "SPAN_ID", "user", "correlationId"]))
    return _logs(spark, sf_dir).select("doc_seq", "ts", F.element_at(names, (F.col("doc_seq") % 7 + 1).cast("int")).alias("name"))


_NAMED = "SELECT doc_seq, ts, ['traceId', 'trace_id', 'X-Request-Id', 'request-id', 'SPAN_ID', 'user', 'correlationId'][doc_seq % 7 + 1] AS name FROM logs"
_add("correlation_keys", lambda df: df.select("doc_seq", f.correlation_key(F.col("name")).alias("is_key")), f"SELECT doc_seq, regexp_replace(lower(name), '[-_]', '', 'g') IN ('traceid', 'requestid', 'correlationid', 'spanid', 'reqid') AS is_key FROM ({_NAMED})", on=_named)
_add("apm_links", lambda df: df.select("doc_seq", f.apm_link("https://apm.test/t/{traceId}?q=1", F.concat("name", F.lit(" a/b+"), F.col("doc_seq").cast("string"))).alias("link")), f"SELECT doc_seq, 'https://apm.test/t/' || url_encode(name || ' a/b+' || doc_seq) || '?q=1' AS link FROM ({_NAMED})", on=_named)
_AGO = f"epoch(TIMESTAMP '{_NOON}')::BIGINT - epoch_us(ts) // 1000000"
_add("time_labels", lambda df: df.select("doc_seq", f.time_ago(F.col("ts"), _NOON).alias("ago")), f"SELECT doc_seq, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago FROM (SELECT doc_seq, {_AGO} AS s FROM logs)")
_PATHS = lambda: F.concat(F.when(F.col("doc_seq") % 2 == 0, "/var/log/").otherwise("C:\\logs\\"), F.col("file"), F.when(F.col("doc_seq") % 3 == 0, "/").otherwise(""))
_add("file_labels", lambda df: df.select("doc_seq", tails.base_name(_PATHS()).alias("label")), "SELECT doc_seq, file AS label FROM logs")
_add("source_names", rows.sources, f"WITH {_REGISTRY} SELECT name AS source FROM registry WHERE enabled", on=_sources)


def _bars(df: DataFrame) -> DataFrame:
    buckets = agg.count_over_time(df, AS_OF, MONTH, DAY, with_rate=True).withColumn("stat_value", F.when(F.col("i") % 2 == 0, F.col("count") * 2.0))
    return buckets.select("i", agg.bar_value(buckets).alias("bar"))


_add("bar_values", _bars, f"SELECT i, CASE WHEN i % 2 = 0 THEN count * 2.0 ELSE rate END AS bar FROM ({_over_time(30, DAY, 'coalesce(c, 0) / 86400.0')})")

# More filters

_filter("filter_everything", f.everything, "true")
_filter("filter_field_any_word", lambda: f.any_word("1 4 nothing", "source"), "source IN ('svc-1', 'svc-4')")
_filter("filter_field_any_word_joined", lambda: f.any_word("view.log other", "file"), "file = 'view.log'")
_filter("filter_preset", lambda: f.simple(levels=f.PRESETS["errors_and_warnings"], as_of=AS_OF, range_minutes=f.TIME_RANGES["7d"]), f"level IN ('ERROR', 'WARN') AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")

# Events of rules


def _rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events, as if each had been raised by one of nine rules."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select((F.col("user_id") % 9).alias("rule_id"), "event_id")


_add("events_of_rule", lambda df: rows.latest_per_key(df, "rule_id", "event_id", 5), "SELECT rule_id, event_id FROM (SELECT user_id % 9 AS rule_id, event_id, row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r <= 5", on=_rule_events)
_add("newest_event_of_rule", lambda df: rows.latest_per_key(df, "rule_id", "event_id"), "SELECT user_id % 9 AS rule_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1", on=_rule_events)

# More formats

_SYSLOG_5424 = lambda: F.concat(F.lit("<34>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" host"), (F.col("doc_seq") % 9).cast("string"), F.lit(" app "), F.col("doc_seq").cast("string"), F.lit(" ID47 "), F.lower("level"), F.lit(" it is"))
_add("extract_syslog_5424", _extracted("priority", "version", "timestamp", "hostname", "appName", "procId", "msgId", "message"), "SELECT doc_seq AS pos, 'syslog' AS format, '34' AS priority, '1' AS version, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'host' || (doc_seq % 9) AS hostname, 'app' AS \"appName\", CAST(doc_seq AS VARCHAR) AS \"procId\", 'ID47' AS \"msgId\", lower(level) || ' it is' AS message FROM logs", on=_made(_SYSLOG_5424))
_SYSLOG_3164 = lambda: F.concat(F.lit("<13>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), (F.col("doc_seq") % 9).cast("string"), F.lit(" cron"), F.when(F.col("doc_seq") % 2 == 0, F.concat(F.lit("["), F.col("doc_seq").cast("string"), F.lit("]"))).otherwise(""), F.lit(": job "), F.lower("level"))
_add("extract_syslog_3164", _extracted("priority", "timestamp", "hostname", "tag", "pid", "message"), "SELECT doc_seq AS pos, 'syslog' AS format, '13' AS priority, strftime(ts, '%b %d %H:%M:%S') AS timestamp, 'host' || (doc_seq % 9) AS hostname, 'cron' AS tag, CASE WHEN doc_seq % 2 = 0 THEN CAST(doc_seq AS VARCHAR) END AS pid, 'job ' || lower(level) AS message FROM logs", on=_made(_SYSLOG_3164))
_NESTED = lambda: F.concat(F.lit('{"a": {"b": '), F.col("doc_seq").cast("string"), F.lit(', "s": "x\\"y"}, "c": [1.5, {"d": true}], "e": null}'))
_add("extract_nested_json", _extracted("a.b", "a.s", "c[0]", "c[1].d", "e"), """SELECT doc_seq AS pos, 'json' AS format, CAST(doc_seq AS VARCHAR) AS "a.b", 'x"y' AS "a.s", '1.5' AS "c[0]", 'true' AS "c[1].d", '' AS e FROM logs""", on=_made(_NESTED))
_WIDE = lambda: F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(10), F.lit(49)), lambda i: F.concat(F.lit('"f'), i.cast("string"), F.lit('": '), (F.col("doc_seq") + i).cast("string"))), ", "), F.lit("}"))
_add("extract_field_cap", lambda df: extract(df.select("pos", F.col("line").alias("message"))).select("pos", F.size("fields").alias("n"), F.try_element_at("fields", F.lit("f41")).alias("f41"), F.try_element_at("fields", F.lit("f42")).alias("f42")), "SELECT doc_seq AS pos, CAST(32 AS INT) AS n, CAST(doc_seq + 41 AS VARCHAR) AS f41, CAST(NULL AS VARCHAR) AS f42 FROM logs", on=_made(_WIDE))
_PROSE = lambda: F.concat(F.lit("nothing of form in entry "), F.col("doc_seq").cast("string"))
_add("extract_unstructured", lambda df: extract(df.select("pos", F.col("line").alias("message"))).select("pos", "format", F.size("fields").alias("n")), "SELECT doc_seq AS pos, 'unstructured' AS format, CAST(0 AS INT) AS n FROM logs", on=_made(_PROSE))

# Sources: framing, union, failures


def _tail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last texts of files, each beginning within a line."""
    made = _made(_APP)(spark, sf_dir)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda p: p["line"]), "\r\n")
    return made.groupBy("source", "file").agg(F.concat(F.lit("cut off\n"), joined, F.lit("\n")).alias("text"))


_add("frame_tail_lines", lambda df: lines.frame_lines(df, F.lit(False), 500).select("source", "pos", "line"), "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_seq) - 1 AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',000 [' || level || '] Worker -  item ' || doc_seq AS line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_seq DESC) AS back FROM logs) WHERE back <= 500", on=_tail_texts)


def _of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine reads of four sources: two written from events in different formats, a disabled one, and one that is gone."""
    engine, top = Engine(spark), store.scratch_dir(spark).removeprefix("file:").replace("///", "/")
    for name, line in {"svc-0": _APP, "svc-1": _ISO, "svc-2": _APP}.items():
        made = _made(line)(spark, sf_dir).where(F.col("source") == name).coalesce(1).sortWithinPartitions("pos")
        made.select("line").write.text(f"file:{top}/{name}", lineSep="\n")
        engine.sources.create(Source(name, "LOCAL_DIRECTORY", f"{top}/{name}", enabled=name != "svc-2"))
    engine.sources.create(Source("svc-9", "LOCAL_DIRECTORY", f"{top}/gone"))
    return engine.logs(AS_OF)


def _of_whole_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _of_sources, but every line of the sources that are there, not their tails."""
    engine = Engine(spark)
    for name, line in {"svc-0": _APP, "svc-1": _ISO, "svc-2": _APP}.items():
        source = engine.sources.create(Source(name, "LOCAL_DIRECTORY", f"/var/log/{name}", enabled=name != "svc-2"))
        engine.attach(source.id, _made(line)(spark, sf_dir).where(F.col("source") == name))
    engine.sources.create(Source("svc-9", "LOCAL_DIRECTORY", f"{store.scratch_dir(spark).removeprefix('file:').replace('///', '/')}/gone"))
    return engine.logs(AS_OF)


_TAIL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_seq DESC) AS back FROM logs) WHERE back <= {tails.MAX_LINES} AND source IN ('svc-0', 'svc-1')"
_add("union_of_sources", lambda df: df.where("source <> 'svc-9'").select("source", "pos", "level", "message"), "SELECT source, doc_seq AS pos, level, CASE source WHEN 'svc-0' THEN 'Worker - item ' || doc_seq ELSE 'Level is ' || lower(level) || ' for item' END AS message FROM logs WHERE source IN ('svc-0', 'svc-1')", on=_of_whole_sources)
_add("failed_source", lambda df: df.groupBy("source").agg(F.count_if(F.col("message").startswith("Failed to read log source: can't read") & (F.col("level") == "ERROR") & F.col("file").isNull() & (F.col("ts") == F.lit(AS_OF).cast("timestamp"))).alias("failures"), F.count_if(F.col("file").startswith("part-")).alias("entries")), f"SELECT source, 0 AS failures, count(*) AS entries FROM ({_TAIL}) GROUP BY 1 UNION ALL SELECT 'svc-9', 1, 0", on=_of_sources)
_add("newest_files", lambda df: tails.newest(_fingerprints(df, 0).withColumn("path", F.concat_ws("/", "source", "file")), 7).select("path"), "SELECT path FROM (SELECT source || '/' || file AS path, max(ts) AS m FROM logs GROUP BY source, file) ORDER BY m DESC, path LIMIT 7")
_add("windowed_counts", lambda df: windowed_counts(df, "6 hours").select(F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "source", "level", "count"), f"SELECT epoch_us(ts) // {6 * HOUR * 1000} * {6 * HOUR} AS start_ms, (epoch_us(ts) // {6 * HOUR * 1000} + 1) * {6 * HOUR} AS end_ms, source, level, count(*) AS count FROM logs GROUP BY ALL")

# The engine


def _engine(df: DataFrame) -> Engine:
    engine = Engine(df.sparkSession)
    for k in range(5):
        engine.sources.create(Source(f"svc-{k}", "LOCAL_DIRECTORY", "/var/log", enabled=k != 4))
    return engine


def _saved(df: DataFrame) -> DataFrame:
    engine = _engine(df)
    saved = engine.saved.create(Search("slow", where="num_value > 20 AND fields['k'] LIKE '1%'", file="click.log", range_minutes=MONTH, sort_by="source"))
    return _page(engine.run_saved(saved.id, df, AS_OF, page=1, size=12))


_add("saved_search", _saved, f"SELECT {_COLUMNS} FROM logs WHERE num_value > 20 AND k LIKE '1%' AND file = 'click.log' AND source <> 'svc-4' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY source DESC, doc_seq LIMIT 12 OFFSET 12")
_add("search_page", lambda df: _page(_engine(df).search(df, "purchase.log", ["WARN"], source="svc-2", size=15)), f"SELECT {_COLUMNS} FROM logs WHERE file = 'purchase.log' AND level = 'WARN' AND source = 'svc-2' ORDER BY ts DESC, doc_seq LIMIT 15")


def _ruled(df: DataFrame) -> DataFrame:
    engine = _engine(df)
    engine.rules.create(Rule("many", window_minutes=10080, threshold=5.0, where="num_value > 50", level="ERROR"))
    engine.rules.create(Rule("broken", window_minutes=60, threshold=1.0, where="no_such_column > 1"))
    engine.rules.create(Rule("few", window_minutes=1440, threshold=1e9, comparison="LT", search="view.log"))
    engine.rules.create(Rule("plain", window_minutes=1440, threshold=10.0, source="svc-1"))
    return engine.evaluate_rules(df, AS_OF).select("rule_id", "count", "triggered")


_add("engine_rules", _ruled, f"""SELECT rule_id, count, CASE rule_id WHEN 1 THEN count > 5 WHEN 3 THEN count < 1e9 ELSE count > 10 END AS triggered FROM (
 SELECT 1 AS rule_id, count(*) FILTER (num_value > 50 AND level = 'ERROR' AND {{w}}) AS count FROM logs UNION ALL SELECT 3, count(*) FILTER (file = 'view.log' AND {{d}}) FROM logs UNION ALL SELECT 4, count(*) FILTER (source = 'svc-1' AND {{d}}) FROM logs)""".replace("{w}", f"source <> 'svc-4' AND ts < TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY").replace("{d}", f"source <> 'svc-4' AND ts < TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY"))
