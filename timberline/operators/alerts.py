"""Alert rules over windows of counts, evaluated for many rules and times at once.

A rule is a row (rule_id, source, level, rule_type, window_minutes, metric,
comparison, threshold, baseline_windows, deviations, muted); null source or
level is no restriction. Evaluation replays ticks: each tick looks at the
window that ends there and, for anomalies, at the windows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARISONS = ("GT", "GTE", "LT", "LTE", "EQ")


def compare(metric: Column, comparison: Column, threshold: Column) -> Column:
    return (
        F.when(comparison == "GTE", metric >= threshold).when(comparison == "LT", metric < threshold)
        .when(comparison == "LTE", metric <= threshold).when(comparison == "EQ", metric == threshold).otherwise(metric > threshold)
    )


def _scopes(where: dict[int, Column]) -> Column:
    """The scopes a row counts in: 0 for all rows, and the id of each rule whose predicate it meets."""
    return F.array_compact(F.array(F.lit(0).cast("long"), *[F.when(p, F.lit(k).cast("long")) for k, p in where.items()]))


def _by_rule(near, rules: DataFrame, as_of: str, windows: int, own_scopes) -> DataFrame:
    """Counts of (ts, source, level, scope, n) rows in each rule's windows; ``near`` makes the rows from the first instant that is looked at."""
    end = F.unix_millis(F.lit(as_of).cast("timestamp"))
    widths = sorted(r[0] for r in rules.select("window_minutes").distinct().collect())  # control data: a few numbers
    ago = F.floor((end - 1 - F.unix_millis("ts")) / (F.col("window_minutes") * 60_000))
    rows = near(F.timestamp_millis(end - max(widths, default=0) * 60_000 * windows), F.lit(as_of).cast("timestamp"))
    wide = rows.withColumn("window_minutes", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")))
    counted = wide.where(F.unix_millis("ts") >= end - F.col("window_minutes").cast("long") * 60_000 * windows).groupBy("window_minutes", ago.cast("int").alias("ago"), "source", "level", "scope").agg(F.sum("n").alias("n"))
    own = F.when(F.col("rule_id").isin(*own_scopes), F.col("rule_id")).otherwise(0) if own_scopes else F.lit(0)
    r, c = rules.withColumn("scope", own.cast("long")).alias("r"), counted.alias("c")
    fits = (F.col("r.window_minutes") == F.col("c.window_minutes")) & (F.col("r.scope") == F.col("c.scope")) & (F.col("r.source").isNull() | (F.col("r.source") == F.col("c.source"))) & (F.col("r.level").isNull() | (F.col("r.level") == F.col("c.level")))
    hits = r.join(c, fits).groupBy("r.rule_id", "c.ago").agg(F.sum("c.n").alias("count"))
    spine = rules.withColumn("ago", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    return spine.join(hits, ["rule_id", "ago"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).withColumn("window", F.lit(windows - 1) - F.col("ago")).drop("ago")


def window_counts(logs: DataFrame, rules: DataFrame, as_of: str, windows: int, where: dict[int, Column] | None = None) -> DataFrame:
    """(rule columns, window, count): entries in each of the last ``windows`` windows of every rule, empty ones included.

    ``where`` has a predicate for the rules that need more than a source and a
    level. Entries are first counted per source, level, predicate and window of
    each distinct width, so the join with the rules meets counts and not
    entries; only entries of the longest rule's windows are scanned.
    """
    where = where or {}
    inside = lambda low, high: logs.where((F.col("ts") < high) & (F.col("ts") >= low)).select("ts", "source", "level", F.explode(_scopes(where)).alias("scope"), F.lit(1).cast("long").alias("n"))
    return _by_rule(inside, rules, as_of, windows, where.keys())


def minute_counts(logs: DataFrame, where: dict[int, Column] | None = None) -> DataFrame:
    """(ts, source, level, scope, n): entries a minute, which ``kept_window_counts`` adds up; counts of parts of the entries may be put together."""
    rows = logs.where("ts IS NOT NULL").select(F.date_trunc("minute", "ts").alias("ts"), "source", "level", F.explode(_scopes(where or {})).alias("scope"))
    return rows.groupBy("ts", "source", "level", "scope").agg(F.count("*").alias("n"))


def kept_window_counts(minutes: DataFrame, rules: DataFrame, as_of: str, windows: int, scopes=()) -> DataFrame:
    """As window_counts, from counts a minute; ``as_of`` must be a whole minute. ``scopes`` are the rules whose predicates were counted."""
    if not str(as_of).endswith(":00"):
        raise ValueError("kept counts are looked at on whole minutes")
    return _by_rule(lambda low, high: minutes.where((F.col("ts") < high) & (F.col("ts") >= low)), rules, as_of, windows, set(scopes))


def evaluate(counts: DataFrame, rate_compat: bool = False) -> DataFrame:
    """Adds metric and triggered to (rule columns, window, count) rows.

    A threshold rule compares the metric; an anomaly rule asks whether the
    count exceeds the mean of the baseline windows before it by ``deviations``
    population standard deviations; without a full baseline it is calm.
    ``rate_compat`` takes the count for a rate.
    """
    metric = F.col("count").cast("double") if rate_compat else F.when(F.col("metric") == "RATE", F.col("count") / (F.col("window_minutes") * 60)).otherwise(F.col("count").cast("double"))
    order = Window.partitionBy("rule_id").orderBy("window")
    past = F.collect_list("count").over(order.rowsBetween(Window.unboundedPreceding, -1))
    base = F.slice("_past", F.greatest(F.size("_past") - F.col("baseline_windows") + 1, F.lit(1)), F.greatest("baseline_windows", F.lit(0)))
    n = F.size("_base").cast("double")
    mean = F.aggregate("_base", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate("_base", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n)
    with_base = counts.withColumn("metric_value", metric).withColumn("_past", past).withColumn("_base", base)
    with_base = with_base.withColumn("_mean", F.when(n > 0, mean)).withColumn("_spread", F.when(n > 0, spread))
    anomaly = (n > 0) & (n >= F.col("baseline_windows")) & (F.col("count") > F.col("_mean") + F.col("deviations") * F.col("_spread"))
    triggered = F.when(F.col("rule_type") == "ANOMALY", F.coalesce(anomaly, F.lit(False))).otherwise(compare(F.col("metric_value"), F.col("comparison"), F.col("threshold")))
    return with_base.withColumn("triggered", triggered).drop("_past", "_base", "_mean", "_spread")


def spans(evaluated: DataFrame) -> DataFrame:
    """Alert events of replayed ticks: (rule_id, triggered_at, resolved_at, metric_value, threshold_at_trigger, notified).

    A rising edge opens an event with the metric of that tick, the next falling
    edge resolves it; a muted rule's event isn't notified.
    """
    order = Window.partitionBy("rule_id").orderBy("window")
    before = F.coalesce(F.lag("triggered").over(order), F.lit(False))
    edges = evaluated.withColumn("_edge", F.when(F.col("triggered") & ~before, "open").when(~F.col("triggered") & before, "close")).where(F.col("_edge").isNotNull())
    closed = edges.withColumn("resolved_at", F.lead("window").over(order)).where(F.col("_edge") == "open")
    return closed.select("rule_id", F.col("window").alias("triggered_at"), "resolved_at", "metric_value", F.col("threshold").alias("threshold_at_trigger"), (~F.col("muted")).alias("notified"))
