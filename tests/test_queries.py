"""All registered log queries against DuckDB, and the plans of the ones that matter at scale."""

import contextlib
import io

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

import __spark_entry__
from timberline.functions import filters as f
from timberline.functions.extract import FLAT_JSON, entry_ids, extract, flat_fields, json_fields
from timberline.operators import aggregations as agg
from timberline.operators import alerts, rows
from timberline.queries import _RULE_COLUMNS, AS_OF, ORACLE_SQL, QUERIES, _logs
from timberline.sources.store import EntryStore


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, name):
    same(spark, data, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_store_reads_only_what_a_search_needs(spark, data, tmp_path):
    store = EntryStore(spark, str(tmp_path / "store"))
    store.replace(_logs(spark, data))
    found = plan(store.read("svc-1", "click.log").where(f.equals("level", "ERROR") & (F.col("ts") > F.lit(AS_OF).cast("timestamp"))).select("ts"))
    scan = next(line for line in found.splitlines() if "PartitionFilters" in line)
    assert "svc-1" in scan and "click.log" in scan
    assert "EqualTo(level,ERROR)" in found and "GreaterThan(ts," in found and "ReadSchema: struct<ts:timestamp,level:string>" in found


def test_groups_are_partly_counted_before_the_shuffle(spark, data):
    found = plan(agg.count_by(_logs(spark, data), "level"))
    assert "partial_count(1)" in found and "TakeOrderedAndProject" in found and "Python" not in found


def test_pages_do_not_sort_everything(spark, data):
    found = plan(rows.page(_logs(spark, data), number=3))
    assert "TakeOrderedAndProject" in found and "Exchange rangepartitioning" not in found


@pytest.fixture
def stored(spark, data, tmp_path):
    store = EntryStore(spark, str(tmp_path / "store"))
    store.replace(_logs(spark, data))
    return store.read()


def test_time_windows_reach_the_scan(spark, stored):
    rules = spark.createDataFrame([(1, None, None, "THRESHOLD", 60, "COUNT", "GT", 1.0, 0, 0.0, False)], _RULE_COLUMNS)
    for found in (agg.count_over_time(stored, AS_OF, 60, 60_000), agg.count_over_time(stored, AS_OF, 60, 60_000, with_rate=True), alerts.window_counts(stored, rules, AS_OF, 3)):
        scan = next(x for x in plan(found).splitlines() if "PushedFilters" in x and "ts" in x)
        assert "GreaterThanOrEqual(ts," in scan and "LessThan(ts," in scan


def test_percentiles_scan_twice(spark, data):
    found = agg.numeric_by(_logs(spark, data), "p95", F.col("num_value"), "source")
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2, final


JSONS = ['{"a": 1, "b": "x y", "c": null, "d": true, "e": -2.5}', ' {"a":"1","a":2} ', '{"a": 1e5}', '{"a": 1.50}', '{"a": -0}', '{"a": {"b": 1}}', "{}", '{"a": "x\\"y"}', '{"a": 12345678901234567890}', '{"é": "ü", "n": 0.001}', '{"a": 1,}', "[1, 2]", '{"a": 0.0}', '{"a": 123456789012.25}', "{bad", '{"a": 1} x', '{"a": "{", "b": "[,]"}', None, "", "plain", '{"a": 1234567.125}', '{"a": 12345678.125}']


def test_flat_json_equals_the_parser(spark):
    """Both paths give the same fields, whichever a message takes."""
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(JSONS)], "k int, message string")
    flat = F.col("message").rlike(FLAT_JSON)
    found = frame.select("k", flat.alias("flat"), flat_fields(F.col("message")).alias("one"), json_fields(F.col("message")).alias("two")).collect()
    assert {JSONS[r.k] for r in found if r.flat} == {JSONS[k] for k in (0, 1, 9, 12, 16, 20)}
    last = lambda pairs: {p.name: p.value for p in pairs}
    assert all(last(r.one) == last(r.two) for r in found if r.flat)
    whole = {r.k: r for r in extract(frame).collect()}
    assert all(whole[r.k].fields == (last(r.two) if r.two else {}) and whole[r.k].format == ("json" if r.two else "unstructured") for r in found)
    assert list(whole[1].fields.items()) == [("a", "2")] and list(whole[0].fields) == list("abcde")


def test_odd_messages(spark):
    """Separators inside groups, repeated names, filters on the result, lone surrogates, very many members."""
    wide = "{" + ", ".join(f'"f{i}": {i}' for i in range(5000)) + "}"
    messages = ['<34>1 2024-01-01T00:00:00Z h app 7 ID47 a\x1f\x1eb', "a=1 b=2 a=3", '{"a": "\\ud800x"}', wide, '{"a.b": 1, "a": {"b": 2}}', "h cron[12]: x", "h cron: y", '1.2.3.4 - - "GET /" 200 5 "" "z"', '1.2.3.4 - - "GET /" 200 5', "[]", "{}", "=", None]
    found = {r.k: r for r in extract(spark.createDataFrame([*enumerate(messages)], "k int, message string")).where("format <> 'nothing'").collect()}
    assert found[0].format == "syslog" and found[0].fields["message"] == "a\x1f\x1eb" and found[0].fields["procId"] == "7"
    assert found[1].fields == {"a": "3", "b": "2"} and found[2].fields == {"a": "?x"}
    assert found[3].fields == {f"f{i}": str(i) for i in range(32)} and found[4].fields == {"a.b": "2"}
    assert found[5].fields == {"hostname": "h", "tag": "cron", "pid": "12", "message": "x"} and "pid" not in found[6].fields
    assert found[7].fields["referer"] == "" and found[7].fields["userAgent"] == "z" and "referer" not in found[8].fields and "timestamp" not in found[8].fields
    assert all(found[k].format == "unstructured" and found[k].fields == {} for k in (9, 10, 11, 12)) and len(found) == len(messages)


def test_fields_cost_linear_time(spark):
    """Four times the members take at most about four times as long, on both paths, and with a filter on the result."""
    import time

    def seconds(members, value):
        line = F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(members)), lambda i: F.concat(F.lit('"f'), i.cast("string"), F.lit('": '), F.lit(value))), ", "), F.lit("}"))
        found = extract(spark.range(8000).select(line.alias("message"))).where("fields['f1'] IS NOT NULL AND format = 'json'")
        start = time.perf_counter()
        assert found.count() == 8000
        return time.perf_counter() - start

    for value in ("1", '"\\n"'):
        seconds(10, value)
        few, some, many = (seconds(n, value) for n in (10, 40, 160))
        assert some < 5 * few + 2 and many < 5 * some + 2, (few, some, many)


def test_union_reads_whole_sources(spark, tmp_path):
    """Sources of more lines than a tail has are read whole, by the query and by an engine."""
    events = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz").alias("ts"), "id", F.lit("error").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": "1"}').alias("props"))
    events.withColumnRenamed("id", "user_id").write.parquet(str(tmp_path / "parts"))
    connect("").sql(f"COPY (FROM '{tmp_path}/parts/*.parquet') TO '{tmp_path}/events.parquet'")
    same(spark, str(tmp_path), QUERIES["union_of_sources"], ORACLE_SQL["union_of_sources"])
    found = QUERIES["union_of_sources"](spark, str(tmp_path)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in found} == {"svc-0": 4000, "svc-1": 4000}


def test_made_lines_are_dealt_out(spark, tmp_path):
    """A table of one split is extracted by several tasks, none of which has most of the rows."""
    events = spark.range(60_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz").alias("ts"), "id", F.lit("error").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": "1"}').alias("props"))
    events.withColumnRenamed("id", "user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["extract_field_cap"](spark, str(tmp_path))
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 4 and sum(tasks) == 60_000 and max(tasks) < 20_000


def plain_ids(rows):
    import hashlib

    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: r.pos):
        h = hashlib.sha256(f"{r.source}|{r.file or 'null'}|{int(r.ts.timestamp() * 1000)}|{r.message}".encode()).hexdigest()
        out[r.file, r.pos] = f"{h}::{seen.setdefault((h,), 0)}"
        seen[h,] += 1
    return out


def test_ids_of_a_hot_entry(spark):
    """A third of the rows are equal: they are numbered through, and no window has more than a range of them."""
    third = F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("m"), (F.col("id") % 7000).cast("string")))
    frame = spark.range(210_000).select(F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, "f").alias("file"), F.col("id").alias("pos"), F.lit(AS_OF).cast("timestamp").alias("ts"), third.alias("message"))
    found = entry_ids(frame)
    assert {(r.file, r.pos): r.doc_id for r in found.collect()} == plain_ids(frame.collect())
    assert all("_range" in line for line in plan(found).splitlines() if "row_number()" in line and "windowspecdefinition" in line)


def test_percentiles_hold_no_group(spark, data):
    found = plan(agg.numeric_by(_logs(spark, data), "p95", F.col("num_value"), "source"))
    assert "percentile" not in found and "ObjectHashAggregate" not in found


@pytest.mark.parametrize("values", [[1.0], [5.0] * 20, [0.0, 1e300, -1e300, 3.0], [-1.5, 2.5, 1e-9, 7.0, 7.0], [float(x * x) for x in range(57)]])
@pytest.mark.parametrize("p", [0.5, 0.95, 0.99])
def test_nearest_rank(spark, values, p):
    import math

    found = agg.nearest_rank(spark.createDataFrame([("a", v) for v in values], "key string, _value double"), p).collect()
    assert [(r["count"], r.stat_value) for r in found] == [(len(values), sorted(values)[max(1, math.ceil(p * len(values))) - 1])]
