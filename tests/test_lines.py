"""Lines to entries and messages to fields."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.functions import lines
from timberline.functions.extract import entry_ids, extract, flatten

AS_OF = "2026-08-10 00:00:00"


def parsed(spark, *texts):
    rows = spark.createDataFrame([("s", "f", i, t) for i, t in enumerate(texts)], "source string, file string, pos long, line string")
    return lines.parse(rows, AS_OF).orderBy("pos").collect()


CASES = [
    ("2026-08-06 08:00:41,250 [ERROR] AuthService - boom", dt.datetime(2026, 8, 6, 8, 0, 41, 250000), "ERROR", "AuthService - boom"),
    ('203.0.113.1 - - [06/Aug/2026:08:00:00 +0200] "GET /x HTTP/1.1" 500 123 "-" "curl"', dt.datetime(2026, 8, 6, 6), "ERROR", '203.0.113.1 - - "GET /x HTTP/1.1" 500 123 "-" "curl"'),
    ('1.1.1.1 - - [06/Aug/2026:08:00:00 +0000] "GET /x HTTP/1.1" 404 1 "-"', dt.datetime(2026, 8, 6, 8), "WARN", '1.1.1.1 - - "GET /x HTTP/1.1" 404 1 "-"'),
    ("Aug  6 08:02:08 cache01 sshd[1]: Failed password for invalid user", dt.datetime(2026, 8, 6, 8, 2, 8), "WARN", "cache01 sshd[1]: Failed password for invalid user"),
    ("Dec 24 08:02:08 db01 nginx[2]: worker process 2 exited on signal 11", dt.datetime(2025, 12, 24, 8, 2, 8), "ERROR", "db01 nginx[2]: worker process 2 exited on signal 11"),
    ("2026-08-06T08:00:00.5+02:00 debug: started", dt.datetime(2026, 8, 6, 6, 0, 0, 500000), "DEBUG", "debug: started"),
    ("2026-08-06T08:00:00+0200 trace x", dt.datetime(2026, 8, 10), "DEBUG", "trace x"),
    ("2026-13-45 08:00:41,000 [warning]   a   b", dt.datetime(2026, 8, 10), "WARN", "a b"),
    ("just some text", dt.datetime(2026, 8, 10), "INFO", "just some text"),
]


def test_lines_are_read_by_the_first_evidence(spark):
    found = parsed(spark, *[c[0] for c in CASES])
    for row, (_, ts, level, message) in zip(found, CASES, strict=True):
        assert (row.ts.replace(tzinfo=None), row.level, row.message) == (ts, level, message)


def test_status_needs_a_space_behind_it(spark):
    assert [r.level for r in parsed(spark, '"GET /" 404 1', '"GET /" 503', '"GET /" 503 -')] == ["WARN", "INFO", "ERROR"]


def test_continuations_fold_and_empty_lines_go(spark):
    found = parsed(spark, "  first", "2026-08-06 08:00:41,000 [ERROR] a", "\tat b", "", " c", "2026-08-06 08:00:42,000 [INFO] d")
    assert [r.message for r in found] == ["first", "a\n\tat b\n c", "d"]


@pytest.mark.parametrize(("text", "begin", "most", "expected"), [("line1\nline2\nline3\n", True, 10, ["line1", "line2", "line3"]), ("artial\nline2\n", False, 10, ["line2"]), ("1\n2\n3\n4\n5", True, 2, ["4", "5"]), ("", True, 10, []), ("only", False, 10, [])])
def test_framing(spark, text, begin, most, expected):
    rows = spark.createDataFrame([("s", "f", text)], "source string, file string, text string")
    assert [r.line for r in lines.frame_lines(rows, F.lit(begin), most).orderBy("pos").collect()] == expected


MESSAGES = [
    ('{"level":"error","details":{"retry":true,"n":[1,{"x":null}]}}', "json", {"level": "error", "details.retry": "true", "details.n[0]": "1", "details.n[1].x": ""}),
    ("{}", "unstructured", {}),
    ('{"a": 1} tail', "unstructured", {}),
    ("<34>1 2026-08-06T08:00:00Z db01 systemd 1234 ID47 Started session", "syslog", {"priority": "34", "version": "1", "timestamp": "2026-08-06T08:00:00Z", "hostname": "db01", "appName": "systemd", "procId": "1234", "msgId": "ID47", "message": "Started session"}),
    ("<13>Aug  6 08:00:11 web cron: ok", "syslog", {"priority": "13", "timestamp": "Aug  6 08:00:11", "hostname": "web", "tag": "cron", "message": "ok"}),
    ("cache01 systemd[8772]: Started", "syslog", {"hostname": "cache01", "tag": "systemd", "pid": "8772", "message": "Started"}),
    ('1.2.3.4 - - "GET / HTTP/1.1" 200 77 "" "Mozilla"', "accesslog", {"host": "1.2.3.4", "ident": "-", "authuser": "-", "request": "GET / HTTP/1.1", "status": "200", "bytes": "77", "referer": "", "userAgent": "Mozilla"}),
    ('1.2.3.4 - - "GET / HTTP/1.1" 200 77', "accesslog", {"host": "1.2.3.4", "ident": "-", "authuser": "-", "request": "GET / HTTP/1.1", "status": "200", "bytes": "77"}),
    ('level=error msg="card declined" retries=3', "logfmt", {"level": "error", "msg": "card declined", "retries": "3"}),
    ("a=1 a=2", "logfmt", {"a": "2"}),
    ("some words with a=b inside of a long sentence and c=d", "unstructured", {}),
    ("plain text", "unstructured", {}),
    ("   ", "unstructured", {}),
    (None, "unstructured", {}),
]


def test_formats_and_fields(spark):
    rows = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MESSAGES)], "pos long, message string")
    for row, (_, form, fields) in zip(extract(rows).orderBy("pos").collect(), MESSAGES, strict=True):
        assert (row.format, row.fields) == (form, fields)


def test_at_most_32_fields(spark):
    wide = "{" + ",".join(f'"k{i}": {i}' for i in range(40)) + "}"
    row = extract(spark.createDataFrame([(wide,)], "message string")).first()
    assert sorted(row.fields, key=lambda k: int(k[1:])) == [f"k{i}" for i in range(32)]


def test_flatten_keeps_document_order():
    assert [k for k, _ in flatten({"b": [1, {"c": 2}], "a": 3})] == ["b[0]", "b[1].c", "a"]


def test_ids_tell_repeated_lines_apart(spark):
    rows = spark.createDataFrame([("s", "f", i, dt.datetime(2026, 1, 1), "same") for i in range(3)], "source string, file string, pos long, ts timestamp, message string")
    found = [r.doc_id for r in entry_ids(rows).orderBy("pos").collect()]
    assert [x.split("::")[1] for x in found] == ["0", "1", "2"] and len({x.split("::")[0] for x in found}) == 1


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_entries_span_ranges_of_a_file(spark, monkeypatch, width):
    """Continuation lines find their entry in whatever earlier range it opened; a file may begin with one."""
    from timberline.functions import lines

    monkeypatch.setattr(lines, "RANGE_LINES", width)
    files = {("s", "a"): [" first", "\tx", "one", " 1a", "", " 1b", " 1c", " 1d", "two", "three", "\t3a"], ("s", None): ["only", *[f" {k}" for k in range(9)]], (None, "b"): ["", " c", "d"]}
    rows = [(s, f, k, x) for (s, f), texts in files.items() for k, x in enumerate(texts)]
    found = lines.fold(spark.createDataFrame(rows, "source string, file string, pos long, line string")).collect()
    expected = {("s", "a", 0, " first", "\tx"), ("s", "a", 2, "one", " 1a\n 1b\n 1c\n 1d"), ("s", "a", 8, "two", ""), ("s", "a", 9, "three", "\t3a"), ("s", None, 0, "only", "\n".join(f" {k}" for k in range(9))), (None, "b", 1, " c", ""), (None, "b", 2, "d", "")}
    assert {(r.source, r.file, r.pos, r["head"], r.tail) for r in found} == expected and len(found) == len(expected)
