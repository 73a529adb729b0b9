"""Structure of messages: format and fields, by the first format that fits.

Order: JSON, syslog (three forms), access log, logfmt, unstructured. A message
is looked at in two steps. The first finds its format: a test that costs
little (its first character, a quote, an equals sign) comes before each
pattern. The second takes the fields of that format only, all groups by one
match.

JSON objects without nesting, escapes, unusual numbers, repeated names or too
many members are parsed in the JVM in one pass; other JSON goes to an Arrow
function, which flattens any depth and gets null for all other messages.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the formats and the names of their groups.
SYSLOG_5424 = r"^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+([\s\S]*)$"
SYSLOG_5424_FIELDS = ["priority", "version", "timestamp", "hostname", "appName", "procId", "msgId", "message"]
SYSLOG_3164 = r"^<(\d{1,3})>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\s\[]+)(?:\[(\d+)])?:\s?([\s\S]*)$"
SYSLOG_3164_FIELDS = ["priority", "timestamp", "hostname", "tag", "pid", "message"]
ACCESS_LOG = r'^(\S+) (\S+) (\S+) (?:\[([^]]+)] )?"([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?\s*$'
ACCESS_LOG_FIELDS = ["host", "ident", "authuser", "timestamp", "request", "status", "bytes", "referer", "userAgent"]
SYSLOG_TAG = r"^(\S+) ([^:\s\[]+)(?:\[(\d+)])?:\s?([\s\S]+)$"
SYSLOG_TAG_FIELDS = ["hostname", "tag", "pid", "message"]
LOGFMT_PAIR = r'([A-Za-z_][\w.-]*)=("(?:[^"\\]|\\.)*"|\S+)'
LOGFMT_SHARE = 0.6
MAX_FIELDS = 32

#: One member of a flat JSON object: numbers only as Python and Java print them both.
_FLAT_NUMBER = r"0|-?0\.(?:0|\d{0,2}[1-9])|-?[1-9]\d{0,6}\.(?:0|\d{0,2}[1-9])|-?[1-9]\d{0,11}"
_FLAT_SPACE, _FLAT_TEXT = r"[ \t\r\n]*+", r'[^"\\\x00-\x1f]*+'
_FLAT_VALUE = rf'"{_FLAT_TEXT}"|true|false|null|(?:{_FLAT_NUMBER})(?![\d.eE])'
_FLAT_MEMBER = rf'"{_FLAT_TEXT}"{_FLAT_SPACE}:{_FLAT_SPACE}(?:{_FLAT_VALUE})'
#: More members are left to Arrow, since Java's matcher recurses once a member.
FLAT_MEMBERS = 64
FLAT_JSON = rf"^\s*+\{{{_FLAT_SPACE}{_FLAT_MEMBER}(?:{_FLAT_SPACE},{_FLAT_SPACE}{_FLAT_MEMBER}){{0,{FLAT_MEMBERS - 1}}}{_FLAT_SPACE}\}}\s*+$"
#: What is cut off around a message.
SPACE = " \t\n\x0b\f\r"
#: Stands between the groups of a match.
BETWEEN = "\x1f\x1e"

FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def flatten(root) -> list[tuple[str, str]]:
    """Leaves of a parsed JSON value with their paths, a.b and a[0], in document order."""
    out, stack = [], [("", root)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            stack.extend((f"{path}[{i}]", v) for i, v in reversed([*enumerate(node)]))
        else:
            out.append((path or "value", _text(node)))
    return out


@F.arrow_udf(FIELDS)
def json_fields(messages: pa.Array) -> pa.Array:
    """Flattened fields of JSON objects and arrays; null where the text is neither or has no leaf. Of a repeated path the last value counts."""
    names, values, bounds, missing = [], [], [0], []
    for text in messages.to_pylist():
        leaves = {}
        text = (text or "").strip()
        if text[:1] in ("{", "["):
            try:
                leaves = dict(flatten(json.loads(text)))
            except (ValueError, RecursionError):
                pass
        names.extend(leaves)
        values.extend(leaves.values())
        bounds.append(len(names))
        missing.append(not leaves)
    pairs = pa.StructArray.from_arrays([pa.array([clean(x) for x in names], pa.string()), pa.array([clean(x) for x in values], pa.string())], ["name", "value"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs, mask=pa.array(missing, pa.bool_()))


def clean(text: str) -> str:
    """A text that has a UTF-8 form: lone surrogates, which JSON escapes may give, become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def flat_fields(message: Column) -> Column:
    """name/value structs of a flat JSON object's members in their order, in one pass; null becomes empty."""
    return F.transform(F.map_entries(F.from_json(message, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("value")))


def _groups(text: Column, pattern: str, names: list[str], optional: Column | None = None) -> Column:
    """name/value structs of a pattern's groups, which it matches as a whole; ``optional`` tells of a struct f whether it stays."""
    one = F.split(F.regexp_replace(text, pattern, BETWEEN.join(f"${i + 1}" for i in range(len(names)))), BETWEEN)
    each = F.array(*[F.regexp_extract(text, pattern, i + 1) for i in range(len(names))])
    values = F.when(F.contains(text, F.lit(BETWEEN)), each).otherwise(one)
    return F.zip_with(F.array(*map(F.lit, names)), values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))


def _without(fields: Column, empty: set[str]) -> Column:
    """The fields less those of ``empty`` that have no text: groups that may be missing."""
    return F.filter(fields, lambda f: ~(f["name"].isin(*empty) & (f["value"] == "")))


def _access(text: Column) -> Column:
    """An empty quoted referer or agent is a field; both are missing if the line ends without them."""
    fields = _without(_groups(text, ACCESS_LOG, ACCESS_LOG_FIELDS), {"timestamp"})
    return F.when(text.rlike(r'" \d{3} \S+ "[^"]*" "[^"]*"\s*$'), fields).otherwise(F.filter(fields, lambda f: ~f["name"].isin("referer", "userAgent")))


def _logfmt(text: Column) -> Column:
    names, values = (F.regexp_extract_all(text, F.lit(LOGFMT_PAIR), F.lit(k)) for k in (1, 2))
    plain = F.transform(values, lambda v: F.when((F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.zip_with(names, plain, lambda n, v: F.struct(n.alias("name"), v.alias("value")))


def _is_logfmt(text: Column) -> Column:
    wholes = F.regexp_extract_all(text, F.lit(LOGFMT_PAIR), F.lit(0))
    return (F.size(wholes) >= 2) & (F.length(F.array_join(wholes, "")) >= F.length(text) * LOGFMT_SHARE)


#: (kind, format, what all of its texts hold, when a text is of the kind, its fields)
_KINDS = [
    ("5424", "syslog", lambda t: t.startswith("<"), lambda t: t.rlike(SYSLOG_5424), lambda t: _groups(t, SYSLOG_5424, SYSLOG_5424_FIELDS)),
    ("3164", "syslog", lambda t: t.startswith("<"), lambda t: t.rlike(SYSLOG_3164), lambda t: _without(_groups(t, SYSLOG_3164, SYSLOG_3164_FIELDS), {"pid"})),
    ("access", "accesslog", lambda t: t.contains('"'), lambda t: t.rlike(ACCESS_LOG), _access),
    ("tag", "syslog", lambda t: t.contains(":"), lambda t: t.rlike(SYSLOG_TAG), lambda t: _without(_groups(t, SYSLOG_TAG, SYSLOG_TAG_FIELDS), {"pid"})),
    ("logfmt", "logfmt", lambda t: t.contains("="), _is_logfmt, _logfmt),
]


def extract(entries: DataFrame) -> DataFrame:
    """Adds format and fields (a map of at most MAX_FIELDS, the last value of a repeated name).

    What several expressions use stands in a column of its own, so that it is
    made once a row: lambda bodies name columns only. The result leaves
    through a generator, below which no caller's filter is pushed, since that
    would put those columns' expressions back into the lambdas.
    """
    kept = [c for c in entries.columns if c not in ("format", "fields")]
    message = F.col("message")
    flat = message.rlike(FLAT_JSON)
    read = entries.select(*kept, F.coalesce(F.btrim("message", F.lit(SPACE)), F.lit("")).alias("_text"), F.when(flat, flat_fields(message)).alias("_flat"))
    names = F.transform("_flat", lambda p: p["name"])
    plain = F.coalesce(F.size(F.array_distinct(names)) == F.size("_flat"), F.lit(False))
    routed = read.withColumn("_plain", plain)
    found = routed.withColumn("_json", F.when(F.col("_plain"), F.col("_flat")).otherwise(json_fields(F.when(F.col("_text").rlike(r"^[{\[]") & ~F.col("_plain"), message))))
    text, kind = F.col("_text"), F.when(F.col("_json").isNotNull(), "json").when(F.col("_text") == "", "none")
    for name, _, near, fits, _ in _KINDS:
        kind = kind.when(near(text) & fits(text), name)
    known = found.withColumn("_kind", kind.otherwise("none"))
    pairs, form = F.when(F.col("_kind") == "json", F.col("_json")), F.when(F.col("_kind") == "json", "json")
    for name, of, _, _, fields in _KINDS:
        pairs, form = pairs.when(F.col("_kind") == name, fields(text)), form.when(F.col("_kind") == name, of)
    capped = known.select(*kept, form.otherwise("unstructured").alias("_form"), F.slice(F.coalesce(pairs, F.array().cast(FIELDS)), 1, MAX_FIELDS).alias("_pairs"))
    last = F.filter("_pairs", lambda p, i: ~F.exists(F.slice("_pairs", i + 2, MAX_FIELDS), lambda q: q["name"] == p["name"]))
    once = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["name"]))) == F.size("_pairs")
    fields = F.map_from_entries(F.when(once, F.col("_pairs")).otherwise(last))
    return capped.select(*kept, F.inline(F.array(F.struct(F.col("_form").alias("format"), fields.alias("fields")))))


#: Positions of a file that one window numbers, where ``pos`` is a number.
RANGE_LINES = 1 << 16


def entry_ids(entries: DataFrame) -> DataFrame:
    """Adds doc_id: a hash of source, file, time and message, with an ordinal among equals in the order of ``pos``.

    Equals are numbered inside ranges of their file (65,536 positions, or the
    first field of a ``pos`` that is a struct, as the splits of a large file),
    after those that earlier ranges have of the same entry. There is one row a
    range for those counts, so an entry that makes up much of a file is no
    task's alone. Equals have their source and file in common, so ranges of
    one file are all that must be looked at.
    """
    kind = entries.schema["pos"].dataType
    place = F.col(f"pos.{kind.names[0]}") if isinstance(kind, T.StructType) else F.floor(F.col("pos") / RANGE_LINES)
    key = F.sha2(F.concat_ws("|", F.col("source"), F.coalesce("file", F.lit("null")), F.unix_millis("ts").cast("string"), F.col("message")), 256)
    keyed = entries.withColumn("_key", key).withColumn("_range", place)
    counts = keyed.groupBy("_key", "_range").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("_key").orderBy(F.asc_nulls_first("_range")).rowsBetween(Window.unboundedPreceding, -1))
    # Only entries that several ranges hold have any ahead: few rows to join with.
    before = counts.withColumn("_ahead", ahead).where("_ahead > 0").select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), "_ahead")
    inside = F.row_number().over(Window.partitionBy("_key", "_range").orderBy("pos"))
    numbered = keyed.withColumn("_inside", inside).join(before, (F.col("_key") == F.col("_k")) & F.col("_range").eqNullSafe(F.col("_r")), "left")
    ordinal = F.col("_inside") - 1 + F.coalesce("_ahead", F.lit(0))
    return numbered.withColumn("doc_id", F.concat_ws("::", "_key", ordinal.cast("string"))).select(*entries.columns, "doc_id")
