"""Raw lines to entries: folding, timestamps, levels and the remaining message.

Everything stays in Column expressions. Folding needs the order of a file's
lines, which it finds range by range, so that no task holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The patterns, formats and word lists that decide how a line is read.
LEVEL_WORDS = "ERROR|WARN|WARNING|INFO|DEBUG|TRACE"
BRACKET_LEVEL = rf"(?i)\[({LEVEL_WORDS})]"
BARE_LEVEL = rf"(?i)\b({LEVEL_WORDS})\b"
HTTP_STATUS = r'"\s+(\d{3})\s'
ERROR_WORDS = r"(?i)\b(exception|panic|fatal|critical|segfault|denied|exited on signal|out of memory)\b"
WARN_WORDS = r"(?i)\b(fail(?:ed|ure)?|invalid|timeout|unauthorized|refused|retry(?:ing)?|degraded)\b"
LEVEL_HEAD = 80
APP_TIME = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})"
ACCESS_TIME = r"\[(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})]"
ISO_TIME = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:?\d{2})?"
SYSLOG_TIME = r"^([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
APP_FORMAT, ACCESS_FORMAT, SYSLOG_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS", "dd/MMM/yyyy:HH:mm:ss Z", "yyyy MMM d HH:mm:ss"


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match; null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def timestamp_of(line: Column, as_of: Column) -> Column:
    """The line's time: the first format that is there and valid, else ``as_of``.

    Times without an offset are UTC, so the session's time zone must be UTC.
    """
    app = F.try_to_timestamp(_found(line, APP_TIME), F.lit(APP_FORMAT))
    access = F.try_to_timestamp(_found(line, ACCESS_TIME), F.lit(ACCESS_FORMAT))
    offset = F.when(line.rlike(ISO_TIME), F.coalesce(F.nullif(F.regexp_extract(line, ISO_TIME, 2), F.lit("")), F.lit("Z")))
    iso = F.when(~offset.rlike(r"^[+-]\d{4}$"), F.concat(_found(line, ISO_TIME), offset).try_cast("timestamp"))
    stamp = F.regexp_replace(_found(line, SYSLOG_TIME), r"\s+", " ")
    this_year = F.try_to_timestamp(F.concat_ws(" ", F.year(as_of).cast("string"), stamp), F.lit(SYSLOG_FORMAT))
    last_year = F.try_to_timestamp(F.concat_ws(" ", (F.year(as_of) - 1).cast("string"), stamp), F.lit(SYSLOG_FORMAT))
    syslog = F.when(stamp.isNotNull(), F.when(this_year > as_of + F.expr("INTERVAL 1 DAY"), F.coalesce(last_year, F.add_months(this_year, -12).cast("timestamp"))).otherwise(this_year))
    return F.coalesce(app, access, iso, syslog, as_of)


def level_of(line: Column) -> Column:
    """The line's level; the first evidence wins."""

    def named(word: Column) -> Column:
        upper = F.upper(word)
        return F.when(upper == "ERROR", "ERROR").when(upper.isin("WARN", "WARNING"), "WARN").when(upper.isin("DEBUG", "TRACE"), "DEBUG").otherwise("INFO")

    head, status = F.substring(line, 1, LEVEL_HEAD), F.regexp_extract(line, HTTP_STATUS, 1).try_cast("int")
    return (
        F.when(line.rlike(BRACKET_LEVEL), named(F.regexp_extract(line, BRACKET_LEVEL, 1)))
        .when(head.rlike(BARE_LEVEL), named(F.regexp_extract(head, BARE_LEVEL, 1)))
        .when(line.rlike(HTTP_STATUS), F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO"))
        .when(line.rlike(ERROR_WORDS), "ERROR")
        .when(line.rlike(WARN_WORDS), "WARN")
        .otherwise("INFO")
    )


def _without_first(text: Column, pattern: str) -> Column:
    """The text less the first match and one space behind it."""
    flags, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    if bare.startswith("^"):
        return F.regexp_replace(text, f"{flags}{bare} ?", "")
    return F.regexp_replace(text, f"{flags}^((?s:.*?)){bare}(?s: ?)", "$1")


def message_of(line: Column) -> Column:
    """What is left of a line without its time and bracketed level."""
    times = [APP_TIME, ACCESS_TIME, ISO_TIME, SYSLOG_TIME]
    rest = F.when(line.rlike(times[0]), _without_first(line, times[0]))
    for pattern in times[1:]:
        rest = rest.when(line.rlike(pattern), _without_first(line, pattern))
    rest = rest.otherwise(line)
    return F.regexp_replace(F.regexp_replace(_without_first(rest, BRACKET_LEVEL), r"^[\p{Z}\s]+|[\p{Z}\s]+$", ""), " {2,}", " ")


def frame_lines(texts: DataFrame, from_start: Column | None = None, max_lines: int | None = None) -> DataFrame:
    """(source, file, pos, line) from (source, file, text) rows of whole or tail texts.

    Of a tail that doesn't begin at the file's start the first, partial line
    goes; the empty line after a final newline goes; the last ``max_lines`` stay,
    or all if none is given.
    """
    begin = F.lit(True) if from_start is None else from_start
    lines = F.split("text", "\n")
    lines = F.when(begin, lines).otherwise(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    lines = F.when((F.size(lines) > 0) & (F.try_element_at(lines, F.lit(-1)) == ""), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    if max_lines is not None:
        lines = F.slice(lines, F.greatest(F.size(lines) - max_lines + 1, F.lit(1)), max_lines)
    return texts.select("source", "file", F.posexplode(lines).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long")).withColumn("line", F.regexp_replace("line", "\r$", ""))


#: Positions of a file that one window holds, where ``pos`` is a number.
RANGE_LINES = 1 << 16


def fold(lines: DataFrame) -> DataFrame:
    """One row per entry: (source, file, pos, head, tail): its first line and the continuation lines after it.

    Empty lines go; a line that starts with a space or tab continues the entry
    before it. ``pos`` is a number, or a struct whose first field tells ranges
    of lines (as the splits of a large file). A line belongs to the last
    opening line before it: that of its own range, else that of the ranges
    before, of which there is one row each.
    """
    kind = lines.schema["pos"].dataType
    split = F.col(f"pos.{kind.names[0]}") if isinstance(kind, StructType) else F.floor(F.col("pos") / RANGE_LINES)
    kept = lines.where(F.length("line") > 0).withColumn("_range", split)
    opening = F.when(~F.col("line").rlike("^[ \t]"), F.col("pos"))
    within = Window.partitionBy("source", "file", "_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ranges = kept.groupBy("source", "file", "_range").agg(F.max(opening).alias("_last"), F.min("pos").alias("_first"))
    of_file = Window.partitionBy("source", "file")
    earlier = F.last("_last", ignorenulls=True).over(of_file.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = ranges.select(*[F.col(c).alias(f"_{c}") for c in ("source", "file", "_range")], F.coalesce(earlier, F.min("_first").over(of_file)).alias("_before"))  # a file's first line opens anyway
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("file").eqNullSafe(F.col("_file")) & F.col("_range").eqNullSafe(F.col("__range"))
    numbered = kept.withColumn("_own", F.last(opening, ignorenulls=True).over(within)).join(before, same, "left").withColumn("entry", F.coalesce("_own", "_before"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    folded = numbered.groupBy("source", "file", "entry").agg(parts.alias("parts"))
    rest = F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: p["line"])
    return folded.select("source", "file", F.col("parts")[0]["pos"].alias("pos"), F.col("parts")[0]["line"].alias("head"), F.array_join(rest, "\n").alias("tail"), (F.size("parts") > 1).alias("continued"))


def parse(lines: DataFrame, as_of: str) -> DataFrame:
    """Entries (source, file, pos, ts, level, message) of (source, file, pos, line) rows."""
    now = F.lit(as_of).cast("timestamp")
    own = message_of(F.col("head"))
    return fold(lines).select(
        "source", "file", "pos",
        timestamp_of(F.col("head"), now).alias("ts"), level_of(F.col("head")).alias("level"),
        F.when(F.col("continued"), F.concat(own, F.lit("\n"), F.col("tail"))).otherwise(own).alias("message"),
    )
