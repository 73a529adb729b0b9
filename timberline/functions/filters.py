"""Predicates on log frames as Columns.

A row that lacks a field matches no predicate on it, and matches the negation:
predicates stay null there, so that plain comparisons reach the Parquet scan,
and ``negate`` takes null for false. Use ``negate`` instead of ``~``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import KEYWORD_FIELDS
from .patterns import whole_term_pattern
from .text import composite, has_any_token, has_near_phrase, has_phrase, tokens, wildcard_pattern

NUMBER = r"^-?\d+(\.\d+)?$"


def value(name: str) -> Column:
    """A keyword column, or a dynamic field (with or without ``field.``)."""
    return F.col(name) if name in KEYWORD_FIELDS else F.element_at("fields", name.removeprefix("field."))


def number(name: str) -> Column:
    """A dynamic field's value where it is wholly a number, as a double; null otherwise."""
    return F.when(value(name).rlike(NUMBER), value(name).cast("double"))


def everything() -> Column:
    return F.lit(True)


def all_text() -> Column:
    """What bare words and phrases search: message, source, level, file and all field values."""
    return composite(F.col("message"), F.col("source"), F.col("level"), F.coalesce("file", F.lit("")), F.array_join(F.map_values("fields"), " "))


def term(words: str) -> Column:
    return has_any_token(all_text(), words)


def phrase(words: str, name: str | None = None, slop: int = 0) -> Column:
    """The words side by side, or moved by at most ``slop``."""
    text = all_text() if name is None else value(name)
    return has_near_phrase(text, words, slop) if slop else has_phrase(text, words)


def any_word(words: str, name: str) -> Column:
    """Any token of ``words`` is a token of a field's value."""
    return F.when(value(name).isNotNull(), has_any_token(value(name), words))


def equals(name: str, text: str) -> Column:
    return value(name) == text


def differs(name: str, text: str) -> Column:
    return negate(equals(name, text))


def between(name: str, low: float | None = None, high: float | None = None, with_low: bool = True, with_high: bool = True) -> Column:
    """A numeric range; None is open."""
    return _range(number(name), low, high, with_low, with_high)


def in_time(low=None, high=None, with_low: bool = True, with_high: bool = True) -> Column:
    return _range(F.col("ts"), *(None if x is None else F.lit(x).cast("timestamp") for x in (low, high)), with_low, with_high)


def _range(column: Column, low, high, with_low: bool, with_high: bool) -> Column:
    out = []
    if low is not None:
        out.append(column >= low if with_low else column > low)
    if high is not None:
        out.append(column <= high if with_high else column < high)
    return every(out) if out else column.isNotNull()


def lexical_range(name: str, low: str | None, high: str | None, with_low: bool = True, with_high: bool = True) -> Column:
    """A range in the order of the text."""
    return _range(value(name), low, high, with_low, with_high)


def matches(pattern: str, name: str | None = None, complement: bool = False) -> Column:
    """A whole-term pattern on a field's value, or on any token of the message; with ``complement``, ``~`` negates."""
    java = whole_term_pattern(pattern, complement)
    if name is None:
        return F.exists(tokens(F.col("message")), lambda t: t.rlike(java))
    return value(name).rlike(java)


def wildcard(pattern: str, name: str | None = None) -> Column:
    java = wildcard_pattern(pattern if name else pattern.lower())
    if name is None:
        return F.exists(tokens(all_text()), lambda t: t.rlike(java))
    return value(name).rlike(java)


def prefix(start: str, name: str | None = None) -> Column:
    if name is None:
        return F.exists(tokens(all_text()), lambda t: t.startswith(start.lower()))
    return value(name).startswith(start)


def fuzzy(word: str, edits: int = 2, name: str | None = None) -> Column:
    """Within some edits of a token, or of a field's value."""
    if name is None:
        return F.exists(tokens(all_text()), lambda t: F.levenshtein(t, F.lit(word.lower())) <= edits)
    return F.levenshtein(value(name), F.lit(word)) <= edits


def every(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def either(parts: Iterable[Column]) -> Column:
    """At least one; true if there are none."""
    parts = list(parts)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def negate(part: Column) -> Column:
    return ~F.coalesce(part, F.lit(False))


def clauses(must: Iterable[Column] = (), should: Iterable[Column] = (), must_not: Iterable[Column] = ()) -> Column:
    """Search-engine clauses: with a must, should is optional; only negative clauses match nothing."""
    must, should, must_not = list(must), list(should), list(must_not)
    if not must and not should:
        return F.lit(not must_not)
    return every([*must, *([] if must else [either(should)]), *map(negate, must_not)])


def scope(as_of: str | None = None, range_minutes: int = 0, source: str | None = None, file: str | None = None, disabled: Iterable[str] = ()) -> Column:
    """The part of the frame that a search looks at: a window up to as_of, a source, a file, no disabled source."""
    parts = [negate(F.col("source").isin(*disabled))] if (disabled := list(disabled)) else []
    if range_minutes > 0:
        parts.append(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(range_minutes)))
    parts += [equals(k, v) for k, v in (("source", source), ("file", file)) if v]
    return every(parts)


def simple(search: str = "", levels: Iterable[str] = (), **where) -> Column:
    """Scope, any of the levels, and any word of the search."""
    parts = [scope(**where)]
    if levels := list(levels):
        parts.append(F.col("level").isin(*levels))
    if search.strip():
        parts.append(term(search.strip()))
    return every(parts)


#: Names of level presets and time ranges in minutes (fixed values).
PRESETS = {"errors": ["ERROR"], "errors_and_warnings": ["ERROR", "WARN"], "clear": []}
TIME_RANGES = {"15m": 15, "1h": 60, "24h": 1440, "7d": 10080, "all": 0}


def correlation_key(name: Column) -> Column:
    """Whether a field's name is that of a trace or request id."""
    return F.regexp_replace(F.lower(name), "[-_]", "").isin("traceid", "requestid", "correlationid", "spanid", "reqid")


def trace(name: str, id_value: str) -> Column:
    """Entries with this id, of all sources and times."""
    return phrase(id_value, name) if name in KEYWORD_FIELDS else equals(name, id_value)


def apm_link(template: str, trace_id: Column) -> Column:
    """The link with the id in it; null if there is no template."""
    if not (template or "").strip():
        return F.lit(None).cast("string")
    return F.replace(F.lit(template), F.lit("{traceId}"), F.replace(F.url_encode(trace_id), F.lit("+"), F.lit("%20")))


def time_ago(ts: Column, as_of: str) -> Column:
    """just now, 5s ago, 3m ago, 2h ago or 4d ago."""
    seconds = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(ts)
    said = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(seconds < 5, "just now").when(seconds < 60, said(seconds, "s ago")).when(seconds < 3600, said(seconds / 60, "m ago")).when(seconds < 86400, said(seconds / 3600, "h ago")).otherwise(said(seconds / 86400, "d ago"))
