"""Tokens, phrases and wildcards."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words, with joiners kept between letters or between digits: web.log, 10.0.0.1, don't.
TOKEN = r"[\p{L}\p{N}\p{M}_]+(?:(?:(?<=\p{L})[.:'’·](?=\p{L})|(?<=\p{Nd})[.,;'’](?=\p{Nd}))[\p{L}\p{N}\p{M}_]+)*"


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _python_tokens(words: str) -> list[str] | None:
    """The tokens of plain ASCII words, where Python tells them as Spark does; None for others."""
    plain = words.lower()
    return plain.split() if re.fullmatch(r"[a-z0-9_ ]*", plain) else None


def has_any_token(text: Column, words: str) -> Column:
    """Whether any token of ``words`` is a token of the text; false if ``words`` has none.

    Texts that don't hold one of plain words at all aren't cut into tokens.
    """
    found = F.arrays_overlap(tokens(text), tokens(F.lit(words)))
    plain = _python_tokens(words)
    if not plain:
        return found
    near = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)) for w in plain])
    return near & found


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the tokens of ``phrase`` stand side by side in the text."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.lit(phrase)), " "), F.lit(" "))
    found = (F.size(tokens(F.lit(phrase))) > 0) & F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), joined)
    plain = _python_tokens(phrase)
    if not plain:
        return found
    return reduce(lambda a, b: a & b, [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)) for w in plain]) & found


#: Stands for no position.
_NOWHERE = (1 << 31) - 1


def has_near_phrase(text: Column, phrase: str, slop: int) -> Column:
    """Whether the tokens of ``phrase`` stand in the text moved by at most ``slop`` in all: a sloppy phrase, in any order.

    A token's shift is its position in the text less that in the phrase; the
    largest and the smallest shift may differ by ``slop``. A token that the
    phrase has twice needs two positions. For each shift that occurs as the
    smallest, positions are chosen from left to right, the first that fits.
    The tokens and their positions are bound to lambda variables, so they are
    found once a row.
    """
    plain = _python_tokens(phrase)
    words = plain if plain is not None else SparkSession.active().range(1).select(tokens(F.lit(phrase)).alias("t")).first().t
    if not words:
        return F.lit(False)
    places = {w: [i for i, x in enumerate(words) if x == w] for w in words}

    def standing(found: Column) -> Column:
        """For each word its positions in the text."""
        at = lambda w: lambda x, i: F.when(x == w, i)
        return F.array(*[F.array_compact(F.transform(found, at(w))) for w in places])

    def fits(held: Column, low: Column) -> Column:
        def first(k: int):
            free = lambda last, i: lambda p: (p > last) & (p >= low + i) & (p <= low + i + slop)
            return lambda last, i: F.coalesce(F.array_min(F.filter(held[k], free(last, i))), F.lit(_NOWHERE))

        return reduce(lambda a, b: a & b, [F.aggregate(F.array(*map(F.lit, own)), F.lit(-1), first(k)) < _NOWHERE for k, own in enumerate(places.values())])

    def matched(held: Column) -> Column:
        back = lambda i: lambda p: p - i
        shifts = F.flatten(F.array(*[F.transform(held[k], back(i)) for k, own in enumerate(places.values()) for i in own]))
        return F.exists(F.array_distinct(shifts), lambda low: fits(held, low))

    found = F.exists(F.transform(F.array(tokens(text)), standing), matched)
    if not plain:
        return found
    return reduce(lambda a, b: a & b, [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)) for w in places]) & found


def composite(*parts: Column) -> Column:
    """All searchable text of an entry."""
    return F.concat_ws(" ", *parts)


def wildcard_pattern(pattern: str) -> str:
    """``*`` and ``?`` wildcards as a Java regular expression; a leading wildcard is refused."""
    if pattern[:1] in ("*", "?"):
        raise ValueError("a wildcard can't come first")
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in pattern) + "\\z"
