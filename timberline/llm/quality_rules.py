"""Quality rules: a table of thresholds compiled into one projection.

``text_metrics`` adds what rules look at: lengths, symbols, stop words, lines
and repeated 3-word windows, all as Column expressions. ``compile_rules``
turns a table of thresholds into one array expression with the names of the
rules that a document fails, so a new rule is a row of the table and no code.
No user function runs, and nothing is shuffled: a document is decided on
where its row is read.

Repeated windows are found exactly and without a shuffle: each window of a
document becomes a number, its hash with its place in the low bits, and the
numbers are sorted, so that equal windows stand side by side. Neighbours of
equal hash are compared by their words; where two of them differ, or a
document has more places than the low bits hold, its windows are sorted by
their words instead. That takes n log n time and about 150 bytes a word for
the document at hand.

Defined results: a null text is empty; a document without words has zero
metrics and fails the base rules; a ratio over no words or no lines is 0, so
no threshold but ``n_words`` speaks there; a threshold for languages leaves
out documents of another or no language; every row is decided on by itself,
whatever its id; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Common function words of the languages whose share is tested.
STOP_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from or an not have has but they his her which will their been".split(),
    "de": "der die das und in den von zu mit sich auf des für ist im dem nicht ein eine als auch es an er so dass sie nach wird bei einer".split(),
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec il se ce ne plus son elle sont aux ou mais".split(),
    "es": "de la que el en y los se del las por un no con su una es para al lo como más o pero sus le ha me si sin".split(),
}


@dataclass(frozen=True)
class Threshold:
    """A document fails if ``ratio`` (SQL over the metrics) is below ``least`` or above ``most``."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None
    langs: tuple[str, ...] = ()

    def sql(self) -> str:
        """When the document fails, as SQL text."""
        bounds = [f"{self.ratio} < {self.least}"] * (self.least is not None) + [f"{self.ratio} > {self.most}"] * (self.most is not None)
        failed = " OR ".join(bounds) or "false"
        return f"({failed})" + (f" AND coalesce(lang, '') IN ({', '.join(map(repr, self.langs))})" if self.langs else "")


_PER_WORD, _PER_LINE = "/ greatest(n_words, 1)", "/ greatest(n_lines, 1)"

#: The base rules, of which one is enough to drop a document.
BASE = (
    Threshold("too_short", "n_words", least=50),
    Threshold("repeated_words", "100 * n_repeat_words - 50 * n_words", most=0),
)
#: The other rules: length, symbol, stop-word and line ratios.
RULES = (
    Threshold("too_long", "n_words", most=10_000_000),
    Threshold("word_length", f"CASE WHEN n_words = 0 THEN 5 ELSE word_chars {_PER_WORD} END", least=2.5, most=12),
    Threshold("symbols", f"n_symbols {_PER_WORD}", most=0.25),
    Threshold("wordless", f"CASE WHEN n_words = 0 THEN 1 ELSE n_letter_words {_PER_WORD} END", least=0.7),
    Threshold("stop_words", f"CASE WHEN n_words = 0 THEN 1 ELSE n_stop_words {_PER_WORD} END", least=0.02, langs=tuple(STOP_WORDS)),
    Threshold("repeated_lines", f"n_dup_lines {_PER_LINE}", most=0.5),
    Threshold("cut_lines", f"n_cut_lines {_PER_LINE}", most=0.5),
    Threshold("list_lines", f"n_list_lines {_PER_LINE}", most=0.9),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_stop_words", "n_lines", "n_cut_lines", "n_list_lines")


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


#: A window's key holds its place in the low bits; longer documents are compared by their words at once.
PLACE_BITS = 24


def _windows(words: str) -> Column:
    """A document's windows with their places, sorted, so that equal ones stand side by side."""
    # A window is its words with a space between, which no word holds; a place is its first word's.
    return F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("window"), i.cast("long").alias("place"))))


def _by_words(words: str) -> Column:
    """The places of the windows that occur twice or more, by comparing their words."""
    pair = lambda a, b: F.when(a["window"] == b["window"], F.array(a["place"], b["place"]))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), pair)
    return F.array_distinct(F.flatten(F.array_compact(F.flatten(F.transform(F.array(_windows(words)), pairs)))))


def _keys(words: str) -> Column:
    """A number for each window, sorted: the high bits of its hash, then its place."""
    low = (1 << PLACE_BITS) - 1
    return F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _alike(a: Column, b: Column) -> Column:
    """Whether two keys have the same hash; null for a missing one."""
    return F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)


def _same_words(words: str, a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x & y, [F.get(words, _place(a) + k) == F.get(words, _place(b) + k) for k in range(3)])


def text_metrics(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang, the METRICS as longs) of every row."""
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    trimmed = _trimmed(F.col("_text"))
    cut = rows.select(
        "doc_id", "lang", "_text",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: _trimmed(x) != "").alias("_lines"),
    )
    n = F.size("_words")
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    longest = max(len(w.encode()) for w in stop)
    lettered = F.filter("_words", lambda w: ((w >= "a") & (w < "{")) | ((w >= "A") & (w < "[")) | w.rlike(r"\p{L}"))  # most begin with one
    common = F.filter("_words", lambda w: (F.octet_length(w) <= longest) & F.lower(w).isin(stop))
    lines = cut.select(
        "doc_id", "lang", "_words", n.alias("n_words"), F.length(F.array_join("_words", "")).alias("word_chars"), F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), F.size("_lines").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: _trimmed(x).endswith("...") | _trimmed(x).endswith("…"))).alias("n_cut_lines"),
        F.size(F.filter("_lines", lambda x: _trimmed(x).rlike(r"^[-*•‣·]\s"))).alias("n_list_lines"),
        F.size(lettered).alias("n_letter_words"), F.size(common).alias("n_stop_words"),
        F.when(n <= 1 << PLACE_BITS, _keys("_words")).otherwise(F.array().cast("array<long>")).alias("_keys"),
    )
    # Keys that share their hash with a neighbour; the columns are used several times, so that Spark makes them once a row.
    met = lines.withColumn("_met", F.filter("_keys", lambda k, i: _alike(k, F.get("_keys", i + 1)) | _alike(k, F.get("_keys", i - 1)))).drop("_keys")
    clash = F.exists(F.transform(F.col("_met"), lambda k, i: F.coalesce(_alike(k, F.get("_met", i + 1)) & ~_same_words("_words", k, F.get("_met", i + 1)), F.lit(False))), lambda x: x)
    by_words = _by_words("_words")
    placed = met.withColumn("_places", F.sort_array(F.when((n > 1 << PLACE_BITS) | clash, by_words).otherwise(F.transform("_met", lambda k: _place(k).cast("long"))))).drop("_words", "_met")
    # Each repeated window covers its three words, or as many as there are before the next one.
    covered = F.aggregate(F.transform("_places", lambda x, i: F.coalesce(F.least(F.lit(3).cast("long"), F.get("_places", i + 1) - x), F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda total, x: total + x)
    # As generated columns: a caller's filter on a metric isn't pushed below them, where it would repeat all of this for every word.
    found = F.struct(*[(covered if c == "n_repeat_words" else F.col(c)).cast("long").alias(c) for c in METRICS])
    return placed.select("doc_id", "lang", F.inline(F.array(found)))


def compile_rules(rules: tuple[Threshold, ...]) -> Column:
    """The names of the rules that a row of metrics fails, as one array expression."""
    return F.array_compact(F.array(*[F.expr(f"CASE WHEN {r.sql()} THEN '{r.name}' END") for r in rules])) if rules else F.array().cast("array<string>")


def judge(metrics: DataFrame, rules: tuple[Threshold, ...] = RULES, base: tuple[Threshold, ...] = BASE) -> DataFrame:
    """Adds base_failed, kept and failed_rules (names, comma-separated, in the tables' order) to rows of metrics."""
    return metrics.withColumns({"base_failed": F.size(compile_rules(base)) > 0, "_failed": compile_rules((*base, *rules))}).select(*metrics.columns, "base_failed", (F.size("_failed") == 0).alias("kept"), F.array_join("_failed", ",").alias("failed_rules"))
