"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Each rendered
turn is read back by a deterministic parser of that grammar; where the turn
that comes back differs from the source, its content is escaped and rendered
anew. Escaping puts a ``^`` after the ``<`` of every ``<``, zero or more ``^``,
``|``; the parser takes one away again. Escaped content holds no ``<|`` and
gives back its source exactly, so one round is enough for any content. A role
has, besides, its line feeds written as ``<n|``. The whole conversation is
then read back, and ``identical`` tells that all turns came back.

Defined results: null role and text are empty; turns go by (turn, role, text),
nulls first; rows whose conv_id is null form one conversation; repeated rows
are turns like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
OPEN_RE = "<\\|im_start\\|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\^*)\\|", "<^$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, "<\\^(\\^*)\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, "<([\\^n]*)\\|", "<^$1|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), "<\\^([\\^n]*)\\|", "<$1|")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted text; a turn against the grammar comes back as null."""

    def turn(part: Column) -> Column:
        head, close = F.instr(part, "\n"), F.instr(part, CLOSE)
        good = (head > 0) & (close > head) & (F.length(part) == close + len(CLOSE))
        role = F.substr(part, F.lit(1), head - 1)
        text = F.substr(part, head + 1, close - head - 1)
        return F.when(good & F.endswith(part, F.lit("\n")), F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text")))

    parts = F.split(formatted, OPEN_RE, -1)
    read = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)
    return F.when(F.element_at(parts, 1) == "", read)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (read back), loss_spans, n_escaped, identical.

    ``loss_spans`` are (start, length) in code points of ``formatted``, from 0:
    the texts of ``loss_role`` as they stand there, markers left out. A
    conversation is one row, so its turns meet in one task by nature.
    """
    source = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    plain = render_turn(F.col("role"), F.col("text"))
    own = F.array(F.struct("role", "text"))
    marked = source.withColumn("clash", ~parse_turns(plain).eqNullSafe(own))
    pieces = marked.select(
        "conv_id", "turn", "role", "text", "clash",
        F.when(F.col("clash"), escape_role(F.col("role"))).otherwise(F.col("role")).alias("shown_role"),
        F.when(F.col("clash"), escape_text(F.col("text"))).otherwise(F.col("text")).alias("shown_text"),
    ).withColumn("piece", render_turn(F.col("shown_role"), F.col("shown_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = pieces.select(
        "conv_id", "role", "text", "clash", "piece",
        F.row_number().over(order).alias("at"),
        (F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece") + len(OPEN) + F.length("shown_role") + 1).alias("start"),
        F.length("shown_text").cast("long").alias("length"),
    )
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "piece", "start", "length"))).alias("rows"), F.count_if("clash").alias("n_escaped"))
    whole = rows.select(
        "conv_id", "n_escaped",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
        F.transform(F.filter("rows", lambda r: r["role"] == loss_role), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))).alias("loss_spans"),
    )
    return whole.withColumn("turns", parse_turns(F.col("formatted"))).select("conv_id", "formatted", "turns", "loss_spans", "n_escaped", F.col("turns").eqNullSafe(F.col("source")).alias("identical"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the spans of a loss mask cover, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The digests of what a reader gets back from ``formatted``: the turns by parsing it, the loss text through the mask."""
    both = formatted.select("conv_id", "formatted", "turns", masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "n_escaped", "identical")
    return both.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "identical",
    )
