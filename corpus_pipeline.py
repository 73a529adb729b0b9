"""The training-data pipeline: five stages from raw documents to a mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs. Decisions are made for rows,
not for ids: rows without an id, rows that repeat an id and a text, and
different texts under one id are each decided on by their own text. Extra
columns of documents pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm._spark import discard, scratch, table, written
from timberline.llm.decontaminate import drop_contaminated
from timberline.llm.exact_dedup import exact_duplicates, text_digest
from timberline.llm.language_id import LanguageModel, label_identified
from timberline.llm.mixing import mix
from timberline.llm.near_dedup import near_duplicates
from timberline.llm.queries import DOMAIN, WEIGHTS


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame, key: str, place: str) -> DataFrame:
    """``docs``, written where its rows are read, with a long of its own for each row and what orders rows: (no id, id, text hash)."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    return written(docs.withColumns({key: F.monotonically_increasing_id(), place: order}), "keyed")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set each document's lang to the language found in its text; drop those that get none: without a letter, empty or null.

    Mixing goes by the language that is set here, so a document with a wrong
    or missing lang is budgeted with those it belongs to.
    """
    return label_identified(docs, LanguageModel.learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text: one with the largest id, or one without an id if no row has any.

    Rows equal in id and text are folded by a partial aggregate before the
    shuffle; the anti join finds its rows where that shuffle put them.
    """
    key = _free("row_key", docs)
    found = exact_duplicates(docs)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.concat_ws(":", "text_sha256", "doc_id").alias(key))
    rows = docs.withColumn(key, F.concat_ws(":", text_digest("text"), F.col("doc_id").cast("long"))).dropDuplicates([key])
    return rows.join(gone, key, "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group at 5-word similarity 0.8: one with the smallest id, or one without an id if no row has any.

    Groups are found for row keys; only the keys of groups with several rows
    are looked up and folded to their first, so texts move once, to the join
    that drops the others.
    """
    key, place = _free("row_key", docs), _free("row_place", docs)
    rows = _keyed(docs, key, place)
    found = near_duplicates(rows, words=5, percent=80, id_col=key).where(~F.col("kept"))
    members = found.select("component_id", F.explode(F.array("doc_id", "component_id")).alias("row")).distinct()
    places = rows.select(F.col(key).alias("row"), F.col(place).alias("place"))
    grouped = written(places.join(members, "row"), "near-members")
    first = grouped.groupBy("component_id").agg(F.min(F.struct("place", "row")).alias("first"))
    gone = grouped.join(first, "component_id").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy or an edited copy of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take 80 % of the tokens by the target weights, each document at most twice."""
    return mix(docs, F.expr(DOMAIN), fraction=0.8, weights=WEIGHTS, max_epochs=2)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch():  # what the stage wrote on its way goes
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
