"""Mixing sources to target weights by hierarchical budgeting.

Documents hang under a tree of domain, language and source. The token budget
runs down the tree: the children of a node share its budget by weight, no
child gets more than its subtree can give (its tokens times ``max_epochs``),
and what a child can't take goes to its siblings by weight. A whole subtree
that is short takes less from its parent in the first place, so a shortage is
made up among siblings before it reaches the ancestors' siblings.

A source then gives whole epochs, and of one more epoch the longest prefix
that fits into what is left. An epoch's order is by the MD5 of seed, epoch and
doc_id. The prefix's end is found in two steps, by sums over the 4,096
leading values of the digest and then within the one value that holds the
end, so that no task sorts a whole source. The selection itself compares each
document with its source's end; only the table of sources is joined.

Defined results: null language, source or domain is the group ``unknown``; a
null or empty text has no tokens and goes with the prefix it stands in; names
without a weight weigh ``other``; nothing is selected from an empty table or
for a budget of 0; existing columns named mix_* are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

TREE = ["mix_domain", "mix_lang", "mix_source"]


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\x09-\\x0D]+")).cast("long")


def _weight(level: str, weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Split each parent's ``budget`` over its nodes by ``weight``, none above its ``capacity``: adds ``share``.

    Nodes fill up in the order of capacity / weight; a node is full if the
    water needed to raise all to its level is there.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy("level", *[c for c in TREE if c in nodes.columns])
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = nodes.withColumn("level", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    filled = levels.withColumn("full", (F.col("weight") > 0) & (F.coalesce(F.sum("capacity").over(before), F.lit(0.0)) + F.col("level") * F.sum("weight").over(after) <= F.col("budget")))
    rest = filled.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(by)).withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(by))
    return rest.withColumn("share", F.when(F.col("full"), F.col("capacity")).when(F.col("weight") > 0, F.col("weight") * F.col("left") / F.col("open")).otherwise(0.0)).drop("level", "full", "left", "open")


def budgets(leaves: DataFrame, budget: float, weights: dict[str, dict[str, float]], other: float, max_epochs: int) -> DataFrame:
    """TREE, tokens, share: what each source gives, of ``leaves`` (TREE, tokens)."""
    share, done = leaves.select(F.lit(float(budget)).alias("budget")).limit(1), []
    for depth, (level, name) in enumerate(zip(TREE, ("domain", "lang", "source"), strict=True)):
        nodes = leaves.groupBy(*TREE[: depth + 1]).agg((F.sum("tokens") * float(max_epochs)).alias("capacity")).withColumn("weight", _weight(level, weights.get(name, {}), other))
        above = nodes.withColumn("budget", F.lit(float(budget))) if not done else nodes.join(share, done)
        share = share_out(above, done).select(*TREE[: depth + 1], F.col("share").alias("budget"))
        done = TREE[: depth + 1]
    return leaves.join(share.withColumnRenamed("budget", "share"), TREE)


def mix(docs: DataFrame, domain: Column, fraction: float, weights: dict[str, dict[str, float]], other: float = 1.0, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every selected document once per epoch: its columns, its place in the tree, mix_tokens and mix_epoch.

    The budget is ``fraction`` of all tokens.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    unknown = F.lit("unknown")
    tree = {"mix_domain": F.coalesce(domain, unknown), "mix_lang": F.coalesce(F.col(lang_col), unknown), "mix_source": F.coalesce(F.col(source_col), unknown)}
    placed = docs.withColumns(tree | {"mix_tokens": count_words(F.col(text_col))})
    small = written(placed.select(*TREE, F.col(id_col).alias("mix_id"), "mix_tokens"), "mix-documents")
    leaves = written(small.groupBy(*TREE).agg(F.sum("mix_tokens").cast("double").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0.0
    plan = budgets(leaves, fraction * total, weights, other, max_epochs).withColumn("epochs", F.when(F.col("tokens") > 0, F.floor((F.col("share") + 1e-6) / F.col("tokens"))).otherwise(F.lit(0)).cast("int")).withColumn("rest", F.floor(F.col("share") - F.col("epochs") * F.col("tokens") + 1e-6).cast("long"))
    plan = written(plan.select(*TREE, "epochs", "rest"), "mix-plan")

    def order(epochs: Column, key: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), (epochs + 1).cast("string"), F.coalesce(key.cast("string"), F.lit(""))))

    ordered = small.join(plan, TREE).withColumn("digest", order(F.col("epochs"), F.col("mix_id"))).withColumn("lead", F.substring("digest", 1, 3))
    sums = ordered.groupBy(*TREE, "rest", "lead").agg(F.sum("mix_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*TREE).orderBy("lead").rowsBetween(Window.unboundedPreceding, 0))
    leads = sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest")))
    last_lead = leads.groupBy(*TREE).agg(F.min(F.struct("lead", (F.col("upto") - F.col("tokens")).alias("before"))).alias("at")).select(*TREE, F.col("at.lead").alias("lead"), F.col("at.before").alias("before"))
    inside = ordered.join(last_lead, [*TREE, "lead"]).withColumn("upto", F.col("before") + F.sum("mix_tokens").over(Window.partitionBy(*TREE).orderBy("digest").rangeBetween(Window.unboundedPreceding, 0)))
    ends = inside.where(F.col("upto") > F.col("rest")).groupBy(*TREE).agg(F.min("digest").alias("end"))
    chosen = written(plan.join(ends, TREE, "left"), "mix-ends").select(*TREE, "epochs", F.coalesce("end", F.lit("g")).alias("end"))
    picked = placed.join(chosen, TREE).withColumn("mix_epoch", F.explode(F.filter(F.sequence(F.lit(1), F.lit(max_epochs)), lambda e: (e <= F.col("epochs")) | ((e == F.col("epochs") + 1) & (order(F.col("epochs"), F.col(id_col)) < F.col("end"))))))
    return picked.select(*docs.columns, *TREE, "mix_tokens", "mix_epoch")
