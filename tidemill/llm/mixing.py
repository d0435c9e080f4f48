"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A tree of domain, language and source shares out a token budget from the root
down.  A node never gets more than its supply times ``max_epochs``; what a node
cannot use goes to its siblings by their weights (water-filling), and only what
all siblings together cannot use was kept back one level higher, because a
parent's own limit is the sum of its children's.  Each leaf then takes whole
epochs and a prefix of one more, in an order that the seed and the epoch's
number decide.

Only ids, leaf names and token counts are shuffled.  A leaf of n documents is
cut into about sqrt(n) hash-ordered buckets: sums of buckets place the prefix's
end in one bucket, and only that bucket's documents are ordered one by one, so
a leaf that holds a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, written

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"

#: Target weights of the default tree; a node that is not named weighs 1 among its siblings.
DOMAIN_WEIGHTS = {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def default_domain(source: Column) -> Column:
    """Sources are numbered; their number modulo four names the domain, others are ``other``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (number.try_cast("int") % 4).cast("string")))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, float(w)).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Share each parent's ``budget`` among its ``level`` nodes by weight ``w`` up to ``cap``."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upward = by.orderBy(F.col("cap") / F.col("w"), level)
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.withColumns({"c0": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w1": F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    full = sums.withColumn("full", F.col("cap") * F.col("w1") <= F.col("w") * (F.col("budget") - F.col("c0")))
    rest = full.withColumns(
        {
            "b1": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(by),
            "w2": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(by),
        }
    )
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("b1") / F.col("w2"))
    return rest.withColumn("got", got).drop("c0", "w1", "full", "b1", "w2")


def leaf_budgets(leaves: DataFrame, total: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``domain, lang, source, tokens, n_docs, budget`` from a table of leaves with tokens and n_docs."""
    budgets: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * float(max_epochs)).alias("cap")).withColumn("w", _weight(level, weights))
        nodes = nodes.withColumn("budget", F.lit(float(total))) if budgets is None else nodes.join(budgets, parent)
        budgets = water_fill(nodes, parent, level).select(*keys, F.col("got").alias("budget"))
    return leaves.join(budgets, list(LEVELS)).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def _place(epoch: Column, seed: int) -> Column:
    """Hexadecimal place of a document in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def leaf_of(docs: DataFrame, text_col: str) -> dict[str, Column]:
    """A document's leaf and its number of tokens."""
    return {
        "domain": default_domain(F.col("source")),
        "lang": F.coalesce("lang", F.lit("unknown")),
        "source": F.coalesce("source", F.lit("unknown")),
        "n_tokens": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"),
    }


def leaf_plan(rows: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, dict[str, float]] | None) -> DataFrame:
    """``domain, lang, source, budget, whole, buckets, rest`` of every leaf: whole epochs, and the tokens left for one more."""
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-leaves")
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    plan = leaf_budgets(leaves, total, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long")
    columns = [*LEVELS, "budget", whole.alias("whole"), F.ceil(F.sqrt("n_docs")).alias("buckets"), (F.col("budget") - whole * F.col("tokens")).alias("rest")]
    return written(plan.select(*columns), "mix-plan")


def taken(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, leaf, n_tokens) with ``place, whole, budget`` and ``extra``: whether the leaf's prefix reaches them."""
    placed = rows.join(plan, list(LEVELS)).withColumn("place", _place(F.col("whole"), seed))
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2**32)).cast("long"))
    sums = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("b_tokens"))
    upto = F.sum("b_tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    ends = written(sums.withColumn("b_end", upto).select(*LEVELS, "bucket", "b_end", (F.col("b_end") - F.col("b_tokens")).alias("b_start")), "mix-buckets")
    out = [*rows.columns, "place", "whole", "budget"]
    both = placed.join(ends, [*LEVELS, "bucket"])
    crossing = (F.col("b_start") <= F.col("rest")) & (F.col("rest") < F.col("b_end"))
    clear = both.where(~crossing).select(*out, (F.col("b_end") <= F.col("rest")).alias("extra"))
    order = Window.partitionBy(*LEVELS, "bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.col("b_start") + F.sum("n_tokens").over(order) <= F.col("rest")
    return clear.unionByName(both.where(crossing).select(*out, inside.alias("extra")))


def mix(
    docs: DataFrame,
    budget_share: float = 0.8,
    max_epochs: int = 2,
    seed: int = 17,
    weights: dict[str, dict[str, float]] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, domain, lang, source, n_tokens, leaf_budget, copies.

    The budget is ``budget_share`` of all tokens; a token is a white-space
    separated word.  Null languages and sources are leaves named ``unknown``.
    A text without words costs nothing and goes with its place in the order.
    Rows that repeat an id have the same place and are taken together or not
    at all.  An empty table gives an empty result.
    """
    leaf = leaf_of(docs, text_col)
    rows = written(docs.select("doc_id", *[leaf[k].alias(k) for k in leaf]), "mix-rows")
    found = taken(rows, leaf_plan(rows, budget_share, max_epochs, weights), seed)
    return found.select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), (F.col("whole") + F.col("extra").cast("long")).alias("copies"))


def mix_documents(
    docs: DataFrame,
    budget_share: float = 0.8,
    max_epochs: int = 2,
    seed: int = 17,
    weights: dict[str, dict[str, float]] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """The rows and columns of ``docs``, each row as often as :func:`mix` takes it.

    A leaf takes its whole epochs and every document up to the last place that
    its prefix reaches, so the texts only meet a table with a row for each
    leaf; none is shuffled by its id.
    """
    leaf = leaf_of(docs, text_col)
    rows = written(docs.select("doc_id", *[leaf[k].alias(k) for k in leaf]), "mix-rows")
    plan = leaf_plan(rows, budget_share, max_epochs, weights)
    last = taken(rows, plan, seed).where("extra").groupBy(*LEVELS).agg(F.max("place").alias("last_place"))
    cut = written(plan.join(last, list(LEVELS), "left").select(*LEVELS, "whole", "last_place"), "mix-cuts")
    names = {k: leaf[k] for k in LEVELS}
    placed = boxed(docs, doc_id=F.col("doc_id"), **names).join(cut, list(LEVELS))
    extra = F.coalesce(_place(F.col("whole"), seed) <= F.col("last_place"), F.lit(False)).cast("long")
    copies = F.sequence(F.lit(1).cast("long"), F.col("whole") + extra)
    return placed.where(F.col("whole") + extra > 0).select("row", F.explode(copies)).select("row.*")
