"""Board listings page by page: what was read without a gap, why the walk ended, and each post's first place.

A landed page (``board, page`` - unique - ``links, current, empty, bare,
cards``) links to others by number, says by an explicit marker that it is
empty, or, past a board's end, is bare and points back to the last page.  A
walk starts at page 1 and goes on only to the next number; the rule needs no
loop, since a page is reached exactly if all pages before it lead on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_outcome() -> Column:
    """``next``, ``end``, ``after_last``, or why a page can not be trusted: ``unclear``, ``gap``, ``empty_with_next``."""
    ahead = F.array_min(F.filter(F.coalesce("links", F.array().cast("array<int>")), lambda n: n > F.col("page")))
    none, current = F.size(F.coalesce("cards", F.array().cast("array<string>"))) == 0, F.col("current")
    back = F.coalesce("bare", F.lit(False)) & (current < F.col("page")) & F.forall(F.coalesce("links", F.array().cast("array<int>")), lambda n: n <= current)
    return (
        F.when(none & ~F.coalesce("empty", F.lit(False)), F.when(F.coalesce(back, F.lit(False)), "after_last").otherwise("unclear"))
        .when(ahead > F.col("page") + 1, "gap").when(ahead.isNotNull() & none, "empty_with_next").when(ahead.isNotNull(), "next").otherwise("end")
    )


def walked(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``board, page`` of the pages that count as read, and ``board, pages, outcome`` of every board.

    A board is ``complete`` if its walk came to an end; else its outcome is the
    page's that stopped it, ``missing_page`` if that was never landed.
    """
    rows = pages.select("board", "page", page_outcome().alias("outcome"))
    order = Window.partitionBy("board").orderBy("page")
    leads_on = F.min((F.col("outcome") == "next").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reached = (F.col("page") == F.row_number().over(order)) & (F.coalesce(leads_on, F.lit(1)) == 1)
    rows = rows.withColumn("reached", reached)
    read = rows.where(F.col("reached") & F.col("outcome").isin("next", "end", "after_last")).select("board", "page")
    last = F.max_by("outcome", F.when(F.col("reached"), F.col("page")))
    ended = F.when(last.isNull() | (last == "next"), "missing_page").when(last.isin("end", "after_last"), "complete").otherwise(last)
    counted = F.count_if(F.col("reached") & F.col("outcome").isin("next", "end", "after_last"))
    return read, rows.groupBy("board").agg(counted.alias("pages"), ended.alias("outcome"))


def listed(pages: DataFrame, read: DataFrame) -> DataFrame:
    """``board, post_id, page, place`` of every post on pages that were read: its first place on its board."""
    cards = pages.select("board", "page", "cards").join(read, ["board", "page"], "left_semi").select("board", "page", F.posexplode("cards").alias("place", "post_id"))
    return cards.groupBy("board", "post_id").agg(F.min(F.struct("page", "place")).alias("first")).select("board", "post_id", "first.page", "first.place")
