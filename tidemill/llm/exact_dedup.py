"""Exact deduplication by progressive refinement.

Lengths are counted first, then hashes of a short prefix among the rows whose
length repeats, and only rows that still share both have their whole text
hashed.  What one step finds reaches the next as a bitmap of bounded size, so
no text and no row is shuffled to be told that it goes on; a row that the
bitmap lets through by chance is hashed in vain and changes nothing.  Every
grouping is an aggregate with map-side combining, so a text that a third of
the rows repeat reaches the reducers as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, boxed, group_join, marked, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def survivor_digests(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``id, text_sha256, tag`` of all rows whose length and prefix another row shares; tag: a short hash of the text."""
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    rows = text.select("id", "t", F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix"))
    short = written(rows.select("len", "prefix"), "dedup-short")
    lengths = bitmap(_repeated(short, ["len"]))
    likely = marked(short, lengths, F.col("len")).where("mark")
    both = written(bitmap(_repeated(likely, ["len", "prefix"])), "dedup-marks")
    left = marked(rows, both, F.col("len"), F.col("prefix")).where("mark")
    return left.select("id", F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("tag"))


def duplicate_groups(whole: DataFrame) -> DataFrame:
    """``text_sha256, keep_id, group_size`` of every text that two or more rows of :func:`survivor_digests` share.

    Empty and null texts are equal.  ``keep_id`` is the largest id; rows whose
    id is null count in ``group_size`` but are never kept over one with an id.
    An empty table gives no groups.
    """
    return whole.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """All rows and columns of ``docs`` that stay: of equal texts the largest id.

    Rows without a text count as empty.  Rows that repeat both id and text are
    told apart by nothing and so share one fate; rows without an id go when
    their text has a row with one, else they stay.  Only rows that may have to
    go are shuffled with their text.
    """
    whole = written(survivor_digests(docs, id_col, text_col, prefix_chars), "dedup-digests")
    groups = written(duplicate_groups(whole), "dedup-groups")
    gone = group_join(whole, groups, "text_sha256", "group_size", "id").where(F.col("keep_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "tag").distinct()
    gone = written(gone, "dedup-gone")
    marks = written(bitmap(gone.select("id")), "dedup-gone-marks")
    rows = marked(boxed(docs, id=F.col(id_col)), marks, F.col("id"))
    doubted = rows.where("mark").withColumn("tag", F.xxhash64(normalised(F.col(f"row.`{text_col}`"))))
    gone = gone.withColumnsRenamed({"id": "gone_id", "tag": "gone_tag"})
    stay = doubted.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("tag") == F.col("gone_tag")), "left_anti")
    return rows.where(~F.col("mark")).select("row.*").unionByName(stay.select("row.*"))


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = written(duplicate_groups(survivor_digests(docs, id_col, text_col, prefix_chars)), "dedup-groups")
    digests = docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    keep = F.coalesce("keep_id", "id")
    return group_join(digests, groups, "text_sha256", "group_size", "id").select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
