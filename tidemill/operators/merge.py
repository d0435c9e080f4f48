"""Set operations, upserts and folds: each takes tables and returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """New rows replace old ones of the same key, except the columns to ``keep``, which stay as first seen.

    Several new rows of a key: the last by ``batch_order`` wins; the result lacks that column.
    """
    values = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch_order")).alias("n"))
    before = old.select(*keys, F.struct(*values).alias("o"))
    both = before.join(last, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in values])


def change_types(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: created, updated or unchanged by content digest."""
    before = old.select(key, F.col(digest).alias("_old"))
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col(digest), "unchanged").otherwise("updated")
    return new.join(before, key, "left").select(key, change.alias("change"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those new rows whose key is new; rows without a key always go in, repeats once."""
    keyed = new.where(F.col(key).isNotNull()).join(old.select(key), key, "left_anti").dropDuplicates([key])
    return old.unionByName(keyed.select(old.columns)).unionByName(new.where(F.col(key).isNull()).select(old.columns))


def paths(sightings: DataFrame, keys: list[str], at: str) -> DataFrame:
    """How often and when first and last each path led to a record."""
    return sightings.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("times_seen"))


def trim_events(events: DataFrame, keep: int = 5000) -> DataFrame:
    """Drop events older than the last ``keep`` sequence numbers, except those that guard against repeats."""
    top = events.agg(F.max("seq")).first()[0] or 0
    return events.where((F.col("seq") > top - keep) | F.col("dedupe_key").isNotNull())


def expire_bodies(records: DataFrame, now: Column) -> DataFrame:
    """Forget bodies past their retention unless the lead is marked or in progress."""
    kept = F.coalesce(F.col("user_mark") == "interested", F.lit(False)) | F.col("sales_stage").isin("contacted", "negotiating", "won", "on_hold")
    gone = (F.col("retained_until") < now) & ~kept
    return records.withColumns({"body": F.when(gone, None).otherwise(F.col("body")), "search_text": F.when(gone, F.lower("title")).otherwise(F.col("search_text"))})


def keyed_max(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Restore merge: the larger of each counter where both sides have the key."""
    left, right = (df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in columns]) for df, p in ((a, "a"), (b, "b")))
    return left.join(right, key, "full_outer").select(key, *[F.greatest(f"a_{c}", f"b_{c}").alias(c) for c in columns])


def patch_activity(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row ``key, field, old, new`` for every field that a patch changed."""
    pairs = before.select(key, *[F.col(f).alias(f"o_{f}") for f in fields]).join(after.select(key, *fields), key)
    changed = [F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new"))) for f in fields]
    return pairs.select(key, F.explode(F.array_compact(F.array(*changed))).alias("c")).select(key, "c.*")


def cycle_state(due: DataFrame, done: DataFrame, unit: list[str]) -> DataFrame:
    """One row: how many due units a cycle still lacks and whether it is complete."""
    left = due.select(*unit).distinct().join(done.select(*unit).distinct(), unit, "left_anti")
    return left.agg(F.count(F.lit(1)).alias("open_units"), (F.count(F.lit(1)) == 0).alias("complete"))
