"""Joins with the shapes the review data needs, each as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key
from ..storage import settled
from .similar import SHARE, gram_sets, similar_pairs


def mark(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: whether a row of ``right`` has the keys.  EXISTS for use under OR."""
    marks = right.select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(marks, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without_any(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``left`` that match no row of ``right`` on any one of the keys.

    NOT EXISTS (a = a OR b = b) as a chain of anti-joins instead of a nested loop.
    """
    for key in keys:
        left = left.join(right.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    return left


def first_after(left: DataFrame, events: DataFrame, key: str, since: str, at: str, until: Column) -> DataFrame:
    """Add ``first_at``: for each left row its key's earliest event at or after its own ``since`` and not after ``until``.

    Bounds and events are laid in one order of time; a window looks ahead from
    every bound, so a key with many bounds and events costs their sum.
    """
    bounds = left.select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.struct(*left.columns).alias("_row"))
    happened = events.where(F.col(at) <= until).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(None).cast(bounds.schema["_row"].dataType).alias("_row"))
    ahead = Window.partitionBy("_k").orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = bounds.unionByName(happened).withColumn("first_at", F.min(F.when(F.col("_row").isNull(), F.col("_t"))).over(ahead))
    return found.where(F.col("_row").isNotNull()).select("_row.*", "first_at")


def pair_key(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges as (low, high), self-edges dropped."""
    return edges.where(F.col(a) != F.col(b)).withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})


def edge_decision(edges: DataFrame) -> DataFrame:
    """Per pair: number of edges, the oldest edge and the state of the latest decision.

    Latest: largest (revision, dismissed, confirmed, created_at, id), so a dismissal wins a tie.
    """
    order = F.struct("revision", F.col("dismissed"), F.col("confirmed"), "created_at", "id")
    oldest = F.min_by("id", F.struct("created_at", "id"))
    state = F.when(F.col("dismissed"), "dismissed").when(F.col("confirmed"), "confirmed").otherwise("candidate")
    return edges.groupBy("low", "high").agg(F.count(F.lit(1)).alias("edges"), oldest.alias("primary_id"), F.max_by(state, order).alias("decision"))


def dedup_key(source: Column, post_id: Column, url: Column, digest: Column) -> Column:
    """Identity of a post: source and id, else canonical URL, else content."""
    return F.when(post_id.isNotNull(), F.concat_ws("|", F.lit("id"), source, post_id)).when(url.isNotNull(), F.concat_ws("|", F.lit("url"), source, url)).otherwise(F.concat_ws("|", F.lit("hash"), source, digest))


def existing(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` with ``existing_id``: the stored record of the same identity; both have source_id, post_id, url, digest."""
    key = dedup_key(F.col("source_id"), F.col("post_id"), F.col("url"), F.col("digest"))
    known = stored.select(key.alias("_key"), F.col("id").alias("existing_id")).groupBy("_key").agg(F.min("existing_id").alias("existing_id"))
    return new.withColumn("_key", key).join(known, "_key", "left").drop("_key")


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each value of ``on`` and in ``size`` how many rows hold it.

    A group of more than one in SHARE of all these rows meets them by broadcast,
    so no task gets all rows of a large group.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.broadcast(groups.where(F.col(size) * SHARE > total))
    return rows.join(large, on).unionByName(rows.join(large.select(on), on, "left_anti").join(groups, on))


def candidate_links(records: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Possible duplicates among ``id, title, body, digest``: equal title, and equal content or similar body.

    Gives members ``id, other`` - each record beside the first one of its title
    and content - and links ``low, high, similarity`` between such first ones
    whose bodies share ``least`` of their trigrams.  A link of a first one holds
    for all its members, so both together are all pairs.  Titles are compared by
    their letters and digits; a title without any, or null, is like another
    such.  A record without a digest is compared by its body alone.  Bodies move
    only where a title has two different contents.
    """
    key = F.sha2(F.coalesce(title_key(F.col("title")), F.lit("")), 256)
    rows = records.select("id", key.alias("key"), F.coalesce(F.col("digest"), F.concat(F.lit("of "), F.col("id").cast("string"))).alias("digest"))
    first = settled(rows.groupBy("key", "digest").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("n")))
    members = with_groups(rows, first.where("n > 1"), ["key", "digest"], "n").where("id <> other").select("id", "other")
    shared = settled(first.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1"))
    compared = with_groups(first.select("key", F.col("other").alias("id")), shared, ["key"], "contents")
    bodies = compared.join(records.select("id", "body"), "id")
    return members, similar_pairs(gram_sets(bodies.select("key", "id", "body")), least)


def uncooled(queued: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Queued runs whose source has no other run with a retry time ahead; runs without a source never wait."""
    cooling = runs.where(F.col("retry_after") > now).select("source_id").where("source_id is not null").distinct()
    return queued.join(cooling, "source_id", "left_anti").select(queued.columns)


def expand_plan(regions: DataFrame, groups: DataFrame) -> DataFrame:
    """Exploration tasks: every region with every keyword of every enabled group.

    Both sides are configuration, of a few hundred rows at most.
    """
    terms = groups.where("enabled").select("query_group", F.explode(F.filter("keywords", lambda k: F.trim(k) != "")).alias("keyword"))
    return regions.join(F.broadcast(terms))
