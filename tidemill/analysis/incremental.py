"""Analyses kept beside their posts: only what changed, or what time has changed, is analysed again.

A cache key stands for everything that an analysis of a post depends on but
the clock: the rule tables, the user's profile, and the post's inputs.  The
clock counts only in steps (an age, a check that grows stale, a deadline that
passes), so each analysis also holds until when it is valid.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from . import rules
from .score import OPTIONAL, Profile, _complete, applied

#: Hours of age at which a post's freshness changes.
AGES = (24, 72, 168)
INPUTS = ("title", "body", "observed_at", *OPTIONAL)
OWN = ("cache_key", "analysed_at", "valid_until")


def rules_version() -> str:
    """A name for the rule tables as they are now: another for any change of any value."""
    tables = {k: v for k, v in vars(rules).items() if k.isupper()}
    return hashlib.sha256(repr(sorted(tables.items())).encode()).hexdigest()[:16]


def cache_key(profile: Profile, ttl_hours: int, version: str | None = None) -> Column:
    """sha256 over the rules, the profile and the columns INPUTS of a row; null and empty values differ."""
    fixed = repr((version or rules_version(), sorted(asdict(profile).items()), ttl_hours))
    return F.sha2(F.to_json(F.struct(F.lit(fixed).alias("fixed"), *INPUTS), {"ignoreNullFields": "false"}), 256)


def _valid_until(now: Column, ttl_hours: int) -> Column:
    """The first moment after ``now`` at which the clock alone changes an analysis; null if none does."""
    hours = lambda n: F.expr(f"INTERVAL {int(n)} HOURS")
    born = F.coalesce("published_at", F.when(F.col("source_kind") != "manual", F.col("first_seen_at")))
    steps = [born + hours(n) for n in AGES] + [F.col("last_checked_at") + hours(ttl_hours), F.col("deadline.at") + hours(24)]
    return F.array_min(F.filter(F.array(*steps), lambda at: at >= now))


def analysed(posts: DataFrame, profile: Profile, now: datetime | str, ttl_hours: int = 24) -> DataFrame:
    """Every post analysed, with its cache key and how long it holds: the table that ``reanalysed`` carries on."""
    at = clock.at(now)
    keyed = _complete(posts).withColumn("cache_key", cache_key(profile, ttl_hours))
    return applied(keyed, profile, now, ttl_hours).withColumns({"analysed_at": at, "valid_until": _valid_until(at, ttl_hours)})


def reanalysed(stored: DataFrame, posts: DataFrame, profile: Profile, now: datetime | str, ttl_hours: int = 24) -> DataFrame:
    """The table of analyses for ``posts`` (unique ids) at ``now``, of which ``stored`` holds what still stands.

    A post is analysed anew if its key differs or is new, or if its analysis
    has run out or lies ahead of ``now``; posts that are gone go.  Only keys
    and ids meet to find that out; no text that stands is analysed or moved by
    this join.
    """
    at = clock.at(now)
    keys = _complete(posts).select("id", cache_key(profile, ttl_hours).alias("cache_key"))
    old = stored.select("id", *[F.col(c).alias(f"_{c}") for c in OWN])
    stands = (F.col("cache_key") == F.col("_cache_key")) & (F.col("_analysed_at") <= at) & F.coalesce(F.col("_valid_until") >= at, F.lit(True))
    judged = keys.join(old, "id", "left").select("id", F.coalesce(stands, F.lit(False)).alias("stands"))
    again = analysed(posts.join(judged.where("not stands").select("id"), "id", "left_semi"), profile, now, ttl_hours)
    kept = stored.join(judged.where("stands").select("id"), "id", "left_semi")
    return kept.select(*again.columns).unionByName(again)
