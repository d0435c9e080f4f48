"""Communities: comments, boards that are read to the end, and posts that are watched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.web import comment_class


def comment_key(external_id: Column, post_url: Column, written_at: Column, body: Column) -> Column:
    """A comment's own id, else sha256 over post, time and text."""
    stamp = F.date_format(written_at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(external_id, F.sha2(F.concat_ws("\n", post_url, F.concat(stamp, F.lit("+00:00")), body), 256))


def upsert_comments(stored: DataFrame, read: DataFrame) -> DataFrame:
    """Stored comments with those read on pages: ``attempt_id, key, body, classification, is_new``.

    A comment keeps its identity and takes its newest text; the reader's own
    ones are left out.
    """
    keyed = read.where(~F.coalesce(F.col("is_own"), F.lit(False))).withColumn("key", comment_key(F.col("external_id"), F.col("post_url"), F.col("written_at"), F.col("body")))
    new = keyed.groupBy("attempt_id", "key").agg(F.max_by("body", F.struct("read_at", "body")).alias("_body"))
    both = stored.select("attempt_id", "key", "body", F.lit(True).alias("_old")).join(new, ["attempt_id", "key"], "full_outer")
    body = F.coalesce("_body", "body")
    return both.select("attempt_id", "key", body.alias("body"), comment_class(body).alias("classification"), F.col("_old").isNull().alias("is_new"))


def read_coverage(read: DataFrame, reported: DataFrame) -> DataFrame:
    """How many comments of each post were read, by own id or by time and text, and whether the app shows more."""
    one = F.coalesce(F.concat(F.lit("i"), "external_id"), F.concat_ws("\n", F.lit("t"), F.col("written_at").cast("string"), F.col("body")))
    counts = read.groupBy("attempt_id").agg(F.count_distinct(one).alias("read_count"))
    both = reported.join(counts, "attempt_id", "left").withColumn("read_count", F.coalesce("read_count", F.lit(0)))
    return both.select("attempt_id", "read_count", (F.col("reported_count").isNull() | (F.col("reported_count") > F.col("read_count"))).alias("needs_app_check"))


def monitor_due(attempts: DataFrame, checks: DataFrame, now: Column, interval_minutes: int, days: int = 60) -> DataFrame:
    """Posts whose comments are read again: posted, not older than ``days``, and not read within the interval."""
    live = attempts.where(F.col("status").isin("posted", "posted_mismatch") & (F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))
    last = checks.groupBy("attempt_id").agg(F.max("checked_at").alias("last"))
    due = F.col("last").isNull() | (F.col("last") + F.expr(f"INTERVAL {int(interval_minutes)} MINUTES") <= now)
    return live.join(last, "attempt_id", "left").where(due).drop("last")


def checkpoints(boards: DataFrame, pages: DataFrame) -> DataFrame:
    """Boards' checkpoints after a scan: they move to its time only where every page of the board was read to the end."""
    scans = pages.groupBy("board").agg(F.bool_and("complete").alias("whole"), F.max("read_at").alias("read_at"))
    moved = F.when(F.col("whole"), F.greatest("checkpoint", "read_at")).otherwise(F.col("checkpoint"))
    return boards.join(scans, "board", "left").select("board", moved.alias("checkpoint"))


def rescanned(posts: DataFrame, checkpoint: Column, now: Column, days: int = 30) -> DataFrame:
    """Posts of the last ``days`` that a scan reads again."""
    return posts.where(F.col("written_at").between(now - F.expr(f"INTERVAL {int(days)} DAYS"), now) & (checkpoint.isNull() | (F.col("written_at") >= checkpoint - F.expr(f"INTERVAL {int(days)} DAYS"))))


def allowance(candidates: DataFrame, by: str, order: list[Column], cap: int, base: int, known: int = 1) -> DataFrame:
    """What a watch may fetch of each source: as many unseen posts as ``base`` and their number allow under ``cap``, and at most ``known`` seen ones.

    Ranks come from windows over each source's candidates of one run.
    """
    w = Window.partitionBy(by)
    unseen = F.sum((~F.col("seen")).cast("int")).over(w)
    rank = F.row_number().over(w.orderBy(F.col("seen"), *order))
    among = F.row_number().over(Window.partitionBy(by, "seen").orderBy(*order))
    rows = candidates.withColumns({"_limit": F.least(F.lit(cap), base + unseen), "_rank": rank, "_among": among})
    return rows.where((F.col("_rank") <= F.col("_limit")) & (~F.col("seen") | (F.col("_among") <= known))).drop("_limit", "_rank", "_among")
