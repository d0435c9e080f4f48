"""Figures about reviews, sources and runs; every aggregate combines before it shuffles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..storage import settled
from .percentiles import exact_ranks, middle

# Activities that count as a review, and stages that confirm a fit.
REVIEW_KINDS = ("user_mark", "sales_stage", "memo", "feedback")
FIT_STAGES = ("contacted", "negotiating", "won")


def reviews(leads: DataFrame, activities: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row: leads reviewed in the last ``days``, how many fit, and the median hours from discovery to the first review after it.

    Activities join leads by id after they are cut to one minimum per lead and
    discovery, so a busy lead costs no more than its activities once.  The
    median is counted, not sorted (``percentiles``).
    """
    mine = activities.where(F.col("kind").isin(*REVIEW_KINDS) & (F.col("at") <= now))
    recent = mine.where(F.col("at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")).select("lead_id").distinct()
    reviewed = leads.join(recent, leads["id"] == recent["lead_id"], "left_semi")
    after = mine.join(reviewed.select(F.col("id").alias("lead_id"), "first_seen_at"), "lead_id").where(F.col("at") >= F.col("first_seen_at"))
    first = after.groupBy("lead_id").agg(F.min("at").alias("first_at"))
    rows = reviewed.join(first, reviewed["id"] == first["lead_id"], "left")
    fit = (F.col("user_mark") == "interested") | F.col("sales_stage").isin(*FIT_STAGES)
    rows = settled(rows.select(fit.alias("fit"), F.timestamp_diff("MICROSECOND", F.col("first_seen_at"), F.col("first_at")).alias("wait")))
    hours = exact_ranks(rows, [], "wait", middle(F.col("n"))).select(F.bround((F.col("low") / 3.6e9 + F.col("high") / 3.6e9) / 2, 1).alias("median_hours_to_review"))
    counts = rows.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if("fit").alias("confirmed_fit"))
    return counts.join(F.broadcast(hours))  # a row each


def false_positives(feedback: DataFrame) -> DataFrame:
    """One row: how often users denied remote work, and a real request."""
    return feedback.agg(
        F.count_if((F.col("kind") == "remote") & (F.col("value") == "denied")).alias("remote_false_positive"),
        F.count_if((F.col("kind") == "real_request") & (F.col("value") == "no")).alias("buyer_false_positive"),
    )


def call_cost(calls: DataFrame, cost: str) -> DataFrame:
    """One row: calls, and their cost - 0 without a call, null if any cost is unknown."""
    known = F.sum(F.col(cost).cast("decimal(38,0)"))
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.when(F.count(F.lit(1)) == 0, 0).when(F.count_if(F.col(cost).isNull()) == 0, known).cast("long").alias("cost"))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def coverage(tasks: DataFrame, plan: DataFrame, unit: list[str]) -> DataFrame:
    """One row: planned units of the newest cycle by state; a unit is blocked over failed over done, and pending without a task.

    The newest cycle is the largest ``scan_cycle``; tasks outside the plan do not count.
    """
    newest = tasks.agg(F.max("scan_cycle").alias("scan_cycle"))
    here = tasks.join(F.broadcast(newest), "scan_cycle", "left_semi").join(plan.select(*unit).distinct(), unit, "left_semi")
    state = here.groupBy(*unit).agg(F.bool_or(F.col("state") == "blocked").alias("b"), F.bool_or(F.col("state") == "failed").alias("f"), F.bool_and(F.col("state") == "done").alias("d"))
    rows = plan.select(*unit).distinct().join(state, unit, "left")
    one = F.when(F.col("b"), "blocked").when(F.col("f"), "failed").when(F.col("d"), "done").otherwise("pending")
    return rows.select(one.alias("s")).agg(F.count(F.lit(1)).alias("planned"), *[F.count_if(F.col("s") == k).alias(k) for k in ("done", "blocked", "failed", "pending")])


def cycle_days(runs: DataFrame, planned: int, completed: int, depth: float, daily: int) -> DataFrame:
    """One row: requests of the runs, requests a unit, and the days that a whole cycle takes at ``daily`` requests."""
    requests = F.coalesce(F.sum(F.get_json_object("counts", "$.requests").try_cast("long")), F.lit(0))
    per_unit = requests / completed if completed else F.lit(float(depth))
    days = F.bround(planned * per_unit / daily, 1) if daily and planned else F.lit(None).cast("double")
    return runs.agg(requests.alias("requests"), per_unit.cast("double").alias("per_unit"), days.alias("estimated_days"))


def host_budget(counters: DataFrame, hosts: Iterable[str], day: Column, daily: int) -> DataFrame:
    """One row: requests used on the day by the hosts, and their limit together."""
    hosts = list(hosts)
    return counters.agg(F.coalesce(F.sum(F.when(F.col("host").isin(*hosts) & (F.col("day") == day), F.col("used"))), F.lit(0)).alias("used"), F.lit(daily * len(hosts)).alias("limit"))


def covered(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """One row: how many of the known values the rows hold."""
    return rows.select(column).distinct().join(known.select(column).distinct(), column, "left_semi").agg(F.count(F.lit(1)).alias("covered"))


def capped_issues(issues: DataFrame, run: str, order: list[str], most: int = 50) -> DataFrame:
    """The first issues of each run with the count of all of them: a report with a limit; only what is listed is ever brought together."""
    first = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    listed = issues.withColumn("place", first).where(F.col("place") <= most)
    counts = issues.groupBy(run).agg(F.count(F.lit(1)).alias("issue_count"))
    return listed.join(counts, run)


def list_requests(anchors: DataFrame, interval_minutes: int, seconds_each: float, sitemap_minutes: int) -> DataFrame:
    """One row: list requests a day, from the anchors' tiers in minutes (0: every watch) and two for every sitemap poll."""
    tier = F.col("tier_minutes")
    each = F.when(tier > 0, F.least(F.lit(1.0), interval_minutes / tier)).otherwise(1.0)
    period = anchors.agg((F.lit(float(interval_minutes)) + F.sum(each) * (seconds_each + 1) / 60).alias("period"))
    feeds = anchors.crossJoin(F.broadcast(period)).agg(F.sum(1440 / F.greatest("period", tier.cast("double"))).alias("feeds"))  # one row on the right
    return feeds.select(F.ceil(F.col("feeds") + F.lit(1440 / max(interval_minutes, sitemap_minutes) * 2)).cast("long").alias("daily_requests"))


def reserved_polls(now: Column, interval_minutes: Column, maps: Column) -> Column:
    """Requests to keep for list polls until the UTC day ends: one for each map and one more, for each poll left."""
    left = F.lit(86400) - clock.seconds_between(F.date_trunc("day", now).cast("timestamp_ntz"), now)
    every = F.greatest(F.lit(30), F.coalesce(interval_minutes, F.lit(30))) * 60
    return (F.greatest(F.lit(0), F.ceil(left / every) - 1) * (F.greatest(F.lit(1), maps) + 1)).cast("long")


def sales_period(now: Column, days: int = 30) -> tuple[Column, Column]:
    """First and last local day of the period; today counts as the last."""
    end = clock.local_day(now)
    return F.date_sub(end, days - 1), end
