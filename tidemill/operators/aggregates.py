"""Aggregates over review data; all combine before they shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import seconds_between
from ..functions.money import poisoned_sum


def money_by(outcomes: DataFrame, by: str, kinds: Iterable[str]) -> DataFrame:
    """Per currency (or other group) and kind: total, known total, records and missing amounts, side by side."""
    out = []
    for kind in kinds:
        out += [c.alias(f"{kind}_{name}") for name, c in poisoned_sum(F.col("amount"), F.col("kind") == kind).items()]
    return outcomes.groupBy(by).agg(*out)


def discovery_delays(records: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """Per source: records, valid samples, median and nearest-rank 95th percentile in seconds, and early shares.

    A sample counts if its publication is exact and not after its discovery.
    With ``now``, only records discovered in the last ``days``.  Delays are
    counted by value first; sums of those counts place the percentiles, so no
    source's delays are held together.
    """
    if now is not None:
        records = records.where(F.col("first_seen_at").between(now - F.expr(f"INTERVAL {int(days)} DAYS"), now))
    delay = seconds_between(F.col("published_at"), F.col("first_seen_at"))
    sample = F.when((F.col("published_precision") == "exact") & (F.col("published_at") <= F.col("first_seen_at")), delay)
    by_value = records.groupBy("source_id", sample.alias("delay")).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("delay").isNotNull(), F.col("n")).otherwise(0)
    w = Window.partitionBy("source_id")
    placed = by_value.withColumns({"samples": F.sum(known).over(w), "upto": F.sum(known).over(w.orderBy(F.col("delay").asc_nulls_first()))})
    at = lambda place: F.min(F.when(F.col("delay").isNotNull() & (F.col("upto") > place), F.col("delay")))
    n = F.col("samples")
    count = lambda limit: F.coalesce(F.sum(F.when(F.col("delay") <= limit, F.col("n"))), F.lit(0))
    return placed.groupBy("source_id").agg(
        F.sum("n").alias("records"),
        F.max("samples").alias("samples"),
        (F.sum("n") - F.max("samples")).alias("unavailable"),
        F.bround((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 3).alias("median_seconds"),
        F.bround(at(F.ceil(n * 0.95) - 1), 3).alias("p95_seconds"),
        count(900).alias("within_15_minutes"),
        count(3600).alias("within_1_hour"),
    )


def counter_sums(runs: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Sums of named counters of a map column; a missing key counts 0."""
    return runs.agg(*[F.coalesce(F.sum(F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))), F.lit(0)).alias(k) for k in keys])


def unit_states(tasks: DataFrame, unit: list[str]) -> DataFrame:
    """State of each unit from its tasks: blocked over failed over done (if all are) over pending."""
    states = tasks.groupBy(*unit).agg(F.bool_or(F.col("state") == "blocked").alias("b"), F.bool_or(F.col("state") == "failed").alias("f"), F.bool_and(F.col("state") == "done").alias("d"), F.count(F.lit(1)).alias("tasks"))
    return states.select(*unit, F.when(F.col("b"), "blocked").when(F.col("f"), "failed").when(F.col("d"), "done").otherwise("pending").alias("unit_state"), "tasks")


def latency_bucket(ms: Column) -> Column:
    return F.when(ms < 10, "<10").when(ms < 100, "<100").when(ms < 1000, "<1000").otherwise(">=1000")


def ledger_periods(attempts: DataFrame) -> DataFrame:
    """Cost ledger by day and by month at once: grouping sets over one scan."""
    rows = attempts.withColumn("month", F.date_format("day", "yyyy-MM"))
    total = lambda state: F.coalesce(F.sum(F.when(F.col("state") == state, F.col("cost"))), F.lit(0))
    grouped = rows.groupingSets([[F.col("day")], [F.col("month")]], F.col("day"), F.col("month"))
    return grouped.agg(total("settled").alias("estimated"), total("reserved").alias("reserved"), total("uncertain").alias("uncertain"), F.count(F.lit(1)).alias("attempts"))


def known_total(factors: Column, risks: Column) -> Column:
    """Sum of known scores less 15 a risk, at least 0; null if no score is known."""
    known = F.filter(factors, lambda x: x["score"].isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda s, x: s + x["score"].cast("long"))
    return F.when(F.size(known) > 0, F.greatest(F.lit(0).cast("long"), total - 15 * F.size(risks)))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Latest value per lead and kind; a kind whose latest value is ``clear`` is gone."""
    last = feedback.groupBy("lead_id", "kind").agg(F.max_by("value", F.struct("created_at", "id")).alias("value"))
    return last.where("value <> 'clear'")


def ordered_digest(key: str | Column) -> Column:
    """sha256 over a group's sorted keys, one a line; an exact contract that needs them together, so for groups of bounded size."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256)


def set_digest(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """A digest of each group's set of keys that needs no order: count and sum of 128 bits of every distinct key's hash.

    For groups of any size; equal sets give equal digests.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.select(*by, key).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("digest"))
