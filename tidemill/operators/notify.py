"""Alerts: who may raise one, when it waits, and what is still to be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from .aggregates import ordered_digest
from .leads import BUYERS, PRE_STAGES

MAX_AGE_HOURS = 24


def eligible(now: Column, ttl_hours: int) -> Column:
    """Whether a lead joined to its record may be alerted now: a fresh, open, accessible project that nobody has dealt with."""
    mark = F.col("user_mark")
    return F.coalesce(
        F.col("recommendation").isin("needs_review", "recommended") & F.col("demand_intent").isin(*BUYERS) & (F.col("engagement_type") == "project") & (mark.isNull() | (mark != "dismissed"))
        & F.col("sales_stage").isin(*PRE_STAGES) & (F.col("source_status") == "open") & (F.col("access_status") == "accessible") & (F.col("published_precision") == "exact")
        & F.col("record_published_at").between(clock.hours_before(now, MAX_AGE_HOURS), now) & (F.col("last_checked_at") >= clock.hours_before(now, ttl_hours)),
        F.lit(False),
    )


def created(events: DataFrame, toggles: dict[str, bool], quiet: tuple[str, str]) -> DataFrame:
    """Notifications with ``suppressed_reason`` and ``deferred_until``: a kind that is off leaves none, quiet hours defer to their end."""
    off = [k for k, on in toggles.items() if not on]
    still = clock.in_quiet_hours(F.col("at"), *quiet)
    reason = F.when(~F.col("kind").isin(*toggles), "unsupported_kind").when(still, "quiet_hours")
    return events.where(~F.col("kind").isin(*off) if off else F.lit(True)).withColumns({"suppressed_reason": reason, "deferred_until": F.when(reason == "quiet_hours", clock.quiet_end(F.col("at"), quiet[1]))})


def pending(notices: DataFrame, eligible_leads: DataFrame, now: Column, toggles: dict[str, bool], quiet: tuple[str, str]) -> DataFrame:
    """What may be delivered now: recent, of a kind that is on, neither sent nor suppressed but by quiet hours, and still about an eligible lead.

    Whether a lead is eligible is a mark on each notice, since other kinds need none.
    """
    marks = eligible_leads.select(F.col("id").alias("lead_id")).distinct().withColumn("_ok", F.lit(True))
    on = [k for k, v in toggles.items() if v]
    fits = F.col("suppressed_reason").isNull() | (F.col("suppressed_reason") == "quiet_hours") & F.col("deferred_until").isNotNull()
    rows = notices.join(marks, "lead_id", "left").where(
        (F.col("at") > clock.hours_before(now, MAX_AGE_HOURS)) & (F.col("at") <= now) & F.col("kind").isin(*on) & fits & (F.col("state") == "pending") & ((F.col("kind") != "new_review_lead") | F.col("_ok"))
    )
    return rows.where(~clock.in_quiet_hours(now, *quiet)).drop("_ok")


def delivery_states(log: DataFrame, now: Column) -> DataFrame:
    """State of each notice from a log of ``id, at, action, token``: pending, expired, suppressed, attempted, accepted, failed or unknown.

    The first claim within a day of creation wins, only its token settles, and
    the first settlement is final.
    """
    born = log.groupBy("id").agg(
        F.min(F.when(F.col("action") == "create", F.col("at"))).alias("created_at"), F.bool_or(F.col("action") == "suppress").alias("suppressed"),
        F.min(F.when(F.col("action") == "claim", F.struct("at", "token"))).alias("won"),
    )
    done = log.where(F.col("action").isin("accepted", "failed", "unknown")).join(born.select("id", F.col("won.token").alias("token"), F.col("won.at").alias("_from")), ["id", "token"]).where("at >= _from")
    final = done.groupBy("id").agg(F.min_by("action", F.struct("at", "action")).alias("final"))
    day = F.expr(f"INTERVAL {MAX_AGE_HOURS} HOURS")
    in_time = F.col("won").isNotNull() & (F.col("won.at") < F.col("created_at") + day)
    state = F.when(F.col("suppressed"), "suppressed").when(in_time & F.col("final").isNotNull(), F.col("final")).when(in_time, "attempted").when(F.col("created_at") + day <= now, "expired").otherwise("pending")
    return born.join(final, "id", "left").select("id", state.alias("state"))


def chat_batch(notices: DataFrame, connected_at: Column, batch: int = 10) -> DataFrame:
    """The next notices for a chat, none from before it was connected; a batch is a limit of the feature."""
    return notices.where(F.col("at") >= connected_at).orderBy("at", "id").limit(batch)


def monitoring(sources: DataFrame, last_runs: DataFrame, now: Column) -> DataFrame:
    """``id, state, overdue_seconds`` of every source: disabled, stopped, running, never, overdue (two minutes and more) or waiting."""
    both = sources.join(last_runs, sources["id"] == last_runs["source_id"], "left")
    every = F.make_dt_interval(secs=(F.coalesce("interval_minutes", F.lit(360)) * 60).cast("decimal(18,6)"))
    due = F.greatest(F.coalesce("finished_at", "created_at") + every, F.when(F.col("retry_after") > now, F.col("retry_after")))
    late = F.greatest(F.lit(0), F.floor(clock.seconds_between(due, now))).cast("long")
    state = (
        F.when(~F.col("enabled"), "disabled").when(F.col("stopped_reason").isNotNull() | ~F.coalesce(F.col("policy").isin("allowed", "restricted"), F.lit(False)), "stopped")
        .when(F.col("run_state").isin("queued", "running", "paused"), "running").when(F.col("run_state").isNull(), "never").when(late >= 120, "overdue").otherwise("waiting")
    )
    return both.select(sources["id"], state.alias("state"), F.when(state == "overdue", late).otherwise(0).cast("long").alias("overdue_seconds"))


# What a run may still be in, how often stored posts are rechecked, and the least wait before a run goes on.
ACTIVE = ("queued", "running", "paused")
RECHECK_HOURS = {"recheck_recent": 6, "recheck_stale": 24}
LEAST_DELAY = 60


def next_due(sources: DataFrame, runs: DataFrame, kinds: tuple[str, ...], now: Column) -> DataFrame:
    """``source_id, kind, due_at, bucket`` of every source (id, interval_minutes) and kind of run; null while one is active.

    The last run's end (or creation) and the kind's period give the time, or the
    delay that an interrupted discovery asks for; a source's retry time, of any
    kind of run, comes before none of them.  A kind that never ran is due now.
    ``bucket`` numbers the period of now: one run is made for each, however many
    were missed.
    """
    order = F.struct("created_at", "id")
    last = runs.groupBy("source_id", "kind").agg(F.max_by(F.struct("state", "created_at", "finished_at", "error_code", "continuation_pending", "continuation_delay"), order).alias("last"))
    cooling = runs.where(F.col("retry_after") > now).groupBy("source_id").agg(F.max("retry_after").alias("cooldown"))
    wanted = sources.select(F.col("id").alias("source_id"), F.coalesce("interval_minutes", F.lit(360)).alias("minutes"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    both = wanted.join(last, ["source_id", "kind"], "left").join(cooling, "source_id", "left")
    hours = F.create_map(*[F.lit(x) for kv in RECHECK_HOURS.items() for x in kv])
    seconds = F.when(F.col("kind") == "discovery", F.col("minutes") * 60).otherwise(F.try_element_at(hours, F.col("kind")) * 3600)
    goes_on = (F.col("kind") == "discovery") & (F.col("last.state") == "partial") & (F.coalesce("last.error_code", F.lit("")) == "") & F.col("last.continuation_pending")
    wait = F.when(F.coalesce(goes_on, F.lit(False)), F.greatest(F.lit(LEAST_DELAY), F.coalesce("last.continuation_delay", F.lit(LEAST_DELAY)))).otherwise(seconds)
    ended = F.coalesce("last.finished_at", "last.created_at")
    due = F.when(F.col("last").isNull(), now).otherwise(ended + F.make_dt_interval(secs=wait.cast("decimal(18,6)")))
    bucket = F.floor(F.unix_timestamp(now.cast("timestamp")) / seconds)
    return both.select("source_id", "kind", F.when(~F.coalesce(F.col("last.state").isin(*ACTIVE), F.lit(False)), F.greatest(due, F.col("cooldown"))).alias("due_at"), bucket.alias("bucket"))


def due_runs(due: DataFrame, made: DataFrame, now: Column) -> DataFrame:
    """The runs to make now: due ones whose period (``source_id, kind, bucket``) has none yet, so a gap of any length is caught up with once."""
    return due.where(F.col("due_at") <= now).join(made.select("source_id", "kind", "bucket"), ["source_id", "kind", "bucket"], "left_anti")


def quiet_summaries(notices: DataFrame, eligible_leads: DataFrame, now: Column, toggles: dict[str, bool], quiet: tuple[str, str]) -> DataFrame:
    """``kind, n, dedupe_key``: one summary for each kind that is on of what waited through the quiet hours and still holds.

    Notices (id, kind, lead_id, at, suppressed_reason, deferred_until, state,
    released) of the last day that are pending, deferred, not yet summed up and
    about an eligible lead count.  The key is a digest of their ids in order,
    so the same notices are summed up once.
    """
    on = [k for k, v in toggles.items() if v]
    fits = (F.col("at") > clock.hours_before(now, MAX_AGE_HOURS)) & (F.col("at") <= now) & (F.col("suppressed_reason") == "quiet_hours") & F.col("kind").isin(*on) & (F.col("state") == "pending") & F.col("deferred_until").isNotNull() & F.col("released").isNull()
    rows = notices.where(fits & ~clock.in_quiet_hours(now, *quiet)).join(eligible_leads.select(F.col("id").alias("lead_id")).distinct(), "lead_id", "left_semi")
    grouped = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), ordered_digest(F.col("id").cast("string")).alias("digest"))  # a night's notices
    return grouped.select("kind", "n", F.concat(F.lit("notify:quiet_summary:"), "kind", F.lit(":"), "digest").alias("dedupe_key"))
