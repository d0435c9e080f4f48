"""From observed posts to stored records: what changed, what is asked again, who goes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.text import canonical_url, ref_key, title_key

# Outcomes that wait a day and those that wait six hours before another try.
DAY_OUTCOMES = ("http_404", "http_410", "collection_disallowed", "hidden_or_deleted")
HOURS_OUTCOMES = ("parse_error", "collection_permission_unknown")
KEEP_IF_NULL = ("original_url", "canonical_url", "posted_region")


def overwrite(stored: DataFrame, parsed: DataFrame, key: str, keep: tuple[str, ...] = KEEP_IF_NULL) -> DataFrame:
    """Stored records with what was parsed anew; only ``keep`` columns fall back to the stored value where the new one is missing."""
    values = [c for c in parsed.columns if c != key]
    new = parsed.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in values])
    both = stored.join(new, key, "left")
    pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in keep else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(key, *[(pick(c) if c in values else F.col(c)).alias(c) for c in stored.columns if c != key])


def backoff_hours(outcome: Column, failures: Column) -> Column:
    """Hours until a failed detail is asked again: a day where it is gone, six where it cannot be read, else doubling up to a day."""
    doubling = F.least(F.lit(24), F.pow(F.lit(2), F.least(failures - 1, F.lit(5))).cast("int"))
    return F.when(outcome == "ok", F.lit(None)).when(outcome.isin(*DAY_OUTCOMES), 24).when(outcome.isin(*HOURS_OUTCOMES), 6).otherwise(doubling).cast("int")


def http_outcome(status: Column, challenged: Column) -> Column:
    """``outcome, stop, halt`` of a response.

    A login that is asked for, a refusal or a challenge stops the source; too
    many requests halt the run until its retry time; the rest is the page's own fate.
    """
    outcome = (
        F.when(status == 401, "login_required").when(status == 403, "http_403").when(status == 429, "rate_limited").when(status == 404, "not_found").when(status == 410, "gone")
        .when(status >= 500, "server_error").when(status >= 400, "client_error").when(status.isNull(), "network_error").when(challenged, "blocked").otherwise("ok")
    )
    return F.struct(outcome.alias("outcome"), outcome.isin("login_required", "http_403", "blocked").alias("stop"), F.coalesce(status == 429, F.lit(False)).alias("halt"))


def retry_after(header: Column, now: Column, default_minutes: int = 30) -> Column:
    """When to ask again: a number of seconds, an HTTP date, or half an hour from now."""
    seconds = now + F.make_dt_interval(secs=header.try_cast("int").cast("decimal(18,6)"))
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(seconds, date, now + F.expr(f"INTERVAL {int(default_minutes)} MINUTES"))


def ref_changed(url: Column, title: Column, updated: Column, known_url: Column, known_title: Column, known_updated: Column, checked: Column) -> Column:
    """Whether a listing says that its post changed: another address or title, another update time, or an update after the last check."""
    moved = (known_url != "") & (canonical_url(url) != canonical_url(known_url))
    renamed = (title != "") & (known_title != "") & (title_key(title) != title_key(known_title))
    newer = F.when(updated.isNotNull(), F.when(known_updated.isNotNull(), updated != known_updated).otherwise(updated > checked))
    return F.coalesce(moved, F.lit(False)) | F.coalesce(renamed, F.lit(False)) | F.coalesce(newer, F.lit(False))


def needs_refresh(changed: Column, recommendation: Column, checked: Column, retry_at: Column, accessible: Column, now: Column, hours: int = 12, excluded_hours: int = 48, parsed_by: Column | None = None, parser: str | None = None) -> Column:
    """Whether a detail is asked again: never before its retry time unless it changed; else when changed, unreadable so far, too old, or read by another parser than ``parser``."""
    every = F.when(recommendation == "excluded", excluded_hours).otherwise(hours)
    old = checked.isNull() | (clock.seconds_between(checked, now) >= every * 3600)
    deferred = F.coalesce(now < retry_at, F.lit(False)) & ~changed
    outdated = F.lit(False) if parsed_by is None else ~parsed_by.eqNullSafe(F.lit(parser))
    return ~deferred & (changed | ~F.coalesce(accessible, F.lit(False)) | old | outdated)


def visits(refs: DataFrame, attempts: DataFrame, records: DataFrame) -> DataFrame:
    """``refs`` (post_id, url) with ``ref_key, visited_at``: the last attempt, else when the record was last checked."""
    keyed = refs.withColumn("ref_key", ref_key(F.col("post_id"), canonical_url(F.col("url"))))
    tried = attempts.groupBy("ref_key").agg(F.max("attempted_at").alias("_tried"))
    checked = records.select(ref_key(F.col("post_id"), canonical_url(F.col("url"))).alias("ref_key"), "last_checked_at").groupBy("ref_key").agg(F.max("last_checked_at").alias("_checked"))
    return keyed.join(tried, "ref_key", "left").join(checked, "ref_key", "left").withColumn("visited_at", F.coalesce("_tried", "_checked")).drop("_tried", "_checked")


def recheck_targets(leads: DataFrame, deferred: DataFrame, now: Column, ttl_hours: int, recent: bool, batch: int, days: int = 7) -> DataFrame:
    """The next leads to check again: open or unknown, half their time gone; never checked first, oldest first; deferred ones wait.

    A batch is what one run takes: a limit of the feature.
    """
    cut = now - F.expr(f"INTERVAL {int(days)} DAYS")
    due = leads.where(F.col("source_status").isin("open", "unknown") & (F.col("last_checked_at").isNull() | (F.col("last_checked_at") < now - F.expr(f"INTERVAL {int(ttl_hours * 30)} MINUTES"))))
    kind = (F.col("first_seen_at") >= cut) & F.col("recommendation").isin("recommended", "needs_review") if recent else F.col("first_seen_at") < cut
    return due.where(kind).join(deferred, "id", "left_anti").orderBy(F.col("last_checked_at").asc_nulls_first(), "id").limit(batch)


def synced(registry: DataFrame, declared: DataFrame, key: str, owned: tuple[str, ...]) -> DataFrame:
    """The registry with declared sources added and their ``owned`` columns renewed; all else stays as the user set it."""
    new = declared.select(key, *[F.col(c).alias(f"_{c}") for c in declared.columns if c != key])
    both = registry.withColumn("_old", F.lit(True)).join(new, key, "full_outer")

    def pick(c: str) -> Column:
        if c not in declared.columns:
            return F.col(c)
        return F.coalesce(F.col(f"_{c}"), F.col(c)) if c in owned else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}"))

    return both.select(key, *[pick(c).alias(c) for c in registry.columns if c != key])


def with_access(records: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Records with their last reported access; an access error never closes a post."""
    last = events.groupBy(key).agg(F.max_by("access_status", F.struct("at", "access_status")).alias("_access"))
    return records.join(last, key, "left").withColumn("access_status", F.coalesce("_access", "access_status")).drop("_access")


def revalidated(status: Column, parsed_status: Column, deletion_reliable: bool) -> Column:
    """``source_status, access_status`` after another look: gone pages count as deleted only where the source says so reliably."""
    gone = status.isin(404, 410)
    ok = status.between(200, 299)
    source = F.when(gone & F.lit(deletion_reliable), "deleted").when(ok, parsed_status)
    return F.struct(source.alias("source_status"), F.when(ok | gone & F.lit(deletion_reliable), "accessible").otherwise("error").alias("access_status"))


# The statuses that a user may ask for, and the kinds of boards that make a community worth collecting from.
SETTABLE = ("candidate", "excluded", "approved", "collect_only")
RELATED_KINDS = ("job_seek", "job_offer", "free")


def transitions(rows: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests ``key, wanted`` on communities ``key, status, joined, allowed_boards, related_boards``, applied and refused.

    A user may drop or exclude a community at any time.  Collecting from one
    needs that it is joined, not excluded and has a related board; approval
    needs that it is joined, eligible or approved by now, and has a board that
    allows posts.  What the rules say of a community (eligible, needs_join) is
    found, never asked for.  Applied: ``key, status, approves, withdraws`` -
    the last says that its boards lose their approval.  Refused: ``key,
    status, wanted, code``.
    """
    both = asked.join(rows, key, "left")
    wanted, status, joined = F.col("wanted"), F.col("status"), F.col("joined").eqNullSafe(True)
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    code = (
        F.when(status.isNull(), "not_found").when(~F.coalesce(wanted.isin(*SETTABLE), F.lit(False)), "invalid_transition")
        .when((wanted == "collect_only") & ~(joined & (status != "excluded") & some("related_boards")), "collection_unverified")
        .when((wanted == "approved") & ~(joined & status.isin("eligible", "approved") & some("allowed_boards")), "rule_unverified")
    )
    judged = both.select(key, "status", "wanted", code.alias("code"))
    kept = judged.where("code is null").select(key, F.col("wanted").alias("status"), (F.col("wanted") == "approved").alias("approves"), (F.col("wanted") != "approved").alias("withdraws"))
    return kept, judged.where("code is not null")


def discovered(stored: DataFrame, seen: DataFrame, key: str, auto_approve: bool = False) -> DataFrame:
    """Communities ``key, name, members, joined, status, allowed_boards`` after a survey that names any of these anew (null: not named).

    A found ban always wins.  What the user chose - excluded, approved, only
    collected from - stands against any other finding, but a community that is
    no longer joined is not collected from, and one that is not joined or has
    no board left that allows posts loses its approval.
    """
    fields = ("name", "members", "joined", "status", "allowed_boards")
    new = seen.select(key, F.lit(True).alias("_seen"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = stored.join(new, key, "full_outer")
    merged = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields if c != "status"}
    found, before = F.coalesce("_status", F.lit("candidate")), F.coalesce("status", F.lit("candidate"))
    status = F.when(found == "excluded", found).when(before.isin("excluded", "approved", "collect_only"), before).otherwise(found)
    rows = both.select(key, "_seen", F.col("status").alias("_before"), *[v.alias(c) for c, v in merged.items()], status.alias("status"))
    joined, status = F.col("joined").eqNullSafe(True), F.col("status")
    left = F.when(F.col("joined").eqNullSafe(False), "needs_join").otherwise("candidate")
    unfit = ~joined | ~F.coalesce(F.col("allowed_boards") > 0, F.lit(False))
    after = F.when((status == "collect_only") & ~joined, left).when((status == "approved") & unfit, "candidate").when((status == "eligible") & F.lit(auto_approve), "approved").otherwise(status)
    return rows.select(key, "name", "members", "joined", F.when(F.col("_seen"), after).otherwise(F.col("_before")).alias("status"), "allowed_boards")


def discovered_boards(stored: DataFrame, seen: DataFrame, communities: DataFrame) -> DataFrame:
    """Boards ``url, community, name, kind, evidence, post_allowed, approved`` after a survey.

    ``communities`` (community, status) are those whose boards were surveyed.
    A board of theirs that was not seen is revoked and of kind ``other``; a seen
    one is renewed and keeps its approval only if it allows posts and its
    community is approved.
    """
    fields = ("community", "name", "kind", "evidence", "post_allowed")
    new = seen.select("url", F.lit(True).alias("_seen"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = stored.join(new, "url", "full_outer").withColumn("community", F.coalesce("_community", "community"))
    both = both.join(communities.select("community", F.col("status").alias("_status")), "community", "left")
    here, gone = F.col("_seen").eqNullSafe(True), F.col("_seen").isNull() & F.col("_status").isNotNull()
    pick = lambda c, lost: F.when(here, F.col(f"_{c}")).when(gone, lost).otherwise(F.col(c)).alias(c)
    kept = F.coalesce(F.col("approved"), F.lit(False)) & F.when(here, F.col("_post_allowed") & (F.col("_status") == "approved")).otherwise(~gone)
    return both.select("url", "community", pick("name", F.col("name")), pick("kind", F.lit("other")), pick("evidence", F.lit(None)), pick("post_allowed", F.lit(False)), F.coalesce(kept, F.lit(False)).alias("approved"))


def one_approved(boards: DataFrame, community: str, order: list[Column]) -> DataFrame:
    """Boards with at most one approved in each community: the first in ``order``."""
    first = F.row_number().over(Window.partitionBy(community, "approved").orderBy(*order)) == 1
    return boards.withColumn("approved", F.col("approved") & first)


def union_first(preferred: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the preferred side wins, and each key stays once."""
    both = preferred.withColumn("_rank", F.lit(0)).unionByName(others.withColumn("_rank", F.lit(1)))
    values = F.struct(*[c for c in preferred.columns if c != key])
    return both.groupBy(key).agg(F.min_by(values, F.struct(F.col("_rank"), values)).alias("v")).select(key, "v.*")


def promoted(comments: DataFrame, leads: DataFrame) -> DataFrame:
    """Comments that become leads: only requests whose lead does not exist yet."""
    return comments.where("classification = 'request'").join(leads.select("source_post_id"), F.concat(F.lit("cafe-comment:"), F.col("id")) == F.col("source_post_id"), "left_anti")


def synced_leads(leads: DataFrame, records: DataFrame) -> DataFrame:
    """Leads brought in line with their primary records: title, status, access, dates, and the lower-case text that is searched."""
    new = records.select(
        F.col("id").alias("primary_record_id"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in ("title", "source_status", "access_status", "last_checked_at", "published_at")],
        F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))).alias("_search_text"),
    )
    both = leads.join(new, "primary_record_id", "left")
    renewed = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("title", "source_status", "access_status", "last_checked_at", "published_at", "search_text")}
    return both.select(*[renewed[c].alias(c) if c in renewed else F.col(c) for c in leads.columns])


def stopped_analyses(leads: DataFrame, analyses: DataFrame, engine: str) -> DataFrame:
    """Leads whose analysis still waits for an engine that was turned off go on with the rules' own."""
    waiting = analyses.where((F.col("engine") == engine) & (F.col("status") == "pending")).select(F.col("id").alias("analysis_id")).distinct().withColumn("_waits", F.lit(True))
    rows = leads.join(waiting, "analysis_id", "left")
    status = F.when(F.col("_waits") & (F.col("analysis_status") == "pending"), "rules_only").otherwise(F.col("analysis_status"))
    return rows.withColumn("analysis_status", status).select(*leads.columns)
