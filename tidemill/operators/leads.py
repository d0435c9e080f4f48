"""The review queue: as-of-now columns, overlapping queues, filters, pages and counts.

Everything is a column expression over one row of leads joined to its primary
record, so any number of queues and filters costs one scan, and pages are a
top-k without a full sort.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.text import matches_all

# Closed vocabularies.
QUEUES = ("fresh", "recommended", "needs_review", "interested", "active", "dismissed", "auto_excluded", "all")
PRE_STAGES = ("new", "reviewing")
ACTIVE_STAGES = ("contacted", "negotiating", "won", "on_hold")
BUYERS = ("buyer_project", "buyer_ongoing")
REMOTE = ("any", "confirmed", "confirmed_or_inferred", "unknown", "onsite")
RECRUIT = ("any", "not_closed", "open_fresh", "recheck", "unknown", "closed", "access_issue")
INTENT = ("any", "buyer", "hiring", "seller", "other")
SORTS = ("priority", "published", "checked")
DAY_DEADLINE_SOURCE = "iboss"


class CursorError(ValueError):
    """A page cursor that does not fit the request."""


@dataclass(frozen=True)
class LeadFilter:
    """Validated filter values; lists are alternatives, different fields are all required."""

    keyword: str = ""
    source_id: str | None = None
    category: str | None = None
    remote: str = "any"
    recruit: str = "any"
    intent: str = "any"
    work_mode: tuple[str, ...] = ()
    source_status: tuple[str, ...] = ()
    sales_stage: tuple[str, ...] = ()
    pay_unit: tuple[str, ...] = ()
    recommendation: tuple[str, ...] = ()
    checked_since: datetime | None = None

    def __post_init__(self):
        for name, allowed in (("remote", REMOTE), ("recruit", RECRUIT), ("intent", INTENT)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is not one of {', '.join(allowed)}")


def with_effective(leads: DataFrame, now: datetime | str, ttl_hours: int) -> DataFrame:
    """Add ``expired, effective_status, recheck_due, effective_recommendation`` as of ``now``.

    A date-only deadline of the board source includes its whole local day; a
    check exactly ``ttl_hours`` old still counts.  Deadlines and publication
    come from the joined record's columns.
    """
    n = clock.at(now)
    expired = (
        (F.col("source_id") == DAY_DEADLINE_SOURCE)
        & F.col("source_status").isin("open", "unknown")
        & (F.col("deadline_precision") == "day")
        & (F.col("deadline_at") < clock.day_cutoff(n))
    )
    expired = F.coalesce(expired, F.lit(False))
    old = F.col("last_checked_at").isNull() | (F.col("last_checked_at") < clock.hours_before(n, ttl_hours))
    due = (F.col("source_status") == "open") & ~expired & old
    stale = (F.col("recommendation") == "recommended") & due
    return leads.withColumns(
        {
            "expired": expired,
            "effective_status": F.when(expired, "closed").otherwise(F.col("source_status")),
            "recheck_due": due,
            "effective_recommendation": F.when(expired, "excluded").when(stale, "needs_review").otherwise(F.col("recommendation")),
        }
    )


def not_dismissed() -> Column:
    mark = F.col("user_mark")
    return (mark.isNull() | (mark != "dismissed")) & (F.col("sales_stage") != "ignored")


def queue(name: str, now: datetime | str, ttl_hours: int) -> Column:
    """The predicate of a queue over :func:`with_effective` rows; unknown inputs never match."""
    n = clock.at(now)
    before_contact = F.col("sales_stage").isin(*PRE_STAGES)
    judged = {"recommended": "recommended", "needs_review": "needs_review", "auto_excluded": "excluded"}
    if name == "all":
        return F.lit(True)
    if name in judged:
        found = (F.col("effective_recommendation") == judged[name]) & not_dismissed() & before_contact
    elif name == "interested":
        found = (F.col("user_mark") == "interested") & before_contact
    elif name == "active":
        found = F.col("sales_stage").isin(*ACTIVE_STAGES)
    elif name == "dismissed":
        found = F.coalesce(F.col("user_mark") == "dismissed", F.lit(False)) | (F.col("sales_stage") == "ignored")
    elif name == "fresh":
        found = (
            F.col("effective_recommendation").isin("recommended", "needs_review")
            & not_dismissed()
            & before_contact
            & F.col("demand_intent").isin(*BUYERS)
            & (F.col("engagement_type") == "project")
            & (F.col("effective_status") == "open")
            & (F.col("access_status") == "accessible")
            & (F.col("last_checked_at") >= clock.hours_before(n, ttl_hours))
            & (F.col("published_precision") == "exact")
            & F.col("record_published_at").between(clock.hours_before(n, 24), n)
        )
    else:
        raise ValueError(f"no queue {name!r}; there are {', '.join(QUEUES)}")
    return F.coalesce(found, F.lit(False))


def filters(f: LeadFilter, now: datetime | str, ttl_hours: int) -> Column:
    """All of a filter's conditions over :func:`with_effective` rows."""
    cutoff = clock.hours_before(clock.at(now), ttl_hours)
    status, ok = F.col("effective_status"), F.col("access_status") == "accessible"
    closed, checked = status.isin("closed", "deleted"), F.col("last_checked_at")
    remote = {
        "confirmed": (F.col("work_mode") == "fully_remote") & F.col("work_mode_basis").isin("explicit", "user_confirmed"),
        "confirmed_or_inferred": F.col("work_mode") == "fully_remote",
        "unknown": F.col("work_mode") == "unknown",
        "onsite": (F.col("work_mode") == "onsite") | (F.col("collaboration_mode") == "onsite_required"),
    }
    recruit = {
        "not_closed": ~closed,
        "open_fresh": (status == "open") & ok & (checked >= cutoff),
        "recheck": (status == "open") & ok & (checked.isNull() | (checked < cutoff)),
        "unknown": (status == "unknown") & ok,
        "closed": closed,
        "access_issue": ~ok & ~closed,
    }
    intent = {"buyer": BUYERS, "hiring": ("employee_hiring",), "seller": ("seller_service",), "other": ("job_seeker", "information", "unknown")}
    found = [matches_all(F.col("search_text"), f.keyword)]
    if f.source_id:
        found.append(F.col("source_id") == f.source_id)
    if f.category:
        found.append(F.array_contains("categories", f.category))
    if f.remote != "any":
        found.append(remote[f.remote])
    if f.recruit != "any":
        found.append(recruit[f.recruit])
    if f.intent != "any":
        found.append(F.col("demand_intent").isin(*intent[f.intent]))
    for column, values in (("work_mode", f.work_mode), ("effective_status", f.source_status), ("sales_stage", f.sales_stage), ("pay_unit", f.pay_unit), ("effective_recommendation", f.recommendation)):
        if values:
            found.append(F.col(column).isin(*values))
    if f.checked_since:
        found.append(checked >= clock.at(f.checked_since))
    out = F.lit(True)
    for x in found:
        out = out & x
    return F.coalesce(out, F.lit(False))


def queue_counts(leads: DataFrame, now: datetime | str, ttl_hours: int, f: LeadFilter | None = None) -> DataFrame:
    """One row with the size of every queue among the filtered leads, in one scan."""
    rows = with_effective(leads, now, ttl_hours)
    if f:
        rows = rows.where(filters(f, now, ttl_hours))
    return rows.agg(*[F.count_if(queue(q, now, ttl_hours)).alias(q) for q in QUEUES])


def sort_key(sort: str) -> Column:
    return {"priority": F.coalesce(F.col("priority_total"), F.lit(-1)), "published": F.col("published_at"), "checked": F.col("last_checked_at")}[sort]


def filter_hash(queue_name: str, f: LeadFilter) -> str:
    """Twelve hex digits of the request without its cursor; a page belongs to one request."""
    asked = {"q": queue_name, **asdict(f)}
    return hashlib.sha1(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()[:12]


def encode_cursor(sort: str, value: object, lead_id: object, request: str) -> str:
    """URL-safe text of the last row shown; dates carry version 2 and microseconds."""
    dated = sort in ("published", "checked")
    key = {"s": sort, "v": value.isoformat(timespec="microseconds") if isinstance(value, datetime) else value, "id": str(lead_id), "h": request} | ({"cv": 2} if dated else {})
    return base64.urlsafe_b64encode(json.dumps(key, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, sort: str, request: str) -> tuple[object, str]:
    """The ``(key, id)`` to go on after; refuses another sort or filter, old versions, and dates without an offset."""
    try:
        c = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise CursorError("the cursor cannot be read") from e
    if not isinstance(c, dict):
        raise CursorError("the cursor cannot be read")
    if c.get("h") != request or c.get("s") != sort:
        raise CursorError("the cursor belongs to another sort or filter")
    if "v" not in c or not isinstance(c.get("id"), str) or not c["id"]:
        raise CursorError("the cursor has no place")
    if sort == "priority" or c["v"] is None and c.get("cv") == 2:
        return c["v"], c["id"]
    if c.get("cv") != 2:
        raise CursorError("the cursor is of an older version")
    try:
        at = datetime.fromisoformat(c["v"])
    except (TypeError, ValueError) as e:
        raise CursorError("the cursor holds no date") from e
    if at.tzinfo is None:
        raise CursorError("the cursor's date has no offset")
    return at, c["id"]


def page(leads: DataFrame, queue_name: str, now: datetime | str, ttl_hours: int, f: LeadFilter | None = None, sort: str | None = None, after: tuple[object, object] | None = None, limit: int = 50) -> DataFrame:
    """At most ``limit + 1`` leads after the ``(key, id)`` of the last one shown; the extra row tells of a next page.

    Largest key first, unknown keys last, ties by id downwards.
    """
    sort = sort or ("published" if queue_name == "fresh" else "priority")
    rows = with_effective(leads, now, ttl_hours).where(queue(queue_name, now, ttl_hours))
    if f:
        rows = rows.where(filters(f, now, ttl_hours))
    rows = rows.withColumn("sort_key", sort_key(sort))
    if after:
        key, last = after
        k = F.col("sort_key")
        if key is None:
            rows = rows.where(k.isNull() & (F.col("id") < last))
        else:
            value = clock.at(clock.utc(key)) if isinstance(key, datetime) else F.lit(key)
            rows = rows.where((k < value) | ((k == value) & (F.col("id") < last)) | k.isNull())
    return rows.orderBy(F.desc_nulls_last("sort_key"), F.desc("id")).limit(limit + 1)


def summary(leads: DataFrame, now: datetime | str, ttl_hours: int) -> DataFrame:
    """List projection: effective columns, up to three reasons led by what changed them, discovery delay."""
    rows = with_effective(leads, now, ttl_hours)
    lead_in = F.when(F.col("expired"), F.array(F.lit("deadline passed"))).when(F.col("recheck_due"), F.array(F.lit("recheck due"))).otherwise(F.array().cast("array<string>"))
    published = F.col("record_published_at")
    valid = (F.col("published_precision") == "exact") & (published <= F.col("first_seen_at")) & (published <= clock.at(now))
    return rows.withColumns(
        {
            "reasons": F.slice(F.concat(lead_in, F.coalesce("reasons", F.array().cast("array<string>"))), 1, 3),
            "discovery_seconds": F.when(valid, clock.seconds_between(published, F.col("first_seen_at"))),
        }
    )


def recruit_class() -> Column:
    """Display class, first that holds: closed, deleted, access_issue, open, recheck, unknown."""
    status = F.col("effective_status")
    return (
        F.when(status == "closed", "closed").when(status == "deleted", "deleted").when(F.col("access_status") != "accessible", "access_issue")
        .when((status == "open") & ~F.col("recheck_due"), "open").when(status == "open", "recheck").otherwise("unknown")
    )


def review_alert(now: datetime | str, ttl_hours: int) -> Column:
    """Whether a lead may raise an alert: in the fresh queue and not yet marked."""
    return queue("fresh", now, ttl_hours) & F.col("user_mark").isNull()


# --- projections ---------------------------------------------------------------


def fuzzy(at: Column, precision: Column, raw: Column) -> Column:
    """``at, precision, raw`` of a date; without a value its precision is unknown."""
    return F.struct(at.alias("at"), F.when(at.isNotNull(), precision).otherwise("unknown").alias("precision"), raw.alias("raw"))


def span(start: Column, end: Column) -> Column:
    """``start, end``, null unless both are known."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def remote_class() -> Column:
    """Display class: confirmed, inferred, partial, negotiable, onsite or unknown."""
    mode, sure = F.col("work_mode"), F.coalesce(F.col("work_mode_basis").isin("explicit", "user_confirmed"), F.lit(False))
    return F.when(mode == "fully_remote", F.when(sure, "confirmed").otherwise("inferred")).when(mode == "hybrid", "partial").when(mode.isin("negotiable", "onsite"), mode).otherwise("unknown")


def intent_class() -> Column:
    intent = F.col("demand_intent")
    return F.when(intent.isin(*BUYERS), "buyer").when(intent == "employee_hiring", "hiring").when(intent == "seller_service", "seller").otherwise("other")


def detail(leads: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Leads with each child table (``lead_id``, ...) as a sorted array of structs, empty without rows.

    Children are gathered by lead: what one page shows, of a lead's own size.
    """
    for name, (rows, order) in children.items():
        fields = order + [c for c in rows.columns if c != "lead_id" and c not in order]
        nested = rows.groupBy("lead_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)).withColumnRenamed("lead_id", "id")
        leads = leads.join(nested, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return leads


def candidate() -> Column:
    """Whether an application may be prepared: an open, accessible project of a buyer that nobody has dealt with."""
    mark = F.col("user_mark")
    return (
        F.col("recommendation").isin("recommended", "needs_review") & F.col("demand_intent").isin(*BUYERS) & (F.col("engagement_type") == "project") & (F.col("pay_unit") == "project")
        & (F.col("source_status") == "open") & (F.col("access_status") == "accessible") & F.col("sales_stage").isin(*PRE_STAGES) & (mark.isNull() | (mark != "dismissed"))
    )


def own_address(url: Column, host: str, path: str) -> Column:
    """Whether an address is an https page of ``host`` under ``path``, on the usual port and without a user."""
    dots = lambda x: x.replace(".", "[.]")
    return F.coalesce(url, F.lit("")).rlike(f"^(?i:https)://(?i:{dots(host)})(?::(?:0*443)?)?{dots(path)}")


def holds(now: datetime | str, ttl_hours: int, host: str, path: str, min_contract: int | None = None, skills: str = "") -> Column:
    """Codes of all that keeps an application from being sent, in a fixed order; each at most once.

    A row is a lead with its primary record (``record_id``, null without one)
    and ``ra``, what an analysis of that record says now (see ``judged``).
    Without a record only what does not ask about it is held.
    """
    n, ra = clock.at(now), F.col("ra")
    checked, published, has_record = F.col("last_checked_at"), F.col("record_published_at"), F.col("record_id").isNotNull()
    whole = has_record & candidate() & (F.col("record_source_status") == "open") & (F.col("record_access_status") == "accessible")
    of_record = {
        "source_body_missing": F.coalesce(F.col("body"), F.lit("")) == "",
        "recheck_required": checked.isNull() | (checked > n) | (checked < clock.hours_before(n, ttl_hours)),
        "publication_not_recent": (F.col("published_precision") != "exact") | published.isNull() | (published > n) | (published < clock.hours_before(n, 24)),
        "source_url_unverified": ~own_address(F.col("original_url"), host, path),
        "rules_ineligible": (ra["recommendation"] == "excluded") | ~ra["dev"] | (ra["pay_unit"] != "project"),
        "condition_review": F.exists(ra["tones"], lambda t: t.isin("caution", "negative")),
        "remote_unconfirmed": ra["work_mode"] != "fully_remote",
        "meeting_unconfirmed": ra["collaboration_mode"] != "online_only",
        "budget_unconfirmed": ra["pay_min"].isNull() | (ra["currency"] != "KRW"),
        "low_pay_review": ra["pay_score"] < 0,
        "below_min_contract": ra["pay_min"] < F.lit(min_contract),
        "questions_unanswered": ra["questions"] > 0,
        "profitability_unconfirmed": ra["profit"] != "calculated",
        "profitability_assumptions": ra["profit"] == "calculated",
    }
    at_all = {
        "source_permission_unverified": ~F.col("policy").eqNullSafe("allowed"), "profile_incomplete": F.lit(not skills.strip()), "profile_not_approved": F.lit(True),
        "submission_path_unverified": F.lit(True), "draft_only": F.lit(True),
    }
    codes = {"not_candidate": ~F.coalesce(whole, F.lit(False))} | {k: has_record & c for k, c in of_record.items()} | at_all
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in codes.items()]))


def judged(analysed: DataFrame) -> DataFrame:
    """``id, ra``: what ``holds`` asks of an analysis."""
    fields = {
        "recommendation": "recommendation", "dev": "category.dev", "pay_unit": "pay.unit", "pay_min": "pay.min", "currency": "pay.currency", "work_mode": "work.value",
        "collaboration_mode": "collab.value", "pay_score": "pay_factor.score", "profit": "profit.status",
    }
    tones = F.transform("reasons", lambda r: r["tone"]).alias("tones")
    return analysed.select("id", F.struct(*[F.col(c).alias(k) for k, c in fields.items()], tones, F.size("questions").alias("questions")).alias("ra"))


def in_collection_scope() -> Column:
    """Communities that are read: approved ones, and those only collected from once joined for certain."""
    return F.col("status").isin("eligible", "approved") | ((F.col("status") == "collect_only") & collectable())


def collectable() -> Column:
    return F.col("joined").eqNullSafe(True)


def coherent() -> Column:
    """Whether an observation's count is there exactly while it watches."""
    return F.col("count").isNotNull() == F.col("watching")


def public_events(events: DataFrame, private: str = "native_delivery") -> DataFrame:
    """Events without the private key of their payload map."""
    return events.withColumn("payload", F.map_filter("payload", lambda k, _: k != private))
