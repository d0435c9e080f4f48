"""From a post to a recommendation: eligibility, explainable scores, pay checks, scenarios and questions.

``analyze`` is a pure DataFrame transform: a change of profile or rules means
running it again over the stored posts.  Scores are weights of the product, no
chances; what is unknown stays null and is not made up for by the rest.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.matches import both, has, let
from ..functions.money import won
from ..functions.text import first_sentence
from . import classify, dates, rules as R
from .classify import Post, judged
from .pay import parse_pay, pay_short, wording_wage
from .scan import scan

BUYERS = ("buyer_project", "buyer_ongoing")


@dataclass(frozen=True)
class Profile:
    """What the user offers and will not do; amounts that are not given are None."""

    services: tuple[str, ...] = ()
    excluded_work: str = ""
    min_contract: int | None = None
    target_hourly: int | None = None
    onsite: str = "no"

    def __post_init__(self):
        if self.onsite not in ("no", "first_meeting", "yes"):
            raise ValueError(f"onsite: {self.onsite!r}")


#: Columns that a table of posts may leave out, with their types.
OPTIONAL = {
    "source_status": "string", "access_status": "string", "last_checked_at": "timestamp_ntz", "published_at": "timestamp_ntz", "first_seen_at": "timestamp_ntz", "source_kind": "string",
    "collection_allowed": "boolean", "pay_hint": "struct<raw:string,currency:string,min:bigint,max:bigint,unit:string,negotiable:boolean,start:int>", "remote_feedback": "string", "request_feedback": "string",
    "deadline_hint": "struct<at:timestamp_ntz,precision:string,raw:string,start:int>",
}


def _texts(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]))


def resolve_pay(hint: Column, body_pay: Column) -> Column:
    """``pay, conflict, from_site``: the site's pay where it says anything, else the body's; conflict where their amounts exclude each other."""
    says = hint.isNotNull() & ((F.btrim(F.coalesce(hint["raw"], F.lit(""))) != "") | hint["min"].isNotNull() | hint["max"].isNotNull() | (hint["unit"] != "unknown") | hint["negotiable"])
    both_known = (hint["min"].isNotNull() | hint["max"].isNotNull()) & (body_pay["min"].isNotNull() | body_pay["max"].isNotNull())
    apart = F.coalesce(hint["max"] < body_pay["min"], F.lit(False)) | F.coalesce(body_pay["max"] < hint["min"], F.lit(False))
    text = F.concat(F.lit(R.SAY["pay_conflict"]), pay_short(hint), F.lit(R.SAY["pay_conflict_body"]), pay_short(body_pay))
    says = F.coalesce(says, F.lit(False))
    return F.struct(F.when(says, hint).otherwise(body_pay).alias("pay"), F.when(says & both_known & (hint["currency"] == body_pay["currency"]) & apart, text).alias("conflict"), says.alias("from_site"))


def excluded_hit(text: Column, profile: Profile) -> Column:
    words = [w for w in (k.strip() for k in profile.excluded_work.replace("\n", ",").split(",")) if len(w) >= 2]
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def score_work_fit(names: Column, dev: Column, profile: Profile, hit: Column) -> Column:
    matched = F.size(F.array_intersect(names, F.array(*map(F.lit, profile.services)).cast("array<string>")))
    offered = F.when(matched > 0, F.least(F.lit(R.WORK_FIT), 24 + 3 * matched)).otherwise(16) if profile.services else F.lit(20)
    return F.when(hit.isNotNull(), 0).when(~dev, F.when(F.array_contains(names, "data"), 12).otherwise(3)).otherwise(offered)


def score_intent(intent: Column, engagement_value: Column) -> Column:
    v, explicit = intent["value"], F.coalesce(intent["basis"] == "explicit", F.lit(False))
    return (
        F.when(v == "buyer_project", F.when(explicit, 23).otherwise(18)).when(v == "buyer_ongoing", F.when(explicit, 21).otherwise(16))
        .when(v == "employee_hiring", F.when(engagement_value == "full_time", 4).otherwise(8)).when(v.isin("seller_service", "job_seeker", "information"), 0)
    )


def score_remote(work: Column, collab_value: Column, profile: Profile) -> Column:
    sure = F.coalesce(work["basis"].isin("explicit", "user_confirmed"), F.lit(False))
    points = F.when(work["value"] == "fully_remote", F.when(sure, F.when(collab_value == "online_only", 20).otherwise(17)).otherwise(8)).when(work["value"] == "hybrid", 8).otherwise(10)
    cap = {"no": 8, "first_meeting": 15, "yes": 18}[profile.onsite]
    return F.when(work["value"] == "unknown", F.lit(None)).when(work["value"] == "onsite", 0).otherwise(F.when(collab_value == "onsite_required", F.least(points, F.lit(cap))).otherwise(points))


def score_freshness(now: Column, ttl_hours: int) -> Column:
    """15, 12, 8 or 4 by age; at most 8 if only the discovery is known; 6 less where the post was not checked in time."""
    published, seen, checked = F.col("published_at"), F.col("first_seen_at"), F.col("last_checked_at")
    ref = F.when(published.isNotNull(), published).when(F.col("source_kind") != "manual", seen)
    hours = F.greatest(F.lit(0.0), clock.seconds_between(ref, now) / 3600)
    points = F.when(hours <= 24, 15).when(hours <= 72, 12).when(hours <= 168, 8).otherwise(4)
    points = F.when(published.isNull(), F.least(points, F.lit(8))).otherwise(points)
    stale = checked.isNull() | (clock.seconds_between(checked, now) > ttl_hours * 3600)
    return F.when(F.col("source_status").isin("closed", "deleted"), 0).when(ref.isNull(), F.lit(None)).otherwise(F.when(stale, F.greatest(F.lit(0), points - 6)).otherwise(points))


def score_clarity(p: Post, pay: Column) -> Column:
    signs, body = sum((p.asked(f"clarity {k}").cast("int") for k in range(len(R.CLARITY))), F.lit(0)), both(p.body)
    return F.least(F.lit(R.SCOPE_CLARITY), 2 * signs + (pay["min"].isNotNull() | pay["max"].isNotNull()).cast("int") + (F.length(body) > 120).cast("int"))


def base_hours(names: Column, clarity: Column) -> Column:
    """Hours of the first category, a fifth more where the scope is unclear."""
    table = F.create_map(*[F.lit(x) for k, v in R.BASE_HOURS.items() for x in (k, float(v))])
    first = F.get(F.filter(names, lambda n: n.isin(*R.BASE_HOURS)), F.lit(0))
    return F.try_element_at(table, F.coalesce(first, F.lit("other"))) * F.when(clarity < 4, 1.2).otherwise(1.0)


def pay_priority(pay: Column, names: Column, profile: Profile, clarity: Column, total: Column, conflict: Column) -> Column:
    """``score, ratio``: how far a small budget caps the total, as a negative number; null where the budget is not known."""
    floor = F.lit(max(100_000, profile.min_contract or 0))
    if profile.target_hourly and profile.target_hourly > 0:
        floor = F.greatest(floor, F.greatest(F.lit(1), F.bround(base_hours(names, clarity) * 0.75, 0).cast("int")) * profile.target_hourly)
    known = conflict.isNull() & (pay["currency"] == "KRW") & (pay["unit"] == "project") & pay["max"].isNotNull()
    ratio = pay["max"] / floor
    cap = F.when(ratio < 0.25, 39).when(ratio < 0.5, 59).when(ratio < 1, 74).otherwise(100)
    score = -F.greatest(F.lit(0), F.coalesce(total, F.lit(0)) - cap)
    return F.struct(F.when(known, score).cast("int").alias("score"), F.when(known, ratio).alias("ratio"))


def contract_floor(pay: Column, floor: int | None) -> Column:
    """What to say where a project's pay does not surely reach the user's least contract; null otherwise."""
    if not floor or floor <= 0:
        return F.lit(None).cast("string")
    setting = F.concat(F.lit(R.FLOOR["setting"]), won(F.lit(floor)))
    short = F.concat(pay_short(pay), F.lit(", "), setting, F.lit(")"))
    lo, hi, say = pay["min"], pay["max"], {k: F.lit(v) for k, v in R.FLOOR.items()}
    text = (
        F.when(hi < floor, F.concat(say["below"], short)).when(lo.isNotNull() & hi.isNotNull(), F.concat(say["across"], short)).when(lo.isNotNull(), F.concat(say["low_bound"], short))
        .when(hi.isNotNull(), F.concat(say["no_low"], won(hi), F.lit(", "), setting, F.lit(")")))
        .otherwise(F.concat(F.when(pay["negotiable"], say["open"]).otherwise(say["none"]), say["check"], setting, F.lit(")")))
    )
    return F.when((pay["unit"] == "project") & ~F.coalesce(lo >= floor, F.lit(False)), text)


def profitability(pay: Column, names: Column, intent_value: Column, profile: Profile, clarity: Column, conflict: Column) -> Column:
    """``status, revenue_type, scenarios``: calculated from a project's price, a hypothesis from the user's hourly value, or not calculated."""
    target = profile.target_hourly
    base = base_hours(names, clarity)
    hours = {"conservative": F.bround(base * 1.35, 0), "base": F.bround(base, 0), "optimistic": F.greatest(F.lit(1.0), F.bround(base * 0.75, 0))}
    lo, hi = F.coalesce(pay["min"], pay["max"]), F.coalesce(pay["max"], pay["min"])
    value = {"conservative": lo, "base": F.floor((lo + hi) / 2), "optimistic": hi}
    null = F.lit(None).cast("long")

    def scenario(key: str, worth: Column, priced: bool) -> Column:
        h = hours[key].cast("long")
        rest = worth - F.bround(h * target, 0).cast("long") if priced and target else null
        hourly = F.bround(worth / h, 0).cast("long") if priced else null
        return F.struct(F.lit(key).alias("key"), worth.cast("long").alias("contract_value"), h.alias("hours"), (worth if priced else null).cast("long").alias("contribution"), hourly.alias("effective_hourly"), rest.cast("long").alias("residual_after_target"))

    priced = F.array(*[scenario(k, value[k], True) for k in hours])
    guessed = F.array(*[scenario(k, F.bround(hours[k] * target, -4).cast("long"), False) for k in hours]) if target else F.slice(priced, 1, 0)
    known = (pay["unit"] == "project") & lo.isNotNull() & conflict.isNull()
    guess = pay["unit"].isin("project", "negotiable", "unknown") & lo.isNull() & intent_value.startswith("buyer") & F.lit(bool(target)) & conflict.isNull()
    once = (pay["unit"] == "project") & lo.isNotNull()
    revenue = F.when(once, "one_time").when((intent_value == "buyer_ongoing") | (pay["unit"] == "month"), "recurring").when(pay["unit"] == "project", "one_time").otherwise("unknown")
    return F.struct(
        F.when(known, "calculated").when(guess, "hypothesis").otherwise("not_calculated").alias("status"), revenue.alias("revenue_type"),
        F.when(known, priced).when(guess, guessed).otherwise(F.slice(priced, 1, 0)).alias("scenarios"),
    )


#: The column that holds what the tables found in a post.
SCANNED = "_scanned"


def scanned(posts: DataFrame) -> DataFrame:
    """``posts`` with what the tables find in them, read once."""
    return posts if SCANNED in posts.columns else posts.withColumn(SCANNED, scan(F.col("title"), F.col("body"), F.col("pay_hint")["raw"]))


def _complete(posts: DataFrame) -> DataFrame:
    """``posts`` with the columns of OPTIONAL that they lack."""
    assumed = {"source_status": "unknown", "access_status": "accessible", "source_kind": "site"}
    return posts.withColumns({name: F.lit(assumed.get(name)).cast(kind) for name, kind in OPTIONAL.items() if name not in posts.columns})


def analyze(posts: DataFrame, profile: Profile, now: datetime | str, ttl_hours: int = 24) -> DataFrame:
    """``posts`` (id, title, body, observed_at and any of OPTIONAL) with every judgement and the recommendation."""
    posts = _complete(posts)
    n, p, col = clock.at(now), Post(F.col("title"), F.col("body"), F.col(SCANNED)), F.col
    body, whole = both(p.body), F.concat_ws("\n", both(p.title), both(p.body))
    a = scanned(posts).withColumns({"category": classify.categories(p), "not_ordered": classify.non_delivery(p), "asked": classify.intent(p), "work": classify.work_mode(p), "scope": classify.applicant_scope(p), "risks": classify.risks(p)})
    a = a.withColumn("asked", F.when(col("not_ordered").isNotNull(), judged("unknown", None)).otherwise(col("asked")))
    a = a.withColumn("engagement", classify.engagement(p, col("asked.value"))).withColumn("collab", classify.collaboration(p, col("work.value")))
    # What the user has confirmed stands above the text.
    said, real = col("remote_feedback"), col("request_feedback")
    mine = lambda value: judged(value, "user_confirmed")
    a = a.withColumns(
        {
            "collab": F.when((said == "confirmed") & (col("collab.value") == "unknown"), mine("online_only")).otherwise(col("collab")),
            "work": F.when(said == "confirmed", mine("fully_remote")).when(said == "denied", mine("onsite")).otherwise(col("work")),
            "asked": F.when((real == "yes") & ~col("asked.value").startswith("buyer"), mine("buyer_project")).otherwise(col("asked")),
        }
    )
    a = a.withColumns({"body_pay": parse_pay(p.scan), "deadline": F.coalesce("deadline_hint", dates.parse_deadline(p.scan, col("observed_at"))), "work_start": dates.parse_work_start(p.scan, col("observed_at")), "closed_mark": dates.closed_marker(p.scan, both(p.title)), "excluded_word": excluded_hit(whole, profile)})
    a = a.withColumn("resolved", resolve_pay(col("pay_hint"), col("body_pay")))
    pay, conflict, names, dev = col("resolved.pay"), col("resolved.conflict"), col("category.names"), col("category.dev")
    a = a.withColumn(
        "factors",
        F.struct(
            score_work_fit(names, dev, profile, col("excluded_word")).alias("work_fit"), score_intent(col("asked"), col("engagement.value")).alias("buyer_intent"),
            score_remote(col("work"), col("collab.value"), profile).alias("remote_fit"), score_freshness(n, ttl_hours).alias("freshness"), score_clarity(p, pay).alias("scope_clarity"),
        ),
    )
    five = F.array(*[col(f"factors.{k}") for k in ("work_fit", "buyer_intent", "remote_fit", "freshness", "scope_clarity")])
    clarity = col("factors.scope_clarity")
    plain = F.aggregate(F.array_compact(five), F.lit(0), lambda s, x: s + x) - R.RISK_PENALTY * F.size("risks")
    a = a.withColumn("plain_total", F.when(F.size(F.array_compact(five)) > 0, F.greatest(F.lit(0), plain)))
    a = a.withColumn("pay_factor", pay_priority(pay, names, profile, clarity, col("plain_total"), conflict))
    a = a.withColumns(
        {
            "total": F.greatest(F.lit(0), col("plain_total") + F.coalesce(col("pay_factor.score"), F.lit(0))),
            "unknown_factors": F.size(five) - F.size(F.array_compact(five)) + col("pay_factor.score").isNull().cast("int"),
            "time_unit": F.when(pay["unit"].isin(*R.TIME_PAY), pay["unit"]).otherwise(F.coalesce(F.when(col("resolved.from_site"), p.scan["wage_hint"]).otherwise(wording_wage(p.scan)), p.scan["wage_body"], p.scan["wage_title"])),
            "floor_text": contract_floor(pay, profile.min_contract),
            "low_text": F.when(col("pay_factor.ratio") < 0.25, R.SAY["very_low"]),
            "profit": profitability(pay, names, col("asked.value"), profile, clarity, conflict),
        }
    )
    say = {k: F.lit(v) for k, v in R.SAY.items()}
    status, access, asked, work, collab = col("source_status"), col("access_status"), col("asked.value"), col("work"), col("collab.value")
    fresh = F.coalesce(clock.seconds_between(col("last_checked_at"), n) <= ttl_hours * 3600, F.lit(False))
    real_yes = F.coalesce(real == "yes", F.lit(False))
    sure = F.coalesce(work["basis"].isin("explicit", "user_confirmed"), F.lit(False))
    wage_names = F.create_map(*[F.lit(x) for kv in R.TIME_PAY.items() for x in kv])
    exclude = _texts(
        (status == "closed", F.concat(say["closed"], F.when(col("closed_mark").isNotNull(), say["closed_marked"]).otherwise(""))),
        (status == "deleted", say["deleted"]),
        (~col("collection_allowed"), say["not_allowed"]),
        (classify.salary_named(p) | has(pay["raw"], R.SALARY), say["salary"]),
        (col("time_unit").isNotNull(), F.concat(F.try_element_at(wage_names, col("time_unit")), say["by_time"])),
        (col("time_unit").isNull() & (pay["unit"] != "project"), say["no_project_pay"]),
        (asked == "seller_service", say["seller"]),
        (asked == "job_seeker", say["seeker"]),
        (work["value"] == "onsite", say["onsite"]),
        (col("engagement.value") == "full_time", F.concat(say["full_time"], F.when(work["value"] == "fully_remote", say["full_time_remote"]).otherwise(""))),
        (col("engagement.value").isin("part_time", "hourly_contract"), say["part_time"]),
        (F.size("risks") > 0, F.concat(say["risks"], F.array_join(F.transform("risks", lambda r: r["label"]), " · "))),
        (col("excluded_word").isNotNull(), F.concat(say["excluded_work"], col("excluded_word"), F.lit(")"))),
        (real == "no", say["denied"]),
        ((asked == "employee_hiring") & classify.operational_staff(p) & ~real_yes, say["staff"]),
        (col("not_ordered").isNotNull() & ~real_yes, col("not_ordered")),
        (~dev, F.when(F.array_contains(names, "data"), say["only_data"]).otherwise(say["no_development"])),
        (asked == "employee_hiring", say["hiring"]),
        (~asked.isin("employee_hiring", "buyer_project", "buyer_ongoing", "seller_service", "job_seeker"), say["no_request"]),
    )
    access_text = F.when(access == "blocked", say["blocked"]).when(access == "login_required", say["login_required"]).otherwise(say["access_error"])
    unseen = F.concat(say["status_unknown"], F.when(col("source_kind") == "manual", say["by_hand"]).otherwise(say["no_mark"]))
    needs_person = (collab == "onsite_required") & F.lit(profile.onsite != "yes")
    review = _texts(
        (conflict.isNotNull(), conflict),
        (col("floor_text").isNotNull(), col("floor_text")),
        (col("low_text").isNotNull(), col("low_text")),
        (~dev, say["dev_unclear"]),
        (access != "accessible", access_text),
        ((access == "accessible") & (status == "unknown"), unseen),
        ((access == "accessible") & (status == "open") & ~fresh, say["recheck"]),
        (work["value"] == "unknown", say["remote_unknown"]),
        ((work["value"] == "fully_remote") & (work["basis"] == "inferred"), say["remote_inferred"]),
        (work["value"].isin("hybrid", "negotiable"), say["remote_terms"]),
        (needs_person, F.concat(say["in_person"], F.when(F.contains(F.coalesce(col("collab.quote"), F.lit("")), F.lit("첫")), say["first_meeting"]).otherwise(""))),
        (~needs_person & (work["value"] == "fully_remote") & (collab != "online_only") & sure, say["collab_unknown"]),
        (col("scope.value") == "regional_restriction", say["regional"]),
    )
    a = a.withColumns({"exclude": exclude, "review": review})
    a = a.withColumn("recommendation", F.when(F.size("exclude") > 0, "excluded").when(F.size("review") > 0, "needs_review").otherwise("recommended"))
    positive = _texts(
        (asked.isin(*BUYERS) & col("asked.basis").isin("explicit", "user_confirmed"), F.when(asked == "buyer_ongoing", say["ongoing"]).otherwise(say["bought"])),
        ((work["value"] == "fully_remote") & sure, F.when(collab == "online_only", say["online"]).otherwise(say["remote"])),
        (col("scope.value") == "nationwide", say["nationwide"]),
        (pay_short(pay).isNotNull(), pay_short(pay)),
    )
    toned = lambda tone, texts: F.transform(texts, lambda t: F.struct(F.lit(tone).alias("tone"), t.alias("text")))
    no_amount = pay["min"].isNull() & pay["max"].isNull()
    cautions = F.slice("review", 1, 2)
    room = F.greatest(F.lit(0), 3 - F.size(cautions) - no_amount.cast("int"))
    gap = F.when(no_amount, F.array(F.when(pay["unit"] == "negotiable", say["quote_needed"]).otherwise(say["no_budget"]))).otherwise(F.array().cast("array<string>"))
    kept = F.concat(toned("caution", cautions), toned("positive", F.slice(positive, F.lit(1), room)), toned("caution", gap))
    unclear = (status == "unknown") | (access != "accessible") | (status == "open") & ~fresh
    ask, floor_ask = R.ASK, F.concat(F.lit(R.ASK["floor"][0]), won(F.lit(profile.min_contract or 0)), F.lit(R.ASK["floor"][1]))
    eligible = F.size("exclude") == 0
    questions = _texts(
        (conflict.isNotNull(), ask["pay_conflict"]),
        (col("floor_text").isNotNull() & eligible, floor_ask),
        (col("low_text").isNotNull() & eligible, ask["low"]),
        ((work["value"] == "unknown") | (work["value"] == "fully_remote") & (work["basis"] == "inferred"), ask["remote"]),
        (collab == "onsite_required", ask["in_person"]),
        (no_amount, ask["budget"]),
        (unclear, ask["open"]),
        (asked == "unknown", ask["kind"]),
        (clarity < 6, ask["scope"]),
        (col("deadline.at").isNull() & asked.startswith("buyer"), ask["schedule"]),
    )
    a = a.withColumns({"reasons": F.when(F.size("exclude") > 0, toned("negative", F.slice("exclude", 1, 3))).otherwise(F.slice(kept, 1, 3)), "all_questions": questions})
    following = (
        F.when(col("recommendation") == "excluded", F.concat(F.lit(R.NEXT["none"]), F.when(F.size("risks") > 0, R.NEXT["risks"]).otherwise("")))
        .when(unclear & (access != "accessible"), R.NEXT["open_post"]).when(F.size("all_questions") > 0, R.NEXT["ask"])
    )
    return a.withColumns({"questions": F.slice("all_questions", 1, 4), "next_action": following, "summary": first_sentence(body), "pay": pay, "pay_conflict": conflict}).drop("resolved", "body_pay", "all_questions", "plain_total", SCANNED)


def inquiry_draft(title: Column, questions: Column, reply: bool = False) -> Column:
    """A draft to be edited: who writes and what it costs is left to the user."""
    d = R.DRAFT
    hello = F.array(*map(F.lit, (*d["reply"], ""))) if reply else F.array(F.lit(d["hello"]), F.concat(F.lit(d["about"][0]), F.btrim(title), F.lit(d["about"][1])), F.lit(""), F.lit(d["self"]), F.lit(""))
    numbered = F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(") "), q))
    asked = F.when(F.size(questions) > 0, F.concat(F.array(F.lit(d["questions"])), numbered, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(hello, asked, F.array(F.lit(d["end"]))), "\n")


def applied(posts: DataFrame, profile: Profile, now: datetime | str, ttl_hours: int = 24) -> DataFrame:
    """Analyse, then again where the text itself closes the post: a closed mark, or a deadline passed by over a day."""
    posts = scanned(_complete(posts))
    marked = dates.closed_marker(F.col(SCANNED), both(F.col("title"))).isNotNull()
    passed = F.coalesce(F.coalesce("deadline_hint", dates.parse_deadline(F.col(SCANNED), F.col("observed_at")))["at"] < clock.at(now) - F.expr("INTERVAL 1 DAY"), F.lit(False))
    status = F.col("source_status")
    status = F.when(marked & (status != "deleted"), "closed").when(status.isin("open", "unknown") & passed, "closed").otherwise(status)
    return analyze(posts.withColumn("source_status", status), profile, now, ttl_hours)


def evidence_rows(analysed: DataFrame) -> DataFrame:
    """One row for every quote behind a judgement: id, field, value, basis, quote, start, stop."""
    fields = {"demand_intent": "asked", "engagement_type": "engagement", "work_mode": "work", "collaboration_mode": "collab", "applicant_scope": "scope"}
    rows = F.array(*[F.struct(F.lit(k).alias("field"), *[F.col(f"{c}.{x}").alias(x) for x in ("value", "basis", "quote", "start", "stop")]) for k, c in fields.items()])
    return analysed.select("id", F.explode(F.filter(rows, lambda r: r["quote"].isNotNull())).alias("e")).select("id", "e.*")
