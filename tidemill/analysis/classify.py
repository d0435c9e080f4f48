"""What a post asks for: five judgements, categories, risks and non-orders, as columns over what a scan found.

A judgement is ``value, basis, quote, start, stop``: basis is explicit,
inferred or null, and the quote is the sentence that decided it, null where
none did.  Nothing is guessed: without a sign the value is ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.matches import let
from . import rules as R


def judged(value: str | Column, basis: str | Column | None, quote: Column | None = None) -> Column:
    value, basis = (x if isinstance(x, Column) else F.lit(x).cast("string") for x in (value, basis))
    place = (F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")) if quote is None else (quote["quote"], quote["start"], quote["stop"])
    return F.struct(value.alias("value"), basis.alias("basis"), *[c.alias(k) for c, k in zip(place, ("quote", "start", "stop"), strict=True)])


def _chain(steps: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The judgement of the first condition that holds."""
    out = F.when(F.lit(False), otherwise)
    for condition, judgement in steps:
        out = out.when(condition, judgement)
    return out.otherwise(otherwise)


class Post:
    """Signs and quotes of one post; ``scanned`` is a column that holds what ``scan`` found in it."""

    def __init__(self, title: Column, body: Column, scanned: Column):
        self.title, self.body, self.scan = title, body, scanned

    def says(self, group: str) -> Column:
        return self.scan["quotes"][group].isNotNull()

    def quote(self, group: str) -> Column:
        return self.scan["quotes"][group]

    def asked(self, name: str) -> Column:
        return F.array_contains(self.scan["asked"], name)


def intent(p: Post) -> Column:
    """seller_service, job_seeker, employee_hiring, buyer_project, buyer_ongoing or unknown.

    Offers and job searches come first, then staff; a buyer who names wages or
    hours is hiring.
    """
    buyer, weak = p.says("buyer"), p.says("employment_weak")
    wages = p.asked("wage_words")
    return _chain(
        [
            (p.says("seller"), judged("seller_service", "explicit", p.quote("seller"))),
            (p.says("job_seeker"), judged("job_seeker", "explicit", p.quote("job_seeker"))),
            (p.says("operational_staff"), judged("employee_hiring", "explicit", p.quote("operational_staff"))),
            (p.says("employment_strong"), judged("employee_hiring", "explicit", p.quote("employment_strong"))),
            (buyer & weak & wages, judged("employee_hiring", "inferred", p.quote("employment_weak"))),
            (buyer & p.says("ongoing"), judged("buyer_ongoing", "explicit", p.quote("buyer"))),
            (buyer, judged("buyer_project", "explicit", p.quote("buyer"))),
            (weak, judged("employee_hiring", "inferred", p.quote("employment_weak"))),
            (p.says("ambiguous_person"), judged("unknown", None, p.quote("ambiguous_person"))),
        ],
        judged("unknown", None),
    )


def engagement(p: Post, intent_value: Column) -> Column:
    """full_time, part_time, hourly_contract, project or unknown; a buyer asks for a project."""
    by_buyer = intent_value.startswith("buyer")
    return _chain(
        [
            (p.says("full_time"), judged("full_time", "explicit", p.quote("full_time"))),
            (p.says("part_time"), judged("part_time", "explicit", p.quote("part_time"))),
            (p.says("hourly_contract"), judged("hourly_contract", "explicit", p.quote("hourly_contract"))),
            (p.says("project"), judged("project", F.when(by_buyer, "explicit").otherwise("inferred"), p.quote("project"))),
            (by_buyer, judged("project", "inferred")),
        ],
        judged("unknown", None),
    )


def work_mode(p: Post) -> Column:
    """onsite, hybrid, fully_remote, negotiable or unknown; remote work with days in the office is hybrid."""
    remote, onsite = p.says("remote_explicit"), p.says("onsite")
    office_days = p.asked("onsite_days")
    is_remote = judged("fully_remote", "explicit", p.quote("remote_explicit"))
    return _chain(
        [
            (p.says("remote_neg"), judged("onsite", "explicit", p.quote("remote_neg"))),
            (p.says("hybrid"), judged("hybrid", "explicit", p.quote("hybrid"))),
            (remote & ~onsite, is_remote),
            (onsite & ~remote, judged("onsite", "explicit", p.quote("onsite"))),
            (remote & onsite & office_days, judged("hybrid", "explicit", p.quote("remote_explicit"))),
            (remote, is_remote),
            (p.says("remote_negotiable"), judged("negotiable", "explicit", p.quote("remote_negotiable"))),
            (p.says("remote_weak"), judged("fully_remote", "inferred", p.quote("remote_weak"))),
            (p.says("freelance_only"), judged("unknown", None, p.quote("freelance_only"))),
        ],
        judged("unknown", None),
    )


def collaboration(p: Post, work_value: Column) -> Column:
    """onsite_required, online_only, negotiable or unknown."""
    return _chain(
        [
            (p.says("onsite_required"), judged("onsite_required", "explicit", p.quote("onsite_required"))),
            (work_value == "onsite", judged("onsite_required", "inferred")),
            (p.says("online_only_explicit"), judged("online_only", "explicit", p.quote("online_only_explicit"))),
            (p.says("collab_negotiable"), judged("negotiable", "explicit", p.quote("collab_negotiable"))),
            (p.says("online_only_weak"), judged("online_only", "inferred", p.quote("online_only_weak"))),
        ],
        judged("unknown", None),
    )


def applicant_scope(p: Post) -> Column:
    return _chain(
        [
            (p.says("regional"), judged("regional_restriction", "explicit", p.quote("regional"))),
            (p.says("nationwide"), judged("nationwide", "explicit", p.quote("nationwide"))),
        ],
        judged("unknown", None),
    )


def categories(p: Post) -> Column:
    """``names, dev``: the post's categories in table order, ``other`` without any, and whether one of them is development.

    Ordinary nouns need a development verb beside them.  What only sounds like
    software - factory lines, goods packed for a shop, advertising - is taken out.
    """
    verb, change = p.asked("dev_verb"), p.asked("software_change")
    named = [F.when(p.asked(f"category {name}") & (F.lit(alone or name == "data") | verb), F.lit(name)) for name, _, alone in R.CATEGORIES]
    from_change = F.when(~change, F.array().cast("array<string>")).when(p.asked("changed_website"), F.array(F.lit("website"))).otherwise(F.array(F.lit("software")))
    first = let(F.array_compact(F.array(*named)), lambda a: F.when(F.size(a) == 0, from_change).otherwise(a))
    marketing = p.asked("marketing_context") & p.asked("marketing_work") & ~change & ~p.asked("marketing_software")
    gone = F.array_compact(
        F.array(
            F.when(~p.asked("vba_words"), "vba"),
            F.when(p.asked("physical_automation") & ~p.asked("software_delivery"), "automation"),
            F.when(p.asked("physical_shop") & ~p.asked("shop_delivery"), "shop"),
        )
    )
    development = F.array(*map(F.lit, R.DEV_CATEGORIES))
    left = let(F.array_except(first, gone), lambda a: F.when(marketing, F.array_except(a, development)).otherwise(a))
    return let(
        left,
        lambda a: F.struct(
            F.when(F.size(a) == 0, F.array(F.lit("other"))).otherwise(a).alias("names"), (F.arrays_overlap(a, development) & verb).alias("dev")
        ),
    )


def risks(p: Post) -> Column:
    """Array of ``id, label, quote, start, stop``: each rule's first hit in the body; down payments to the maker are none."""
    return p.scan["risks"]


def non_delivery(p: Post) -> Column:
    """Why the post orders no delivery - advice, teaching, research - or null."""
    ordered, taught = p.says("buyer"), p.says("education")
    advice = p.says("advice") & ~p.asked("software_change")
    teaching = taught & p.asked("education_title") & ~p.asked("delivery_title") | taught & ~ordered & p.asked("teaching_body")
    research = p.asked("research_title") & p.says("research") & ~ordered
    return F.when(advice, R.NO_ADVICE_ORDER).when(teaching, R.NO_TEACHING_ORDER).when(research, R.NO_RESEARCH_ORDER)


def salary_named(p: Post) -> Column:
    return p.says("salary")


def operational_staff(p: Post) -> Column:
    return p.says("operational_staff")
