"""Dates in free text: deadlines, starts and closed marks, each with its precision; vague words stay vague."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.clock import ZONE_HOURS, local
from ..functions.matches import let


def about_recruitment(m: Column) -> Column:
    """Whether a date or mark is about applying: the nearest recruiting word of its clause is nearer than any word of work dates.

    Without a recruiting word only a plain deadline label counts, and only if no work date is named.
    """
    return F.when(m["recruit"].isNotNull(), m["work"].isNull() | (m["recruit"] < m["work"])).otherwise(m["work"].isNull() & F.contains(m["hit"], F.lit("마감")))


def resolve_month_day(month: Column, day: Column, observed: Column) -> Column:
    """The local midnight of a month and day near ``observed``, as UTC: over 60 days ago means next year; null if there is no such day."""
    here = local(observed)
    stamp = lambda year: F.try_make_timestamp_ntz(year, month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    past = lambda at: F.floor(F.timestamp_diff("SECOND", at, here) / 86400) > 60
    return let(stamp(F.year(here)), lambda at: F.when(at.isNull(), at).when(past(at), stamp(F.year(here) + 1)).otherwise(at)) - F.expr(f"INTERVAL {ZONE_HOURS} HOURS")


def _date(at: Column, precision: str, raw: Column, start: Column) -> Column:
    return F.struct(at.alias("at"), F.lit(precision).alias("precision"), raw.alias("raw"), start.cast("int").alias("start"))


def _vague(line: Column) -> Column:
    """A date in words only."""
    return F.when(line.isNotNull(), _date(F.lit(None).cast("timestamp_ntz"), "unknown", line["hit"], line["start"]))


def _no_date() -> Column:
    return _date(F.lit(None).cast("timestamp_ntz"), "unknown", F.lit(None).cast("string"), F.lit(None))


def parse_deadline(scanned: Column, observed: Column) -> Column:
    """``at, precision, raw, start`` of the last day to apply; patterns in their order, each in text order."""
    fitting = F.filter(scanned["dates"], lambda m: m["rule"].startswith("deadline") & about_recruitment(m))
    dated = F.transform(fitting, lambda m: _date(resolve_month_day(m["month"], m["day"], observed), "day", m["hit"], m["start"]))
    return F.coalesce(F.get(F.filter(dated, lambda d: d["at"].isNotNull()), F.lit(0)), _vague(scanned["lines"]["always_open"]), _no_date())


def parse_work_start(scanned: Column, observed: Column) -> Column:
    """``at, precision, raw, start`` of the first day of work, or the vague words for it."""
    first = F.get(F.filter(scanned["dates"], lambda m: m["rule"] == "start"), F.lit(0))
    dated = _date(resolve_month_day(first["month"], first["day"], observed), "day", first["hit"], first["start"])
    return let(dated, lambda d: F.coalesce(F.when(d["at"].isNotNull(), d), _vague(scanned["lines"]["vague_start"]), _no_date()))


def _closed_in(found: Column) -> Column:
    """The first mark that says a post is closed now; not denied, conditional, dated or yet to come."""

    def closes(m: Column) -> Column:
        sign = lambda k: F.array_contains(m["signs"], k)
        open_still = sign("negated") | ~sign("past") & (sign("future") | sign("dated"))
        return about_recruitment(m) & ~sign("conditional") & (F.ltrim(m["hit"]).startswith("[") | ~open_still)

    mark = F.filter(found, lambda m: (m["rule"] == "closed") & closes(m))
    label = F.filter(found, lambda m: (m["rule"] == "closed_label") & F.array_contains(m["signs"], "alone"))
    return F.coalesce(F.get(mark, F.lit(0)), F.get(label, F.lit(0)))


def closed_marker(scanned: Column, title: Column) -> Column:
    """``quote, start, stop`` of the mark in the body, else the title as a whole; null if the post is not marked closed."""
    nowhere = F.lit(None).cast("int")
    in_body = let(_closed_in(scanned["dates"]), lambda m: F.when(m.isNotNull(), F.struct(m["hit"].alias("quote"), m["start"], m["stop"])))
    in_title = F.when(_closed_in(scanned["title_closed"]).isNotNull(), F.struct(title.alias("quote"), nowhere.alias("start"), nowhere.alias("stop")))
    return F.coalesce(in_body, in_title)
