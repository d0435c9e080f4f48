"""Pay in free text: amounts, unit and bounds; unknown amounts stay null and the wording is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.matches import has
from ..functions.money import won
from . import rules as R
from .scan import scan

AMOUNT = "long"


def to_amount(number: Column, multiple: Column) -> Column:
    """``1.5`` and ``만`` to 15000; null if there is no number."""
    table = F.create_map(*[F.lit(x) for kv in R.MULTIPLES.items() for x in kv])
    times = F.coalesce(F.try_element_at(table, multiple), F.lit(1))
    return F.bround(F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(20,6)") * times, 0).cast(AMOUNT)


def _pay(raw: Column, lo: Column, hi: Column, unit: Column, negotiable: Column, start: Column, currency: Column | None = None) -> Column:
    return F.struct(
        raw.alias("raw"), (F.lit("KRW") if currency is None else currency).alias("currency"), lo.cast(AMOUNT).alias("min"), hi.cast(AMOUNT).alias("max"),
        F.coalesce(unit, F.lit("unknown")).alias("unit"), F.coalesce(negotiable, F.lit(False)).alias("negotiable"), start.cast("int").alias("start"),
    )


def _nothing() -> Column:
    null = F.lit(None)
    return _pay(null.cast("string"), null, null, F.lit("unknown"), F.lit(False), null)


def time_pay_unit(text: Column) -> Column:
    """The unit of wages by time that the text names anywhere; null without one.  Hours of work are no wages."""
    return scan(F.lit(None).cast("string"), text)["wage_body"]


def _amount(scanned: Column) -> Column:
    """The first amount in a line about pay; null without one."""
    sign = lambda m, k: F.array_contains(m["signs"], k)
    return F.get(F.filter(scanned["amounts"], lambda m: sign(m, "pay") & ~sign(m, "no_pay")), F.lit(0))


def _of_amount(m: Column) -> Column:
    """The pay of the chosen amount with its bounds, unit and wording."""
    sign = lambda k: F.array_contains(m["signs"], k)
    first = lambda a, b: F.when(m[a] != "", m[a]).otherwise(m[b])
    alone = to_amount(m["g1"], m["g2"]) + F.coalesce(F.when(m["g3"] != "", to_amount(m["g3"], m["g4"])), F.lit(0).cast(AMOUNT))
    lo = F.when(m["range"], to_amount(m["g1"], first("g2", "g4"))).when(~sign("lower") & sign("upper"), None).otherwise(alone)
    hi = F.when(m["range"], to_amount(m["g3"], first("g4", "g2"))).when(sign("lower"), None).otherwise(alone)
    unit = F.coalesce(m["unit"], F.when(sign("project"), "project"))
    return _pay(m["raw"], lo, hi, F.when(unit == "year", "unknown").otherwise(unit), sign("negotiable"), m["raw_start"])


def parse_pay(scanned: Column) -> Column:
    """``raw, currency, min, max, unit, negotiable, start`` of a scanned body.

    The first amount in a line about pay counts; without one, a named salary,
    then an open price, then payment by the piece.
    """
    amount, (salary, open_price, by_piece) = _amount(scanned), (scanned["lines"][k] for k in ("salary", "open_price", "by_piece"))
    null = F.lit(None)
    code = F.upper(F.regexp_extract(salary["hit"], r"(?i)\b(USD|KRW|EUR|GBP)\b", 1))
    of_salary = _pay(salary["line"], null, null, F.lit("unknown"), F.lit(False), salary["line_start"], F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown")))
    of_open = _pay(open_price["line"], null, null, F.when(has(open_price["line"], R.LINE_PROJECT) & open_price["wage"].isNull(), "project").otherwise("negotiable"), F.lit(True), open_price["line_start"])
    of_piece = _pay(by_piece["line"], null, null, F.lit("project"), has(by_piece["line"], R.NEGOTIABLE), by_piece["line_start"])
    return F.when(amount.isNotNull(), _of_amount(amount)).when(salary.isNotNull(), of_salary).when(open_price.isNotNull(), of_open).when(by_piece.isNotNull(), of_piece).otherwise(_nothing())


def wording_wage(scanned: Column) -> Column:
    """The unit of wages by time in the wording that ``parse_pay`` chose."""
    amount, lines = _amount(scanned), scanned["lines"]
    out = F.when(amount.isNotNull(), amount["wage"])
    for k in ("salary", "open_price", "by_piece"):
        out = out.when(lines[k].isNotNull(), lines[k]["wage"])
    return out


# Words of a budget field that name its unit; the first in this order counts.
BUDGET_UNITS = (("건당", "project"), ("월간", "month"), ("월급", "month"), ("일당", "day"), ("일급", "day"), ("시급", "hour"), ("시간당", "hour"))
LEAST, MOST = "최소", "최대"


def budget_label(label: Column) -> Column:
    """``raw, min, max, unit, negotiable`` of a public budget field; without a unit's word the unit is unknown."""
    raw = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(label), r"(?U)\s+", " "), r"^예산\s*", ""))
    unit = F.lit("unknown")
    for word, name in reversed(BUDGET_UNITS):
        unit = F.when(F.contains(raw, F.lit(word)), name).otherwise(unit)
    least, most = F.contains(raw, F.lit(LEAST)), F.contains(raw, F.lit(MOST))
    open_above = least & ~most & ~raw.rlike(r"[~–-]\s*\d")
    plain = F.concat(F.lit("예산 "), F.regexp_replace(raw, rf"{LEAST}\s*|{MOST}\s*", ""))
    p = parse_pay(scan(F.lit(None).cast("string"), plain))
    return F.struct(raw.alias("raw"), F.when(~(most & ~least), p["min"]).alias("min"), F.when(~open_above, p["max"]).alias("max"), unit.alias("unit"), p["negotiable"].alias("negotiable"))


# Units of structured salaries; any other is unknown.
SALARY_UNITS = {"HOUR": "hour", "DAY": "day", "WEEK": "week", "MONTH": "month"}


def structured_salary(value: Column) -> Column:
    """``min, max, unit, currency, raw`` of a JobPosting's baseSalary as JSON text; null without an amount."""
    field = lambda path: F.get_json_object(value, path)
    plain = field("$.value").try_cast("double")
    lo = F.coalesce(field("$.value.minValue"), field("$.value.value")).try_cast("double")
    hi = F.coalesce(field("$.value.maxValue"), field("$.value.value")).try_cast("double")
    lo, hi = F.coalesce(lo, plain).cast(AMOUNT), F.coalesce(hi, plain).cast(AMOUNT)
    unit, currency = field("$.value.unitText"), F.coalesce(field("$.currency"), F.lit("KRW"))
    table = F.create_map(*[F.lit(x) for kv in SALARY_UNITS.items() for x in kv])
    none = F.lit("None")
    raw = F.concat(F.lit("baseSalary "), F.coalesce(lo.cast("string"), none), F.lit("~"), F.coalesce(hi.cast("string"), none), F.lit(" "), currency, F.lit("/"), F.coalesce(unit, F.lit("?")))
    found = F.struct(lo.alias("min"), hi.alias("max"), F.coalesce(F.try_element_at(table, F.upper(unit)), F.lit("unknown")).alias("unit"), currency.alias("currency"), raw.alias("raw"))
    return F.when(lo.isNotNull() | hi.isNotNull(), found)


def pay_short(pay: Column) -> Column:
    """Short text of a pay's amounts; null if both are unknown."""
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in R.PAY_PREFIX.items() for x in kv]), pay["unit"]), F.lit(""))
    span = pay["min"].isNotNull() & pay["max"].isNotNull() & (pay["min"] != pay["max"])
    one = F.coalesce(pay["min"], pay["max"])
    return F.when(one.isNotNull(), F.concat(prefix, F.when(span, F.concat(won(pay["min"]), F.lit("~"), won(pay["max"]))).otherwise(won(one))))
