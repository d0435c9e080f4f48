"""Money: integer minor units, null for unknown, exact sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE_INTEGER = 9_007_199_254_740_991


def poisoned_sum(amount: Column, among: Column | None = None) -> dict[str, Column]:
    """``amount`` (null if any is missing), ``known_amount``, ``records`` and ``missing_amounts`` of the rows that ``among`` holds for.

    No rows sum to 0.  Sums are exact decimals.
    """
    here = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    known = F.coalesce(F.sum(F.when(here, amount).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    missing = F.count_if(here & amount.isNull())
    return {"amount": F.when(missing == 0, known), "known_amount": known, "records": F.count_if(here), "missing_amounts": missing}


def legacy_scalar(total: Column) -> Column:
    """A total as a plain integer, null where floating-point readers could not hold it."""
    return F.when(F.abs(total) <= MAX_SAFE_INTEGER, total.cast("long"))


def won(value: Column) -> Column:
    """Short Korean format: whole ten-thousands as 만원."""
    return F.when((value >= 10_000) & (value % 10_000 == 0), F.concat(F.format_number(F.floor(value / 10_000), 0), F.lit("만원"))).otherwise(
        F.concat(F.format_number(value, 0), F.lit("원"))
    )


def ranges_conflict(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Whether two ranges with open ends share no amount."""
    return F.coalesce(hi_a < lo_b, F.lit(False)) | F.coalesce(hi_b < lo_a, F.lit(False))


def token_cost_micros(tokens_in: Column, tokens_out: Column, nano_in: Column, nano_out: Column) -> Column:
    """Price in millionths from prices in billionths a token, rounded up in integers."""
    nano = tokens_in * nano_in + tokens_out * nano_out
    return F.floor((nano + 999) / 1000).cast("long")
