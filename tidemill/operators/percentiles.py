"""Exact order statistics by counting: each pass splits the range that still holds a rank, so no values are gathered or sorted.

A pass counts the values of each part of the range, combined before they are
shuffled, and keeps the part in which the rank falls.  With PARTS parts a range
of 2**44 takes four passes, whatever the number of values; also for one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled

PARTS = 1 << 12


def middle(n: Column) -> dict[str, Column]:
    """The two ranks whose mean is the median."""
    return {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)}


def nearest(share: float, n: Column) -> Column:
    """The nearest rank of a share."""
    return F.greatest(F.lit(0), F.ceil(n * F.lit(share)) - 1)


def exact_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``keys``, ``n`` and a column for each of ``ranks``: the values at those places (from 0) of each key's values in order.

    Values are whole numbers of up to 62 bits; nulls are left out, and a key without
    values, or a rank beyond them, gives no value.  ``ranks`` are expressions
    over the column ``n``, the number of a key's values.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("_v"))
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
    bounds = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("n > 0")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("bigint").alias("place")) for name, place in ranks.items()]))
    width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / PARTS).cast("bigint")
    targets = settled(bounds.withColumn("_r", asked).select(*keys, "n", F.col("_r.name").alias("_name"), F.col("_r.place").alias("_place"), "_lo", width.alias("_width")).where("_place >= 0 AND _place < n"))
    at = [*keys, "n", "_name"]
    while (targets.agg(F.max("_width")).first()[0] or 0) > 0:
        inside = (F.col("v._v") >= F.col("t._lo")) & (F.col("v._v") - F.col("t._lo") < F.col("t._width") * PARTS)
        part = F.floor((F.col("v._v") - F.col("t._lo")) / F.col("t._width")).cast("bigint")
        left = targets.where("_width > 0")
        met = known.alias("v").join(left.alias("t"), on) if on else known.alias("v").join(F.broadcast(left).alias("t"))  # a row a rank
        counts = met.where(inside).groupBy(*[F.col(f"t.{c}").alias(c) for c in (*at, "_place", "_lo", "_width")], part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*at).orderBy("_part"))
        found = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_n") <= F.col("_place")))
        finer = F.when(F.col("_width") == 1, 0).otherwise(F.ceil(F.col("_width") / PARTS)).cast("bigint")
        found = found.select(*at, (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place"), (F.col("_lo") + F.col("_part") * F.col("_width")).alias("_lo"), finer.alias("_width"))
        targets = settled(targets.where("_width = 0").select(*at, "_place", "_lo", "_width").unionByName(found))
    values = [F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in ranks]
    return targets.groupBy(*keys).agg(F.max("n").alias("n"), *values)
