"""Ordered and windowed operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by aggregation, so hot keys combine before the shuffle."""
    others = [c for c in columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def numbered(df: DataFrame, order: list[Column], name: str, by: str | None = None) -> DataFrame:
    """Number all rows, or those of each value of ``by``, from 0 in ``order``, without bringing them together.

    Rows are dealt by ranges of the order; counts of the ranges, one row for
    each range and value, give every range its first number.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * 4
    spread = settled(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    keys = ["_part"] + ([by] if by else [])
    counts = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys[1:]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    same = [F.col("r._part") == F.col("f._part")] + ([F.col(f"r.{by}").eqNullSafe(F.col(f"f.{by}"))] if by else [])
    joined = spread.withColumn("_inside", inside).alias("r").join(F.broadcast(first).alias("f"), same)
    return joined.select(*[f"r.{c}" for c in df.columns], (F.col("f._first") + F.col("r._inside")).cast("long").alias(name))


def interleave(df: DataFrame, kind: str, order: list[Column], first: str, per_turn: int = 3) -> DataFrame:
    """Number rows so that ``per_turn`` of ``first`` are followed by one of the other kind; add ``slot``.

    A kind that runs out leaves gaps in the numbers, which only say the order.
    """
    rows = numbered(df, order, "_i", kind)
    i = F.col("_i")
    turn = F.floor(i / per_turn) * (per_turn + 1) + i % per_turn
    return rows.withColumn("slot", F.when(F.col(kind) == first, turn).otherwise(i * (per_turn + 1) + per_turn).cast("long")).drop("_i")


def exploration_order(refs: DataFrame, per_turn: int = 3) -> DataFrame:
    """Add ``place`` to ``ref_key, kind, priority, first_listed_at, updated_at, visited_at``: the order in which details are asked for.

    Never visited ones first, by priority, then newest listing, newest update
    and key; after ``per_turn`` of the kind ``core`` comes one of the other.
    Then all that were visited, oldest visit first.
    """
    newest = lambda c: F.col(c).desc_nulls_last()
    never_listed = F.when(F.col("first_listed_at").isNotNull(), -F.unix_micros(F.col("first_listed_at").cast("timestamp"))).otherwise(0)
    fresh = interleave(refs.where("visited_at is null"), "kind", [F.desc("priority"), never_listed, newest("updated_at"), F.col("ref_key")], "core", per_turn)
    seen = numbered(refs.where("visited_at is not null"), [F.col("visited_at"), newest("updated_at"), F.col("ref_key")], "_i")
    ordered = fresh.withColumn("_tier", F.lit(0)).unionByName(seen.withColumnRenamed("_i", "slot").withColumn("_tier", F.lit(1)))
    return numbered(ordered, [F.col("_tier"), F.col("slot")], "place").drop("_tier", "slot")


def board_order(checkpoints: Column, board: Column) -> list[Column]:
    """Boards never read first, then those read longest ago, then by id."""
    return [F.coalesce(checkpoints.cast("string"), F.lit("")).asc(), board.asc()]


def gap_since(df: DataFrame, keys: list[str], start: str, finish: str, order: list[str]) -> DataFrame:
    """Add ``gap_seconds``: from the finish of the key's previous row to the start, at least 0; null for the first."""
    before = F.lag(finish).over(Window.partitionBy(*keys).orderBy(*order))
    gap = F.timestamp_diff("MICROSECOND", before, F.col(start)) / F.lit(1e6)
    return df.withColumn("gap_seconds", F.when(before.isNotNull(), F.greatest(F.lit(0.0), gap)))


def increases(df: DataFrame, session: list[str], at: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds the session's previous one; the first sample is a baseline."""
    before = F.lag(value).over(Window.partitionBy(*session).orderBy(*at))
    return df.withColumn("previous", before).where(F.col(value) > F.col("previous"))


def changes(df: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's previous row."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*at))
    return df.withColumn("previous", before).where(~F.col(value).eqNullSafe(F.col("previous")) & F.col("previous").isNotNull())


def diff_fields(df: DataFrame, keys: list[str], at: list[str], fields: list[str]) -> DataFrame:
    """Names of the fields that changed since the key's previous version; first versions have none."""
    w = Window.partitionBy(*keys).orderBy(*at)
    first = F.row_number().over(w) == 1
    changed = [F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), F.lit(f)) for f in fields]
    return df.withColumn("changed", F.when(first, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*changed))))


def sessions(df: DataFrame, keys: list[str], at: str, gap_seconds: int) -> DataFrame:
    """Number each key's sessions: a new one begins after a gap of more than ``gap_seconds``."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = (F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) > gap_seconds * 1_000_000).cast("int")
    marked = df.withColumn("_new", F.coalesce(new, F.lit(1)))
    return marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def last_known(df: DataFrame, keys: list[str], at: str, value: str, rows: int = 20) -> DataFrame:
    """Most recent known value within the last ``rows`` rows, the row itself included."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumn("last_known", F.last(value, ignorenulls=True).over(w))


def paired(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """The i-th entry of one array beside the i-th of another, null where the other is shorter."""
    return df.select(key, F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("i", "p")).select(key, "i", F.col("p.l").alias(left), F.col("p.r").alias(right))


def newest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows, largest first, null dates last: a page, which is a limit of the feature."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n)
