"""Ordered folds: state that each row of a key reads and changes.

Rows are dealt by key and sorted, and each task walks through its keys a batch
at a time with one state in hand, so a key of any size needs no more memory
than a batch.  For rules that no window function can say: what is accepted
depends on what was accepted before.

``fold_ranges`` also cuts single keys: rows are dealt by ranges of key and
order, each range of a key that spans several is summarised for every state
that could enter it, the summaries are chained, and then all ranges are walked
at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import settled

Step = Callable[[Any, dict], tuple[Any, dict]]
#: An action that no row of a range names.
OTHER = "\0other"


def _walk(keys: list[str], uses: list[str], start: Any, step: Step, added: str, types: list, starts: dict | None = None):
    """``step`` along rows sorted by key; only ``uses`` become Python values.  ``starts``: other states to begin with, by part and key."""
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, key, state = [to_arrow_type(t) for t in types], None, start
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            part = batch.column(batch.schema.get_field_index("_part"))[0].as_py() if starts is not None and batch.num_rows else None
            of = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
            for at, row in zip(of, batch.select(uses).to_pylist(), strict=True):
                if at != key:
                    key, state = at, start if starts is None else starts.get((part, at), start)
                state, more = step(state, row)
                for n in names:
                    out[n].append(more[n])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)]], names=[*batch.schema.names, *names])

    return run


def _shape(rows: DataFrame, added: str) -> tuple[str, list]:
    types = [f.dataType for f in rows.sparkSession.createDataFrame([], added).schema]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + added, types


def fold(df: DataFrame, keys: list[str], order: list[str], start: Any, step: Step, added: str, uses: list[str] | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (a schema), which ``step(state, row)`` gives with the next state; a row holds the columns ``uses``."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    shape, types = _shape(rows, added)
    return rows.mapInArrow(_walk(keys, uses or df.columns, start, step, added, types), shape)


def fold_ranges(df: DataFrame, keys: list[str], order: list[str], start: Any, step: Step, added: str, uses: list[str], summarise: Callable, summary: str, enter: Callable, parts: int | None = None) -> DataFrame:
    """As ``fold``, with keys of any size cut into ranges of ``order``, which must tell all rows of a key apart.

    ``summarise(rows)`` gives rows of the schema ``summary`` that say what a
    range makes of any state; ``enter(state, summary rows)`` gives the state
    after it.  Only keys that lie in several ranges are summarised, at most two
    a range, so what is told to every task is bounded by the number of ranges.
    """
    spark = df.sparkSession
    parts = parts or spark.sparkContext.defaultParallelism * 4
    rows = df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    rows = settled(rows.sortWithinPartitions(*keys, *order))
    at = F.struct(*keys)
    spans = rows.groupBy(at.alias("_key")).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last")).where("_first < _last")
    cut = rows.join(F.broadcast(spans), at.eqNullSafe(F.col("_key")), "left_semi").select(*keys, *order, "_part", *[c for c in uses if c not in {*keys, *order}])  # at most a key for each edge of two ranges
    key_shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    fields = spark.createDataFrame([], summary).schema
    types = [to_arrow_type(f.dataType) for f in fields]

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        found = summarise(table.sort_by([(c, "ascending") for c in order]).select(uses).to_pylist())
        columns = [pa.array([k.as_py()] * len(found), k.type) for k in key] + [pa.array([r[f.name] for r in found], t) for f, t in zip(fields, types, strict=True)]
        return pa.Table.from_arrays(columns, names=[*keys, "_part", *fields.names])

    told = settled(cut.groupBy(*keys, "_part").applyInArrow(summed, f"{key_shape}, _part int, {summary}"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out, waiting = None, start, [], []
        for batch in batches:
            for row in batch.to_pylist():
                now = (tuple(row[k] for k in keys), row["_part"])
                if now != last:
                    state = enter(state, waiting) if last and now[0] == last[0] else start
                    waiting, last = [], now
                    out.append((now[1], pickle.dumps((now[0], state))))
                waiting.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["_part", "_entered"])

    entered = told.repartition(*keys).sortWithinPartitions(*keys, "_part").mapInArrow(chained, "_part int, _entered binary").collect()
    starts = {(r["_part"], pickle.loads(bytes(r["_entered"]))[0]): pickle.loads(bytes(r["_entered"]))[1] for r in entered}
    shape, kinds = _shape(rows, added)
    return rows.mapInArrow(_walk(keys, uses, start, step, added, kinds, starts), shape).drop("_part")


def reservations(requests: DataFrame, keys: list[str], order: list[str], day: str, month: str, amount: str, day_cap: int, month_cap: int) -> DataFrame:
    """Add ``accepted, day_spent, month_spent``: a request is accepted if it fits under both caps with what was accepted before; refused ones cost nothing.

    ``day`` and ``month`` rise with ``order``, and a day lies in one month.
    Days are walked at once as if no month had a cap.  Where the days' sums
    stay under it, that is what happens; only the days from the first one that
    would pass it are walked in turn, with what the month has spent by then.
    """

    def step(month_cap: int | None):
        def run(state: tuple | None, row: dict) -> tuple[tuple, dict]:
            at_day, spent_day, spent_month = state or (None, 0, row["_before"] or 0)
            spent_day = spent_day if row[day] == at_day else 0
            taken = row[amount] is not None and spent_day + row[amount] <= day_cap and (month_cap is None or spent_month + row[amount] <= month_cap)
            if taken:
                spent_day, spent_month = spent_day + row[amount], spent_month + row[amount]
            return (row[day], spent_day, spent_month), {"accepted": taken, "day_spent": spent_day, "month_spent": spent_month}

        return run

    added, uses = "accepted boolean, day_spent bigint, month_spent bigint", [day, amount, "_before"]
    free = settled(fold(requests.withColumn("_before", F.lit(0).cast("bigint")), [*keys, month, day], order, None, step(None), added, uses))
    days = free.groupBy(*keys, month, day).agg(F.max("day_spent").alias("_spent"))
    upto = Window.partitionBy(*keys, month).orderBy(F.col(day).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # A row a day: the greatest sum so far says whether an earlier day passed the cap.
    sums = days.withColumn("_before_day", F.coalesce(F.sum("_spent").over(upto), F.lit(0))).withColumn("_over", F.col("_before_day") + F.col("_spent") > month_cap)
    bound = sums.withColumn("_bound", F.max("_over").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    bound = bound.withColumn("_enter", F.min(F.when(F.col("_bound"), F.col("_before_day"))).over(Window.partitionBy(*keys, month))).drop("_spent", "_over")
    on = [*keys, month, day]
    both = free.alias("r").join(bound.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]).select("r.*", "b._before_day", "b._bound", "b._enter")
    within = both.where(~F.col("_bound")).withColumn("month_spent", F.col("month_spent") + F.col("_before_day")).select(*requests.columns, "accepted", "day_spent", "month_spent")
    rest = both.where("_bound").withColumn("_before", F.col("_enter")).select(*requests.columns, "_before")
    return within.unionByName(fold(rest, [*keys, month], order, None, step(month_cap), added, uses).drop("_before"))


def decisions(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A log of ``expected_revision, action`` by compare-and-swap: add ``outcome, revision, state``.

    An action that is already in force changes nothing, whatever it expects;
    any other needs the current revision and makes the next one.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        revision, action = state
        if row["action"] == action:
            outcome = "unchanged"
        elif row["expected_revision"] == revision:
            outcome, revision, action = "applied", revision + 1, row["action"]
        else:
            outcome = "conflict"
        return (revision, action), {"outcome": outcome, "revision": revision, "state": action}

    def summarise(rows: list[dict]) -> list[dict]:
        """Where each revision and action that the range moves leads to, found from its end; a row for each action says that it occurs."""
        actions, leads = {r["action"] for r in rows}, {}
        for r in reversed(rows):
            if r["expected_revision"] is not None:
                after = (r["expected_revision"] + 1, r["action"])
                leads |= dict.fromkeys(((r["expected_revision"], a) for a in {*actions, OTHER} if a != r["action"]), leads.get(after, after))
        return [{"r": None, "a": a, "r2": None, "a2": None} for a in actions] + [{"r": r, "a": a, "r2": r2, "a2": a2} for (r, a), (r2, a2) in leads.items()]

    def enter(state: tuple, found: list[dict]) -> tuple:
        revision, action = state
        known = action if any(x["r"] is None and x["a"] == action for x in found) else OTHER
        return next(((x["r2"], x["a2"]) for x in found if x["r"] == revision and x["a"] == known), state)

    uses = ["expected_revision", "action"]
    return fold_ranges(log, [key], order, (0, "candidate"), step, "outcome string, revision bigint, state string", uses, summarise, "r bigint, a string, r2 bigint, a2 string", enter)


def drafts(edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Edits of ``expected, text``: add ``saved, current``; an edit is saved only over the text that it expects."""

    def step(state: str, row: dict) -> tuple[str, dict]:
        saved = (row["expected"] or "") == state
        state = (row["text"] or "") if saved else state
        return state, {"saved": saved, "current": state}

    return fold(edits, [key], order, "", step, "saved boolean, current string")


def observations(samples: DataFrame, key: str, order: list[str], gap_seconds: float = 15.0) -> DataFrame:
    """Samples of ``sequence, count, at``: add ``outcome, rise``.

    A repeated sample is a duplicate, a lower sequence number or a changed
    repeat is rejected, and so is a sample without a number, count or time;
    after a silence the next sample is a baseline again.
    """

    def step(state: tuple | None, row: dict) -> tuple[tuple | None, dict]:
        if row["sequence"] is None or row["count"] is None or row["at"] is None:
            return state, {"outcome": "rejected", "rise": None}
        if state is not None:
            last, count, at = state
            if row["sequence"] == last and row["count"] == count:
                return state, {"outcome": "duplicate", "rise": None}
            if row["sequence"] <= last:
                return state, {"outcome": "rejected", "rise": None}
            if (row["at"] - at).total_seconds() <= gap_seconds:
                rise = row["count"] - count if row["count"] > count else None
                return (row["sequence"], row["count"], row["at"]), {"outcome": "accepted", "rise": rise}
        return (row["sequence"], row["count"], row["at"]), {"outcome": "baseline", "rise": None}

    def summarise(rows: list[dict]) -> list[dict]:
        """The sample that a range leaves behind unless a higher number entered it: the first with its highest."""
        whole = [r for r in rows if r["sequence"] is not None and r["count"] is not None and r["at"] is not None]
        top = max(whole, key=lambda r: r["sequence"], default=dict.fromkeys(("sequence", "count", "at")))
        return [{k: top[k] for k in ("sequence", "count", "at")}]

    def enter(state: tuple | None, found: list[dict]) -> tuple | None:
        top = found[0]
        return state if top["sequence"] is None or state is not None and top["sequence"] <= state[0] else (top["sequence"], top["count"], top["at"])

    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in ("sequence", "count", "at"))
    return fold_ranges(samples, [key], order, None, step, "outcome string, rise bigint", ["sequence", "count", "at"], summarise, kinds, enter)
