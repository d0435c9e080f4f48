"""Folds over single keys that are cut into ranges, against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import folds


def keys_of(rng, n):
    """One key holds most rows; many hold a few."""
    return ["hot" if rng.random() < 0.7 else f"k{rng.randrange(n // 10)}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_decisions_in_ranges(spark, seed):
    rng, rows, state = random.Random(seed), [], {}
    for seq, key in enumerate(keys_of(rng, 1500)):
        revision, action = state.get(key, (0, "candidate"))
        said = rng.choice(["confirmed", "dismissed", "candidate", "confirmed", None])
        expected = rng.choice([revision, revision, revision - 1, revision + 1, None, rng.randrange(40)])
        if said == action:
            outcome = "unchanged"
        elif expected == revision:
            outcome, revision, action = "applied", revision + 1, said
        else:
            outcome = "conflict"
        state[key] = (revision, action)
        rows.append((key, seq, expected, said, f"note {seq}", outcome, revision, action))
    df = spark.createDataFrame(rows, "id string, seq long, expected_revision long, action string, note string, o string, r long, s string")
    got = folds.decisions(df.repartition(5).select("id", "seq", "expected_revision", "action", "note", "o", "r", "s"), "id", ["seq"]).collect()
    assert len(got) == len(rows) and all((x.outcome, x.revision, x.state) == (x.o, x.r, x.s) for x in got)
    assert {x.outcome for x in got} == {"applied", "unchanged", "conflict"} and all(x.note == f"note {x.seq}" for x in got)


def test_observations_in_ranges_and_with_nulls(spark):
    rng, rows, state, at = random.Random(3), [], {}, datetime(2026, 1, 1)
    for n, key in enumerate(keys_of(rng, 1200)):
        at += timedelta(seconds=rng.choice([0.2, 0.5, 1, 30]))
        last = state.get(key)
        sequence, count = (last[0] if last else 0) + rng.choice([0, 1, 1, 2, -3]), rng.randrange(5)
        if rng.random() < 0.1 and last:
            sequence, count = last[:2]
        row = [sequence, count, at]
        if rng.random() < 0.08:
            row[rng.randrange(3)] = None
        rise = None
        if None in row:
            outcome = "rejected"
        elif last and row[:2] == list(last[:2]):
            outcome = "duplicate"
        elif last and sequence <= last[0]:
            outcome = "rejected"
        else:
            outcome = "accepted" if last and (at - last[2]).total_seconds() <= 15 else "baseline"
            rise = count - last[1] if outcome == "accepted" and count > last[1] else None
            state[key] = (sequence, count, at)
        rows.append((key, n, *row, outcome, rise))
    df = spark.createDataFrame(rows, "session string, n long, sequence long, count long, at timestamp, o string, r long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = folds.observations(df, "session", ["n"]).collect()
    assert len(got) == len(rows) and all((x.outcome, x.rise) == (x.o, x.r) for x in got)
    assert {x.outcome for x in got} == {"rejected", "duplicate", "accepted", "baseline"}
    assert folds.observations(df.limit(0), "session", ["n"]).count() == 0


@pytest.mark.parametrize("month_cap", [60, 400, 10**9])
def test_budgets_by_days_and_months(spark, month_cap):
    rng, rows, state, at = random.Random(5), [], {}, datetime(2026, 1, 1)
    for n, key in enumerate(keys_of(rng, 1500)):
        at += timedelta(hours=1.7)
        day, month, amount = at.strftime("%Y-%m-%d"), at.strftime("%Y-%m"), rng.choice([None, 1, 2, 3, 5, 9])
        old_day, old_month, spent_day, spent_month = state.get(key, (None, None, 0, 0))
        spent_day, spent_month = spent_day if day == old_day else 0, spent_month if month == old_month else 0
        taken = amount is not None and spent_day + amount <= 20 and spent_month + amount <= month_cap
        if taken:
            spent_day, spent_month = spent_day + amount, spent_month + amount
        state[key] = (day, month, spent_day, spent_month)
        rows.append((key, n, day, month, amount, taken, spent_day, spent_month))
    df = spark.createDataFrame(rows, "id string, n long, day string, month string, amount long, t boolean, d long, m long")
    got = folds.reservations(df, ["id"], ["n"], "day", "month", "amount", 20, month_cap).collect()
    assert len(got) == len(rows) and all((x.accepted, x.day_spent, x.month_spent) == (x.t, x.d, x.m) for x in got)
