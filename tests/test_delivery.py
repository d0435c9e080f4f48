"""Delivery as a stream, replayed in small batches, against the batch operator."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators import notify
from tidemill.streaming import delivery, events


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, delivery.STATE_STORE)
    yield
    spark.conf.set(key, before)


def log_of(seed, n=40):
    """Creations, claims by several tokens, settlements by right and wrong ones, suppressions, in order of time."""
    rng, rows, start = random.Random(seed), [], datetime(2026, 1, 1)
    for k in range(n):
        at = start + timedelta(minutes=37 * k)
        rows.append((k, at, "create", None))
        if rng.random() < 0.15:
            rows.append((k, at + timedelta(minutes=rng.randint(1, 90)), "suppress", None))
        for _ in range(rng.randint(0, 2)):
            rows.append((k, at + timedelta(minutes=rng.randint(1, 1700)), "claim", rng.choice("ab")))
        for _ in range(rng.randint(0, 3)):
            rows.append((k, at + timedelta(minutes=rng.randint(1, 1900)), rng.choice(["accepted", "failed", "unknown"]), rng.choice("ab")))
    rows = [(i, at + timedelta(microseconds=j), a, t) for j, (i, at, a, t) in enumerate(rows)]
    return sorted(rows, key=lambda r: r[1]) + [(10_000, start + timedelta(days=9), "create", None)]


def test_small_batches_give_what_the_whole_log_gives(spark, store, tmp_path):
    rows = log_of(3)
    schema, step = "id long, at timestamp, action string, token string", 25
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.parquet(f"{tmp_path}/log/{k:05d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    got, losses = [], [len(rows) // step // 2]

    def sink(batch, number):
        got.extend(batch.collect())
        if number in losses:
            losses.clear()
            raise RuntimeError("the driver is lost")

    query = lambda: events.run_available(delivery.delivery_changes(stream), sink, f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="lost"):
        query()
    query()  # from the checkpoint: the batch that failed comes again
    last = {}
    for r in sorted(set(map(tuple, got)), key=lambda r: r[1]):
        last[r[0]] = r[2]
    batch = spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp_ntz"))
    want = {r.id: r.state for r in notify.delivery_states(batch, clock.at("2026-01-10 00:00:00")).collect()}
    assert last == want and {"expired", "attempted", "suppressed", "pending"} <= set(want.values()) and set(want.values()) & set(delivery.SETTLEMENTS)
