"""The event log as a stream: deduplication, budgets, sessions, releases and claims.

Every function maps a streaming (or static) DataFrame to another; state is kept
by Spark under the watermark that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.clock import ZONE_HOURS
from ..operators.aggregates import set_digest


def tail(spark, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Follow an append-only folder of event files; offsets are Spark's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once_per_key(events: DataFrame, key: str, at: str | None = None, within: str | None = None) -> DataFrame:
    """First event of each key; events without a key all pass.

    Without ``within`` keys are remembered for ever, as an outbox must; with it
    only among events not later than ``within`` behind, so that state is bounded.
    """
    same = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("seq").cast("string")))
    if within is None:
        return events.withColumn("_same", same).dropDuplicates(["_same"]).drop("_same")
    return events.withWatermark(at, within).withColumn("_same", same).dropDuplicatesWithinWatermark(["_same"]).drop("_same")


def daily_counts(events: DataFrame, key: str, at: str, within: str, local_days: bool = False) -> DataFrame:
    """Tumbling day counts per key; local days begin at midnight of the business zone."""
    offset = f"{24 - ZONE_HOURS} hours" if local_days else "0 hours"
    day = F.window(at, "1 day", "1 day", offset)
    return events.withWatermark(at, within).groupBy(key, day).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("day_start"), "n")


def live_sessions(observations: DataFrame, key: str, at: str, gap: str, within: str) -> DataFrame:
    """Sessions that a silence of ``gap`` ends, with their number of observations and extremes."""
    w = F.session_window(at, gap)
    return (
        observations.withWatermark(at, within).groupBy(key, w).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        .select(key, F.col("session_window.start").alias("start"), "n", "least", "most")
    )


def _follow(gap_seconds: float):
    """Rises of one session in the rows of a micro-batch, after the state of the last one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, at = state.get if state.exists else (-1, None, None)
        rows = pd.concat(list(batches)).sort_values("sequence", kind="stable").drop_duplicates("sequence")
        rows = rows[rows["sequence"] > last]
        if len(rows):
            before = rows[["unread", "at"]].shift()
            before.iloc[0] = [np.nan if count is None else count, pd.NaT if at is None else pd.Timestamp(at)]
            silent = (rows["at"] - pd.to_datetime(before["at"])).dt.total_seconds() > gap_seconds
            rose = (rows["unread"] > before["unread"].astype(float)) & ~silent
            end = rows.iloc[-1]
            state.update((int(end["sequence"]), int(end["unread"]), end["at"].to_pydatetime()))
            found = rows[rose].assign(session=key[0], previous=before["unread"][rose].astype("int64"))
            yield found[["session", "sequence", "unread", "previous"]]

    return run


def unread_increases(observations: DataFrame, gap_seconds: float = 15.0) -> DataFrame:
    """Of ``session, sequence, unread, at`` the rows whose count rose; a session's first is its baseline, and so is the first after a silence.

    A sequence number not above the last one seen is ignored.  A micro-batch of
    a session is held at a time, and one row of state between them.
    """
    return observations.groupBy("session").applyInPandasWithState(
        _follow(gap_seconds), "session string, sequence long, unread long, previous long", "last long, count long, at timestamp", "append", GroupStateTimeout.NoTimeout
    )


def releases(deferred: DataFrame) -> DataFrame:
    """One summary for each kind and end of quiet hours: how many, and a digest of the set of member ids."""
    return set_digest(deferred, ["kind", "quiet_end"], "id").withColumnRenamed("digest", "dedupe_key")


def claims(log: DataFrame) -> DataFrame:
    """Delivery state of each notification from a log of ``id, at, action, token``.

    The first claim wins; only its token may settle, once.  States: attempted,
    then accepted or failed.
    """
    won = log.where("action = 'claim'").groupBy("id").agg(F.min_by("token", F.struct("at", "token")).alias("won"))
    settled = log.where("action <> 'claim'").join(won, "id").where("token = won").groupBy("id").agg(F.min_by("action", F.struct("at", "action")).alias("settled"))
    return won.join(settled, "id", "left").select("id", "won", F.coalesce("settled", F.lit("attempted")).alias("state"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, batch by batch, and stop; a restart goes on from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
