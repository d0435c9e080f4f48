"""Delivery of notices as a stream: one claim, one settlement, and an end after a day, kept per notice by Spark.

A notice's state lives in a value that Spark drops some time after its last
change; a timer at its end of life expires it when the stream's time passes,
whether or not anything more arrives for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.notify import MAX_AGE_HOURS

#: What the state store of such a stream must be.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTICE = "created_at timestamp, token string, claimed_at timestamp, state string"
CHANGES = "id long, at timestamp, state string"
SETTLEMENTS = ("accepted", "failed", "unknown")


class Deliveries(StatefulProcessor):
    """One notice: pending, then attempted by the first claim within its life, then settled once by that claim's token; or suppressed, or expired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.notice = handle.getValueState("notice", NOTICE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values(["at", "action"], kind="stable")
        created, token, claimed, state = self.notice.get() if self.notice.exists() else (None, None, None, None)
        before, changes = state, []
        for at, action, said in zip(log["at"], log["action"], log["token"], strict=True):
            end = None if created is None else created + timedelta(hours=MAX_AGE_HOURS)
            if action == "create" and state is None:
                created, state = at, "pending"
                self.handle.registerTimer(int((at + timedelta(hours=MAX_AGE_HOURS)).timestamp() * 1000))
            elif action == "suppress" and state != "suppressed":
                state = "suppressed"
            elif action == "claim" and state == "pending" and at < end:
                token, claimed, state = said, at, "attempted"
            elif action in SETTLEMENTS and state == "attempted" and said == token and at >= claimed:
                state = action
            if state != before:
                changes.append((key[0], at, state))
                before = state
        if state is not None:
            self.notice.update((created, token, claimed, state))
        if changes:
            yield pd.DataFrame(changes, columns=["id", "at", "state"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """A day after its creation a notice that nobody claimed is over; a settled one needs no state any more."""
        if self.notice.exists():
            created, token, claimed, state = self.notice.get()
            if state == "pending":
                self.notice.update((created, token, claimed, "expired"))
                yield pd.DataFrame([(key[0], created + timedelta(hours=MAX_AGE_HOURS), "expired")], columns=["id", "at", "state"])

    def close(self) -> None:
        pass


def delivery_changes(log: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changes ``id, at, state`` of notices from a stream of ``id, at, action, token``; rows may come ``late`` by so much.

    The session's state store must be STATE_STORE.
    """
    keyed = log.withWatermark("at", late).groupBy("id")
    return keyed.transformWithStateInPandas(Deliveries(), CHANGES, "append", "eventTime")
