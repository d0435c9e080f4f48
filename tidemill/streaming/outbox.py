"""An outbox of numbered events as a streaming source: ``spark.readStream.format("outbox").load(folder)``.

The folder holds one Parquet file for each stretch of events, named
``<generation>-<first>-<last>.parquet`` with columns ``seq, payload``; old
stretches are deleted as the outbox is trimmed, and a restored store begins a
new generation.  A batch takes at most ``batch`` numbers.  A reader whose place
is no longer kept, or is of another generation, starts again at the oldest
event that is, and its first row says so: ``reset`` is true there and nowhere
else.  Offsets are Spark's; only names are listed on the driver, events are
read by the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "generation bigint, seq bigint, payload string, reset boolean"
NAME = re.compile(r"(\d+)-(\d+)-(\d+)\.parquet$")


def _store(folder: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def stretches(folder: str) -> list[tuple[int, int, int, str]]:
    """Generation, first and last number and name of every file of the newest generation, in order."""
    from pyarrow import fs

    system, place = _store(folder)
    names = [info.path for info in system.get_file_info(fs.FileSelector(place))]
    found = sorted((*map(int, m.groups()), n) for n in names if (m := NAME.match(n.rsplit("/", 1)[-1])))
    return [x for x in found if x[0] == found[-1][0]]


class Stretch(InputPartition):
    def __init__(self, name: str, generation: int, after: int, upto: int, reset: bool):
        self.name, self.generation, self.after, self.upto, self.reset = name, generation, after, upto, reset


class OutboxReader(DataSourceStreamReader):
    """Offsets are ``generation, seq``: the last event that was read, and ``reset`` where the next one is not the one after."""

    def __init__(self, folder: str, batch: int):
        self.folder, self.batch = folder, batch
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"generation": -1, "seq": -1}

    def latestOffset(self, start: dict | None = None, limit: Any = None) -> dict:
        at = start or self.at or self.initialOffset()
        kept = stretches(self.folder)
        if not kept:
            return at
        generation, oldest, newest = kept[0][0], kept[0][1], kept[-1][2]
        seq = at["seq"] if at["generation"] == generation and oldest - 1 <= at["seq"] <= newest else oldest - 1
        self.at = {"generation": generation, "seq": min(newest, seq + self.batch)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.at = end
        kept = [x for x in stretches(self.folder) if x[0] == end["generation"]]
        if not kept:
            return []
        begun = start["generation"] >= 0
        after = start["seq"] if start["generation"] == end["generation"] and start["seq"] >= kept[0][1] - 1 and start["seq"] <= end["seq"] else kept[0][1] - 1
        reset = begun and (start["generation"], start["seq"]) != (end["generation"], after)
        parts = [Stretch(name, g, after, end["seq"], False) for g, first, last, name in kept if first <= end["seq"] and last > after]
        if parts:
            parts[0].reset = reset
        return parts

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = _store(self.folder)
        with system.open_input_file(partition.name) as source:
            rows = pq.read_table(source, columns=["seq", "payload"])
        rows = rows.filter(pc.and_(pc.greater(rows["seq"], partition.after), pc.less_equal(rows["seq"], partition.upto))).sort_by("seq")
        n = rows.num_rows
        marks = [partition.reset and k == 0 for k in range(n)]
        columns = [pa.array([partition.generation] * n, pa.int64()), rows["seq"].cast(pa.int64()).combine_chunks(), rows["payload"].cast(pa.string()).combine_chunks(), pa.array(marks, pa.bool_())]
        yield from pa.table(columns, names=["generation", "seq", "payload", "reset"]).to_batches()

    def commit(self, end: dict) -> None:
        pass


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> OutboxReader:
        return OutboxReader(self.options["path"], int(self.options.get("batch", 200)))
