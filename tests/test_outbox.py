"""The outbox as a source: batches, restarts, and resets where the reader's place is gone."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemill.streaming import outbox


def put(folder, generation, first, last):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"seq": list(range(first, last + 1)), "payload": [f"{generation}:{k}" for k in range(first, last + 1)]}), folder / f"{generation}-{first}-{last}.parquet")


@pytest.fixture
def follow(spark, tmp_path):
    """Read what is there, batch by batch, from where the last call stopped."""
    spark.dataSource.register(outbox.Outbox)

    def run(batch=200):
        got = []

        def sink(df, number):
            got.append([(r.generation, r.seq, r.payload, r.reset) for r in sorted(df.collect(), key=lambda r: r.seq)])

        stream = spark.readStream.format("outbox").option("batch", batch).load(str(tmp_path / "outbox"))
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return [b for b in got if b]

    return run


def test_tail_restart_and_reset(tmp_path, follow):
    folder = tmp_path / "outbox"
    put(folder, 1, 1, 5)
    put(folder, 1, 6, 9)
    first = follow(batch=4)
    assert [[s for _, s, _, _ in b] for b in first] == [[1, 2, 3, 4], [5, 6, 7, 8], [9]]
    assert not any(r for b in first for *_, r in b) and first[0][0][2] == "1:1"
    # A restart goes on from the checkpoint.
    put(folder, 1, 10, 12)
    assert [[s for _, s, _, _ in b] for b in follow()] == [[10, 11, 12]]
    # The outbox was trimmed beyond the reader's place.
    for f in folder.iterdir():
        f.unlink()
    put(folder, 1, 20, 22)
    (after,) = follow()
    assert [(s, r) for _, s, _, r in after] == [(20, True), (21, False), (22, False)]
    # A restored store begins another generation, whose numbers are lower.
    put(folder, 2, 3, 4)
    (restored,) = follow()
    assert [(g, s, r) for g, s, _, r in restored] == [(2, 3, True), (2, 4, False)]
    assert follow() == []
    put(folder, 2, 5, 5)
    assert [[(s, r) for _, s, _, r in b] for b in follow()] == [[(5, False)]]


def test_places_of_readers(tmp_path):
    folder = tmp_path / "outbox"
    folder.mkdir()
    reader = outbox.OutboxReader(str(folder), 3)
    start = reader.initialOffset()
    assert reader.latestOffset() == start and reader.partitions(start, start) == []
    put(folder, 1, 4, 9)
    assert reader.latestOffset() == {"generation": 1, "seq": 6}
    (part,) = reader.partitions(start, {"generation": 1, "seq": 6})
    assert (part.after, part.upto, part.reset) == (3, 6, False)
    # A reader ahead of all that is kept starts again.
    (part,) = reader.partitions({"generation": 1, "seq": 50}, {"generation": 1, "seq": 6})
    assert (part.after, part.reset) == (3, True)
