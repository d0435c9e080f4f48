"""Retention over linked tables: what goes, and which files are touched."""

from pyspark.sql import functions as F

from tidemill.operators import retention


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "listings")
    rows = [(k, f"u{k}", k // 10, None if k % 7 == 0 else f"2026-01-{k // 10 + 1:02d}", f"text {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, url string, seen long, day string, body string")
    df.write.partitionBy("day").parquet(path)
    records = spark.createDataFrame([(1, None), (None, "u2"), (13, "x"), (None, "u24")], "id long, url string")
    table = spark.read.parquet(path)
    gone = retention.unlinked(table, records, F.lit(2), "seen", "id", "url")
    doomed = {r.id for r in gone.collect()}
    assert doomed == {k for k in range(20)} - {1, 2, 13}
    # One more partition goes as a whole.
    gone = gone.select("id", "day").unionByName(table.where("day = '2026-01-05'").select("id", "day"))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "listings").rglob("*.parquet")}
    told = retention.purge(spark, path, "day", gone, "id")
    left = {r.id: (r.url, r.seen, r.day and str(r.day), r.body) for r in spark.read.parquet(path).collect()}
    doomed |= {k for k in range(40, 50) if k % 7}
    assert left == {k: (u, s, d, b) for k, u, s, d, b in rows if k not in doomed}
    assert told == {"written": 3, "removed": 1, "rows": len(doomed)}
    kept = {f for f in files if f.exists() and f.stat().st_mtime_ns == files[f]}
    assert {f.parent.name for f in kept} == {"day=2026-01-03", "day=2026-01-04", "day=2026-01-06"}
    assert retention.purge(spark, path, "day", spark.read.parquet(path).select("id", "day").limit(0), "id") == {"written": 0, "removed": 0, "rows": 0}
