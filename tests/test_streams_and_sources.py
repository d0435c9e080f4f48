import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import files, tails
from tidemill.streaming import events


@pytest.fixture
def collected():
    rows = []
    return rows, lambda df, _: rows.extend(tuple(r) for r in df.collect())


def land(spark, path, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n}")


def test_events_pass_once_over_restarts(spark, tmp_path, collected):
    rows, sink = collected
    schema = "seq long, at timestamp, dedupe_key string"
    at = "2024-01-01 00:00:0{}"
    for n, part in enumerate(([(1, "a"), (2, None)], [(3, "a"), (4, None), (5, "b")])):
        df = spark.createDataFrame([(s, at.format(s), k) for s, k in part], "seq long, at string, dedupe_key string").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = events.once_per_key(events.tail(spark, str(tmp_path / "log"), schema), "dedupe_key", "at", "1 day")
        events.run_available(stream.select("seq"), sink, str(tmp_path / "ck"))
        assert sorted(rows) == [[(1,), (2,)], [(1,), (2,), (4,), (5,)]][n]


def test_unread_increases(spark, tmp_path, collected):
    rows, sink = collected
    data = [("s", 1, 3, 0), ("s", 2, 5, 5), ("s", 2, 9, 6), ("s", 3, 4, 9), ("s", 4, 6, 12), ("t", 1, 8, 0), ("s", 5, 9, 40)]
    schema = "session string, sequence long, unread long, at timestamp"
    for part in (data[:4], data[4:]):
        df = spark.createDataFrame(part, "session string, sequence long, unread long, s int").withColumn("at", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "o"))
        events.run_available(events.unread_increases(stream), sink, str(tmp_path / "ck"))
    assert sorted(rows) == [("s", 2, 5, 3), ("s", 4, 6, 4)]  # after the silence a baseline


def test_keys_are_remembered_for_ever(spark, tmp_path, collected):
    """Without a watermark a key stays known, however late it comes again."""
    rows, sink = collected
    schema = "seq long, at timestamp, dedupe_key string"
    for s, at, k in ((1, "2024-01-01", "a"), (2, "2025-01-01", "b"), (3, "2026-01-01", "a")):
        spark.createDataFrame([(s, at, k)], "seq long, at string, dedupe_key string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(str(tmp_path / "log"))
        events.run_available(events.once_per_key(events.tail(spark, str(tmp_path / "log"), schema), "dedupe_key").select("seq"), sink, str(tmp_path / "ck"))
    assert sorted(rows) == [(1,), (2,)]


def test_days_sessions_claims_and_releases(spark):
    rows = spark.createDataFrame([("h", "2024-01-01 14:59:59", 1), ("h", "2024-01-01 15:00:00", 2), ("h", "2024-01-01 15:00:10", 5)], "k string, at string, value int").withColumn("at", F.to_timestamp("at"))
    assert sorted(r.n for r in events.daily_counts(rows, "k", "at", "1 hour", local_days=True).collect()) == [1, 2]
    assert [r.n for r in events.daily_counts(rows, "k", "at", "1 hour").collect()] == [3]
    assert [(r.n, r.least, r.most) for r in events.live_sessions(rows, "k", "at", "15 seconds", "1 hour").collect()] == [(3, 1, 5)]
    log = spark.createDataFrame([(1, 1, "claim", "x"), (1, 2, "claim", "y"), (1, 3, "accepted", "y"), (1, 4, "failed", "x"), (2, 1, "claim", "z")], "id int, at int, action string, token string")
    assert sorted(tuple(r) for r in events.claims(log).collect()) == [(1, "x", "failed"), (2, "z", "attempted")]
    deferred = spark.createDataFrame([(2, "new", 8), (1, "new", 8), (3, "due", 8)], "id int, kind string, quiet_end int")
    assert sorted((r.kind, r.n) for r in events.releases(deferred).collect()) == [("due", 1), ("new", 2)]


def test_imports_and_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufefftitle,body,url,region,published_at,published_raw\n"Shop, site","line  one\nline two",https://x.example/1,,2024-01-02,\n,no title,ftp://x,,,\n', encoding="utf-8")
    good, bad = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.title, r.body, r.url, str(r.published_at), r.published_precision) for r in good.collect()] == [("Shop, site", "line one\nline two", "https://x.example/1", "2024-01-01 15:00:00", "day")] and bad.count() == 1
    (tmp_path / "b.json").write_text(json.dumps([{"title": "T", "body": "B", "url": "javascript:x", "published_raw": "3시간 전"}, {"title": "only"}]))
    good, bad = files.read_json(spark, str(tmp_path / "b.json"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    assert [(r.title, r.url, str(r.published_at), r.published_precision) for r in good.collect()] == [("T", None, "2024-01-01 09:00:00", "approximate")] and bad.count() == 1
    with pytest.raises(files.ImportRefused):
        files.read_json(spark, str(tmp_path / "b.json"), most_rows=1)
    (tmp_path / "c.txt").write_text("A first line\nand the rest\n")
    (tmp_path / "d.txt").write_text("short")
    texts, refused = files.read_text(spark, str(tmp_path / "[cd].txt"))
    assert [tuple(r) for r in texts.collect()] == [("A first line", "and the rest")] and refused.count() == 1
    (tmp_path / "s.xml").write_text(f'<urlset xmlns="{files.SITEMAP_SPACE}"><url><loc>https://x/a-b%20c-1</loc><lastmod>2024-03-01T00:00:00Z</lastmod></url><url><loc>https://x/b-1</loc><lastmod>2024-02-01T00:00:00Z</lastmod></url><url><loc>https://x/c-2</loc></url></urlset>')
    assert [(r.post_id, r.url, r.title) for r in files.read_sitemap(spark, str(tmp_path / "s.xml")).collect()] == [("1", "https://x/a-b%20c-1", "a b c"), ("2", "https://x/c-2", "c")]
    (tmp_path / "i.xml").write_text(f'<sitemapindex xmlns="{files.SITEMAP_SPACE}"><sitemap><loc>https://x/s1.xml</loc></sitemap></sitemapindex>')
    assert [r.loc for r in files.read_sitemap_index(spark, str(tmp_path / "i.xml")).collect()] == ["https://x/s1.xml"]
    (tmp_path / "o.xml").write_text('<urlset xmlns="http://other"><url><loc>https://x/a-1</loc></url></urlset>')
    with pytest.raises(files.ImportRefused):
        files.read_sitemap(spark, str(tmp_path / "o.xml"))
    rows = spark.createDataFrame([(2, "=1+1"), (1, "plain")], "id int, cell string")
    files.export_csv(rows, str(tmp_path / "out"), ["id"], one_file=True)
    assert next((tmp_path / "out").glob("*.csv")).read_text().splitlines() == ['"\ufeffid","cell"', '"1","plain"', '"2","\'=1+1"']
    files.export_json(rows, str(tmp_path / "json"), ["id"])
    assert sorted(r.cell for r in spark.read.json(str(tmp_path / "json")).collect()) == ["=1+1", "plain"]


def test_log_counts_and_settings(spark, tmp_path):
    (tmp_path / "x.log").write_text("half a line\n2024-01-01 00:00:00,1 INFO app.http event=fetch outcome=ok status=200 ms=42\n2024-01-01 00:00:01,1 ERROR app.http event=fetch outcome=fail status=503 ms=2000\nTraceback\n")
    got = {(r.level, r.event, r.outcome, r.status, r.latency): r.n for r in files.log_counts(spark, str(tmp_path / "x.log")).collect()}
    assert got == {("INFO", "fetch", "ok", "200", "<100"): 1, ("ERROR", "fetch", "fail", "503", ">=1000"): 1}
    row = spark.createDataFrame([('{"ttl": 24, "days": 9999, "secret": "x", "n": "many"}',)], "s string")
    assert row.select(files.safe_settings(F.col("s"), {"ttl": (1, 100), "days": (1, 365), "n": (0, 9)})).first()[0] == {"ttl": "24", "days": "unknown", "n": "unknown"}


def test_only_the_ends_of_files_are_read(spark, tmp_path):
    spark.dataSource.register(tails.Tails)
    lines = [f"line {k} é" for k in range(9000)]
    text = "\n".join(lines) + "\n"
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.log").write_text(text)
    (folder / "deep" / "b.log").write_text("short\nlast")
    (folder / "empty.log").write_text("")
    raw = text.encode()
    for most in (1000, 1001, 1002, 10**9, 3):
        got = {}
        for r in spark.read.format("tail").option("bytes", most).load(str(folder)).collect():
            got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.line, r.value))
        whole = raw if most >= len(raw) else raw[-most:] if raw[-most - 1 : -most] == b"\n" else raw[-most:].split(b"\n", 1)[1]
        assert [v for _, v in sorted(got.get("a.log", []))] == whole.decode().splitlines()
        assert [v for _, v in sorted(got.get("b.log", []))] == (["short", "last"] if most > 10 else [])
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("tail").load(str(tmp_path / "nothing")).collect()
    (folder / "a.log").write_text("2024-01-01 00:00:00,1 INFO app.http event=fetch ms=1\n" * 20_000)
    assert files.log_counts(spark, str(folder / "a.log")).first().n == (256 * 1024) // len("2024-01-01 00:00:00,1 INFO app.http event=fetch ms=1\n")
