"""Imports of posts from CSV, JSON and text, sitemaps, logs, and the export sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.text import csv_safe, normalize_text, safe_url
from .tails import Tails

POST = "title string, body string, url string, region string, published_at string, published_raw string"
TITLE_CHARS, TEXT_TITLE_CHARS, LEAST_TEXT = 200, 120, 10
MOST_ROWS, MOST_BYTES = 1000, 2 * 1024 * 1024
SITEMAP_SPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
SITEMAP_BYTES = 50 * 1024 * 1024


class ImportRefused(ValueError):
    """A file that breaks the limits of an import."""


def _strip(value) -> Column:
    return F.btrim(value, F.lit(" \t\r\n\ufeff"))


def checked(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> None:
    """Refuse files over the size limit; only names and sizes are read."""
    large = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > most_bytes).limit(1).collect()
    if large:
        raise ImportRefused(f"{large[0].path}: {large[0].length} bytes, at most {most_bytes}")


def _posts(raw: DataFrame, observed: Column | None, most_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Mapped posts, and the rows refused for want of a title or body; a table over the row limit is refused whole."""
    if most_rows is not None and len(raw.limit(most_rows + 1).select(F.lit(1)).collect()) > most_rows:
        raise ImportRefused(f"more than {most_rows} rows")
    named = raw.select(*[F.col(c) for c in raw.columns if not c.startswith("_")]).withColumnsRenamed({c: c.strip("\ufeff") for c in raw.columns})
    exact = clock.parse_iso(F.col("published_at"))
    near = clock.relative_time(F.coalesce("published_raw", "published_at"), observed) if observed is not None else F.lit(None).cast("timestamp_ntz")
    at = F.coalesce(exact["at"].cast("timestamp_ntz"), near)
    precision = F.when(exact["at"].isNotNull(), exact["precision"]).when(near.isNotNull(), "approximate").otherwise("unknown")
    rows = named.select(
        F.substring(_strip("title"), 1, TITLE_CHARS).alias("title"), normalize_text(_strip("body")).alias("body"), safe_url(F.col("url")).alias("url"), _strip("region").alias("region"),
        at.alias("published_at"), precision.alias("published_precision"), _strip(F.coalesce("published_raw", "published_at")).alias("published_raw"),
    )
    whole = F.coalesce((F.col("title") != "") & (F.col("body") != ""), F.lit(False))
    return rows.where(whole), rows.where(~whole)


def read_csv(spark: SparkSession, path: str, observed: Column | None = None, most_rows: int | None = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Posts of CSV files with a header; a byte-order mark before it is no part of a name."""
    checked(spark, path)
    return _posts(spark.read.schema(POST).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).option("encoding", "UTF-8").csv(path), observed, most_rows)


def read_json(spark: SparkSession, path: str, observed: Column | None = None, most_rows: int | None = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """An array of objects or a single object a file; anything else fails."""
    checked(spark, path)
    return _posts(spark.read.schema(POST).option("multiLine", True).option("mode", "FAILFAST").json(path), observed, most_rows)


def read_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One post a file: the first line is the title, the rest the body, or all of it if there is no rest; and the texts refused as too short."""
    checked(spark, path)
    raw = spark.read.text(path, wholetext=True).select(_strip("value").alias("value"))
    lines = F.split("value", "\n", 2)
    rest = _strip(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    posts = raw.where(F.length("value") >= LEAST_TEXT).select(F.substring(_strip(lines[0]), 1, TEXT_TITLE_CHARS).alias("title"), normalize_text(F.coalesce(F.nullif(rest, F.lit("")), F.col("value"))).alias("body"))
    return posts, raw.where(F.length("value") < LEAST_TEXT)


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """``loc`` of the sitemaps that index files name."""
    checked(spark, path, SITEMAP_BYTES)
    return _spaced(spark, path, "sitemap").select("loc").where("loc is not null").distinct()


def _spaced(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Entries of landed files; a file of another namespace is no sitemap and fails."""
    heads = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 2000).alias("head"))
    if heads.where(F.col("head").contains("xmlns=") & ~F.col("head").contains(SITEMAP_SPACE)).limit(1).collect():
        raise ImportRefused("a file is not in the sitemap namespace")
    return spark.read.schema("loc string, lastmod string").option("rowTag", tag).format("xml").load(path)


def read_sitemap(spark: SparkSession, path: str, pattern: str = r"-([0-9a-z]+)/?$") -> DataFrame:
    """Newest entry per post id of landed sitemap files, newest first, with the title that the address spells."""
    checked(spark, path, SITEMAP_BYTES)
    rows = _spaced(spark, path, "url")
    rows = rows.select(F.regexp_extract("loc", pattern, 1).alias("post_id"), F.col("loc").alias("url"), F.try_to_timestamp("lastmod").alias("lastmod")).where("post_id <> ''")
    best = F.max_by(F.struct("url", "lastmod"), F.struct(F.coalesce(F.unix_micros("lastmod"), F.lit(-(2**62))), F.col("url")))
    newest = rows.groupBy("post_id").agg(best.alias("b")).select("post_id", "b.*")
    slug = F.try_url_decode(F.regexp_extract("url", r"/([^/?#]*)-[0-9a-z]+/?$", 1))
    return newest.withColumn("title", F.btrim(F.replace(slug, F.lit("-"), F.lit(" ")))).orderBy(F.desc_nulls_last("lastmod"), "url")


def log_counts(spark: SparkSession, path: str, header: str = r"^(\d{4}-\d{2}-\d{2} [\d:,.]+) (DEBUG|INFO|WARNING|ERROR|CRITICAL) ([\w.]+) (.*)$") -> DataFrame:
    """Lines at the end of each log file by level, event, outcome, status and latency; lines without a header do not count."""
    spark.dataSource.register(Tails)
    lines = spark.read.format("tail").load(path).where(F.col("value").rlike(header))
    message = F.regexp_extract("value", header, 4)
    field = lambda k: F.nullif(F.regexp_extract(message, rf"\b{k}=([\w.-]+)", 1), F.lit(""))
    ms = field("ms").try_cast("double")
    latency = F.when(ms < 10, "<10").when(ms < 100, "<100").when(ms < 1000, "<1000").when(ms.isNotNull(), ">=1000")
    rows = lines.select(F.regexp_extract("value", header, 2).alias("level"), field("event").alias("event"), field("outcome").alias("outcome"), field("status").alias("status"), latency.alias("latency"))
    return rows.groupBy("level", "event", "outcome", "status", "latency").agg(F.count(F.lit(1)).alias("n"))


def safe_settings(raw: Column, limits: dict[str, tuple[float, float]]) -> Column:
    """Allow-listed numbers of a settings document as a map; what is no number or out of range is ``unknown``."""
    pairs = []
    for name, (lo, hi) in limits.items():
        value = F.get_json_object(raw, f"$.{name}").try_cast("double")
        pairs += [F.lit(name), F.when(value.between(lo, hi), F.get_json_object(raw, f"$.{name}")).otherwise("unknown")]
    return F.create_map(*pairs)


def export_csv(rows: DataFrame, path: str, order: list, one_file: bool = False) -> None:
    """Text cells guarded against formulas, the first name after a byte-order mark; the commit of the write is atomic.

    One file only where the reader needs it: then one task writes everything.
    """
    safe = rows.orderBy(*order).select(*[csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    first = safe.columns[0]
    (safe.coalesce(1) if one_file else safe).withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_json(rows: DataFrame, path: str, order: list) -> None:
    rows.orderBy(*order).write.mode("overwrite").json(path)
