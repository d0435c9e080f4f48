"""Retention of stored tables: rows past their time go, and only the partitions that lose rows are written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settled
from .relations import without_any


def unlinked(listings: DataFrame, records: DataFrame, cutoff: Column, at: str, *keys: str) -> DataFrame:
    """Listings last seen before ``cutoff`` that no record is linked to by any one of the keys."""
    return without_any(listings.where(F.col(at) < cutoff), records, *keys)


def purge(spark: SparkSession, path: str, by: str, gone: DataFrame, key: str) -> dict[str, int]:
    """Delete the rows whose ``key`` is in ``gone(key, by)`` from the Parquet table at ``path``, partitioned by ``by``.

    The partitions that hold such rows are read, joined and overwritten; a
    partition that loses all its rows is removed; no other file is touched.
    What stays is settled before anything is overwritten, so a lost task is
    made again and a run that broke off can be repeated.  Gives the number of
    partitions written and removed and of rows deleted.  ``by`` has few values
    (days): a name for each partition that is touched comes to the driver.
    """
    table = spark.read.parquet(path)
    kind = table.schema[by].dataType
    doomed = settled(gone.select(F.col(key), F.col(by).cast(kind).alias(by)).distinct())
    touched = [r[0] for r in doomed.select(by).distinct().collect()]
    if not touched:
        return {"written": 0, "removed": 0, "rows": 0}
    inside = table.where(F.col(by).isin(*[t for t in touched if t is not None]) | (F.col(by).isNull() if None in touched else F.lit(False)))
    same = (F.col(f"t.{key}") == F.col(f"g.{key}")) & F.col(f"t.{by}").eqNullSafe(F.col(f"g.{by}"))
    stays = settled(inside.alias("t").join(doomed.alias("g"), same, "left_anti"))
    before = {r[0]: r[1] for r in inside.groupBy(by).count().collect()}
    after = {r[0]: r[1] for r in stays.groupBy(by).count().collect()}
    changed = [p for p in before if before[p] != after.get(p, 0)]
    left = [p for p in changed if after.get(p)]
    if left:
        rows = stays.where(F.coalesce(F.col(by).isin(*[p for p in left if p is not None]), F.lit(None in left)))
        rows.repartition(by).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    empty = [p for p in changed if not after.get(p)]
    jvm, names = spark.sparkContext._jvm, spark.createDataFrame([(p,) for p in empty], spark.createDataFrame([], table.select(by).schema).schema) if empty else None
    for name in [r[0] for r in names.select(F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).collect()] if names is not None else []:
        folder = jvm.org.apache.hadoop.fs.Path(path, f"{by}={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return {"written": len(left), "removed": len(empty), "rows": sum(before[p] - after.get(p, 0) for p in changed)}
