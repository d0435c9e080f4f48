"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and everything runs on one machine
    (tests) is a folder made here; executors elsewhere could not read it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="spark-"))
    return "file://" + _own_root[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """Texts one at a time, null as empty, without a list of the whole batch.

    Bytes that are no UTF-8 are read as U+FFFD.
    """
    for value in column.cast(pa.binary()):
        yield (value.as_py() or b"").decode(errors="replace")


def in_parts(items: Iterator, most_items: int, most_size: int) -> Iterator[list]:
    """Lists of consecutive sized items, each of at most ``most_items`` and, but for its last, under ``most_size`` in all."""
    part, size = [], 0
    for item in items:
        part.append(item)
        size += len(item)
        if len(part) >= most_items or size >= most_size:
            yield part
            part, size = [], 0
    if part:
        yield part


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` with all its columns in a struct ``row`` beside ``more``, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


#: Words of a bitmap of marks: what is broadcast never exceeds so many rows of two longs.
MARK_WORDS = 1 << 19


def _mark(keys: list[Column]) -> tuple[Column, Column]:
    """Word and bit of the keys in a bitmap of MARK_WORDS words."""
    place = F.pmod(F.xxhash64(*keys, F.lit("mark")), F.lit(64 * MARK_WORDS))
    return F.floor(place / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def bitmap(keys: DataFrame) -> DataFrame:
    """``word, bits``: a bitmap of the hashes of ``keys``' rows, at most MARK_WORDS rows whatever the input's size."""
    word, bit = _mark([F.col(c) for c in keys.columns])
    return keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def marked(rows: DataFrame, marks: DataFrame, *keys: Column) -> DataFrame:
    """``rows`` with ``mark``: false where the keys are surely not among those of the bitmap.

    No row moves: the bitmap is broadcast, and its size is bounded.  The fuller
    the bitmap, the more rows are marked that need not be; none is missed.
    """
    word, bit = _mark(list(keys))
    found = rows.withColumn("_word", word).join(F.broadcast(marks.withColumnsRenamed({"word": "_w", "bits": "_bits"})), F.col("_word") == F.col("_w"), "left")
    return found.withColumn("mark", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_w", "_bits")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``: the fixed held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


#: Places that a hash may take when rows are sampled: so many that a share of one in 1e11 still means one in 1e11.
PLACES = 1 << 40


def sample_place(*keys: Column) -> Column:
    """A place from 0 to 1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(PLACES)) / F.lit(float(PLACES))


def hashed_sample(df: DataFrame, key: str, groups: list[str], most: int) -> DataFrame:
    """About ``most`` rows of each group, chosen by a hash of ``key``.

    The share to keep comes from a count of every group, so the result's size
    is bounded whatever the input's; no group is gathered anywhere.
    """
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(most)) / F.col("_n")
    return df.join(F.broadcast(counts), groups).where(sample_place(F.col(key), F.lit("sample")) < share).drop("_n")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``docs`` (id, text, ...) with a ``label``: about ``most`` rows of each label of ``labels`` (id, label).

    The labels are sampled before they meet the texts, so what is broadcast is
    bounded by ``most`` and no text is shuffled.
    """
    picked = hashed_sample(labels.where("label is not null"), "id", ["label"], most)
    return docs.where("text is not null").join(F.broadcast(picked), "id")


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``gone(id)``; only rows that may have to go are shuffled."""
    gone = written(gone.select("id").distinct(), "gone")
    marks = written(bitmap(gone), "gone-marks")
    rows = marked(boxed(docs, id=F.col(id_col).cast(gone.schema["id"].dataType)), marks, F.col("id"))
    stay = rows.where("mark").join(gone, "id", "left_anti")
    return rows.where(~F.col("mark")).select("row.*").unionByName(stay.select("row.*"))


def group_join(rows: DataFrame, groups: DataFrame, key: str, size: str, by: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row a key, ``size`` rows each), null where the key has none.

    Groups of more than one in ``share`` of all grouped rows are fewer than
    ``share`` and are broadcast; their rows keep keys of their own, dealt by
    the column ``by``, in the join with the other groups.  So no task gets more
    than its part, and the plan is the same at every size.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    values = [c for c in groups.columns if c != key]
    struct = F.struct(*values)
    large = groups.where(F.col(size) * share > total).select(key, struct.alias("_large"))
    first = rows.join(F.broadcast(large), key, "left")
    kind = "binary" if rows.schema[key].dataType == BinaryType() else "string"
    named = F.col(key).cast(kind)
    own = F.when(F.col("_large").isNotNull(), F.concat(F.lit("#"), F.xxhash64(by).cast("string")).cast(kind)).otherwise(named)
    both = first.withColumn("_key", own).join(groups.select(named.alias("_key"), struct.alias("_other")), "_key", "left")
    return both.withColumn("_got", F.coalesce("_large", "_other")).select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in values])
