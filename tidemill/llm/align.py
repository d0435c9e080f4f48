"""Alignment of two tokenizers' tokens over the bytes of the same text.

Each byte has an owner among the tokens of A and one among those of B
(``np.repeat``).  Where the pair of owners changes a new overlap begins, and
where both change at once the text is cut: no token of either crosses there.
An id pair's count is the number of documents that hold it linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, texts, written
from .unit_tokens import byte_units, piece_units, vocabulary

#: A pair is one number: A's id times this, plus B's.
B_IDS = 1 << 16
#: Pairs that are told to every task: those in more than one in so many of all (document, pair) rows, so never more.
COMMON_PAIRS = 1 << 20
SIDE_BY_SIDE = 1 << 20
#: Rows whose pairs are looked up side by side.
ROWS = 512

ALIGNED = "id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups {groups}, pairs array<long>, times array<int>"


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and B of every overlap in order, and which overlaps begin a group; both lists of lengths cover the same bytes."""
    own_a, own_b = np.repeat(np.arange(len(len_a)), len_a), np.repeat(np.arange(len(len_b)), len_b)
    new_a, new_b = np.ones(len(own_a), bool), np.ones(len(own_b), bool)
    new_a[1:], new_b[1:] = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    at = np.flatnonzero(new_a | new_b)
    return own_a[at], own_b[at], (new_a & new_b)[at]


def _spelt(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """The ids in writing, group by group: A's joined by commas, a bar, B's, a semicolon."""
    last = lambda g: np.append(g[1:] != g[:-1], True)
    before_b = np.searchsorted(group_b, group_a)  # B tokens of earlier groups
    upto_a = np.searchsorted(group_a, group_b, "right")
    out = np.empty(len(ids_a) + len(ids_b), object)
    for ids, ends, place in ((ids_a, np.where(last(group_a), "|", ","), np.arange(len(ids_a)) + before_b), (ids_b, np.where(last(group_b), ";", ","), np.arange(len(ids_b)) + upto_a)):
        both, back = np.unique(ids.astype(np.int64) * 2 + (ends != ","), return_inverse=True)
        mark = "|" if ids is ids_a else ";"
        out[place] = np.array([f"{x >> 1}{mark if x & 1 else ','}" for x in both.tolist()], object)[back]
    return out.tolist()


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of ``docs``: ``id, row, n_a, n_b, n_groups, n_links, groups, pairs, times``.

    A reads the text with a space before it, B adds one itself.  ``groups`` is
    written ``a1,a2|b1;a3|b2,b3`` (with ``digest`` only its sha256), ``pairs``
    are the distinct linked id pairs and ``times`` how often each is linked.
    A text that is null, empty or not spelt exactly by both has no tokens, and
    its ``groups`` is ''.  ``row`` tells apart rows of equal ids.
    """
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    shape = ALIGNED.format(kind=rows.schema["id"].dataType.simpleString(), groups="string")

    def several(part: list[str], ids: pa.Array, numbers: pa.Array) -> pa.RecordBatch:
        a, b = byte_units(path_a, " "), piece_units(path_b)
        part = [t.s for t in part]
        (ids_a, n_a, ok_a), (ids_b, n_b, ok_b) = a.batch(part), b.batch(part)
        ok = ok_a & ok_b & np.array([t != "" for t in part])
        ids_a, ids_b = ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)]
        n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        at_a, at_b, cut = overlaps(a.sizes[ids_a], b.sizes[ids_b])
        doc = np.repeat(np.arange(len(part)), n_a)[at_a]
        n_links, n_groups = np.bincount(doc, minlength=len(part)), np.bincount(doc[cut], minlength=len(part))
        # Groups count through the whole part; every text begins one.
        group = np.cumsum(cut) - 1
        group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        group_a[at_a], group_b[at_b] = group, group
        said, edges = _spelt(ids_a, ids_b, group_a, group_b), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = ["".join(said[s:e])[:-1] for s, e in zip(edges[:-1], edges[1:], strict=True)]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        # Distinct pairs of each text, by one sort of (text, pair).
        keys, times = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (ids_a[at_a].astype(np.uint64) * np.uint64(B_IDS) + ids_b[at_b].astype(np.uint64)), return_counts=True)
        upto = np.concatenate([[0], np.cumsum(np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(part)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(v)) for v in ((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), times.astype(np.int32))]
        numbers_of = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)]
        return pa.RecordBatch.from_arrays([ids, numbers, *numbers_of, pa.array(groups, pa.string()), *lists], names=["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_parts(map(_Sized, texts(batch.column(2))), 4096, SIDE_BY_SIDE):
                yield several(part, batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)))
                at += len(part)

    return rows.mapInArrow(run, shape)


class _Sized:
    """A text with a size of one at least, so that parts of empty texts stay small."""

    def __init__(self, s: str):
        self.s = s

    def __len__(self) -> int:
        return len(self.s) + 1


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold each id pair linked, and whether no pair of the same A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "pair-counts")
    a = F.floor(F.col("pair") / B_IDS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (as ``align`` gives it, written) with ``n_best, count_sum`` in place of its pairs.

    Pairs of more than one in COMMON_PAIRS of all (document, pair) rows are at
    most so many and are told to every task; all other rows are few a pair and
    are joined.
    """
    spark = aligned.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") * COMMON_PAIRS > total).toPandas().sort_values("pair")
    told = spark.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("pair", "n", "best")))
    keep = [f for f in aligned.schema if f.name not in ("pairs", "times")]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", n_best long, count_sum long, pairs array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = told.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            lists = [batch.column(k) for k in (batch.num_columns - 2, batch.num_columns - 1)]
            flat, times = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            sizes = np.diff(lists[0].offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            known = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], doc[known], (times * best[at])[known] if len(pair) else 0)
            np.add.at(sums[1], doc[known], (times * n[at])[known] if len(pair) else 0)
            rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=batch.num_rows))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~known])) for v in (flat, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(s) for s in sums], *left], names=[*batch.schema.names[:-2], "n_best", "count_sum", "pairs", "times"])

    first = written(aligned.select(*[f.name for f in keep], "pairs", "times").mapInArrow(run, shape), "aligned-common")
    names = [f.name for f in keep]
    rare = first.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    found = rare.join(counts.where(F.col("n") * COMMON_PAIRS <= total), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in keep if f.name != "row"]
    both = first.select(*names, "n_best", "count_sum").unionByName(found.select("row", *nothing, "n_best", "count_sum").select(*names, "n_best", "count_sum"))
    return both.groupBy("row").agg(*[F.max(c).alias(c) for c in names if c != "row"], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, groups`` (its sha256) ``, n_best, count_sum`` of every document."""
    aligned = written(align(docs, path_a, path_b, True, id_col, text_col), "aligned")
    return with_counts(aligned, written(pair_counts(aligned), "pairs")).withColumnRenamed("id", id_col)
