"""Token ids in files: every document's ids with an end id, in ascending order of document id.

A file is ``IDBLOCK2``, then groups of blocks, then the table of its documents
and a trailer that finds it.  A group holds the number of its blocks, the ids of
a block, and for every block its bytes, its ids and the checksums of both; then
the blocks' codes (see ``id_coder``).  All numbers are little-endian.

Documents are range-partitioned by id and sorted; a task encodes a group at a
time and writes files of its own.  A file counts only if the manifest, which
Spark commits, names it: what a lost or repeated task leaves behind is never
read.  The folder must be one that driver and executors share and that pyarrow
can open (a path, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_parts, texts
from .id_coder import BLOCK_IDS, LANES, checksum, decode_blocks, encode_blocks
from .unit_tokens import byte_units, vocabulary

MAGIC = b"IDBLOCK2"
GROUP, BLOCK, TRAILER = struct.Struct("<II"), np.dtype([("bytes", "<u4"), ("ids", "<u4"), ("code_crc", "<u4"), ("ids_crc", "<u4")]), struct.Struct("<QQQI8s")
DOCUMENT = np.dtype([("id", "<i8"), ("no_id", "u1"), ("ids", "<u8")])
#: A file is closed at the first document's end after so many ids.
FILE_IDS = 1 << 26
MANIFEST = "part int, file int, path string, first_id long, n_ids long, n_docs long, n_bytes long"


class Damaged(ValueError):
    """A file whose checksums or sizes do not hold."""


def _open(folder: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _block_ids(n: int) -> int:
    """Ids of a block: shorter where there are few, so that many advance together."""
    return min(BLOCK_IDS, max(256, -(-n // 256)))


class FileWriter:
    """Writes documents' ids into one file, a group at a time."""

    def __init__(self, out: Any):
        self.out, self.at = out, 0
        self.docs: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        while self.n_waiting >= LANES * BLOCK_IDS:
            self._group(LANES * BLOCK_IDS)

    def _group(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n
        ids, steps = ids[:n], _block_ids(n)
        rows = np.zeros((-(-n // steps), steps), np.uint16)  # the last block is filled up with zeros
        rows.ravel()[:n] = ids
        codes = encode_blocks(rows)
        table = np.zeros(len(rows), BLOCK)
        for k, code in enumerate(codes):
            own = ids[k * steps : (k + 1) * steps]
            table[k] = (len(code), len(own), zlib.crc32(code), checksum(own))
        self._put(GROUP.pack(len(rows), steps) + table.tobytes() + b"".join(codes))

    def close(self) -> int:
        """Bytes of the file."""
        if self.n_waiting:
            self._group(self.n_waiting)
        footer = np.array(self.docs, DOCUMENT).tobytes()
        self._put(footer + TRAILER.pack(self.at, len(self.docs), self.n_ids, zlib.crc32(footer), MAGIC))
        return self.at


class FileReader:
    """Reads a file that FileWriter wrote; ``size`` is its length."""

    def __init__(self, source: Any, size: int):
        self.source = source
        source.seek(size - TRAILER.size)
        self.end, n_docs, self.n_ids, crc, magic = TRAILER.unpack(source.read(TRAILER.size))
        source.seek(self.end)
        footer = source.read(n_docs * DOCUMENT.itemsize)
        source.seek(0)
        if magic != MAGIC or source.read(len(MAGIC)) != MAGIC or zlib.crc32(footer) != crc:
            raise Damaged("no file of token ids, or its table of documents is damaged")
        self.docs = np.frombuffer(footer, DOCUMENT)

    def groups(self) -> Iterator[np.ndarray]:
        """The ids of one group after another."""
        at, read = len(MAGIC), 0
        while at < self.end:
            lanes, steps = GROUP.unpack(self.source.read(GROUP.size))
            table = np.frombuffer(self.source.read(lanes * BLOCK.itemsize), BLOCK)
            codes = [self.source.read(int(n)) for n in table["bytes"]]
            at += GROUP.size + lanes * BLOCK.itemsize + int(table["bytes"].sum())
            if any(zlib.crc32(c) != x for c, x in zip(codes, table["code_crc"].tolist(), strict=True)):
                raise Damaged("a block's code is damaged")
            rows = decode_blocks(codes, steps)
            if any(checksum(r[:n]) != x for r, n, x in zip(rows, table["ids"].tolist(), table["ids_crc"].tolist(), strict=True)):
                raise Damaged("a block's ids are damaged")
            ids = rows.ravel()[: int(table["ids"].sum())]
            read += len(ids)
            yield ids
        if read != self.n_ids:
            raise Damaged("ids are missing")

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray], int]]:
        """``id, ids before it, ids in parts, crc32`` of one document after another."""
        groups, left = self.groups(), np.zeros(0, np.uint16)
        start = 0
        for doc_id, no_id, n in self.docs.tolist():
            parts, crc, need = [], 0, n
            while need:
                if not len(left):
                    left = next(groups)
                parts.append(left[:need])
                crc = checksum(parts[-1], crc)
                left, need = left[need:], need - len(parts[-1])
            yield None if no_id else doc_id, start, parts, crc
            start += n
        for _ in groups:
            raise Damaged("ids without a document")


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty) with a vocabulary of the tokenizers library and write the ids.

    Ids of documents are whole numbers or null; null ids come first, and rows of
    equal ids lie by a hash of their texts.  Other columns are not read.  An
    empty table leaves a manifest without files.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _open(folder)
        files.create_dir(place, recursive=True)
        part, tokens = TaskContext.get().partitionId(), byte_units(path, most=700_000)
        made, writer, name, first = [], None, "", 0
        for batch in batches:
            at = 0
            for some in in_parts(texts(batch.column(1)), 2000, 4 << 20):
                ids, counts = tokens.bulk(some)
                edges = np.concatenate([[0], np.cumsum(counts)])
                for k in range(len(some)):
                    if writer is None:
                        name = f"{place}/part-{part:05d}-{len(made):05d}-{uuid.uuid4().hex}.ids"
                        writer = FileWriter(files.open_output_stream(name))
                    writer.add(batch.column(0)[at + k].as_py(), np.append(ids[edges[k] : edges[k + 1]], end_id).astype(np.uint16))
                    if writer.n_ids >= FILE_IDS:
                        made.append(_closed(writer, part, len(made), name, first))
                        first, writer = first + writer.n_ids, None
                at += len(some)
        if writer is not None:
            made.append(_closed(writer, part, len(made), name, first))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")]).cast(_manifest_schema())

    rows.select("id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def _manifest_schema() -> pa.Schema:
    return pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in MANIFEST.split(", ")])


def _closed(writer: FileWriter, part: int, file: int, name: str, first: int) -> tuple:
    size = writer.close()
    writer.out.close()
    return part, file, name, first, writer.n_ids, len(writer.docs), size


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in a folder's files; a task reads a file.

    ``start`` counts the ids of all documents before it, in all files: a running
    sum with a row for each partition that wrote.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    files = manifest.join(bases, "part").select("path", "n_bytes", (F.col("base") + F.col("first_id")).alias("before"))
    files = files.repartition(max(1, min(10_000, manifest.count())))
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, before in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, place = _open(folder)
                with system.open_input_file(name) as source:
                    found = ((doc_id, before + start, parts, crc) for doc_id, start, parts, crc in FileReader(source, size).documents())
                    for some in in_parts(map(_Sized, found), 10_000, 1 << 22):
                        rows = [(x.doc[0], x.doc[1], len(x), x.doc[3], *([np.concatenate(x.doc[2]).astype(np.int32)] * with_ids)) for x in some]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, shape)


class _Sized:
    def __init__(self, doc: tuple):
        self.doc = doc

    def __len__(self) -> int:
        return sum(map(len, self.doc[2]))
