"""Fill-in-the-middle: texts cut at two places that a hash of the id draws, and put together in another order.

A text's units are runs of ASCII letters and single other characters.  Their
first bytes are the ones of a packed bit vector over the bytes of many texts;
a directory of the ones in every block answers ``rank`` and ``select``, so the
number of a text's units and the bytes at which it is cut cost a block each and
not a pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # bytes of the bit vector for each entry of the directory
#: Texts of about so many bytes are held side by side; a longer one runs alone.
SIDE_BY_SIDE = 8 << 20
_IN_BYTE = np.array([[k for k in range(8) if b >> k & 1] + [0] * (8 - b.bit_count()) for b in range(256)], np.int64)


class BoundaryBits:
    """A bit vector with rank and select."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        self.bits = np.concatenate([packed, np.zeros(BLOCK - len(packed) % BLOCK, np.uint8)]).reshape(-1, BLOCK)
        #: The ones before each block; the last entry counts them all.
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits.view(np.uint64)).sum(axis=1, dtype=np.int64))])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        block, rest = np.divmod(places, 8 * BLOCK)
        byte, bit = np.divmod(rest, 8)
        inside = np.bitwise_count(self.bits[block])
        inside[np.arange(BLOCK) >= byte[:, None]] = 0
        part = np.bitwise_count(self.bits[block, byte] & ((1 << bit) - 1).astype(np.uint8))
        return self.directory[block] + inside.sum(axis=1, dtype=np.int64) + part

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Place of the one that has so many ones before it."""
        block = np.searchsorted(self.directory, ranks, "right") - 1
        left = ranks - self.directory[block]
        upto = np.cumsum(np.bitwise_count(self.bits[block]), axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, upto[np.arange(len(byte)), byte - 1], 0)
        return (block * BLOCK + byte) * 8 + _IN_BYTE[self.bits[block, byte], left]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, null as empty, and where each begins and ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about SIDE_BY_SIDE bytes."""
    _, edges = _flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + SIDE_BY_SIDE, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def boundaries(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which bytes begin a unit; bytes that continue no character belong to the unit before them."""
    letter = ((data | 0x20) - np.uint8(97)) < 26
    first = (data & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    first[edges[:-1][edges[:-1] < edges[1:]]] = True
    return first


def _marked(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts hold a marker."""
    hit = np.zeros(len(edges) - 1, bool)
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], [ord(c) for c in "PSM"]))
        text = np.searchsorted(edges, at, "right") - 1
        hit[text[at + 3 <= edges[text + 1]]] = True
    return hit


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' ids with ``n, form, prefix_chars, middle_chars, output``.

    ``output`` is the text again (plain), or its parts in the order prefix,
    suffix, middle (psm) or suffix, prefix, middle (spm), each after its marker.
    A null text is empty and so plain; an id that is null draws as an empty
    one; rows that repeat give equal outputs.  Bytes that are no UTF-8 stay as
    they are.  Other columns of ``docs`` are left out.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *draws)
    kind = rows.schema["id"].dataType.simpleString()

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        data, edges = _flat(part.column(1))
        h1, h2, h3, h4 = (part.column(k).to_numpy() for k in (2, 3, 4, 5))
        bits = BoundaryBits(boundaries(data, edges))
        before = bits.rank(edges)
        base, n = before[:-1], np.diff(before)
        cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
        at = [np.where(c < n, bits.select(np.minimum(base + c, max(0, int(before[-1]) - 1))), edges[1:]) if before[-1] else edges[1:] for c in cuts]
        plain = (n == 0) | _marked(data, edges) | (h3 % 100 >= 90)
        spm = h4 % 100 < 20
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        counts = [chars[at[0]] - chars[edges[:-1]], chars[at[1]] - chars[at[0]]]
        raw, out = data.tobytes(), []
        for s, a, b, e, is_plain, is_spm in zip(edges[:-1].tolist(), at[0].tolist(), at[1].tolist(), edges[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
            if is_plain:
                out.append(raw[s:e])
            elif is_spm:
                out.append(b"<S>%b<P>%b<M>%b" % (raw[b:e], raw[s:a], raw[a:b]))
            else:
                out.append(b"<P>%b<S>%b<M>%b" % (raw[s:a], raw[b:e], raw[a:b]))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        columns = [part.column(0), pa.array(n), pa.array(form.tolist(), pa.string()), *[pa.array(c, mask=plain) for c in counts], pa.array(out, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                yield one(part)

    made = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def rebuild(output: bytes, form: str) -> bytes:
    """The text of an output; the first of each marker is the real one, because no text with a marker is cut."""
    if form == "plain":
        return output
    first, rest = output[3:].split(b"<S>" if form == "psm" else b"<P>", 1)
    second, middle = rest.split(b"<M>", 1)
    return first + middle + second if form == "psm" else second + middle + first


def restore(filled: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``filled`` with ``restored``: the text, from nothing but an output and its form."""
    boxed = filled.select(F.struct(*[F.col(f"`{c}`") for c in filled.columns if c != output_col]).alias("row"), F.col(form_col).alias("form"), F.col(output_col).cast("binary").alias("output"))
    shape = f"row {boxed.schema['row'].dataType.simpleString()}, output binary, restored binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                texts = [rebuild(o.as_py() or b"", f.as_py() or "plain") for o, f in zip(part.column(2), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(texts, pa.binary())], names=["row", "output", "restored"])

    back = boxed.mapInArrow(run, shape)
    return back.select("row.*", F.col("output").cast("string").alias(output_col), F.col("restored").cast("string").alias("restored"))
