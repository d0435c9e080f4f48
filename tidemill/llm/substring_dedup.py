"""Removal of word windows that an earlier document already holds.

FM-index shards hold stretches of words, and documents are streamed through
the one shard that can hold their equals.  What makes that linear is how the
shards are cut: of the 5-word grams inside a window the one with the smallest
hash is its anchor, so equal windows have equal anchors and share a shard.

1. Equal texts are settled by their digest: all but the smallest id lose every
   window, and only one text of each group goes on.
2. Anchors (about one for five words) are shuffled with a tag of their text;
   those that two texts share become candidates.  Anchors that a bounded
   sample finds in one text of a hundred are candidates without being brought
   together, so a passage in a third of all documents meets in no task.
3. Candidate stretches, with every window around the anchor, are combined per
   task and dealt to shards.  A shard indexes the stretches that a document
   before the last of their anchor holds, and streams those that a document
   after the first holds: backward search keeps each one's matching statistics,
   and reports where they reach a whole window, with its smallest document.
   Stretches of anchors with more rows than a shard are dealt by whole windows.
4. Covered words are removed from the texts that lose any.

Words are compared by 48 bits of their hashes within a shard, and stretches
are named by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_join, sample_place, texts, written
from .fm_index import FmIndex

GRAM = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = hashlib.sha256(b"").hexdigest()


class RunHashes:
    """Hashes of any run of a sequence of hashes, from prefix sums of a polynomial."""

    def __init__(self, step: int = 0x9E3779B97F4A7C15):
        self.step, self.back = step, pow(step, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (self.step, self.back))

    def __call__(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = len(hashes)
        self._powers(n + 1)
        sums = np.append(np.uint64(0), np.cumsum(hashes * self.up[:n], dtype=np.uint64))
        run = (sums[start + size] - sums[start]) * self.down[start] + size.astype(np.uint64)
        run ^= run >> np.uint64(32)
        return (run * MIX).view(np.int64)


class WordHashes:
    """64-bit hashes of a text's words, all at once: runs of bytes that are no white space, each byte a number of its own."""

    def __init__(self):
        self.numbers = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
        self.white = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
        self.runs = RunHashes(0xA24BAED4963EE407)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        white = np.ones(len(data) + 2, bool)
        self.white.take(data, out=white[1:-1], mode="clip")
        edges = np.flatnonzero(white[1:] != white[:-1])
        return self.runs(self.numbers.take(data), edges[::2], edges[1::2] - edges[::2]).view(np.uint64)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` entries."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor hash."""
    grams = rolled(hashes, GRAM)
    n, width, reach = len(hashes) - window + 1, window - GRAM + 1, 1
    least, at = grams, np.arange(len(grams))  # the first of the smallest among ``reach`` grams, doubled
    while reach < width:
        step = min(reach, width - reach)
        later = least[step:] < least[:-step]
        least, at = (np.where(later, x[step:], x[:-step]) for x in (least, at))
        reach += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.diff(np.append(first, n)), grams[at[first]]


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest = [], []
        for text in texts(batch.column(1)):
            words = text.encode().split()
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), batch.column(2), batch.column(3)], names=["doc_id", "n_words", "all_sha256", "tag", "same"])


def _anchor_rows(window: int, frequent: frozenset[int]):
    hot = np.array(sorted(frequent), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes, done = WordHashes(), set()
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for text, tag in zip(texts(batch.column(0)), batch.column(1).to_numpy().tolist(), strict=True):
                hashes = word_hashes.of(text.encode() if tag not in done else b"")
                done.add(tag)  # copies within a task go once
                if len(hashes) < window:
                    continue
                first, n, anchor = anchors(hashes, window)
                anchor = anchor.view(np.int64)
                parts.append((anchor, np.full(len(first), tag), first * 64 + n * 2 + np.isin(anchor, hot)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["anchor", "tag", "pos"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor those whose anchor several texts hold, and all of frequent anchors."""
    held = [np.zeros(0, np.int64)] * 3
    settled = None  # an anchor already known to be shared, whose rows may still come
    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        anchor, tag, pos = rows
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(begin, len(anchor)))
        several = np.minimum.reduceat(tag, begin) != np.maximum.reduceat(tag, begin)
        several[0] |= anchor[0] == settled
        keep = np.repeat(several, size) | (pos & 1 == 1)
        if several[-1]:
            settled, held = anchor[-1], [np.zeros(0, np.int64)] * 3
        else:  # the last group may turn out shared; its texts are few, for each comes once a task
            tail = np.arange(len(anchor)) >= begin[-1]
            held = [x[tail & ~keep] for x in rows]
            settled = None
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tag, pos, anchor)], names=["tag", "pos", "anchor"])


def _stretches(batch: pa.RecordBatch, window: int, word_hashes: WordHashes, runs: tuple[RunHashes, RunHashes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row its word hashes and its candidates: key, segment number and check, first window, number of windows."""
    lists = batch.column(3)
    ends, inner = lists.offsets.to_numpy(), lists.values
    pos, anchor = (inner.field(k).to_numpy() for k in ("pos", "anchor"))
    for k, text in enumerate(texts(batch.column(2))):
        hashes = word_hashes.of(text.encode())
        p, key = pos[ends[k] : ends[k + 1]], anchor[ends[k] : ends[k + 1]]
        inside = (p >> 6) + ((p & 63) >> 1) + window - 1 <= len(hashes)  # a tag that two texts share may bring another's places
        p, key = p[inside], key[inside]
        first, n, hot = p >> 6, (p & 63) >> 1, p & 1 == 1
        # Windows of a frequent anchor go one by one, each under its own number.
        each = n[hot]
        ones = np.repeat(first[hot] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        start, count = np.concatenate([first[~hot], ones]), np.concatenate([n[~hot], np.ones(len(ones), np.int64)])
        segment, check = (r(hashes, start, count + window - 1) for r in runs)
        yield hashes, np.concatenate([key[~hot], segment[len(start) - len(ones) :]]), segment, check, start, count


def _runs() -> tuple[RunHashes, RunHashes]:
    return RunHashes(), RunHashes(0xD1B54A32D192ED03)


INDEX = "key long, segment long, check long, low binary, high binary, least long, most long"


def _index_rows(window: int):
    """Each segment of a batch once, with the smallest and the largest document that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes, runs = WordHashes(), _runs()
        for batch in batches:
            parts, symbols, before = [], [], 0
            for doc_id, (hashes, key, segment, check, start, count) in zip(batch.column(0).to_numpy().tolist(), _stretches(batch, window, word_hashes, runs), strict=True):
                parts.append((key, segment, check, start + before, count, np.full(len(key), doc_id)))
                symbols.append(hashes)
                before += len(hashes)
            key, segment, check, start, count, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(key):
                continue
            order = np.lexsort((owner, check, segment))
            new = np.append(True, (segment[order][1:] != segment[order][:-1]) | (check[order][1:] != check[order][:-1]))
            most = owner[order][np.append(np.flatnonzero(new)[1:], len(order)) - 1]
            order = order[new]
            size = count[order] + window - 1
            ends = np.cumsum(size)
            place = np.repeat(start[order] - (ends - size), size) + np.arange(int(ends[-1]))
            flat = np.concatenate(symbols)[place]
            cut = lambda kind, shift: pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(np.append(0, kind().itemsize * ends).astype(np.int32)), pa.py_buffer((flat >> np.uint64(shift)).astype(kind))])
            whole = pa.record_batch(
                [pa.array(key[order]), pa.array(segment[order]), pa.array(check[order]), cut(np.uint32, 32), cut(np.uint16, 16), pa.array(owner[order]), pa.array(most)],
                names=["key", "segment", "check", "low", "high", "least", "most"],
            )
            for lo in range(0, whole.num_rows, 50_000):
                yield whole.slice(lo, 50_000)

    return run


def _query_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes, runs = WordHashes(), _runs()
        for batch in batches:
            ids, tags = batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist()
            rows = []
            for doc_id, tag, (_, _, segment, check, start, _) in zip(ids, tags, _stretches(batch, window, word_hashes, runs), strict=True):
                rows.append((segment, check, np.full(len(segment), doc_id), np.full(len(segment), tag), start))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["segment", "check", "doc_id", "tag", "first"])

    return run


NOWHERE = np.iinfo(np.int64).max


def _search_shard(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None  # one shard, of bounded size
        if got is None or not got.num_rows:
            return
        # Several tasks may have sent a segment: its smallest and largest documents count.
        segment, check, least, most, key = (got[c].to_numpy() for c in ("segment", "check", "least", "most", "key"))
        order = np.lexsort((least, check, segment))
        new = np.flatnonzero(np.append(True, (segment[order][1:] != segment[order][:-1]) | (check[order][1:] != check[order][:-1])))
        most, rows = np.maximum.reduceat(most[order], new), order[new]
        least, key = least[rows], np.unique(key[rows], return_inverse=True)[1]
        first, last = np.full(key.max() + 1, NOWHERE), np.full(key.max() + 1, -NOWHERE)
        np.minimum.at(first, key, least)
        np.maximum.at(last, key, most)
        held, asked = rows[least < last[key]], rows[most > first[key]]
        if not len(held) or not len(asked):
            return

        def words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Word numbers of segments, one after the other, and their lengths."""
            low, high = got["low"].take(at).to_pylist(), got["high"].take(at).to_pylist()
            lens = np.fromiter((len(x) // 4 for x in low), np.int64, len(low))
            return np.frombuffer(b"".join(low), np.uint32).astype(np.int64) << 16 | np.frombuffer(b"".join(high), np.uint16).astype(np.int64), lens

        index = FmIndex(*words(held), got["least"].to_numpy()[held], window)
        symbols, lens = words(asked)
        minima = index.window_minima(symbols, lens, NOWHERE)
        counts = lens - window + 1
        hit = np.flatnonzero((minima < NOWHERE).any(axis=1))
        flat = minima[hit][np.arange(minima.shape[1]) < counts[hit, None]]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[hit])).astype(np.int32)), pa.array(flat))
        names = [got[c].take(asked[hit]).combine_chunks() for c in ("segment", "check")]
        for part in pa.table([*names, lists], names=["segment", "check", "minima"]).to_batches(20_000):
            yield part

    return run


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest = [], []
            for text, starts in zip(texts(batch.column(2)), batch.column(3), strict=True):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                change[at] += 1
                change[at + window] -= 1
                kept = np.cumsum(change)[:-1] == 0
                removed.append(int(len(words) - kept.sum()))
                digest.append(hashlib.sha256(b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "tag", "n_removed", "kept_sha256"])

    return run


def frequent_anchors(rows: DataFrame, n_docs: int, window: int, sample_docs: int = 2000) -> frozenset[int]:
    """Anchors that one sampled text in a hundred holds; they only decide how rows are dealt.

    Bounded by the sample: at most a hundred times the anchors of a mean text.
    """
    share = min(1.0, sample_docs / max(1, n_docs))
    sample = rows.where(sample_place(F.col("tag")) < share).select("text", "tag")
    counts = sample.mapInArrow(_anchor_rows(window, frozenset()), "anchor long, tag long, pos long").groupBy("anchor").agg(F.count_distinct("tag").alias("n"))
    return frozenset(r[0] for r in counts.where(F.col("n") >= max(8, 0.01 * share * n_docs)).select("anchor").collect())


def crowded(shared: DataFrame, most: int) -> DataFrame:
    """``shared`` with the anchors of more than ``most`` rows marked frequent, so that their windows are dealt one by one."""
    many = written(shared.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("anchor").alias("many")), "crowded-anchors")
    if many.isEmpty():
        return shared
    marked = shared.join(many, F.col("anchor") == F.col("many"), "left")
    return marked.select("tag", F.when(F.col("many").isNotNull(), F.col("pos").bitwiseOR(F.lit(1).cast("long"))).otherwise(F.col("pos")).alias("pos"), "anchor")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, shard_rows: int = 30_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes when a window of ``window`` words over it also starts in a
    document with a smaller id.  Repeats inside one document stay.  Null and
    short texts lose nothing; rows without an id are compared with none; rows
    that repeat an id do not count as earlier than each other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    base = written(rows.select("doc_id", "text", "tag", F.unhex(F.sha2("text", 256)).alias("same")).mapInArrow(_base, "doc_id long, n_words long, all_sha256 string, tag long, same binary"), "base")
    size = base.agg(F.count(F.lit(1)), F.sum("n_words")).first()
    firsts = written(base.where("doc_id is not null").groupBy("same", "tag").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "first-texts")
    parallel = docs.sparkSession.sparkContext.defaultParallelism

    able = rows.where("doc_id is not null")
    found = able.select("text", "tag").mapInArrow(_anchor_rows(window, frequent_anchors(able, size[0], window)), "anchor long, tag long, pos long")
    spread = F.when(F.col("pos").bitwiseAND(F.lit(1)) == 1, F.xxhash64("anchor", "tag")).otherwise(F.col("anchor"))
    parts = max(parallel, math.ceil((size[1] or 0) / 4_000_000))
    shared = written(found.repartition(parts, spread).sortWithinPartitions("anchor").mapInArrow(_shared, "tag long, pos long, anchor long"), "shared-anchors")

    cands = crowded(shared, shard_rows).groupBy("tag").agg(F.collect_set(F.struct("pos", "anchor")).alias("cands"))  # a text's own anchors
    cands = cands.join(firsts.select("tag", F.col("first_id").alias("doc_id")), "tag").hint("merge")
    told = written(able.join(cands, ["doc_id", "tag"]).select("doc_id", "tag", "text", "cands"), "candidates")
    shards = max(parallel, math.ceil(shared.count() / shard_rows))
    index = told.mapInArrow(_index_rows(window), INDEX).repartition(shards, "key")
    minima = index.mapInArrow(_search_shard(window), "segment long, check long, minima array<long>").hint("merge")
    asked = told.mapInArrow(_query_rows(window), "segment long, check long, doc_id long, tag long, first long")
    earlier = F.filter(F.transform("minima", lambda m, i: F.when(m < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull())
    starts = asked.join(minima, ["segment", "check"]).select("doc_id", "tag", earlier.alias("starts")).where(F.size("starts") > 0)
    starts = starts.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = told.select("doc_id", "tag", "text").join(starts.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "starts")
    cut = written(cut.mapInArrow(_cut_out(window), "doc_id long, tag long, n_removed long, kept_sha256 string"), "cut")

    several = firsts.where("copies > 1").select("same", "first_id", "copies")
    known = group_join(base, several, "same", "copies", "doc_id").join(cut.hint("merge"), ["doc_id", "tag"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window), F.lit(False))
    return known.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )
