"""SimHash near-duplicates, searched with pivot distance tables.

Equal fingerprints are merged first, so copies never meet as pairs.  Two
fingerprints that differ in at most ``most_bits`` bits agree on all but that
many of ``b`` blocks; rows are dealt by the blocks they would agree on, with
``b`` growing with the number of fingerprints so that chance meetings stay
rare.  Inside a bucket each fingerprint has a table of Hamming distances to
reference fingerprints (pivots); by the triangle inequality a pair whose
distances to any pivot differ by more than ``most_bits`` cannot link.  Rows lie
in the order of their first distance, so a row only meets the stretch that can
be near; pairs whose largest coordinate difference is too large are discarded,
and survivors are verified bit by bit.  Only a spanning forest of a
bucket's links leaves the task.  A bucket above ``bucket_rows`` is not searched
as it is: its fingerprints go through a finer set of tables, down to one whose
buckets cannot exceed 2**16 distinct fingerprints.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_join, map_arrow, texts, without_ids, written
from .components import components

PIVOTS = 24
BLOCK = 16384
LEVELS = (6, 7, 8, 10, 12, 16)


def shingle_hashes(text: str, words_per_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 hashes (seed 42) of all word shingles, repeats included, in blocks; fewer words make one shingle."""
    words = text.encode().lower().split()  # bytes: both touch ASCII only
    if not words:
        return
    buffer = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    k = min(words_per_shingle, len(words))
    first, past = starts[: len(words) - k + 1], (starts + lens)[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(first), BLOCK):
        yield np.array([digest(buffer[s:e], 42) for s, e in zip(first[lo : lo + BLOCK].tolist(), past[lo : lo + BLOCK].tolist(), strict=True)], "<u8")


class Majority:
    """The majority of each bit over the hashes added."""

    def __init__(self):
        self.count, self.n = np.zeros(64, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.count += np.add.reduce(bits, axis=0, dtype=np.int32)
        self.n += len(hashes)

    def value(self) -> int:
        return sum(1 << i for i in np.flatnonzero(2 * self.count > self.n).tolist())


def simhash(text: str, words_per_shingle: int) -> int:
    """Fingerprint of a text: the majority of each bit over all its shingles' hashes; 0 without words."""
    bits = Majority()
    for hashes in shingle_hashes(text, words_per_shingle):
        bits.add(hashes)
    return bits.value()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """``doc_id, fp``: the 64 bits as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((simhash(t, words_per_shingle) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(id_col, text_col), rows, "doc_id long, fp long")


def block_masks(blocks: int, agree: int) -> list[int]:
    """A mask for every choice of ``agree`` of ``blocks`` runs of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(runs, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the fixed reference fingerprints."""
    pivots = np.random.default_rng(64).integers(0, 2**64, PIVOTS, np.uint64, endpoint=False)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


class Near:
    """Decides which pairs of a bucket's rows link: maximum coordinate difference first, then the
    bits, then - with signatures - how many of their places agree."""

    def __init__(self, fps: np.ndarray, most_bits: int, signatures: np.ndarray | None = None, least_equal: int = 0):
        self.fps, self.table, self.most_bits = fps, pivot_table(fps), most_bits
        self.signatures, self.least_equal = signatures, least_equal

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = np.abs(self.table[a] - self.table[b]).max(axis=1) <= self.most_bits
        near[near] = np.bitwise_count((self.fps[a] ^ self.fps[b])[near]) <= self.most_bits
        if self.signatures is not None and near.any():
            near[near] = (self.signatures[a[near]] == self.signatures[b[near]]).sum(axis=1) >= self.least_equal
        return near

    def sorted(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of their distance to the first pivot, and that distance."""
        order = np.argsort(self.table[rows, 0], kind="stable")
        return rows[order], self.table[rows[order], 0]

    def reach(self, at: int, place: np.ndarray) -> tuple[int, int]:
        """The part of the order that may lie near a row: no other can, by the triangle inequality."""
        own = int(self.table[at, 0])
        return int(np.searchsorted(place, own - self.most_bits)), int(np.searchsorted(place, own + self.most_bits, "right"))

    def __len__(self) -> int:
        return len(self.fps)


class Alike:
    """Decides which pairs of rows resemble each other by ``similarity``: equal places of the signatures
    discard, the sets of shingles decide."""

    def __init__(self, signatures: np.ndarray, sets: list[np.ndarray], least_equal: int, similarity: float):
        self.signatures, self.sets, self.least_equal, self.similarity = signatures, sets, least_equal, similarity

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alike = (self.signatures[a] == self.signatures[b]).sum(axis=1) >= self.least_equal
        for i in np.flatnonzero(alike).tolist():
            alike[i] = resemblance(self.sets[a[i]], self.sets[b[i]]) >= self.similarity
        return alike

    def sorted(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of the sizes of their sets, and those sizes."""
        sizes = np.fromiter((len(self.sets[i]) for i in rows.tolist()), np.int64, len(rows))
        order = np.argsort(sizes, kind="stable")
        return rows[order], sizes[order]

    def reach(self, at: int, place: np.ndarray) -> tuple[int, int]:
        """The part of the order that may resemble a row: sets whose sizes differ more cannot."""
        own = len(self.sets[at])
        return int(np.searchsorted(place, math.ceil(own * self.similarity - 1e-9))), int(np.searchsorted(place, math.floor(own / self.similarity + 1e-9), "right"))

    def __len__(self) -> int:
        return len(self.sets)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes, neither empty."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def bucket_links(near_pairs: Near | Alike, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that span each bucket's components; buckets begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(near_pairs)))
    out_a, out_b = [], []
    small = (sizes > 1) & (sizes <= 6)
    for d in range(1, 6):
        for i in range(6 - d):
            a = starts[small & (sizes > i + d)] + i
            near = near_pairs(a, a + d)
            out_a.append(a[near])
            out_b.append(a[near] + d)
    for start, size in zip(starts[sizes > 6].tolist(), sizes[sizes > 6].tolist(), strict=True):
        left, place = near_pairs.sorted(np.arange(start, start + size))
        while len(left):
            queue = [int(left[0])]
            left, place = left[1:], place[1:]
            while queue and len(left):
                at = queue.pop()
                lo, hi = near_pairs.reach(at, place)
                near = np.zeros(len(left), bool)
                near[lo:hi] = near_pairs(np.full(hi - lo, at), left[lo:hi])
                found, left, place = left[near], left[~near], place[~near]
                out_a.append(np.full(len(found), at))
                out_b.append(found)
                queue += found.tolist()
    return np.concatenate(out_a), np.concatenate(out_b)


def _search(most_bits: int, least_equal: int = 0, similarity: float = 0.0):
    """Links of rows ``band, key, fp, node`` (and ``signature``, and ``shingles``) sorted by bucket."""

    def links(part: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        signatures = part[4].view(np.uint8).reshape(-1, SIGNATURE) if len(part) > 4 else None
        if len(part) > 5:
            near_pairs = Alike(signatures, [np.frombuffer(x, "<u8") for x in part[5]], least_equal, similarity)
        else:
            near_pairs = Near(part[2].view(np.uint64), most_bits, signatures, least_equal)
        a, b = bucket_links(near_pairs, starts)
        return pa.RecordBatch.from_arrays([pa.array(part[3][a]), pa.array(part[3][b])], names=["u", "v"])

    def column(c: pa.Array, at: int) -> np.ndarray:
        if at == 5:
            return np.array([*c.to_pylist(), None], object)[:-1]
        if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            return np.array(c.to_pylist(), f"V{SIGNATURE}")
        return c.to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            part = [column(c, at) for at, c in enumerate(batch.columns)]
            part = [np.concatenate([r, p]) for r, p in zip(rest, part, strict=True)] if rest else part
            new = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0)) + 1
            if len(new):  # the last bucket may go on in the next batch
                yield links([p[: new[-1]] for p in part], np.append(0, new[:-1]))
                part = [p[new[-1] :] for p in part]
            rest = part
        if rest and len(rest[0]):
            yield links(rest, np.zeros(1, np.int64))

    return run


def near_links(prints: DataFrame, most_bits: int = 4, bucket_rows: int = 4096, rows_a_task: int = 400_000) -> DataFrame:
    """Links ``u, v`` between nodes of ``prints(node, fp)``, enough to span every component."""
    n = prints.count()
    found, level = [], 0
    while level < len(LEVELS) - 1 and 64 * (LEVELS[level] - most_bits) / LEVELS[level] < math.log2(n + 1) + 3:
        level += 1
    while True:
        masks = block_masks(LEVELS[level], LEVELS[level] - most_bits)
        dealt = prints.select(
            "node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")
        ).select("k.band", "k.key", "fp", "node")
        tasks = max(prints.sparkSession.sparkContext.defaultParallelism, math.ceil(n * len(masks) / rows_a_task))
        last = level == len(LEVELS) - 1
        if not last:
            hot = written(dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).drop("n"), "hot-buckets")
            if hot.isEmpty():
                last = True
            else:
                again = dealt.join(hot, ["band", "key"], "left_semi").select("node", "fp").distinct()
                dealt = dealt.join(hot, ["band", "key"], "left_anti").select("band", "key", "fp", "node")
        found.append(dealt.repartition(tasks, "band", "key").sortWithinPartitions("band", "key", "fp").mapInArrow(_search(most_bits), "u long, v long"))
        if last:
            break
        prints, level = written(again, "hot-prints"), level + 1
        n = prints.count()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, most_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and link like any other.
    Rows that share an id count as one document; a row without an id gets the
    component of its fingerprint's other rows, or null if there is none.
    """
    each = written(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    prints = written(each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "prints")
    # One id with several fingerprints holds those together.
    repeats = each.where("doc_id is not null").join(prints, "fp").where("doc_id <> node")
    repeats = repeats.join(prints.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    joined = components(near_links(prints, most_bits).unionByName(repeats))
    smallest = written(prints.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "print-components")
    return each.join(smallest, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Resemblance: the share of equal minima under SIGNATURE fixed permutations; ROWS of them make a band.
SIGNATURE, ROWS = 192, 4
_RANDOM = np.random.default_rng(SIGNATURE)
FACTORS = _RANDOM.integers(0, 2**63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 2**63, SIGNATURE, np.uint64)
BANDS = 12


def shingle_set(text: str, words_per_shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    blocks = list(shingle_hashes(text, words_per_shingle))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, "<u8")


def signed_prints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """``doc_id, tag, size, fp, signature, bands`` of each text's set of shingles; a text without words has no bands.

    ``tag`` is a hash of the text and ``size`` the number of its distinct shingles.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, signatures, bands, sizes = [], [], [], []
        for text in texts(batch.column(1)):
            hashes = shingle_set(text, words_per_shingle)
            bits, least = Majority(), np.full(SIGNATURE, 2**64 - 1, np.uint64)
            for lo in range(0, len(hashes), 256):
                bits.add(hashes[lo : lo + 256])
                least = np.minimum(least, (hashes[lo : lo + 256, None] * FACTORS + SHIFTS).min(axis=0))
            fps.append(bits.value())
            signatures.append((least & np.uint64(255)).astype(np.uint8).tobytes())  # of the least: its high bits are always near zero
            keys = [xxhash.xxh64_intdigest(least[ROWS * k : ROWS * (k + 1)].tobytes(), k) - 2**63 for k in range(BANDS)]
            bands.append(keys if bits.n else [])
            sizes.append(len(hashes))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "tag", "size", "fp", "signature", "bands"],
        )

    source = docs.select(id_col, text_col, F.xxhash64(text_col))
    return map_arrow(source, rows, "doc_id long, tag long, size long, fp long, signature binary, bands array<long>")


def with_shingles(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """``band, key, fp, node, signature, shingles`` from the same columns with a text in the last one's place."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, words_per_shingle).tobytes() for t in texts(batch.column(5))]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.binary())], names=["band", "key", "fp", "node", "signature", "shingles"])

    return map_arrow(rows, sets, "band long, key array<long>, fp long, node long, signature binary, shingles binary")


def part_tasks(parts: Column, node: Column) -> Column:
    """The tasks a node of a bucket in ``parts`` parts goes to: one for each two parts, so that every two nodes meet."""
    own = F.pmod(F.xxhash64(node), parts)
    others = F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda q: q != own)
    return F.when(parts > 1, F.transform(others, lambda q: F.least(q, own) * parts + F.greatest(q, own))).otherwise(F.array(F.lit(0).cast("long")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, rows_a_task: int = 200_000) -> DataFrame:
    """``doc_id, component_id`` of rows whose shingle sets resemble each other by ``similarity``.

    At this similarity fingerprints differ in up to a third of their bits, too
    many for blocks of equal bits to find.  Candidates come from bands of
    shingle minima instead (a pair at 0.8 shares one of the twelve with
    probability 0.998); in each shared bucket pivot tables, bits and signatures
    discard with bounds five standard errors wide.  Texts that candidate pairs
    hold together form a group, and in a group the sets of shingles themselves
    decide.  Equal fingerprints and signatures are merged before; a crowded
    bucket or group is cut into parts, and every two parts meet in a task of
    their own.
    """
    most_bits = math.ceil(64 * (1 - similarity) * 2.2)  # five standard errors, also at five shingles against four
    least_equal = math.floor(SIGNATURE * (similarity - 0.15))
    each = written(signed_prints(docs, id_col, text_col, words_per_shingle), "signed-prints")
    first = F.min(F.struct("doc_id", "tag", "size")).alias("r")
    prints = each.where("doc_id is not null").groupBy("fp", "signature").agg(first, F.first("bands").alias("bands"))
    prints = written(prints.select("fp", "signature", F.col("r.doc_id").alias("node"), "r.tag", "r.size", "bands"), "signed-nodes")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(prints.count() * BANDS / rows_a_task))
    # Signatures only move to buckets of two rows and more.
    thin = prints.select(F.posexplode("bands").alias("band", "key"), "node", "tag")
    shared = thin.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("merge")
    shared = written(thin.join(shared, ["band", "key"]), "shared-buckets")
    dealt = shared.join(prints.select("node", "tag", "fp", "signature").hint("merge"), ["node", "tag"])
    dealt = dealt.withColumn("task", F.explode(part_tasks(F.ceil(F.col("n") / CROWDED), F.col("node"))))
    dealt = dealt.select("band", F.xxhash64("key", "task").alias("key"), "fp", "node", "signature")
    links = dealt.repartition(tasks, "band", "key").sortWithinPartitions("band", "key", "node").mapInArrow(_search(most_bits, least_equal), "u long, v long")
    joined = components(verified(docs, prints, components(links), id_col, text_col, words_per_shingle, similarity, least_equal, tasks))
    named = written(prints.join(joined, "node", "left").select("fp", "signature", F.coalesce("component", "node").alias("component_id")), "similar-components")
    return each.join(named, ["fp", "signature"], "left").select("doc_id", "component_id")


def verified(
    docs: DataFrame, prints: DataFrame, groups: DataFrame, id_col: str, text_col: str, words_per_shingle: int, similarity: float, least_equal: int, tasks: int
) -> DataFrame:
    """Links ``u, v`` that span each group's texts of ``similarity``; groups: ``node, component``."""
    members = written(prints.drop("bands").join(groups.hint("merge"), "node"), "members")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / CROWDED, F.sum("size") / CROWDED_SHINGLES))
    sizes = written(members.groupBy("component").agg(parts.alias("parts"), F.count(F.lit(1)).alias("n")), "group-sizes")
    members = group_join(members, sizes, "component", "n", "node")
    texts_of = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    rows = texts_of.join(members.hint("merge"), ["node", "tag"])
    key = part_tasks(F.col("parts"), F.col("node"))
    sets = with_shingles(rows.select(F.col("component").alias("band"), key.alias("key"), "fp", "node", "signature", "text"), words_per_shingle)
    dealt = sets.withColumn("key", F.explode("key")).repartition(tasks, "band", "key").sortWithinPartitions("band", "key", "node")
    return dealt.mapInArrow(_search(0, least_equal, similarity), "u long, v long")


CROWDED = 4096
CROWDED_SHINGLES = 4_000_000


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that stay: the smallest id of each component of similar texts.

    Rows that repeat that id stay together, and rows without an id stay.
    Texts without words are alike.
    """
    marks = similar_documents(docs, id_col, text_col, words_per_shingle, similarity)
    gone = marks.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("id"))
    return without_ids(docs, gone, id_col)
