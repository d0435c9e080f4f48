"""Toxicity by a convolutional text classifier, trained on every labelled row.

A word's embedding is the sum of hashed vectors of its whole form, its
beginnings and its character 4-grams, so inflected forms share what they were
taught.  Filters of several widths run over the word sequence, max pooling
keeps each filter's strongest answer in the whole text, and a logistic unit
weighs those.  Languages differ in how loud the filters are, so the decision
threshold is calibrated by language: a small hashed-word model names the
language from the text alone, and the raw score is mapped so that this
language's threshold lands on 0.7.

Training goes in rounds.  In each, tasks fit copies of one network to their
parts of the rows, and the copies are averaged: a word's vector over those that
moved it.  The first round is one part of bounded size, walked several times; the
others hold all other rows.
"""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, boxed, in_parts, map_arrow, marked, sample_place, texts, written

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
LANG_BUCKETS = 1 << 12
LONGEST = 64  # characters of a stretch
BLOCK = 8192  # words convolved at once, so that memory does not follow a text's length
THRESHOLD = 0.7
FIRST, EPOCHS = 2400, 5  # rows of the first round, about, and how often it is walked
ROUNDS, PART = 3, 2000  # rounds after the first, and rows of a part, about
SLICES = 64  # of the table, so that averaging it is dealt out
STEP = 0.01  # of log-odds, between two cuts that are told apart


def split_words(text: str) -> list[str]:
    """Lower-case words; an overlong run goes in stretches that overlap by three, so that every 4-gram of it is in one.

    Text without spaces is thus read to its end, a stretch at a time.
    """
    out = []
    for word in WORD.findall(text.lower()):
        out += [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - 3, LONGEST - 3)]
    return out


def buckets(word: str) -> list[int]:
    """Hash buckets of a word: whole, beginnings of 3 to 6 letters, all 4-grams."""
    if word.isascii():
        w = word.encode()
        found = {b"=" + w, *[b"<" + w[:k] for k in range(3, min(6, len(w)) + 1)], *[w[i : i + 4] for i in range(len(w) - 3)]}
        return [zlib.crc32(p) % BUCKETS for p in sorted(found)]
    parts = {"=" + word} | {"<" + word[:k] for k in range(3, min(6, len(word)) + 1)} | {word[i : i + 4] for i in range(len(word) - 3)}
    return [zlib.crc32(p.encode()) % BUCKETS for p in sorted(parts)]


_ZEROS = zlib.crc32(bytes(4))
#: What a byte at each of four places changes in the checksum of four zeros.
_CRC = np.array([[zlib.crc32(bytes(k) + bytes([c]) + bytes(3 - k)) ^ _ZEROS for c in range(256)] for k in range(4)], np.uint32)


def bucket_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``buckets`` of many words: ``flat[starts[k] : starts[k] + lens[k]]`` are those of word ``k``, in an order that depends on the word alone."""
    plain = [k for k, w in enumerate(words) if w.isascii()]
    coded = [words[k].encode() for k in plain]
    data = np.frombuffer(b"".join(coded), np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    grams = np.maximum(sizes - 3, 0)
    place = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    code = sum(data[place + k].astype(np.int64) << (24 - 8 * k) for k in range(4)) if len(place) else place
    keys = np.unique(np.repeat(np.arange(len(coded)), grams) << 32 | code)  # a word's different 4-grams
    four = np.bitwise_xor.reduce([_CRC[k][keys >> (24 - 8 * k) & 255] for k in range(4)]) ^ np.uint32(_ZEROS)
    heads = [[zlib.crc32(w, _WHOLE), *[zlib.crc32(w[:k], _BEGUN) for k in range(3, min(6, len(w)) + 1)]] for w in coded]
    n_heads, n_grams = np.fromiter(map(len, heads), np.int64, len(heads)), np.bincount(keys >> 32, minlength=len(coded))
    owner = np.concatenate([np.repeat(np.arange(len(coded)), n_heads), keys >> 32])
    values = np.concatenate([np.fromiter(itertools.chain.from_iterable(heads), np.int64, int(n_heads.sum())), four.astype(np.int64)]) % BUCKETS
    other = {k: buckets(w) for k, w in enumerate(words) if not w.isascii()}
    flat = np.concatenate([values[np.argsort(owner, kind="stable")], np.fromiter(itertools.chain.from_iterable(other.values()), np.int64)])
    lens = np.zeros(len(words), np.int64)
    order = np.array([*plain, *other], np.int64)
    lens[order] = np.concatenate([n_heads + n_grams, np.fromiter(map(len, other.values()), np.int64, len(other))])
    starts = np.zeros(len(words), np.int64)
    starts[order] = np.cumsum(lens[order]) - lens[order]
    return flat, starts, lens


_WHOLE, _BEGUN = zlib.crc32(b"="), zlib.crc32(b"<")


class Lexicon:
    """Word numbers, their buckets and language buckets; remembers up to ``most`` words."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.index: dict[str, int] = {}
        self.waiting: list[str] = []
        self.flat = self.starts = self.lens = self.spoken = np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        index = self.index
        for w in set(words).difference(index):
            index[w] = len(index)
            self.waiting.append(w)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def learn(self) -> np.ndarray:
        """Work out the buckets of the words that were met since; their numbers."""
        flat, starts, lens = bucket_runs(self.waiting)
        spoken = np.fromiter((zlib.crc32(w.encode()) for w in self.waiting), np.int64, len(self.waiting)) % LANG_BUCKETS
        new = np.arange(len(self.lens), len(self.lens) + len(lens))
        self.starts, self.lens = np.concatenate([self.starts, starts + len(self.flat)]), np.concatenate([self.lens, lens])
        self.flat, self.spoken, self.waiting = np.concatenate([self.flat, flat]), np.concatenate([self.spoken, spoken]), []
        return new

    def embed(self, numbers: np.ndarray, table: np.ndarray) -> np.ndarray:
        """A row per word: the sum of its buckets' vectors over the root of their number."""
        if not len(numbers):
            return np.zeros((0, DIM), np.float32)
        lens = self.lens[numbers]
        begin = np.cumsum(lens) - lens
        at = self.flat[np.repeat(self.starts[numbers] - begin, lens) + np.arange(int(lens.sum()))]
        return np.add.reduceat(table[at], begin, axis=0) / np.sqrt(lens)[:, None].astype(np.float32)


@dataclass
class Toxicity:
    table: np.ndarray  # BUCKETS x DIM
    kernels: list[np.ndarray]  # width x DIM x FILTERS for each width
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float
    languages: tuple[str, ...]
    language_weights: np.ndarray  # LANG_BUCKETS x languages, log-probabilities
    thresholds: np.ndarray  # on the raw score, one for each language

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max over the text of every filter, and where it was reached."""
        best, place = [], []
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases, strict=True):
            if len(x) < width:
                x = np.concatenate([x, np.zeros((width - len(x), DIM), np.float32)])
            n = len(x) - width + 1
            top, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
            for lo in range(0, n, BLOCK):
                hi = min(n, lo + BLOCK)
                y = sum(x[lo + k : hi + k] @ kernel[k] for k in range(width))
                where = y.argmax(axis=0)
                value = y[where, np.arange(FILTERS)]
                at = np.where(value > top, where + lo, at)
                top = np.maximum(value, top)
            best.append(np.maximum(top + bias, 0))
            place.append(at)
        return np.concatenate(best), np.concatenate(place)

    def strongest(self, x: np.ndarray) -> np.ndarray:
        """What ``pooled`` gives without the places."""
        best = []
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases, strict=True):
            if len(x) < width:
                x = np.concatenate([x, np.zeros((width - len(x), DIM), np.float32)])
            n = len(x) - width + 1
            tops = [sum(x[lo + k : min(n, lo + BLOCK) + k] @ kernel[k] for k in range(width)).max(axis=0) for lo in range(0, n, BLOCK)]
            best.append(np.maximum(np.max(tops, axis=0) + bias, 0))
        return np.concatenate(best)

    def raw(self, x: np.ndarray) -> float:
        h = self.strongest(x)
        return float(1 / (1 + np.exp(-np.clip(h @ self.out + self.offset, -40, 40))))

    def language(self, words: set[str]) -> int:
        """Number of the likeliest language by its words; 0 without words or languages."""
        if not words or len(self.languages) < 2:
            return 0
        return self.spoken(np.array([zlib.crc32(w.encode()) % LANG_BUCKETS for w in words]))

    def spoken(self, at: np.ndarray) -> int:
        """The same by the buckets of different words."""
        return int(self.language_weights[at].sum(axis=0).argmax()) if len(at) and len(self.languages) > 1 else 0

    def calibrated(self, raw: float, language: int) -> float:
        """Log-odds moved so that the language's threshold becomes THRESHOLD."""
        t = float(self.thresholds[language]) if len(self.thresholds) else 0.5
        odds = np.log(raw / (1 - raw)) - np.log(t / (1 - t)) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


@dataclass
class State:
    """A network in training with the squared gradients that its steps are divided by."""

    m: Toxicity
    g_table: np.ndarray
    g_kernels: list[np.ndarray]
    g_out: np.ndarray
    g_bias: list[np.ndarray]

    def rest(self) -> list[np.ndarray]:
        """All arrays but the table and its gradients."""
        return [*self.m.kernels, *self.m.biases, self.m.out, *self.g_kernels, self.g_out, *self.g_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([*[x.ravel() for x in self.rest()], np.array([self.m.offset])]).astype(np.float64)

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.rest():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.m.offset = float(flat[at])


def _begun(seed: int) -> State:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    m = Toxicity(normal(BUCKETS, DIM) * 0.1, [normal(w, DIM, FILTERS) * (0.5 / np.sqrt(w)) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(len(WIDTHS) * FILTERS) * 0.3, -1.0, (), np.zeros((LANG_BUCKETS, 0)), np.zeros(0))
    return State(m, np.full(BUCKETS, 1e-3, np.float32), [np.full_like(k, 1e-3) for k in m.kernels], np.full_like(m.out, 1e-3), [np.full_like(b, 1e-3) for b in m.biases])


def _fit(state: State, lexicon: Lexicon, texts: list[np.ndarray], y: np.ndarray, weights: tuple[float, float], rates: list[float], seed: int) -> None:
    """Adagrad on the logistic loss, a text at a time, one walk for each rate; only the pooled positions get gradients."""
    rng = np.random.default_rng(seed)
    m, g_table, g_kernels, g_out, g_bias = state.m, state.g_table, state.g_kernels, state.g_out, state.g_bias
    weight = np.where(y == 1, weights[1], weights[0])
    for rate in rates:
        for i in rng.permutation(len(texts)).tolist():
            numbers = texts[i]
            used, inverse = np.unique(numbers, return_inverse=True)
            x = lexicon.embed(used, m.table)[inverse]
            h, place = m.pooled(x)
            p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.offset, -40, 40)))
            d = np.float32((p - y[i]) * weight[i])
            if abs(d) < 0.02:
                continue
            back = d * m.out * (h > 0)
            g = d * h
            g_out += g * g
            m.out -= rate * g / np.sqrt(g_out)
            m.offset -= rate * 0.3 * float(d)
            moved: dict[int, np.ndarray] = {}
            for k, width in enumerate(WIDTHS):
                rows = slice(k * FILTERS, (k + 1) * FILTERS)
                g_bias[k] += back[rows] ** 2
                gk = np.zeros_like(m.kernels[k])
                for f in np.flatnonzero(back[rows]).tolist():
                    for o in range(width):
                        at = int(place[rows][f]) + o
                        if at >= len(numbers):
                            continue
                        gk[o, :, f] += back[rows][f] * x[at]
                        w = int(numbers[at])
                        moved[w] = moved.get(w, 0) + back[rows][f] * m.kernels[k][o, :, f]
                g_kernels[k] += gk * gk
                m.kernels[k] -= rate * gk / np.sqrt(g_kernels[k])
                m.biases[k] -= rate * back[rows] / np.sqrt(g_bias[k])
            for w, g in moved.items():
                at = lexicon.flat[lexicon.starts[w] : lexicon.starts[w] + lexicon.lens[w]]
                g = g / np.float32(np.sqrt(len(at)))
                g_table[at] += float(g @ g)
                m.table[at] -= rate * g / np.sqrt(g_table[at])[:, None]


def _averaged(rows: DataFrame, state: State, weights: tuple[float, float], rates: list[float], seed: int) -> State:
    """``state`` after a round over ``rows`` (part, id, text, label): the mean of what the parts make of it."""
    shared = rows.sparkSession.sparkContext.broadcast(state)  # bounded: the network's size
    size = BUCKETS // SLICES

    def fit(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        own, lexicon = pickle.loads(pickle.dumps(shared.value)), Lexicon()
        numbers = [lexicon.numbers(split_words(x)) for x in texts(part.column("text"))]
        lexicon.learn()
        _fit(own, lexicon, numbers, part.column("label").to_numpy().astype(np.int64), weights, rates, seed + key[0].as_py())
        moved = own.g_table != shared.value.g_table
        table = np.concatenate([own.m.table - shared.value.m.table, (own.g_table - shared.value.g_table)[:, None], moved[:, None]], axis=1).astype(np.float64)
        sums = [x.tobytes() for x in table.reshape(SLICES, -1)] + [np.append(own.flat(), 1).tobytes()]
        return pa.table({"slice": pa.array(range(SLICES + 1), pa.int32()), "part": pa.array([key[0].as_py()] * len(sums), pa.int32()), "sums": pa.array(sums, pa.binary())})

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in parts.sort_by("part").column("sums"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    fitted = rows.groupBy("part").applyInArrow(fit, "slice int, part int, sums binary")
    got = {r["slice"]: np.frombuffer(r["sums"]) for r in fitted.groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()}
    if not got:
        return state
    table = np.concatenate([got[k].reshape(size, DIM + 2) for k in range(SLICES)])
    by = np.maximum(table[:, -1:], 1)
    state.m.table += (table[:, :DIM] / by).astype(np.float32)
    state.g_table += (table[:, DIM] / by[:, 0]).astype(np.float32)
    state.put(got[SLICES][:-1] / got[SLICES][-1])
    return state


def _language_weights(rows: DataFrame) -> tuple[tuple[str, ...], np.ndarray]:
    """Log-probabilities of word buckets in the languages of ``rows`` (text, lang), each text's words counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                at = [zlib.crc32(w.encode()) % LANG_BUCKETS for w in set(split_words(text))]
                counts[lang] = counts.get(lang, 0) + np.bincount(np.array(at, np.int64), minlength=LANG_BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x.tolist() for x in counts.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    found = rows.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, counts array<bigint>")
    summed = found.select("lang", F.posexplode("counts").alias("bucket", "n")).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).where("n > 0")
    got = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).collect()  # languages times buckets
    names = tuple(sorted(r["lang"] for r in got))
    counts = np.full((LANG_BUCKETS, len(names)), 0.5)
    for r in got:
        counts[[x[0] for x in r["counts"]], names.index(r["lang"])] += [x[1] for x in r["counts"]]
    return names, np.log(counts / counts.sum(axis=0))


def _threshold(odds: np.ndarray, n: np.ndarray, hits: np.ndarray, usual: float) -> float:
    """The cut with the best F1, midway to the next score, over ``n`` rows at ascending log-odds, ``hits`` of label 1; the usual one without both labels."""
    if hits.sum() in (0, n.sum()):
        return usual
    odds, n, hit = odds[::-1], n[::-1], np.cumsum(hits[::-1])
    k = int((2 * hit / (np.cumsum(n) + hits.sum())).argmax())
    middle = (odds[k] + (odds[k + 1] if k + 1 < len(odds) else odds[k] - 1)) / 2
    return float(np.clip(1 / (1 + np.exp(-middle)), 0.02, 0.98))


def _thresholds(rows: DataFrame, model: Toxicity) -> np.ndarray:
    """A threshold for each language from all ``rows`` (id, text, label): they are counted by language and step of the log-odds."""
    scored = _raw(rows, model, "id", "text").join(rows.select("id", "label"), "id")
    step = F.round(F.log(F.col("raw") / (1 - F.col("raw"))) / STEP).cast("int")
    got = scored.groupBy("language", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).toPandas().sort_values("step")  # at most languages times steps
    cut = lambda g, usual: _threshold(g.index.to_numpy() * STEP, g["n"].to_numpy(), g["hits"].to_numpy(), usual)
    usual = cut(got.groupby("step")[["n", "hits"]].sum(), 0.5)
    return np.array([cut(got[got["language"] == k].set_index("step"), usual) for k in range(max(1, len(model.languages)))])


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Toxicity:
    """Fit on ``docs`` (id, text, lang) and ``labels`` (id, label), all rows that have both.

    The language column only teaches which words belong to which language.  A
    fifth of the rows is kept from the network and sets the thresholds.
    """
    labels = labels.where("label is not null")
    place = lambda name: sample_place(F.col("id"), F.lit(name))
    # Only texts whose ids may be labelled move.
    rows = marked(boxed(docs.where("text is not null"), id=F.col("id")), written(bitmap(labels.select("id")), "toxic-marks"), F.col("id")).where("mark")
    rows = written(rows.select("id", "row.text", "row.lang").join(labels.select("id", F.col("label").cast("int").alias("label")).hint("merge"), "id").withColumn("calibrates", place("calibrate") < 0.2), "toxic-rows")
    n = dict(rows.where("not calibrates").groupBy("label").count().collect())
    taught = sum(n.values())
    weights = tuple(0.5 * taught / max(1, n.get(k, 0)) for k in (0, 1))
    later = F.floor(place("round") * ROUNDS).cast("int") + 1
    parts = max(1, -(-taught // (ROUNDS * PART)))
    own = rows.where("not calibrates").select("id", "text", "label", F.when(place("first") * max(taught, 1) < FIRST, 0).otherwise(later).alias("round"), F.floor(place("part") * parts).cast("int").alias("part"))
    state = _averaged(own.where("round = 0").withColumn("part", F.lit(0)), _begun(seed), weights, [0.15 / (1 + k) for k in range(EPOCHS)], seed)
    if taught > FIRST:
        for k in range(1, ROUNDS + 1):
            state = _averaged(own.where(F.col("round") == k), state, weights, [0.15 / (EPOCHS + k)], seed + 1000 * k)
    model = state.m
    model.languages, model.language_weights = _language_weights(rows)
    model.thresholds = _thresholds(rows.where("calibrates"), model)
    return model


def _raw(docs: DataFrame, model: Toxicity, id_col: str, text_col: str) -> DataFrame:
    """``id, raw, language, worded`` of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the network's size

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, lexicon, vectors = shared.value, Lexicon(), np.zeros((0, DIM), np.float32)
        raw, language, worded = [], [], []
        for part in in_parts(map(split_words, texts(batch.column(1))), most_items=500, most_size=200_000):
            if len(lexicon.index) > lexicon.most:
                lexicon, vectors = Lexicon(), vectors[:0]
            numbers = [lexicon.numbers(w) for w in part]
            vectors = np.concatenate([vectors, lexicon.embed(lexicon.learn(), model.table)])
            for n in numbers:
                raw.append(min(max(model.raw(vectors[n]), 1e-9), 1 - 1e-9))
                language.append(model.spoken(lexicon.spoken[np.unique(n)]))
                worded.append(len(n) > 0)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.float64()), pa.array(language, pa.int32()), pa.array(worded, pa.bool_())], names=["id", "raw", "language", "worded"])

    return map_arrow(docs.select(id_col, text_col), rows, "id long, raw double, language int, worded boolean")


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row's whole text.

    A null text is empty; an empty text or one without words scores 0.  Equal
    texts score alike.
    """
    odds = lambda p: F.log(p / (1 - p))
    cuts = F.array(*[F.lit(float(t)) for t in (model.thresholds if len(model.thresholds) else [0.5])])
    moved = odds(F.col("raw")) - odds(F.get(cuts, F.col("language"))) + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    value = F.when(F.col("worded"), 1 / (1 + F.exp(-F.least(F.greatest(moved, F.lit(-40.0)), F.lit(40.0))))).otherwise(0.0)
    return _raw(docs, model, id_col, text_col).select(F.col("id").alias("doc_id"), value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
