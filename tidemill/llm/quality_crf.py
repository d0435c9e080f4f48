"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's evidence is its own measures and those of
the lines before and after it; transition weights make neighbouring lines
agree.  Forward-backward gives each line's probability of being good, and the
mean of these, weighted by length, is the document's.  Labels come for whole
documents only: all lines of a good document are good, and those of a bad one
start as bad and are labelled again by the field itself between fits, at least
one of them staying bad.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_parts, labelled_sample, map_arrow, texts

SYMBOLS, UPPER, DIGITS, SHOUT = b"#*$%&|<>~^_=@\\{}[]", bytes(range(65, 91)), b"0123456789", b"!?"
OWN = 13
FEATURES = 3 * OWN
THRESHOLD = 0.3
CELLS = 60_000  # lines, with padding, that run side by side; a longer document runs alone


def line_measures(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    words, n = line.split(), max(1, len(line))
    w = max(1, len(words))
    gone = lambda chars: (len(line) - len(line.translate(None, chars))) / n
    again = line in seen
    seen.add(line)
    return (
        1.0,
        math.log1p(len(line)) / 8,
        min(1.0, 4 * gone(SYMBOLS)),
        gone(UPPER),
        gone(DIGITS),
        min(1.0, 5 * gone(SHOUT)),
        1 - len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        float(again),
        float(len(words) < 3),
        float(line.rstrip()[-1:] in b".!?:;\"'" and bool(line.strip())),
        min(1.0, n / w / 20),
        float(not line.isascii()),
    )


def document_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Measures and byte lengths of the lines that hold a word."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    own = np.array([line_measures(x, seen) for x in lines]).reshape(-1, OWN)
    return own, np.fromiter(map(len, lines), np.float64, len(lines))


class MeasuredLines:
    """A document's line measures and lengths; its size is its number of lines."""

    def __init__(self, text: str):
        self.own, self.lengths = document_lines(text)

    def __len__(self) -> int:
        return len(self.lengths)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's measures beside those of the lines before and after it, zero at the ends."""
    x = np.zeros((len(own), FEATURES))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN :] = own[1:]
    return x


@dataclass
class LineField:
    weights: np.ndarray  # evidence for bad
    transitions: np.ndarray  # 2 x 2: from, to; 1 is bad
    cut: float = 0.5  # document quality that maps onto THRESHOLD
    slope: float = 6.0

    def marginals(self, evidence: list[np.ndarray]) -> tuple[list[np.ndarray], float, np.ndarray]:
        """P(bad) of each line of each document, the summed log-partition, and expected transitions.

        Documents of like length run together, one step along their lines at a time.
        """
        order = sorted(range(len(evidence)), key=lambda i: len(evidence[i]))
        bad: list[np.ndarray] = [np.zeros(0)] * len(evidence)
        logz, moves, k = 0.0, np.zeros((2, 2)), 0
        step = np.exp(self.transitions - self.transitions.max())
        while k < len(order):
            if not len(evidence[order[k]]):
                k += 1
                continue
            end = k
            while end < len(order) and len(evidence[order[end]]) <= 1.5 * len(evidence[order[k]]) + 4 and (end - k) * len(evidence[order[end]]) < CELLS:
                end += 1
            group = order[k:end]
            lens = np.array([len(evidence[i]) for i in group])
            rows, width = np.arange(len(group)), int(lens.max())
            e = np.zeros((width, len(group)))
            for r, i in enumerate(group):
                e[: lens[r], r] = evidence[i]
            emit = np.stack([1 / (1 + np.exp(e)), 1 / (1 + np.exp(-e))], axis=2)  # each line's two states, scaled to sum 1
            scale_log = np.logaddexp(0, e)
            alpha, beta = np.zeros((width, len(group), 2)), np.zeros((width, len(group), 2))
            norm = np.ones((width, len(group)))
            for t in range(width):
                a = emit[t] * (0.5 if t == 0 else alpha[t - 1] @ step)
                norm[t] = a.sum(axis=1)
                alpha[t] = a / norm[t][:, None]
            beta[lens - 1, rows] = 1
            for t in range(width - 2, -1, -1):
                inside = (t < lens - 1)[:, None]
                ahead = emit[t + 1] * beta[t + 1] / norm[t + 1][:, None]
                beta[t] = np.where(inside, ahead @ step.T, beta[t])
                both = alpha[t][:, :, None] * step * ahead[:, None, :] * inside[:, :, None]
                moves += both.sum(axis=0)
            inside = np.arange(width)[:, None] < lens
            logz += float(((np.log(norm) + scale_log + (np.arange(width) > 0)[:, None] * self.transitions.max()) * inside).sum()) + len(group) * math.log(2)
            share = alpha * beta
            share = share[:, :, 1] / np.maximum(share.sum(axis=2), 1e-300)
            for r, i in enumerate(group):
                bad[i] = share[: lens[r], r]
            k = end
        return bad, logz, moves

    def quality(self, bad: np.ndarray, lengths: np.ndarray) -> float:
        return float(1 - (bad * lengths).sum() / lengths.sum()) if len(lengths) else 0.0

    def calibrated(self, quality: float) -> float:
        odds = self.slope * (quality - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


def _fit(field: LineField, xs: list[np.ndarray], ys: list[np.ndarray], weight: np.ndarray, rounds: int) -> None:
    """Adam on the weighted conditional log-likelihood with a small ridge."""
    m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    stacked = np.concatenate(xs)
    cuts = np.cumsum([len(x) for x in xs])[:-1]
    line_weight = np.repeat(weight, [len(x) for x in xs])
    flat = np.concatenate(ys)
    seen = np.zeros((2, 2))
    for y in ys:
        np.add.at(seen, (y[:-1].astype(int), y[1:].astype(int)), 1)
    for t in range(1, rounds + 1):
        bad, _, moves = field.marginals(np.split(stacked @ field.weights, cuts))
        d_w = stacked.T @ (line_weight * (flat - np.concatenate(bad))) / line_weight.sum() - 1e-4 * field.weights
        d_t = (seen - moves) / max(1.0, seen.sum()) - 1e-3 * field.transitions
        g = np.concatenate([d_w, d_t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        field.weights = field.weights + move[:FEATURES]
        field.transitions = field.transitions + move[FEATURES:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 1200, rounds: int = 60, relabels: int = 3) -> LineField:
    """Fit on ``docs`` (id, text) and ``labels`` (id, label; 1: good): about ``most_docs`` rows of either label."""
    got = labelled_sample(docs, labels, most_docs).select("id", "text", "label").toPandas().sort_values("id")
    docs = [document_lines(t) for t in got["text"]]
    use = [i for i, d in enumerate(docs) if len(d[0])]
    good = got["label"].to_numpy(np.int64)[use]
    docs = [docs[i] for i in use]
    field = LineField(np.zeros(FEATURES), np.array([[0.5, -0.5], [-0.5, 0.5]]))
    if not len(docs) or good.min() == good.max():
        return field
    xs = [with_neighbours(d[0]) for d in docs]
    lines = np.array([len(x) for x in xs])
    ys = [np.full(len(x), float(1 - g)) for x, g in zip(xs, good, strict=True)]
    share = np.where(good == 1, 0.5 / lines[good == 1].sum(), 0.5 / lines[good == 0].sum()) * lines.sum()
    for again in range(relabels):
        _fit(field, xs, ys, share, rounds)
        bad, _, _ = field.marginals([x @ field.weights for x in xs])
        if again < relabels - 1:
            for i in np.flatnonzero(good == 0).tolist():
                ys[i] = (bad[i] >= np.minimum(0.5, bad[i].max())).astype(float)
    quality = np.array([field.quality(b, d[1]) for b, d in zip(bad, docs, strict=True)])
    cuts = np.unique(quality)
    middles = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else np.array([0.5])
    right = [(quality[good == 1] >= c).mean() + (quality[good == 0] < c).mean() for c in middles]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    field.cut = float(middles[best].mean())
    field.slope = 8.0
    return field


def score(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row's whole text.

    A null text is empty; a text without a word has no good line and scores as
    quality 0.  Equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        field, scores = shared.value, []
        for part in in_parts(map(MeasuredLines, texts(batch.column(1))), most_items=500, most_size=CELLS):
            bad, _, _ = field.marginals([with_neighbours(d.own) @ field.weights for d in part])
            scores += [field.calibrated(field.quality(b, d.lengths)) for b, d in zip(bad, part, strict=True)]
        values = np.array(scores)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_arrow(docs.select(id_col, text_col), rows, "doc_id long, score double, predicted int")
