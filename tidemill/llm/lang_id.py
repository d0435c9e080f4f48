"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public
vocabulary.  A word's probability under a language is the sum, over all ways
to cut it into pieces, of the product of their probabilities; the forward
algorithm takes that sum without listing the segmentations.  The piece
probabilities are learned by expectation-maximisation, with expected counts
from the forward-backward algorithm over the words of a bounded sample.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, in_parts, map_arrow, texts

MARK = "▁"  # the vocabulary's sign for the start of a word
LETTERS = re.compile(r"[^\W\d_]+")
CELLS = 200_000  # letters, with padding, of the words that run side by side; a longer word runs alone
RESCALE = 16  # steps after which the forward sums are brought back to size
UNSEEN = 1e-7  # of a letter that is no piece of its own
BASE = np.uint64(1_000_003)


@functools.lru_cache(maxsize=2)
def letter_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the word-start sign, sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p and p.removeprefix(MARK).isalpha() or p == MARK)


class Lattice:
    """Finds all pieces inside many words at once by rolling hashes."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._of(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted, self.n, self.longest = hashes[self.order], len(pieces), max(map(len, pieces))
        self.powers = np.ones(self.longest + 1, np.uint64)
        for i in range(self.longest):
            self.powers[i + 1] = int(self.powers[i]) * int(BASE) % 2**64

    @staticmethod
    def _of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c)) % 2**64
        return h

    def edges(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each piece length its piece number at each end position (n: none), and the words' lengths."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lens.max())
        codes = np.zeros((len(words), width), np.uint64)
        codes[np.arange(width) < lens[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        prefix = np.zeros((len(words), width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j]
        found = []
        for size in range(1, min(self.longest, width) + 1):
            h = prefix[:, size:] - prefix[:, :-size] * self.powers[size]
            at = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
            ids = np.where(self.sorted[at] == h, self.order[at], self.n)
            ids[np.arange(size, width + 1) > lens[:, None]] = self.n
            if size == 1:  # a lone letter is always possible
                ids = np.where((ids == self.n) & (np.arange(1, width + 1) <= lens[:, None]), self.n + 1, ids)
            found.append(ids)
        return found, lens

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each column of ``p`` (a row per piece, then none and unseen).

        Only the sums that a piece can still reach back to are held, scaled
        from time to time, so words of any length are summed whole.
        """
        edges, lens = self.edges(words)
        reach, scale = len(edges), np.zeros((len(words), p.shape[1]))
        sums = {0: np.ones((len(words), p.shape[1]))}  # by position, the last ``reach`` of them
        out = np.zeros((len(words), p.shape[1]))
        for j in range(1, int(lens.max()) + 1):
            now = np.zeros((len(words), p.shape[1]))
            for size in range(1, min(reach, j) + 1):
                ids = edges[size - 1][:, j - size]
                hit = np.flatnonzero(ids != self.n)
                now[hit] += sums[j - size][hit] * p[ids[hit]]
            sums[j] = now
            sums.pop(j - reach, None)
            done = lens == j
            out[done] = np.log(now[done]) + scale[done]
            if j % RESCALE == 0:
                most = np.max(list(sums.values()), axis=0)
                most[most == 0] = 1  # past a word's end
                scale += np.log(most)
                sums = {k: x / most for k, x in sums.items()}
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words, by forward and backward sums; p: one language."""
        edges, lens = self.edges(words)
        width, rows = int(lens.max()), np.arange(len(words))
        reach = len(edges)
        # The sums at a position times exp(its scale) are the true ones.
        alpha, beta, scale_a, scale_b = (np.zeros((width + 1, len(words))) for _ in range(4))
        alpha[0] = 1
        beta[lens, rows] = 1
        for j in range(1, width + 1):
            for size in range(1, min(reach, j) + 1):
                alpha[j] += alpha[j - size] * p[edges[size - 1][:, j - size]]
            scale_a[j] = scale_a[j - 1]
            if j % RESCALE == 0:
                _bring_back(alpha, scale_a, slice(max(0, j - reach), j + 1))
        for j in range(width - 1, -1, -1):
            for size in range(1, min(reach, width - j) + 1):
                beta[j] += beta[j + size] * p[edges[size - 1][:, j]]
            scale_b[j] = np.where(j < lens, scale_b[j + 1], 0)
            if j % RESCALE == 0:
                _bring_back(beta, scale_b, slice(j, min(width, j + reach) + 1))
        whole, whole_scale = counts / alpha[lens, rows], scale_a[lens, rows]
        use = np.zeros(len(p))
        for size in range(1, reach + 1):
            for j in range(width + 1 - size):
                ids = edges[size - 1][:, j]
                hit = np.flatnonzero(ids != self.n)
                share = alpha[j, hit] * beta[j + size, hit] * whole[hit]
                if width >= RESCALE:
                    share *= np.exp(scale_a[j, hit] + scale_b[j + size, hit] - whole_scale[hit])
                use += np.bincount(ids[hit], share * p[ids[hit]], len(p))
        return use


def _bring_back(sums: np.ndarray, scale: np.ndarray, near: slice) -> None:
    """Bring the sums that are still reached back from to size, and their scale with them."""
    most = sums[near].max(axis=0)
    most[most == 0] = 1  # past a word's end
    sums[near] /= most
    scale[near] += np.log(most)


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(letter_pieces(path))


def marked_words(text: str) -> list[str]:
    """Lower-case runs of letters, marked as word starts."""
    out = []
    for word in LETTERS.findall(text.lower()):
        if not word.isalpha():  # signs such as a raised two count as word characters, but are no letters
            word = "".join(filter(str.isalpha, word))
            if not word:
                continue
        out.append(MARK + word)
    return out


@dataclass(frozen=True)
class LanguageModel:
    vocabulary: str
    languages: tuple[str, ...]
    p: np.ndarray  # pieces + 2 rows, a column for each language


def _in_batches(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``words``, sorted by length, that fill about CELLS letters with padding."""
    lo = 0
    while lo < len(words):
        hi = lo + 1
        while hi < len(words) and (hi + 1 - lo) * len(words[hi]) <= CELLS:
            hi += 1
        yield lo, hi
        lo = hi


def train(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_docs: int = 800, rounds: int = 4) -> LanguageModel:
    """Fit on about ``most_docs`` rows of each language, chosen by a hash of the id.

    Words are counted by Spark; the driver gets one row for each language and
    distinct word of the sample.  Words of any length teach whole.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = hashed_sample(labelled, "id", ["lang"], most_docs)

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: dict[tuple[str, str], int] = {}
        for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for w in marked_words(text):
                count[lang, w] = count.get((lang, w), 0) + 1
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(count.values(), pa.int64())], names=["lang", "word", "n"])

    counted = map_arrow(sample.select("text", "lang"), words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    net = lattice(vocabulary)
    languages, columns = tuple(sorted(counted["lang"].unique())), []
    for lang in languages:
        own = counted[counted["lang"] == lang].sort_values("word")
        own = own.iloc[np.argsort(own["word"].str.len(), kind="stable")]
        ws, ns = own["word"].tolist(), own["n"].to_numpy(float)
        p = np.full(net.n + 2, 1.0 / net.n)
        p[-2:] = 0, UNSEEN
        for _ in range(rounds):
            use = sum(net.expected(ws[a:b], ns[a:b], p) for a, b in _in_batches(ws))[: net.n] + 0.05
            p[: net.n] = use / use.sum()
        columns.append(p)
    return LanguageModel(vocabulary, languages, np.stack(columns, axis=1) if columns else np.zeros((net.n + 2, 0)))


class WordScores:
    """Log-probabilities of words, remembered up to ``most`` words at a time."""

    def __init__(self, model: LanguageModel, most: int = 300_000):
        self.model, self.most, self.net = model, most, lattice(model.vocabulary)
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.index) > self.most:
            self.index, self.scores = {}, self.scores[:0]
        new = sorted(words.difference(self.index), key=len)  # words of like length share a padded matrix
        parts = [self.net.forward(new[a:b], self.model.p) for a, b in _in_batches(new)]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, *parts])

    def total(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.scores[at].sum(axis=0)


_scorers: dict[int, WordScores] = {}


def _scorer(key: int, model: LanguageModel) -> WordScores:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = WordScores(model)
    return _scorers[key]


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row's whole text.

    The score is the posterior probability of the language under equal priors.
    Null texts, texts without a letter, and all texts under a model without
    languages are ``und`` with score 0; on equal scores the first language in
    alphabetical order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: pieces x languages

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        scorer, langs, scores = _scorer(id(model), model), [], []
        for part in in_parts(map(marked_words, texts(batch.column(1))), most_items=500, most_size=200_000):
            scorer.learn(set().union(*part))
            for words in part:
                if not words or not model.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = scorer.total(words)
                best = int(np.argmax(total))
                langs.append(model.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(id_col, text_col), rows, "doc_id long, lang_pred string, score double")


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")
