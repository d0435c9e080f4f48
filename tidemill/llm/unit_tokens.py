"""Token ids of whole texts from the ids of their words, each worked out once.

Neither vocabulary has a token that crosses the edge of a word with its leading
space, so the ids of a text are those of its words in order.  (The tests hold
both against whole texts.)  A batch of texts becomes one flat array of ids.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

# Fixed value: white space but for the space itself.
_WS = "\t-\r\x85\xa0  -     　"
# The splitting rule of byte-level vocabularies, for texts of Latin letters and common signs ...
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ {_WS}{_L}{_N}]+|[ {_WS}]+(?![^ {_WS}])|[ {_WS}]+")
_NOT_LATIN = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
# ... and for any other text only where it splits at white space: the library does the rest.
_UNITS = re.compile(f" ?[^ {_WS}]+|[ {_WS}]+(?![^ {_WS}])|[ {_WS}]")


# The kind of every character of such texts: 0 space, 1 other white space, 2 letter, 3 digit, 4 sign.
_KINDS = np.array([0 if c == 32 else next((k for k, x in ((1, _WS), (2, _L), (3, _N)) if re.match(f"[{x}]", chr(c))), 4) for c in range(0x2100)], np.uint8)


def latin_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words that ``_LATIN_WORDS`` finds in texts of its letters, in UTF-16, and how many each text has; all texts at once."""
    chars = np.frombuffer("".join(texts).encode("utf-16-le"), np.uint16)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    edge = np.zeros(len(chars) + 4, bool)
    edge[edges] = True
    kind = _KINDS[chars]
    white = kind < 2
    run = np.maximum(kind, 1)
    starts = edge[: len(chars)].copy()
    starts[1:] |= run[1:] != run[:-1]
    # A word begins with the space before it; of a longer run of white space only the last goes apart.
    ahead = starts[1:] & ~white[1:] & ~edge[1 : len(chars)]
    starts[1:] &= ~(ahead & (kind[:-1] == 0))
    starts[:-1] |= ahead & white[:-1]
    quote = np.flatnonzero(chars == ord("'"))
    quote = quote[starts[quote] & ~edge[quote + 1]]
    if len(quote):
        padded = np.append(chars, np.zeros(2, np.uint16))
        one, two = padded[quote + 1], np.where(edge[quote + 2], 0, padded[np.minimum(quote + 2, len(chars))])
        ends = [quote[np.isin(one, [ord(c) for c in "stmd"])] + 2, *(quote[(one == ord(a)) & (two == ord(b))] + 3 for a, b in ("re", "ve", "ll"))]
        for size, end in zip((2, 3, 3, 3), ends, strict=True):
            starts[end - size + 1] = False
            starts[end[end < len(chars)]] = True
    at = np.flatnonzero(starts)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(chars)) * 2), pa.py_buffer(chars)])
    return words, np.diff(np.searchsorted(at, edges))


class Units(dict):
    """Numbers of words; ``flat[starts[k] : starts[k] + lens[k]]`` are the ids of word ``k``.  About ``most`` are remembered at a time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        #: Bytes of each id's token.
        self.sizes = np.array([len(self.spelt.get(k, b"")) for k in range(max(self.spelt) + 1)])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.lens, self.flat, self.exact = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.waiting.append(word)
        return number

    def learn(self) -> None:
        """Work out the words that were met and not yet known."""
        if self.waiting:
            new = self.encode(self.waiting)
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, new), np.int64, len(new))])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(new), np.uint32)])
            self.exact = np.concatenate([self.exact, self.spells(self.waiting, new)])
        self.waiting = []

    def spells(self, words: list[str], ids: list[list[int]]) -> np.ndarray:
        """Which words their tokens spell byte for byte."""
        spell = self.spelt.__getitem__
        return np.array([b"".join(map(spell, x)) == word.encode() for word, x in zip(words, ids, strict=True)], bool)

    def batch(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, the number of each text's ids, and whether its tokens spell it exactly."""
        if len(self) > self.most:
            self.forget()
        numbers, counts = array("q"), []
        for text in texts:
            words = self.words(text)
            numbers.extend(map(self.__getitem__, words))
            counts.append(len(words))
        return self.spelled(np.array(numbers, np.int64), counts)

    def spelled(self, at: np.ndarray, counts: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``batch`` returns, by the numbers of all words and how many each text has."""
        self.learn()
        starts = np.cumsum(self.lens) - self.lens
        lens = self.lens[at]
        ends = np.cumsum(lens)
        place = np.repeat(starts[at] - (ends - lens), lens) + np.arange(int(lens.sum()))
        edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        total, bad = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(~self.exact[at])])
        return self.flat[place], np.diff(total[edges]), np.diff(bad[edges]) == 0


class ByteUnits(Units):
    """A byte-level vocabulary of the tokenizers library; ``lead`` is put before every text."""

    def __init__(self, path: str, lead: str = "", most: int = 300_000):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.lead = lead
        # Fixed rule: visible Latin-1 bytes are written as themselves, the others as the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in shown]
        self.spelling = {c: c for c in shown} | {c: 256 + k for k, c in enumerate(hidden)}
        byte_of = {chr(v): k for k, v in self.spelling.items()}
        self.spelt = {k: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, k in self.tokenizer.get_vocab().items()}
        super().__init__(most)

    def words(self, text: str) -> list[str]:
        text = self.lead + text
        if text.isascii() or not _NOT_LATIN.search(text):
            return _LATIN_WORDS.findall(text)
        return [w for unit in _UNITS.findall(text) for w in ([unit] if _NOT_LATIN.search(unit) else _LATIN_WORDS.findall(unit))]

    def bulk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first two of ``batch``; texts of Latin letters are cut all at once, and each of their words is looked up once."""
        if len(self) > self.most:
            self.forget()
        texts = [self.lead + x for x in texts]
        others = [k for k, x in enumerate(texts) if not x.isascii() and _NOT_LATIN.search(x)]
        apart = set(others)
        words, counts = latin_words(["" if k in apart else x for k, x in enumerate(texts)])
        words = words.dictionary_encode()
        _, ends, chars = words.dictionary.buffers()
        different = chars.to_pybytes().decode("utf-16-le") if len(words.dictionary) else ""
        ends = (np.frombuffer(ends, np.int64, len(words.dictionary) + 1) // 2).tolist() if different else []
        numbers = np.array([self[different[a:b]] for a, b in itertools.pairwise(ends)], np.int64)[words.indices.to_numpy()]
        if others:
            own = [np.array([self[w] for w in self.words(texts[k][len(self.lead) :])], np.int64) for k in others]
            cuts = np.split(numbers, np.cumsum(counts)[others])
            numbers = np.concatenate([*itertools.chain.from_iterable(zip(cuts, own, strict=False)), cuts[-1]])
            counts[others] = [len(x) for x in own]
        return self.spelled(numbers, counts)[:2]

    def spells(self, words: list[str], ids: list[list[int]]) -> np.ndarray:
        """All: every byte has a token of its own."""
        return np.ones(len(words), bool)

    def encode(self, words: list[str]) -> list[list[int]]:
        tokenize, spelling, out = self.tokenizer.model.tokenize, self.spelling, []
        for word in words:
            if word.isascii():
                out.append([t.id for t in tokenize(word.translate(spelling))])
            elif not _NOT_LATIN.search(word):
                out.append([t.id for t in tokenize(word.encode().decode("latin-1").translate(spelling))])
            else:
                out.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return out


class PieceUnits(Units):
    """A sentencepiece vocabulary that adds a space before every text and keeps all others.

    Words come with the run of spaces before them.  Only a space is written as
    U+2581, so a text that holds that character is not spelt exactly.
    """

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = ((k, self.model.id_to_piece(k)) for k in range(self.model.get_piece_size()))
        self.spelt = {k: bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in pieces}
        super().__init__(most)

    def words(self, text: str) -> list[str]:
        if "  " in text or text[:1] in (" ", "") or text[-1] == " ":
            return re.findall(" +[^ ]*", " " + text) if text else []
        return [" " + x for x in text.split(" ")]

    def encode(self, words: list[str]) -> list[list[int]]:
        alone = [self.model.piece_to_id("▁")]
        return [x or alone for x in self.model.encode([w[1:] for w in words], num_threads=1)]


@functools.lru_cache(maxsize=4)
def byte_units(path: str, lead: str = "", most: int = 300_000) -> ByteUnits:
    return ByteUnits(path, lead, most)


@functools.lru_cache(maxsize=2)
def piece_units(path: str) -> PieceUnits:
    return PieceUnits(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers as P

    return P.path(name)
