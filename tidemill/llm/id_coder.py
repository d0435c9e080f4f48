"""Context-mixing range coder for token ids, in blocks that start afresh.

A block is coded on its own, so any block can be read without the others.
Three models predict the next id: after the last two ids (order 2) and after
the last one (order 1) the id that followed there before, each with a
confidence, and how often every id is left to order 0.  For each pair of
confidences a block has mixing weights of its own.  One step of the range coder
codes which model is right and, where it is order 0, the id by its share.

A block's code begins with what is fitted to it: the ids that it holds twice or
more, which are numbered and known to the models, their shares and the mixing
weights.  Ids that it holds once are no context and none is foretold; they
stand plainly behind and only their places are coded.

An encoder knows its blocks beforehand, so it finds what every context said
last by sorting, all steps at once; only the range coder itself goes step by
step.  There, and in the decoder, all blocks of a group advance together, one
id at a time, each with its own state, so a step is a few array operations over
the group.  Ranges stay below 2**48, so that the decoder's divisions of
floats are exact: it computes the encoder's numbers on any machine.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK_IDS = 4096
#: Blocks that advance together.
LANES = 2048
#: A block has at most so many ids: two bits and the number of an id that it holds twice have 16 bits.
MOST_IDS = 1 << 14

_BITS = 14
#: A range is at most 2**48 and never stays below 2**32: a word of 16 bits leaves at a time, and a bit above it is a carry.
_FULL, _TOP, _LOW, _HELD, _WORD = 1 << 48, 1 << 32, (1 << 32) - 1, 32, 16
_SLOTS = 1 << 11
#: All in 16 bits, of which the upper eleven are left.
_HASH = np.array([40503, 30011, 5], np.uint16)
_ONE, _MOST_SURE = np.uint16(1), np.uint16(3)
#: Mixing weights have a byte each; where the parts of the range end.
_ENDS = (np.arange(256) << _BITS) // 255
#: What four bits say of an id's count: no more than it is, so that parts of all ids find room.
_COUNTS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 23, 32, 45, 64, 96, 160])
#: Numbered ids, plain ids, which pairs of confidences have weights.
_HEAD = struct.Struct("<HHI")
#: Steps after which the decoder looks for blocks whose words have run out.
_WORDS = 64
#: For four numbers of 16 bits in one.
_EACH, _TOPS = 0x0001000100010001, np.int64(-0x7FFF7FFF7FFF8000)
#: Blocks whose models are worked out at once; their arrays stay in a core's cache.
_CHUNK = 64


def _depth(steps: int) -> int:
    """Bits of order 0's shares: their total is no less than a block's ids."""
    if steps > MOST_IDS:
        raise ValueError(f"a block has at most {MOST_IDS} ids")
    return max(12, (steps - 1).bit_length())


def _slot(now: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of two numbers' context.  It is only hashed: a clash costs bits, never an id."""
    return now * _HASH[0] + last * _HASH[1] >> _HASH[2]


def _shares(counts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Every block's numbers in one array, number 0 first: start and size of the part of order 0 in one number.

    ``counts`` are those of the numbers from 1 on, ``sizes`` how many of them a
    block has; number 0 stands for the whole, as where order 0 is not asked.
    """
    first = np.cumsum(sizes + 1) - sizes - 1
    own = np.zeros(len(counts) + len(sizes), np.int64)
    own[np.delete(np.arange(len(own)), first)] = counts
    ends = np.cumsum(own)
    begin = np.repeat(ends[first], sizes + 1)
    total = np.repeat(np.maximum(np.add.reduceat(own, first) if len(first) else own, 1), sizes + 1)
    start, end = (ends - own - begin << depth) // total, (ends - begin << depth) // total
    end[first] = 1 << depth
    return start << 15 | end - start


class _Chunk:
    """What a few blocks' models say at every step, and the parts of the range that follow."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, self.depth = ids, depth
        self.lanes, self.steps = ids.shape
        self.row = (np.arange(self.lanes, dtype=np.int32) * np.int32(self.steps))[:, None]
        self.number()
        before = np.zeros((self.lanes, self.steps + 2), np.uint16)
        before[:, 2:] = self.numbers
        one, two = self.said(before[:, 1:-1]), self.said(_slot(before[:, 1:-1], before[:, :-2]))
        self.mix(one, two)

    def by(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every block's steps by key and time: the keys, the places in the chunk, and where a key is the one before."""
        ranked = np.sort(keys.astype(np.uint32) << np.uint32(self.depth) | np.arange(self.steps, dtype=np.uint32), axis=1)
        key = ranked >> np.uint32(self.depth)
        same = np.zeros((self.lanes, self.steps + 1), bool)
        np.equal(key[:, 1:], key[:, :-1], out=same[:, 1:-1])
        ranked &= np.uint32((1 << self.depth) - 1)
        return key, ranked.view(np.int32) + self.row, same

    def number(self) -> None:
        """Number every block's ids that it holds twice or more, from 1 on by size."""
        key, at, same = self.by(self.ids)
        twice = same[:, 1:] & ~same[:, :-1]
        self.known, self.sizes = key[twice].astype(np.int64), np.count_nonzero(twice, axis=1)
        number = np.cumsum(twice.ravel(), dtype=np.int32).reshape(key.shape)
        number -= (np.cumsum(self.sizes) - self.sizes).astype(np.int32)[:, None]
        number *= same[:, 1:] | same[:, :-1]
        self.numbers = np.empty(key.shape, np.uint16)
        self.numbers.ravel()[at] = number

    def said(self, contexts: np.ndarray) -> np.ndarray:
        """Which number followed each step's context last, times 4, and how often it was so in a row before, up to 3."""
        _, at, same = self.by(contexts)
        follows = self.numbers.ravel().take(at)
        says = np.zeros_like(follows)
        np.multiply(follows[:, :-1], same[:, 1:-1], out=says[:, 1:])
        right = np.zeros((self.lanes, self.steps + 3), np.uint16)
        np.multiply(says[:, :-1] == follows[:, :-1], same[:, 1:-1], out=right[:, 3:-1])
        right = right[:, : self.steps + 2]
        says <<= 2
        says += right[:, 2:] * (1 + right[:, 1:-1] * (1 + right[:, :-2]))
        out = np.empty_like(says)
        out.ravel()[at] = says
        return out

    def mix(self, one: np.ndarray, two: np.ndarray) -> None:
        numbers, known = self.numbers, self.numbers > 0
        case = (3 - known).astype(np.uint8)
        case[(one >> 2 == numbers) & known] = 1
        case[(two >> 2 == numbers) & known] = 0
        place = _pair(one, two).astype(np.int32) * 4 + case + np.arange(self.lanes, dtype=np.int32)[:, None] * 128
        counts = np.bincount(place.ravel(), minlength=self.lanes * 128).reshape(-1, 4)
        total = counts.sum(axis=1, keepdims=True)
        parts = np.maximum(counts * 255 // np.maximum(total, 1), counts > 0)
        parts[np.arange(len(parts)), parts.argmax(axis=1)] += 255 - parts.sum(axis=1)
        self.used, self.weights = (total > 0).reshape(self.lanes, 32), np.cumsum(parts, axis=1)
        ends = _ENDS[self.weights]
        starts = np.concatenate([np.zeros((len(ends), 1), ends.dtype), ends[:, :-1]], axis=1)
        left = case == 2
        first = np.cumsum(self.sizes + 1) - self.sizes - 1
        own = numbers + first.astype(np.int32)[:, None]
        often = np.bincount(own[left], minlength=len(self.known) + self.lanes)
        self.counts = np.searchsorted(_COUNTS, np.delete(often, first), side="right") - 1
        shares = _shares(_COUNTS[self.counts], self.sizes, self.depth)
        shares = shares.astype(np.int32).take(np.where(left, own, first.astype(np.int32)[:, None]))
        size = (ends - starts).astype(np.uint32).ravel().take(place)
        self.start = (starts << self.depth).astype(np.uint32).ravel().take(place) + size * (shares >> 15).view(np.uint32)
        self.size = size * (shares & 0x7FFF).view(np.uint32)

    def heads(self) -> list[bytes]:
        """What stands before every block's code."""
        single = self.numbers == 0
        plain, n_plain = self.ids[single].astype("<u2").tobytes(), np.count_nonzero(single, axis=1)
        masks = (self.used.astype(np.int64) << np.arange(32)).sum(axis=1)
        weights, n_weights = self.weights[self.used.ravel(), :3].astype(np.uint8).tobytes(), np.count_nonzero(self.used, axis=1)
        first = np.cumsum(self.sizes) - self.sizes
        gaps = np.diff(self.known, prepend=-1) - 1
        some = first[self.sizes > 0]
        gaps[some] = self.known[some]
        counts, ends = self.counts.astype(np.uint8), [0, 0, 0]
        out = []
        for k, n in enumerate(self.sizes.tolist()):
            own, gap = np.zeros(n + n % 2, np.uint8), gaps[first[k] : first[k] + n]
            own[:n] = counts[first[k] : first[k] + n]
            a, b = ends[0], ends[1]
            ends = [a + 3 * int(n_weights[k]), b + 2 * int(n_plain[k]), 0]
            head = _HEAD.pack(n, int(n_plain[k]), int(masks[k])) + weights[a : ends[0]] + (own[::2] << 4 | own[1::2]).tobytes()
            out.append(head + np.minimum(gap, 255).astype(np.uint8).tobytes() + gap[gap >= 255].astype("<u2").tobytes() + plain[b : ends[1]])
        return out


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which mixing weights hold: by both confidences and whether both say the same."""
    return (two & 3) << 3 | (one & 3) << 1 | ((one ^ two) < 4)


class _Encoder:
    def __init__(self, lanes: int, ids: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
        self.width = 2 * ids + 8  # a step takes 28 bits at most
        self.words, self.begin = np.zeros(lanes * self.width, np.uint32), np.arange(lanes) * self.width
        self.at = self.begin.copy()

    def code(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Narrow every range to the part ``start, size`` of ``2**bits``."""
        unit = self.range >> bits
        self.low += unit * start
        np.multiply(unit, size, out=self.range)
        short = np.flatnonzero(self.range < _TOP)
        while len(short):
            at, low, span = self.at.take(short), self.low.take(short), self.range.take(short) << _WORD
            self.words[at] = low >> _HELD
            self.at[short] = at + 1
            self.low[short] = (low & _LOW) << _WORD
            self.range[short] = span
            short = short[span < _TOP]

    def finish(self) -> list[bytes]:
        """Every block's bytes: one last word within its range, carries added upwards, zeros at the end left out."""
        self.words[self.at] = (self.low + _LOW) >> _HELD
        counts = self.at - self.begin + 1
        words = self.words.reshape(len(counts), -1)[:, : counts.max(initial=0)].copy()
        flat = words.ravel()
        over = np.flatnonzero(flat > 0xFFFF)
        while len(over):
            carry = flat[over] >> _WORD
            flat[over] &= 0xFFFF
            over -= 1
            flat[over] += carry
            over = over[flat[over] > 0xFFFF]
        words = words.astype(">u2")
        return [words[k, :n].tobytes().rstrip(b"\0") for k, n in enumerate(counts.tolist())]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The codes of the rows of ``ids``, whose ids are below 2**16."""
    ids = np.ascontiguousarray(ids, np.uint16)
    lanes, steps = ids.shape
    depth = _depth(steps)
    starts, sizes, heads = np.empty((steps, lanes), np.uint32), np.empty((steps, lanes), np.uint32), []
    for lo in range(0, lanes, _CHUNK):
        chunk = _Chunk(ids[lo : lo + _CHUNK], depth)
        starts[:, lo : lo + _CHUNK], sizes[:, lo : lo + _CHUNK] = chunk.start.T, chunk.size.T
        heads += chunk.heads()
    out = _Encoder(lanes, steps)
    for start, size in zip(starts, sizes, strict=True):
        out.code(start, size, _BITS + depth)
    return [head + code for head, code in zip(heads, out.finish(), strict=True)]


class _Decoder:
    """What the heads of blocks' codes say."""

    def __init__(self, payloads: list[bytes], depth: int):
        lanes = len(payloads)
        self.sizes, weights = np.zeros(lanes, np.int64), np.zeros((lanes, 32, 4), np.uint8)
        weights[:, :, 3] = 255
        known, counts, plain, codes = [], [], [], []
        for k, p in enumerate(payloads):
            n, n_plain, mask = _HEAD.unpack_from(p)
            used = [j for j in range(32) if mask >> j & 1]
            at = _HEAD.size
            weights[k, used, :3] = np.frombuffer(p, np.uint8, 3 * len(used), at).reshape(-1, 3)
            at += 3 * len(used)
            pairs = np.frombuffer(p, np.uint8, (n + 1) // 2, at)
            counts.append(np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n])
            at += len(pairs)
            gaps = np.frombuffer(p, np.uint8, n, at).astype(np.int64)
            at += n
            far = np.flatnonzero(gaps == 255)
            gaps[far] = np.frombuffer(p, "<u2", len(far), at)
            at += 2 * len(far)
            known += [np.zeros(1, np.int64), np.cumsum(gaps + 1) - 1]
            plain.append(np.frombuffer(p, "<u2", n_plain, at))
            codes.append(p[at + 2 * n_plain :])
            self.sizes[k] = n
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        self.known, self.plain, self.codes = join(known, np.uint16), plain, codes
        # Four ends in one number; taking a place from each leaves its top bit where the end lies behind the place.
        self.ends = (_ENDS[weights] + 0x7FFF).astype("<u2").view("<i8").ravel()
        self.shares = _shares(_COUNTS[join(counts, np.int64)], self.sizes, depth).astype(np.int32)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        number = np.arange(len(self.shares)) - np.repeat(self.first, self.sizes + 1)
        #: The number at every place of order 0's part, a block after another.
        part = self.shares & 0x7FFF
        part[self.first[self.sizes > 0]] = 0
        self.at = np.repeat(number.astype(np.uint16), part)


def decode_blocks(payloads: list[bytes], steps: int) -> np.ndarray:
    """The ids of blocks that were coded together, a row each."""
    lanes, depth = len(payloads), _depth(steps)
    head, bits = _Decoder(payloads, depth), _BITS + depth
    width = max(map(len, head.codes), default=0) // 2 + 4 * _WORDS
    words = np.zeros((lanes, width), np.uint16)
    for k, code in enumerate(head.codes):
        words[k, : (len(code) + 1) // 2] = np.frombuffer(code + b"\0" * (len(code) % 2), ">u2")
    value = words[:, 0].astype(np.int64) << 32 | words[:, 1].astype(np.int64) << 16 | words[:, 2]
    words, taken = words.ravel(), np.arange(lanes) * width + 3
    last = taken + (width - 3 * _WORDS)
    span = np.full(lanes, _FULL, np.int64)
    # What order 1 says after each of a block's numbers, then what order 2 says by slots.
    base = np.concatenate([head.first, len(head.shares) + np.arange(lanes) * _SLOTS])
    after, at, before = np.zeros(len(head.shares) + lanes * _SLOTS, np.uint16), base.copy(), np.zeros(lanes, np.uint16)
    mixes, places = np.arange(lanes) * 32, np.arange(lanes) << depth
    out = np.zeros((steps, lanes), np.uint16)
    for t in range(steps):
        if t % _WORDS == 0:
            np.minimum(taken, last, out=taken)
        says = after.take(at)
        one, two = says[:lanes], says[lanes:]
        ends = head.ends.take(mixes + _pair(one, two))
        unit = span >> bits
        place = (value / unit).astype(np.int64)
        case = 4 - np.bitwise_count((ends - (place >> depth) * _EACH & _TOPS).view(np.uint64)).astype(np.int64)
        shift = case << 4
        begin = (ends << 16 | 0x7FFF) >> shift & 0xFFFF
        part = (ends >> shift & 0xFFFF) - begin
        begin -= 0x7FFF
        begin <<= depth
        order0 = case == 2
        number = head.at.take(((place - begin) / part).astype(np.int64) * order0 + places) * order0.view(np.uint8)
        share = head.shares.take(number + head.first)
        value -= unit * (begin + part * (share >> 15))
        span = unit * (part * (share & 0x7FFF))
        short = np.flatnonzero(span < _TOP)
        while len(short):
            where, wide = taken.take(short), span.take(short) << _WORD
            value[short] = value.take(short) << _WORD | words.take(where)
            taken[short] = where + 1
            span[short] = wide
            short = short[wide < _TOP]
        now = number + ((one ^ (one ^ two) * (case == 0).view(np.uint8)) >> 2) * (case < 2).view(np.uint8)
        out[t] = now
        after[at] = _learnt(says, np.concatenate([now, now]) << 2)
        np.add(base[:lanes], now, out=at[:lanes])
        np.add(base[lanes:], _slot(now, before), out=at[lanes:])
        before = now
    ids = np.empty((lanes, steps), np.uint16)
    for lo in range(0, lanes, _CHUNK):
        numbers = np.ascontiguousarray(out[:, lo : lo + _CHUNK].T)
        own = head.known.take(numbers + head.first[lo : lo + _CHUNK, None])
        own[numbers == 0] = np.concatenate(head.plain[lo : lo + _CHUNK])
        ids[lo : lo + _CHUNK] = own
    return ids


def _learnt(says: np.ndarray, now: np.ndarray) -> np.ndarray:
    """What a context says next, after it said ``says`` and ``now`` (times 4) came."""
    sure = says ^ now
    return now + (sure < 4) * np.minimum(sure + _ONE, _MOST_SURE)


def checksum(ids: np.ndarray, before: int = 0) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers, after those of ``before``."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes(), before)
