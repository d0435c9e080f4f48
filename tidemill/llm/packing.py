"""Best-fit packing with certified bin counts.

Texts become token ids once, where they are read; from then on only
``(doc, piece, length, checksum)`` rows move.  Pieces are dealt at random over
groups of bounded size, each group is packed best-fit decreasing in one task,
and dual-feasible functions give a lower bound on its bin count.  A group that
reaches its bound is certified and final.  A group with a gap hands the
documents of its emptiest bins on; those are dealt over fewer groups and packed
again, keeping the earlier arrangement wherever a rerun would not need fewer
bins.  Rounds go on until every group is certified, one group is left, or a
round saves not one bin.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = PIECES + ", sequence_id long, offset long, home long, certified boolean, final boolean, saved long"


# The splitting rule that the shortcut below follows, as vocabulary files state it.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same rule for lower-case text of Latin-1 characters.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}\\x09-\\x0d\\x20\\x85\\xa0]+")


class WordTokens(dict):
    """Ids of white-space separated words, each worked out once and then looked up.

    The vocabulary collapses white space before it splits, so the ids of a text
    are those of its words in order.  A word of Latin-1 characters is taken
    apart here by the vocabulary's rule; only parts that were not met before
    are encoded, and any other word is encoded as it is.  (The tests hold both
    against whole texts.)  The dictionary numbers words and parts alike; about
    ``most`` are remembered at a time.  A vocabulary with any other rule encodes
    whole texts by itself.
    """

    def __init__(self, path: str, most: int = 700_000):
        import tokenizers

        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            rule = json.load(f)
        splits = (rule.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = (rule.get("normalizer") or {}).get("normalizers") == NORMALISERS and splits[0].get("pattern") == {"Regex": SPLIT} and splits[0].get("behavior") == "Removed"
        spell = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the vocabulary writes the bytes of a character.
        self.spelling = {c: "".join(x[0] for x in spell.pre_tokenize_str(chr(c))) for c in range(256)}
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.starts, self.lens, self.flat = array("q"), array("q"), array("I")

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        if text.isascii() or max(text) <= "\xff":
            low = text.lower()
            parts = LATIN_PARTS.findall(low)
            if len(parts) == 1 and parts[0] == text:
                ids = [t.id for t in self.tokenizer.model.tokenize(text.translate(self.spelling))]
            else:
                ids = []
                for part in parts:
                    k = self[part.encode()]
                    ids += self.flat[self.starts[k] : self.starts[k] + self.lens[k]]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = number = len(self.starts)
        self.starts.append(len(self.flat))
        self.lens.append(len(ids))
        self.flat.extend(ids)
        return number

    def ids(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self) > self.most:
            self.forget()
        words = text.encode().split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        lens = np.frombuffer(self.lens, np.int64)[at] if len(at) else at
        if not lens.sum():
            return np.zeros(0, np.uint32)
        starts = np.frombuffer(self.starts, np.int64)[at]
        ends = np.cumsum(lens)
        place = np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]))
        return np.frombuffer(self.flat, np.uint32)[place]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids followed by ``end_id``; only longer ones are cut."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, out = word_tokens(vocabulary), []
        for k, text in enumerate(texts(batch.column(1))):
            doc_id = batch.column(0)[k].as_py()
            ids = np.append(tokens.ids(text), np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                cut = ids[start : start + capacity]
                crc = zlib.crc32(cut.tobytes())
                out.append((doc_id, piece, start, len(cut), crc, zlib.crc32(b"%d %d %d" % (crc, len(out), doc_id or 0))))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return map_arrow(docs.select(id_col, text_col), rows, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins that any packing needs, by two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = math.ceil(int(x.sum()) / capacity)
    order = np.sort(x)
    total = np.concatenate([[0], np.cumsum(order)])
    cuts = np.unique(order[order <= capacity // 2])
    # f_a(x): capacity above capacity - a, 0 below a, x between.
    lo, hi = np.searchsorted(order, cuts), np.searchsorted(order, capacity - cuts, "right")
    if len(cuts):
        best = max(best, int(np.max(-(-((len(order) - hi) * capacity + total[hi] - total[lo]) // capacity))))
    # u_k(x): x where (k+1)x/C is whole, else floor((k+1)x/C) C/k; scaled by k to stay in integers.
    for k in range(1, 20):
        scaled, rest = np.divmod((k + 1) * x, capacity)
        best = max(best, -(-int(np.where(rest == 0, k * x, scaled * capacity).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Bins are kept by free space; a bit set of the free spaces in use finds the
    fullest bin that still takes an item in constant time.
    """
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}
    spaces, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                spaces &= ~(1 << space)
        else:
            space, b, bins = capacity, bins, bins + 1
        bin_of[i], offset[i] = b, capacity - space
        free.setdefault(space - size, []).append(b)
        spaces |= 1 << (space - size)
    return bin_of, offset, bins


def _pack_group(round_no: int, capacity: int, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "salt", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bound = lower_bound(lengths, capacity)
        bin_of, offset, bins = best_fit_decreasing(lengths, capacity)
        group = int(pdf["grp"].iloc[0])
        ids = (np.int64(round_no) << 56) | (np.int64(group) << 24) | bin_of
        before = pdf["sequence_id"].nunique() if round_no else bins
        if round_no and bins >= before:
            ids, offset, bins = pdf["sequence_id"].to_numpy(np.int64), pdf["offset"].to_numpy(np.int64), before
            bin_of = pd.factorize(ids)[0]
        certified = bins == bound
        final = np.ones(len(pdf), bool)
        if not certified and not last:
            used = np.bincount(bin_of, weights=lengths)
            loose = used < capacity * 15 // 16
            loose[np.argsort(used, kind="stable")[:2]] = True
            final = ~loose[bin_of]
        saved = np.zeros(len(pdf), np.int64)
        saved[0] = before - bins
        return pdf.assign(sequence_id=ids, offset=offset, home=group, certified=certified, final=final, saved=saved)[[x.split()[0] for x in PACKED.split(", ")]]

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = 5000) -> DataFrame:
    """Assign a sequence and an offset to every piece; see the module's text.

    An empty table packs into no sequences; equal pieces are packed each for
    itself.  ``certified`` tells whether a piece's group met its lower bound.
    A group of ``group_pieces`` pieces on average is packed in one task.
    """
    left = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "home": F.col("salt")})
    done: list[DataFrame] = []
    for r in itertools.count():
        groups = max(1, math.ceil(left.count() / group_pieces))
        # After the first round whole bins move, so that a group may keep its arrangement.
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("home" if r == 0 else "sequence_id", F.lit(r)), F.lit(groups)))
        packed = written(dealt.groupBy("grp").applyInPandas(_pack_group(r, capacity, groups == 1), PACKED), f"packed-{r}")
        saved, going = packed.agg(F.sum("saved"), F.count_if(~F.col("final"))).first()
        if groups == 1 or not going or (r and not saved):
            done.append(packed)
            break
        done.append(packed.where("final"))
        left = packed.where("not final").drop("certified", "final", "saved")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack; null texts are empty and hold only the end id."""
    if vocabulary is None:
        import public_tokenizers as P

        vocabulary = P.path("word_bpe_49k.json")
    return pack(written(token_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)
