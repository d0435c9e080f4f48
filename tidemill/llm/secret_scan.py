"""Secret scanning with a token-efficiency test.

Fixed patterns find assignments, access keys and long hexadecimal runs.  The
efficiency test adds what no pattern names: a long run of key characters whose
characters-per-token ratio under a public byte-pair vocabulary is low is text
that the vocabulary has never seen, that is, random.  Known digests and
identifiers (hash lengths in hexadecimal, UUIDs) are excluded from that test.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts

# The patterns and least lengths of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers as P
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known_identifier(run: str) -> bool:
    """Digests of usual lengths and UUIDs: random by nature, but no secrets."""
    return bool(UUID.fullmatch(run)) or len(run) in DIGEST_LENGTHS and bool(HEX_ONLY.fullmatch(run))


def random_spans(text: str, encode, most_chars_per_token: float) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if not known_identifier(run) and len(run) <= most_chars_per_token * len(encode(run)):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most_chars_per_token: float = 2.2
) -> DataFrame:
    """One row per row of ``docs`` with counts and spans (code points, end exclusive).

    Null and empty texts have no spans.  Overlapping spans of different kinds
    are all listed.  Whole texts are scanned; no state is kept between rows.
    """
    if vocabulary is None:
        import public_tokenizers as P

        vocabulary = P.path("byte_bpe_50k.tiktoken")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, out = _encoding(vocabulary).encode_ordinary, {k: [] for k in ("a", "k", "h", "sha", "spans", "r")}
        for text in texts(batch.column(1)):
            base = base_spans(text)
            more = random_spans(text, encode, most_chars_per_token)
            kinds = [k for _, k, _ in base]
            out["a"].append(kinds.count(0))
            out["k"].append(kinds.count(1))
            out["h"].append(kinds.count(2))
            out["sha"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + more)))
            out["r"].append(len(more))
        longs = [pa.array(out[k], pa.int64()) for k in ("a", "k", "h")]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *longs, pa.array(out["sha"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["r"], pa.int64())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
        )

    return map_arrow(docs.select(id_col, text_col), rows, SCHEMA)
