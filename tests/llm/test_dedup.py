"""Exact, substring and near deduplication against brute force."""

import hashlib
import string

import numpy as np
import pytest
import xxhash

from tidemill.llm import exact_dedup, simhash_pivot, substring_dedup
from tidemill.llm.fm_index import FmIndex

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute_windows(pairs, size=13):
    first = {}
    for doc_id, text in pairs:
        w = split(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text in pairs:
        w = split(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_against_brute_force(docs, doc_rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_windows(docs).collect()}
    assert got == brute_windows([r[:2] for r in doc_rows])


def test_substrings_with_every_anchor_frequent(docs, doc_rows, monkeypatch):
    real = substring_dedup.frequent_anchors
    monkeypatch.setattr(substring_dedup, "frequent_anchors", lambda rows, n, window: real(rows, 1, window, 10))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_windows(docs).collect()}
    assert got == brute_windows([r[:2] for r in doc_rows])


def test_substrings_of_nothing(empty):
    assert substring_dedup.repeated_windows(empty).count() == 0


def test_repeated_ids_are_not_earlier_than_each_other(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "start " + text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.repeated_windows(df).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 20), (None, 0)]


def test_substrings_with_every_anchor_crowded(docs, doc_rows):
    """Windows of crowded anchors are dealt one by one."""
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_windows(docs, shard_rows=1).collect()}
    assert got == brute_windows([r[:2] for r in doc_rows])


def test_fm_index_reports_smallest_owner_and_failed_matches():
    """Streams that are partly in the index, with words that no indexed sequence holds."""
    import numpy as np

    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 3, n) for n in (30, 25, 40, 13, 14)]
    owners = np.array([7, 3, 9, 1, 5])
    asked = [np.concatenate([rng.integers(0, 4, 5), seqs[k][a:b], rng.integers(0, 9, 3)]) for k, a, b in ((0, 4, 20), (2, 0, 40), (3, 0, 13), (1, 3, 15), (4, 1, 12))] + seqs + [rng.integers(0, 3, 60), np.full(20, 8)]
    lens = np.array([len(s) for s in asked])
    index = FmIndex(np.concatenate(seqs), np.array([len(s) for s in seqs]), owners, 13)
    found = index.window_minima(np.concatenate(asked), lens)
    hits = 0
    for k, s in enumerate(asked):
        for i in range(len(s) - 12):
            w = s[i : i + 13].tolist()
            least = min((o for o, t in zip(owners, seqs) for j in range(len(t) - 12) if t[j : j + 13].tolist() == w), default=-1)
            assert found[k, i] == least
            hits += least == -1
    assert hits > 50


def test_exact_against_brute_force(docs, doc_rows):
    groups = {}
    for r in doc_rows:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    want = {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_digest(docs).collect()}
    assert got == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in groups.values())


def test_exact_of_nothing_and_rows_without_id(spark, empty):
    assert exact_dedup.dedup_digest(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    df = spark.createDataFrame([(None, "A"), (2, "a"), (None, "b"), (3, "c"), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.exact_dedup(df).collect() if r.doc_id) == [(2, "a"), (3, "c"), (3, "c")]
    assert [r.text for r in exact_dedup.exact_dedup(df).collect() if r.doc_id is None] == ["b"]


def brute_fingerprint(text, size):
    w = split((text or "").translate(LOWER))
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(docs, doc_rows):
    prints = {r[0]: brute_fingerprint(r[1], 4) for r in doc_rows}
    want = brute_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_pivot.near_duplicates(docs, words_per_shingle=4).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("bucket_rows", [2, 4096])
def test_links_of_close_fingerprints(spark, bucket_rows):
    import random

    rng = random.Random(3)
    prints = {}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints[len(prints)] = base
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()], "node long, fp long")
    links = simhash_pivot.near_links(df, bucket_rows=bucket_rows).collect()
    assert all(bin(prints[r.u] ^ prints[r.v]).count("1") <= 4 for r in links)
    pairs = {frozenset((r.u, r.v)) for r in links}
    want = brute_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    assert brute_components(sorted(prints), lambda a, b: frozenset((a, b)) in pairs) == want


def test_near_duplicates_of_nothing(empty):
    assert simhash_pivot.near_duplicates(empty).count() == 0
    assert simhash_pivot.near_dedup(empty).count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(12):
        base = [rng.choice(words) for _ in range(300)]
        ids = []
        for k in range(g % 4 + 1):
            w = list(base)
            for _ in range(k and 3):  # three changed words: a resemblance of about 0.9
                w[rng.randrange(300)] = "changed"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(w), "x"))
        groups.append(ids)
    half = rows[0][1].split()
    rows.append((len(rows), " ".join(half[:200] + [rng.choice(words) for _ in range(100)]), "x"))  # a resemblance of one half stays
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = sorted(r.doc_id for r in simhash_pivot.near_dedup(df).collect())
    assert kept == sorted([ids[0] for ids in groups] + [len(rows) - 1])


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    df = spark.createDataFrame([(5, "same"), (5, "other"), (9, "SAME")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.exact_dedup(df).collect()) == [(5, "other"), (9, "SAME")]


def test_words_of_a_text_are_hashed_at_once():
    """Words are those of ``split``, equal words have equal hashes wherever they stand, and anchors are the first smallest grams."""
    rng = np.random.default_rng(5)
    texts = [b"", b" ", b"a", b" a\x0bb\x1c c ", "\x85 é\xa0b ab ba".encode(), b"\x00 \x00\x00 a"] + [bytes(rng.choice(list(b"abc \n\t\x00"), n).tolist()) for n in rng.integers(0, 300, 200)]
    of, seen = substring_dedup.WordHashes().of, {}
    for text in texts:
        got = of(text).tolist()
        assert len(got) == len(text.split())
        for word, h in zip(text.split(), got, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) > 500
    hashes = rng.integers(0, 3, 400).astype(np.uint64)
    first, n, anchor = substring_dedup.anchors(hashes, 13)
    grams = substring_dedup.rolled(hashes, substring_dedup.GRAM)
    at = np.array([k + grams[k : k + 9].argmin() for k in range(388)])
    assert np.repeat(anchor, n).tolist() == grams[at].tolist() and (np.diff(at)[first[1:] - 1] != 0).all() and n.sum() == 388
