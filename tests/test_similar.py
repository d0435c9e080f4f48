"""The set-similarity join and candidate links against brute force."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import relations, similar
from tidemill.plans import queries as review
from tidemill.plans import records as plans


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def grams(text):
    t = re.sub(r"\s+", "", text or "")
    return {t[i : i + 3] for i in range(len(t) - 2)}


@pytest.mark.parametrize("small", [False, True])
def test_pairs_of_sets_against_brute_force(spark, monkeypatch, small):
    """Also with long lists cut into many parts, small blocks, and no element common enough to be ranked."""
    if small:
        monkeypatch.setattr(similar, "TOGETHER", 5)
        monkeypatch.setattr(similar, "BLOCK", 3)
        monkeypatch.setattr(similar, "RANKED", 1)
    rng = random.Random(4)
    rows = []
    for k in range(150):
        base = rng.sample(range(60), rng.randint(0, 12)) if k % 3 else rng.sample(range(400), rng.randint(20, 60))
        rows.append((rng.choice(["a", "b", None]), k, sorted(set(base))))
        if k % 2:
            again = set(base) ^ set(rng.sample(range(400), rng.randint(0, 6)))
            rows.append((rows[-1][0], 1000 + k, sorted(again)))
    df = spark.createDataFrame(rows, "key string, id long, elements array<bigint>")
    for least in (0.6, 0.8, 1.0):
        got = {(r.low, r.high): r.similarity for r in similar.similar_pairs(df, least).collect()}
        want = {(min(i, j), max(i, j)): jaccard(set(x), set(y)) for (k, i, x), (m, j, y) in itertools.combinations(rows, 2) if k == m and jaccard(set(x), set(y)) >= least}
        assert got == pytest.approx(want) and want
    assert similar.similar_pairs(df.limit(0), 0.6).count() == 0


def test_bounds_hold_for_every_pair():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ({rng.randrange(50) for _ in range(rng.randint(1, 40))} for _ in range(2))
        words = [similar.parity(similar.np.array(sorted(s))) for s in (a, b)]
        assert int(similar.np.bitwise_count((words[0] ^ words[1]).view("u8")).sum()) <= len(a ^ b)


def test_grams_of_any_script(spark):
    texts = ["ab c d", "  ", None, "ab", "é日本語 テキスト", "😀x😀y", "a\x1cb\x85c　d", "abcabcabc", "\U0010ffff" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    for r in similar.gram_sets(rows).collect():
        spelt = {"".join(chr(e >> s & 0x1FFFFF) for s in (42, 21, 0)) for e in r.elements}
        assert spelt == grams(texts[r.id]) and list(r.elements) == sorted(r.elements)


def test_candidate_links_against_brute_force(spark):
    """Titles alike by letters and digits, any script, empty and null; equal contents are members and stand once among the links."""
    rng = random.Random(6)
    titles, alphabet = ["Homepage!", "home page", "홈페이지 제작", "", None, "###"], "abcde 가나다라é日"
    rows = []
    for k in range(160):
        body = None if k % 40 == 0 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0 and rows:
            old = rng.choice(rows)[2] or ""
            body = old if k % 2 else old[:-2] + "xy"
        rows.append((k, rng.choice(titles), body))
    rows += [(1000 + k, "홈페이지제작", "many near copies of one text " * 5 + str(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, title string, body string").withColumn("digest", F.md5(F.coalesce("body", F.lit("")).cast("binary")))
    members, links = relations.candidate_links(df)
    key = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    first = {}
    for i, t, b in rows:
        first.setdefault((key(t), b or ""), i)
    assert {(r.id, r.other) for r in members.collect()} == {(i, first[key(t), b or ""]) for i, t, b in rows if first[key(t), b or ""] != i}
    want = {(min(i, j), max(i, j)): jaccard(grams(a), grams(b)) for ((k, a), i), ((m, b), j) in itertools.combinations(first.items(), 2) if k == m and jaccard(grams(a), grams(b)) >= 0.6}
    assert {(r.low, r.high): r.similarity for r in links.collect()} == pytest.approx(want) and len(want) > 400


@pytest.mark.parametrize("places", [0, 1 << 40])
def test_pairs_by_lists_and_by_products(spark, monkeypatch, places):
    """Keys of many blocks, once by the lists of their elements and once by products of blocks, sizes from 1 to 90."""
    monkeypatch.setattr(similar, "BLOCK", 4)
    monkeypatch.setattr(similar, "WIDTH", 16)
    monkeypatch.setattr(similar, "PLACES", places)
    rng = random.Random(8)
    rows = [("k", i, sorted(rng.sample(range(100), min(90, int(1.06 ** (i + 1)) + 1)))) for i in range(80)]
    rows += [("k", 100 + i, sorted({*e, -7, 1 << 62})) for _, i, e in rows[::3]]
    for least in (0.5, 0.6):
        got = {(r.low, r.high): r.similarity for r in similar.similar_pairs(spark.createDataFrame(rows, "key string, id long, elements array<bigint>"), least).collect()}
        want = {(i, j): s for (_, i, a), (_, j, b) in itertools.combinations(rows, 2) if (s := jaccard(set(a), set(b))) >= least}
        assert got == pytest.approx(want) and len(want) > 30


def test_alike_sets_store_no_pairs(spark, monkeypatch):
    """Sets that have much in common, few of them enough: what is stored between steps grows with the sets, not with their pairs."""
    stored = []
    keep = similar.settled
    monkeypatch.setattr(similar, "settled", lambda df: (out := keep(df), stored.append(out.count()))[0])
    rng = random.Random(9)
    rows = [("k", i, sorted(rng.sample(range(0, 3_000_000, 1000), 1800))) for i in range(120)]
    assert similar.similar_pairs(spark.createDataFrame(rows, "key string, id long, elements array<bigint>"), 0.6).count() == 0
    assert sum(stored) < 3 * 120


def test_copies_stand_among_the_links(spark, tmp_path):
    """Every pair of documents that brute force finds follows from the query's rows: pairs of first ones, each with its copies; SQL gives the same."""
    base = "Home page\nwe look for somebody who builds a home page for a small bakery"
    texts = [base, base + " soon", base, base + " soon", base, "home-page!\nsomething quite unlike it", "ab", "ab", None, "", "ab\n", base + "  soon", "другой\nтекст", "Другой\nтекст."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.candidate_links(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(review.SQL["candidate_links"])
    assert got.columns == [c[0] for c in want.description]
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    equal = lambda i, j: (texts[i] or "") == (texts[j] or "")
    copies = {k: [k, *[r.high for r in rows if r.low == k and equal(k, r.high)]] for k in range(len(texts))}
    pairs = {p for members in copies.values() for p in itertools.combinations(members, 2)}
    pairs |= {(min(p), max(p)) for r in rows if not equal(r.low, r.high) for p in itertools.product(copies[r.low], copies[r.high])}
    title = lambda t: "".join(c for c in (t or "").split("\n")[0].lower() if c.isalnum())
    alike = lambda a, b: title(a) == title(b) and jaccard(grams(a), grams(b)) >= 0.6
    assert pairs == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if equal(i, j) or alike(texts[i], texts[j])} and len(pairs) > 15
    assert all(r.same == equal(r.low, r.high) and r.low < r.high for r in rows)


def test_records_without_a_digest(spark):
    """They are no copies of each other; each is compared by its body."""
    rows = spark.createDataFrame([(1, "t", "one text of some words", None), (2, "t", "one text of some words!", None), (3, "t", "another thing entirely", None), (4, "t", "one text of some words", "h")], "id long, title string, body string, digest string")
    members, links = relations.candidate_links(rows)
    assert not members.collect() and sorted((r.low, r.high) for r in links.collect()) == [(1, 2), (1, 4), (2, 4)]
