"""The pipeline's near-duplicate stage: crowded buckets and the decision at 0.8."""

import itertools
import random

from pyspark.sql import functions as F

from tidemill.llm import simhash_pivot


def test_every_two_nodes_of_a_crowded_bucket_meet(spark):
    for parts in (1, 2, 5):
        rows = spark.range(40).select("id", F.explode(simhash_pivot.part_tasks(F.lit(parts).cast("long"), F.col("id"))).alias("task")).collect()
        tasks = {}
        for r in rows:
            tasks.setdefault(r.task, []).append(r.id)
        met = {pair for nodes in tasks.values() for pair in itertools.combinations(sorted(nodes), 2)}
        assert met == set(itertools.combinations(range(40), 2))


def test_pairs_of_a_crowded_bucket_are_linked_without_leaders(spark, monkeypatch):
    """Copies with one changed word, in buckets cut into parts of four."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(300)]
    docs = []
    for i in range(40):
        own = [f"d{i}x{rng.random()}" for _ in range(160)]
        docs += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:-1] + ["changed"]))]
    monkeypatch.setattr(simhash_pivot, "CROWDED", 4)
    got = {r.doc_id: r.component_id for r in simhash_pivot.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == 80


def test_shingle_sets_decide_at_the_threshold(spark):
    """Pairs at 0.81 are found and pairs at 0.79 are not, however often a line of them repeats."""
    rng = random.Random(4)

    def word():
        return f"w{rng.random()}"

    docs, want = [], {}
    for i in range(80):
        near = i % 2 == 0
        size, own = (1000, 105) if near else (1000, 117)
        base = [word() for _ in range(size + 4 - own)]
        a, b = base + [word() for _ in range(own)], base + [word() for _ in range(own)]
        if i % 4 < 2:
            b += b[-10:] * 18
        sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert (alike >= 0.8) == near and abs(alike - 0.8) < 0.02
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if near else 2 * i + 1}
    got = {r.doc_id: r.component_id for r in simhash_pivot.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_groups_cut_into_parts_hold_together(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.random()}" for _ in range(200)]
    docs = [(i, " ".join(base[: 100 + i] + [f"n{i}"] + base[100 + i :])) for i in range(30)]
    monkeypatch.setattr(simhash_pivot, "CROWDED_SHINGLES", 1000)
    assert {r.component_id for r in simhash_pivot.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0}
