"""The corpus pipeline, stage by stage, against brute force; mixing and exact dedup against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from tidemill.llm import mixing, queries, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        after = spark.read.parquet(f"{root}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_quality_stage(steps):
    _, before, after = steps[0]
    assert ids(after) == sorted(r.doc_id for r in quality_rules.score_quality(before).collect() if r.kept)


def test_exact_stage(steps):
    _, before, after = steps[1]
    best = {}
    for r in before.collect():
        low = r.text.translate({c: c + 32 for c in range(65, 91)})
        best[low] = max(best.get(low, -1), r.doc_id)
    assert ids(after) == sorted(best.values())


def test_near_stage(steps):
    _, before, after = steps[2]
    sets = {}
    for r in before.collect():
        w = r.text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    kept = set(ids(after))
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a in sets:
        if a in kept:
            assert max((alike(a, b) for b in kept if b != a), default=0) < 0.8
        else:
            assert max(alike(a, b) for b in sets if b != a) >= 0.8


def test_mixing_stage(steps):
    _, before, after = steps[3]
    want = sorted(r.doc_id for r in mixing.mix(before).collect() for _ in range(r.copies))
    assert ids(after) == want


def test_packing_stage(steps):
    _, before, after = steps[4]
    first = [r for r in after.collect() if r.piece == 0]
    assert sorted(r.doc_id for r in first) == ids(before)


def test_run_gives_the_same_as_the_stages(spark, steps):
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in steps[-1][2].collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    df = queries.queries()[name](spark, SF).select(columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, got.fetchall()))


def test_mixing_meets_budgets_and_moves_shortages_to_siblings(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    taken, budget = {}, {}
    for r in rows:
        leaf = (r.domain, r.lang, r.source)
        taken[leaf] = taken.get(leaf, 0) + r.n_tokens * r.copies
        budget[leaf] = r.leaf_budget
    assert len(rows) == docs.count() and all(taken[k] <= budget[k] for k in taken)
    assert sum(budget.values()) <= 0.8 * sum(r.n_tokens for r in rows) + 1
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
