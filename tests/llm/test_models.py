"""Language, toxicity and line quality: held-out accuracy, and defined results for odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import lang_id, quality_crf, queries, toxicity

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held_out_labels(spark, got, label):
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(F.col("held_out") & F.col(label).isNotNull()).select(label, "predicted").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97


def test_toxicity_held_out(spark):
    y, p = held_out_labels(spark, queries.op2_toxicity(spark, SF), "toxic")
    assert (y == p).mean() > 0.9 and p[y == 0].mean() < 0.08


def test_line_quality_held_out(spark):
    y, p = held_out_labels(spark, queries.op8_quality_crf(spark, SF), "quality")
    assert (y == p).mean() > 0.9


def test_forward_sums_every_segmentation():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a"]
    net = lang_id.Lattice(sorted(pieces))
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 2, 1))
    p[-2], p[-1] = 0, lang_id.UNSEEN
    index = {x: i for i, x in enumerate(sorted(pieces))}
    for word in ("▁a", "▁abab", "▁bac", "▁bbaab"):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            chance = 1.0
            for x in parts:
                chance *= p[index[x], 0] if x in index else p[-1, 0] if len(x) == 1 else 0
            total += chance
        assert net.forward([word], p)[0, 0] == pytest.approx(np.log(total))


def brute_bad(e, moves):
    score = np.zeros(len(e))
    z = 0.0
    for states in itertools.product([0, 1], repeat=len(e)):
        w = np.exp(sum(e[i] for i, s in enumerate(states) if s) + sum(moves[a, b] for a, b in itertools.pairwise(states)))
        z += w
        score += w * np.array(states)
    return score / z, np.log(z)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    field = quality_crf.LineField(np.zeros(quality_crf.FEATURES), rng.normal(size=(2, 2)))
    evidence = [rng.normal(size=n) for n in (1, 2, 5, 7, 7)]
    bad, logz, _ = field.marginals(evidence)
    want = [brute_bad(e, field.transitions) for e in evidence]
    for b, (w, _) in zip(bad, want, strict=True):
        assert b == pytest.approx(w)
    assert logz == pytest.approx(sum(z for _, z in want))


def test_odd_rows_have_defined_results(spark, docs, empty):
    words = {"en": "the and this with house", "de": "der und mit haus nicht"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(["en", "de"] * 20)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lang_id.default_vocabulary())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ½ ² !"), (4, "the house " * 3000), (4, "the house"), (None, "und nicht")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in lang_id.predict(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")], key=str)
    assert lang_id.predict(empty, model).count() == 0
    nothing = lang_id.train(empty, lang_id.default_vocabulary())
    assert {r.lang_pred for r in lang_id.predict(docs, nothing).collect()} == {"und"}


def test_models_without_labels(spark, docs, empty):
    named = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    none = spark.createDataFrame([], "id long, label int")
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id long, label int")
    for labels in (none, one):
        assert toxicity.score(docs, toxicity.train(named, labels)).count() == docs.count()
        got = quality_crf.score(docs, quality_crf.train(named, labels))
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.collect())
    assert toxicity.score(empty, toxicity.train(named, none)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than a sample would hold: language words are counted in all, and what only later rounds show is learned."""
    rows = [(k, " ".join((f"w{k % 50}", f"x{k % 37}", "vile" if k % 8 == 0 else "mild", "fine")), ("en", "de", None)[k % 3]) for k in range(9000)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    seen, fit = [], getattr(toxicity, "_averaged", None)
    monkeypatch.setattr(toxicity, "_averaged", lambda part, *more: (seen.append({r.id for r in part.select("id").collect()}), fit(part, *more))[1], raising=False)
    m = toxicity.train(docs, docs.select("id", (F.col("id") % 8 == 0).cast("int").alias("label")))
    counts = np.full((toxicity.LANG_BUCKETS, 2), 0.5)
    for _, text, lang in rows:
        if lang:
            np.add.at(counts, ([toxicity.zlib.crc32(w.encode()) % toxicity.LANG_BUCKETS for w in set(toxicity.split_words(text))], m.languages.index(lang)), 1)
    assert np.allclose(m.language_weights, np.log(counts / counts.sum(axis=0)))
    assert len(seen) == 4 and sum(map(len, seen)) == len(set().union(*seen)) and 7000 < len(set().union(*seen)) < 7400
    got = toxicity.score(docs, m, id_col="id").toPandas()
    assert (got["predicted"] == (got["doc_id"] % 8 == 0)).all()


def test_buckets_of_many_words_at_once():
    words = ["a", "ab", "abc", "abcd", "aaaaaaaa", "abababab", "12x", "größe", "日本語日本語", "x" * 64, "Übermut", "w1"]
    for some in (words, words[::-1], ["é"], ["a"], []):
        flat, starts, lens = toxicity.bucket_runs(some)
        assert [sorted(flat[s : s + n]) for s, n in zip(starts, lens, strict=True)] == [sorted(toxicity.buckets(w)) for w in some]
