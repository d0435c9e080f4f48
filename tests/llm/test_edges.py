"""Rows that are odd in every way: nulls, repeats, ties, long texts, bytes that are no text, columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import exact_dedup, lang_id, mixing, packing, quality_crf, quality_rules, secret_scan, simhash_pivot, substring_dedup, toxicity

ODD = [(None, None), (None, ""), (None, "no id here at all"), (1, "one two three four five six"), (1, "one two three four five six"), (2, ""), (2, None), (3, " \n\t "), (4, "ONE TWO three four five six"), (5, "word " * 20_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string").coalesce(2)


@pytest.fixture(scope="module")
def broken(spark):
    """A string whose bytes are no UTF-8."""
    rows = spark.createDataFrame([(1, bytearray(b"plain \xff\xfe words and a token=abcdef1")), (2, bytearray(b"good words"))], "doc_id long, b binary")
    return rows.select("doc_id", F.col("b").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s0").alias("source"))


def test_stages_with_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        rows = out.collect()
        if name == "quality rules":
            assert rows == []  # short, empty and repeated texts fail the base test
        elif name == "exact dedup":
            # Equal texts: the largest id stays; rows without an id go where one with an id stays.
            assert sorted((r.doc_id, r.text) for r in rows if r.doc_id not in (2, None) and r.doc_id != 5) == [(3, " \n\t "), (4, "ONE TWO three four five six")]
            assert sorted(str(r.text) for r in rows if r.doc_id == 2) == ["", "None"] and [r.text for r in rows if r.doc_id is None] == ["no id here at all"]
        elif name == "SimHash near-dedup":
            # Wordless texts are alike; rows without an id stay.
            assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "2", "5", "None", "None", "None"]
        elif name == "mixing sources":
            assert {r.doc_id for r in rows} <= {i for i, _ in ODD}
        else:
            assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}) == len(rows) and sum(r.length for r in rows) == len(ODD) + 1 + 20_000 + sum(len((t or "").split()) for i, t in ODD if i != 5) - 1


def test_stages_with_clashing_columns(spark):
    rows = [(k, f"text number {k} " + " ".join(f"w{(k * 7 + j) % 50}" for j in range(60)), "en", "src1", 1, "a", True, "b", "c", 5) for k in range(12)]
    names = "doc_id long, text string, lang string, source string, copies int, __m string, mark boolean, row string, domain string, place int"
    df = spark.createDataFrame(rows, names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
    assert {r.row for r in exact_dedup.exact_dedup(df).collect()} == {"b"} and mixing.mix_documents(df).count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == 12


def test_stages_with_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0


def test_bytes_that_are_no_text(spark, broken):
    named = broken.select(F.col("doc_id").alias("id"), "text", "lang")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id long, label int")
    assert [r.n_assign for r in secret_scan.scan_secrets(broken).orderBy("doc_id").collect()] == [1, 0]
    assert simhash_pivot.near_duplicates(broken).count() == packing.pack_documents(broken).count() == 2
    assert toxicity.score(broken, toxicity.train(named, labels)).count() == quality_crf.score(broken, quality_crf.train(named, labels)).count() == 2
    assert lang_id.predict(broken, lang_id.train(broken, lang_id.default_vocabulary())).where("lang_pred = 'en'").count() == 2


def test_ids_that_repeat_or_lack(odd):
    assert secret_scan.scan_secrets(odd).count() == len(ODD)
    near = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_pivot.near_duplicates(odd).collect()}
    assert near[1, next(f for i, f in near if i == 4)] == near[4, next(f for i, f in near if i == 4)] == 1
    assert {c for (i, f), c in near.items() if f == "0" * 16} == {2}
    pieces = packing.pack_documents(odd).collect()
    assert sum(r.doc_id == 1 for r in pieces) == 2 and sum(r.doc_id is None for r in pieces) == 3


def test_mixing_ties_and_repeats(spark):
    """Rows of one id share one fate, and a text without words that stands where the budget ends goes with its place."""
    rows = [(k // 2, "a b c", "en", "src0") for k in range(40)] + [(None, None, None, None), (99, "", "en", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, budget_share=0.5, max_epochs=1)
    fates = {}
    for r in got.collect():
        fates.setdefault(r.doc_id, set()).add(r.copies)
    assert all(len(f) == 1 for f in fates.values()) and got.count() == len(rows)
    taken = sum(r.copies for r in got.collect())
    assert mixing.mix_documents(df, budget_share=0.5, max_epochs=1).count() == taken


def naive_best_fit(lengths, capacity):
    bins = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [b for b in range(len(bins)) if bins[b] >= lengths[i]]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= lengths[i]
        else:
            bins.append(capacity - lengths[i])
    return sorted(bins)


def test_best_fit_against_a_naive_one():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = rng.integers(1, 61, rng.integers(1, 80))
        bin_of, _, bins = packing.best_fit_decreasing(lengths, 60)
        assert sorted(60 - np.bincount(bin_of, lengths, bins)) == naive_best_fit(lengths, 60)


def test_other_vocabularies_encode_whole_texts(spark):
    import public_tokenizers as P
    import tokenizers

    path = P.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    text = "Two  spaces, Upper case\nand lines"
    got = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()
    ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
    assert (got.length, got.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


@pytest.fixture(scope="module")
def network(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(80)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(30)) + (" nasty vile thing" if k % 3 == 0 else ""), ("en", "de")[k % 2]) for k in range(150)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    return toxicity.train(docs, docs.select("id", (F.col("id") % 3 == 0).cast("int").alias("label")))


def naive_raw(m, words):
    """Convolution, pooling and the output unit, one number at a time."""
    vectors = []
    for w in words:
        at = toxicity.buckets(w)
        vectors.append([sum(float(m.table[b][d]) for b in at) / len(at) ** 0.5 for d in range(toxicity.DIM)])
    answers = []
    for width, kernel, bias in zip(toxicity.WIDTHS, m.kernels, m.biases, strict=True):
        padded = vectors + [[0.0] * toxicity.DIM] * max(0, width - len(vectors))
        for f in range(toxicity.FILTERS):
            best = max(sum(padded[i + o][d] * float(kernel[o, d, f]) for o in range(width) for d in range(toxicity.DIM)) for i in range(len(padded) - width + 1))
            answers.append(max(0.0, best + float(bias[f])))
    z = sum(a * float(w) for a, w in zip(answers, m.out, strict=True)) + float(m.offset)
    return 1 / (1 + np.exp(-z))


def test_network_against_a_naive_one(spark, network):
    texts = ["one nasty word", "x", "a longer text with a vile thing in it, and more " * 3, "z" * 150 + "nasty"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), network).collect()}
    for k, text in enumerate(texts):
        words = toxicity.split_words(text)
        assert got[k] == pytest.approx(network.calibrated(naive_raw(network, words), network.language(set(words))), rel=1e-3)


def test_toxic_words_late_in_an_unbroken_run(spark, network):
    """Characters after the 64th of a run without spaces are read."""
    assert toxicity.split_words("a" * 130)[0] == "a" * 64 and "".join(toxicity.split_words("a" * 130)[1:]) != ""
    grams = {g for w in toxicity.split_words("q" * 100 + "nasty") for g in toxicity.buckets(w)}
    assert {zlib.crc32(g.encode()) % toxicity.BUCKETS for g in ("nast", "asty")} <= grams


def test_scores_of_odd_texts(spark, odd, network):
    rows = toxicity.score(odd, network).collect()
    assert [r.score for r in rows if not r.score] == [0.0] * 5  # null, empty and wordless texts
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and all(r.predicted == int(r.score >= 0.7) for r in rows)
    lines = spark.createDataFrame([(k, "\n".join(["good line of words."] * 5 if k % 2 else ["### $$$ %%%"] * 5), k % 2) for k in range(40)], "id long, text string, label int")
    field = quality_crf.train(lines.select("id", "text"), lines.select("id", "label"))
    scores = [(r.doc_id, r.score) for r in quality_crf.score(odd, field).collect()]
    assert len({s for i, s in scores if i == 1}) == 1 and len({round(s, 12) for i, s in scores if i in (2, 3)}) == 1


def test_long_documents_run_alone():
    """Documents with more lines than are held side by side give the same marginals."""
    rng = np.random.default_rng(2)
    field = quality_crf.LineField(np.zeros(quality_crf.FEATURES), rng.normal(size=(2, 2)))
    evidence = [rng.normal(size=n) for n in (70_000, 3, 2, 70_500)]
    together, _, _ = field.marginals(evidence)
    for e, bad in zip(evidence, together, strict=True):
        assert bad == pytest.approx(field.marginals([e])[0][0])


def test_long_words_are_summed_whole():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a"]
    net = lang_id.Lattice(sorted(pieces))
    p = np.random.default_rng(0).random((len(pieces) + 2, 2))
    p[-2], p[-1] = 0, lang_id.UNSEEN
    index = {x: i for i, x in enumerate(sorted(pieces))}
    word = "▁" + "abbac" * 120
    sums, scale = [np.ones(2)], np.zeros(2)
    for j in range(1, len(word) + 1):
        now = np.zeros(2)
        for size in (1, 2):
            if size <= j:
                part = word[j - size : j]
                now += sums[-size] * (p[index[part]] if part in index else p[-1] if size == 1 else 0)
        sums = [sums[-1] / now.max(), now / now.max()]
        scale += np.log(now.max())
    assert net.forward([word, "▁ab"], p)[0] == pytest.approx(np.log(sums[-1]) + scale)


def test_runs_longer_than_any_cut_are_judged_whole(spark):
    rng = random.Random(1)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(9000))
    got = secret_scan.scan_secrets(spark.createDataFrame([(1, f"x {run} y")], "doc_id long, text string")).first()
    assert f"random:2:{2 + len(run)}" in got.spans.split(",") and got.base_sha256 == hashlib.sha256(",".join(s for s in got.spans.split(",") if not s.startswith("random")).encode()).hexdigest()


def test_uses_of_pieces_in_long_words():
    """Forward and backward sums of long words, scaled, against exact fractions; words of other lengths beside them."""
    from fractions import Fraction

    pieces = sorted(["a", "ab", "b", "ba", "abab", "▁", "▁a"])
    net = lang_id.Lattice(pieces)
    p = np.concatenate([np.array([0.02, 0.003, 0.05, 0.001, 0.0004, 0.01, 0.002]), [0, lang_id.UNSEEN]])
    words, counts = ["▁ab", "▁" + "abbab" * 30, "▁" + "c" * 90 + "ab", "▁b"], np.array([2.0, 1.0, 3.0, 1.0])
    exact = [Fraction(float(x)) for x in p]
    want = np.zeros(len(p))
    for word, n in zip(words, counts, strict=True):
        steps = [[(k, size) for size in range(1, 5) for k in [net.order[list(net.sorted).index(net._of(word[j : j + size]))] if j + size <= len(word) and word[j : j + size] in pieces else None] if k is not None] for j in range(len(word))]
        for j in range(len(word)):
            if word[j] not in pieces:
                steps[j].append((len(p) - 1, 1))
        ahead, back = [Fraction(0)] * (len(word) + 1), [Fraction(0)] * (len(word) + 1)
        ahead[0] = back[-1] = Fraction(1)
        for j in range(len(word)):
            for k, size in steps[j]:
                ahead[j + size] += ahead[j] * exact[k]
        for j in reversed(range(len(word))):
            back[j] = sum((exact[k] * back[j + size] for k, size in steps[j]), Fraction(0))
        for j in range(len(word)):
            for k, size in steps[j]:
                want[k] += float(n * float(ahead[j] * exact[k] * back[j + size] / ahead[-1]))
    assert net.expected(words, counts, p) == pytest.approx(want, rel=1e-9)


def test_a_language_without_spaces_is_learned(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice(["ka", "tori", "mizu", "no"]) for _ in range(150)), "xx") for k in range(8)] + [(100 + k, " ".join(rng.choice(["the", "cat", "house", "and"]) for _ in range(60)), "en") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df, lang_id.default_vocabulary())
    assert model.languages == ("en", "xx")
    assert {r.doc_id: r.lang_pred for r in lang_id.predict(df, model).collect()} == {i: lang for i, _, lang in rows}


def test_samples_shrink_at_any_size(spark):
    """A share of 800 rows in 1e10 is a share: places are many enough to tell such rows apart."""
    from tidemill.llm.common import sample_place

    places = spark.range(300_000).select(sample_place(F.col("id")).alias("p"))
    got = places.agg(F.count_distinct("p").alias("n"), F.count_if(F.col("p") < 8e-8).alias("rare"), F.avg("p").alias("mean")).first()
    assert got.n == 300_000 and got.rare <= 2 and abs(got.mean - 0.5) < 0.005
    # The share of 2000 texts in 1e10 that op3's sample takes is one place or more.
    from tidemill.llm.common import PLACES

    assert PLACES * (800 / 1e10) > 1000 and PLACES * (2000 / 1e11) > 1000


def test_letters_alone_are_judged_too(spark):
    run = "qZkXvBnMwRtYpLsDhJfGcQzK"
    got = secret_scan.scan_secrets(spark.createDataFrame([(1, f"see {run} here, and thequickbrownfoxjumpsoverthelazydog")], "doc_id long, text string")).first()
    assert got.spans == f"random:4:{4 + len(run)}" and got.n_random == 1


def test_substring_dedup_of_odd_rows(spark, odd, broken):
    """Nulls, repeats and a long text through op3, op4, op5 and op7; bytes that are no UTF-8 too."""
    rows = substring_dedup.repeated_windows(odd).collect()
    assert len(rows) == len(ODD) and sorted(r.n_words for r in rows if r.doc_id is not None) == [0, 0, 0, 6, 6, 6, 20_000]
    # One window repeats all through the long text, but within one document; nothing goes.
    assert all(r.n_removed == 0 for r in rows)
    assert quality_rules.score_quality(odd).count() == mixing.mix(odd).count() == len(ODD)
    digests = exact_dedup.dedup_digest(odd).collect()
    assert len(digests) == len(ODD) and {r.group_size for r in digests if r.doc_id == 1} == {3}
    for operator in (substring_dedup.repeated_windows, quality_rules.score_quality, mixing.mix, exact_dedup.dedup_digest):
        assert operator(broken).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, broken, "").count() <= 2
