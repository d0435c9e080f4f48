"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one measure of a text and votes good (1), bad (-1) or
abstains (0).  Votes are counted by pattern - at most 3**rules of them, however
many the texts - and expectation-maximisation over the pattern counts estimates
each rule's accuracy on good and on bad texts and the share of good ones.  A
text is kept if its posterior probability of being good is at least one half.

The data decide what a rule's vote is worth: what is believed beforehand weighs
as much as a few hundred texts, whatever the input's size.  It only breaks the
symmetry of the two classes, and a rule can at worst lose all say: one that
objects more often to good texts than to bad ones is held to object alike.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = string.punctuation + string.digits
ROUNDS = 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(w: Column, size: int = 5) -> Column:
    """How many words, given by their hashes, stand in windows of ``size`` that the text holds twice or more.

    Windows are compared by 64-bit hashes; sorting them with their positions
    finds the repeated ones in n log n steps, also in very long texts.
    """
    positions = F.sequence(F.lit(0), F.size(w) - size)
    hashes = F.transform(positions, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]).eqNullSafe(True)), lambda x: x["i"]
                )
            ),
        )
        gaps = let(again, lambda a: F.transform(a, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(a, k + 1) - x, F.lit(size)))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(w) >= size, repeated).otherwise(0)


def removed(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(text_col: str) -> Column:
    """A struct of all measures of a text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def fields(w: Column) -> Column:
        return let(
            lines,
            lambda ln: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
                removed(text, SYMBOLS).cast("long").alias("n_symbols"),
                (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(ln).cast("long").alias("n_lines"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                removed(text, UPPER).cast("long").alias("n_upper"),
                removed(text, "!?").cast("long").alias("n_shouts"),
                removed(text, SIGNS).cast("long").alias("n_signs"),
            ),
        )

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), fields)


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes(m: Column) -> Column:
    """The rules' votes on a struct of measures, in a fixed order.

    Five rules only ever object: a text without junk symbols may still be bad.
    Several look at one failing from different sides, so that their agreement
    tells more than either.
    """
    n, chars = m["n_words"], m["word_chars"]
    return F.array(
        _vote(n < 10, n >= 40),
        _vote((chars < 2 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 11 * n)),
        _vote(10 * m["n_symbols"] > n),
        _vote(10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        _vote(100 * m["n_repeat_words"] > 20 * n, (m["n_repeat_words"] == 0) & (n >= 20)),
        _vote(100 * m["n_upper"] > 30 * chars),
        _vote(m["n_distinct"] * m["n_distinct"] < 2 * n),  # vocabularies grow like the root of a text's length
        _vote(4 * m["n_shouts"] > n),
        _vote(100 * m["n_signs"] > 12 * chars, 100 * m["n_signs"] <= 8 * chars),
    )


RULES = 9


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _log_odds(v: Column, model: Column) -> Column:
    """Log-odds of good given votes v under a struct of :func:`fit`."""

    def term(x: Column, j: Column) -> Column:
        gu, gd, bu, bd = (F.get(model[k], j) for k in RATES)
        return F.when(x == 1, F.log(gu) - F.log(bu)).when(x == -1, F.log(gd) - F.log(bd)).otherwise(F.log(1 - gu - gd) - F.log(1 - bu - bd))

    return F.aggregate(F.transform(v, term), F.log(model["pi"] / (1 - model["pi"])), lambda s, x: s + x)


def posterior(v: Column, model: Column) -> Column:
    return 1 / (1 + F.exp(-_log_odds(v, model)))


#: How often a rule votes good and bad on good texts, and the same on bad ones.
RATES = ("good_up", "good_down", "bad_up", "bad_down")
#: What is believed before any text is seen, worth STRENGTH texts of either class: rules seldom object to
#: good texts and object to a good part of the bad ones; those that can approve do so more on good texts.
APPROVING = (0, 1, 4, 8)
PRIOR = {
    "good_up": [0.6 if j in APPROVING else 0.0 for j in range(RULES)],
    "good_down": [0.02] * RULES,
    "bad_up": [0.4 if j in APPROVING else 0.0 for j in range(RULES)],
    "bad_down": [0.3] * RULES,
}
STRENGTH = 200.0
PRIOR_GOOD = 0.85


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _step(model: Column, patterns: Column) -> Column:
    """One round: the posterior of every pattern, then all rates anew."""
    weighed = F.transform(patterns, lambda p: F.struct(p["v"].alias("v"), (p["n"] * posterior(p["v"], model)).alias("g"), p["n"].cast("double").alias("n")))

    def total(w: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(w, F.lit(0.0), lambda s, p: s + of(p))

    def good(p: Column) -> Column:
        return p["g"]

    def bad(p: Column) -> Column:
        return p["n"] - p["g"]

    def votes_of(w: Column, name: str) -> Column:
        """Each rule's votes of one kind on one class, with those believed beforehand."""
        of, sign = good if name.startswith("good") else bad, 1 if name.endswith("up") else -1
        return F.transform(_doubles(PRIOR[name]), lambda mean, j: mean * STRENGTH + total(w, lambda p: F.when(F.get(p["v"], j) == sign, of(p)).otherwise(0.0)))

    def anchored(on_good: Column, on_bad: Column, n_good: Column, n_bad: Column, more_on_good: bool) -> Column:
        """Rates on either class; where they stand the wrong way round, both are the common rate."""

        def pair(g: Column, b: Column) -> Column:
            x, y, both = g / n_good, b / n_bad, (g + b) / (n_good + n_bad)
            right = x >= y if more_on_good else x <= y
            return F.struct(F.when(right, x).otherwise(both).alias("good"), F.when(right, y).otherwise(both).alias("bad"))

        return F.zip_with(on_good, on_bad, pair)

    def after(w: Column, g: Column, n: Column) -> Column:
        n_good, n_bad = g + STRENGTH, n - g + STRENGTH
        up = anchored(votes_of(w, "good_up"), votes_of(w, "bad_up"), n_good, n_bad, True)
        down = anchored(votes_of(w, "good_down"), votes_of(w, "bad_down"), n_good, n_bad, False)
        side = lambda pairs, name: F.transform(pairs, lambda x: x[name])
        pi = (g + PRIOR_GOOD * STRENGTH) / (n + STRENGTH)
        return let(up, lambda u: let(down, lambda d: F.struct(pi.alias("pi"), *[side(x, c).alias(k) for k, x, c in zip(RATES, (u, d, u, d), ("good", "good", "bad", "bad"), strict=True)])))

    return let(weighed, lambda w: let(total(w, good), lambda g: let(total(w, lambda p: p["n"]), lambda n: after(w, g, n))))


def fit(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row of ``pi`` and the four rate lists from ``v, n``: patterns and how many texts cast each.

    Expectation-maximisation from the prior on; without any text it stays there.
    """
    start = F.struct(F.lit(PRIOR_GOOD).alias("pi"), *[_doubles(PRIOR[k]).alias(k) for k in RATES])
    one = counts.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns"))  # at most 3**RULES patterns
    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: _step(s, F.col("patterns"))).alias("m")).select("m.*")


def _model(row) -> Column:
    return F.struct(F.lit(float(row["pi"])).alias("pi"), *[_doubles(row[k]).alias(k) for k in RATES])


def pattern_counts(measured: DataFrame, m: str) -> DataFrame:
    return measured.select(votes(F.col(m)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def verdict(m: Column, model: Column) -> Column:
    return ~base_failed(m) & (posterior(votes(m), model) >= 0.5)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, kept, p_good.

    Null and empty texts have no words, fail the base test and are not kept.
    Repeated rows are judged each for itself, alike.
    """
    measured = written(docs.select(F.col(id_col).alias("doc_id"), measures(text_col).alias("m")), "quality-measures")
    model = _model(fit(pattern_counts(measured, "m")).first())
    m = F.col("m")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select("doc_id", *[m[k].alias(k) for k in names], base_failed(m).alias("base_failed"), verdict(m, model).alias("kept"), posterior(votes(m), model).alias("p_good"))


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept, with their own columns; no row moves.

    The rows are written with their measures, so that a text is measured once.
    """
    measured = written(boxed(docs, m=measures(text_col)), "quality-measured")
    model = _model(fit(pattern_counts(measured, "m")).first())
    return measured.where(verdict(F.col("m"), model)).select("row.*")
