"""Regular-expression matches with their places, as columns.

Places are code points.  All matches of a text are found in one pass: each
match is preceded by the gap since the last one, and the gaps' lengths add up
to the places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"  # digits, spaces and word characters of all scripts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def both(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def has(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns occurs; a null text holds none."""
    return both(text).rlike(UNICODE + "|".join(f"(?:{p})" for p in patterns))


def _total(lengths: Column, upto: Column) -> Column:
    return F.aggregate(F.slice(lengths, 1, upto), F.lit(0), lambda s, n: s + n)


def find_all(text: Column, pattern: str, *groups: int) -> Column:
    """Array of ``start, stop, hit`` and ``g<n>`` for the named groups (empty where one took no part)."""
    whole = UNICODE + r"\G((?s:.*?))(" + pattern + ")"
    take = lambda k: F.regexp_extract_all(both(text), F.lit(whole), F.lit(k))

    def placed(gaps: Column, hits: Column, *values: Column) -> Column:
        sizes = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h))

        def one(hit: Column, i: Column, sizes: Column) -> Column:
            stop = _total(sizes, i + 1)
            more = [F.get(v, i).alias(f"g{g}") for v, g in zip(values, groups, strict=True)]
            return F.struct((stop - F.length(hit)).alias("start"), stop.alias("stop"), hit.alias("hit"), *more)

        return let(sizes, lambda s: F.transform(hits, lambda hit, i: one(hit, i, s)))

    return let(F.struct(take(1).alias("gaps"), take(2).alias("hits"), *[take(g + 2).alias(f"v{g}") for g in groups]), lambda m: placed(m["gaps"], m["hits"], *[m[f"v{g}"] for g in groups]))


def find_first(text: Column, pattern: str) -> Column:
    """``start, stop, hit`` of the first match, null without one."""
    whole = UNICODE + r"^((?s:.*?))(" + pattern + ")"

    def placed(m: Column) -> Column:
        start = F.length(m["before"])
        return F.struct(start.alias("start"), (start + F.length(m["hit"])).alias("stop"), m["hit"].alias("hit"))

    parts = F.struct(F.regexp_extract(both(text), whole, 1).alias("before"), F.regexp_extract(both(text), whole, 2).alias("hit"))
    return F.when(both(text).rlike(UNICODE + pattern), let(parts, placed))


def before(text: Column, start: Column, most: int | None = None) -> Column:
    """The text up to ``start``, or its last ``most`` characters."""
    head = F.substring(text, F.lit(1), start)
    return head if most is None else F.right(head, F.lit(most))


def after(text: Column, stop: Column, most: int | None = None) -> Column:
    return F.substring(text, stop + 1, F.lit(most if most is not None else 2**31 - 1))


def line_before(text: Column, start: Column) -> Column:
    """What the line of ``start`` holds before it."""
    return F.substring_index(before(text, start), "\n", -1)


def line_after(text: Column, stop: Column) -> Column:
    return F.substring_index(after(text, stop), "\n", 1)


# What ends a sentence, and what is trimmed before a quote.
SENTENCE_END = "\n.!?。"
BULLETS = " \t-•*·"


def sentence_around(text: Column, start: Column, stop: Column, limit: int = 90) -> Column:
    """``quote, start, stop``: the match widened to its sentence, at most ``limit`` characters each way, without bullets."""
    left = F.regexp_extract(before(text, start, limit), f"[^{SENTENCE_END}]*\\z", 0)
    right = F.regexp_extract(after(text, stop, limit), f"^[^{SENTENCE_END}]*", 0)

    def widened(left: Column, right: Column) -> Column:
        mark = F.substring(text, stop + F.length(right) + 1, F.lit(1))
        end = stop + F.length(right) + F.when(mark.isin(*SENTENCE_END[1:]), 1).otherwise(0)
        begin = start - F.length(left)
        raw = F.substring(text, begin + 1, end - begin)

        def trimmed(raw: Column) -> Column:
            bare = F.ltrim(raw, F.lit(BULLETS))
            quote = F.rtrim(bare, F.lit(" \t"))
            first = begin + F.length(raw) - F.length(bare)
            return F.struct(quote.alias("quote"), first.alias("start"), (first + F.length(quote)).alias("stop"))

        return let(raw, trimmed)

    return let(F.struct(left.alias("l"), right.alias("r")), lambda x: widened(x["l"], x["r"]))


def evidence(patterns: Iterable[str], body: Column, title: Column, widen: bool = True) -> Column:
    """``quote, start, stop`` of the first pattern, in their order, that the body holds, else of the title; null if neither does.

    A quote from the title is all of it and has no place.
    """
    patterns, b, t = list(patterns), both(body), both(title)
    nowhere = F.lit(None).cast("int")
    whole_title = F.struct(F.btrim(t).alias("quote"), nowhere.alias("start"), nowhere.alias("stop"))
    first = F.coalesce(*[F.when(b.rlike(UNICODE + p), F.lit(UNICODE + r"^((?s:.*?))(" + p + ")")) for p in patterns])
    part = lambda pattern, k: F.call_function("regexp_extract", b, pattern, F.lit(k))

    def found(m: Column) -> Column:
        start, stop = F.length(m["before"]), F.length(m["before"]) + F.length(m["hit"])
        return sentence_around(b, start, stop) if widen else F.struct(m["hit"].alias("quote"), start.alias("start"), stop.alias("stop"))

    in_body = lambda pattern: let(F.struct(part(pattern, 1).alias("before"), part(pattern, 2).alias("hit")), found)
    return let(first, lambda pattern: F.when(pattern.isNotNull(), in_body(pattern)).when(has(t, *patterns), whole_title))
