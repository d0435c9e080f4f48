"""JSON documents as typed values: what kind stands at a path, and guarded reads of it.

A text becomes a VARIANT once; number, text, boolean, object, array, null and
missing are told apart, where text paths would give the same string or nothing.
A document that is no JSON holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}


def document(text: Column) -> Column:
    return F.try_parse_json(text)


def kind(doc: Column, path: str) -> Column:
    """number, text, boolean, object, array or null at ``path`` of a VARIANT; ``missing`` without such a path."""
    at = F.try_variant_get(doc, path, "variant")
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.when(at.isNull(), "missing").otherwise(F.coalesce(F.try_element_at(table, F.regexp_extract(F.schema_of_variant(at), r"^(\w+)", 1)), F.lit("other")))


def number(doc: Column, path: str, least: float | None = None, most: float | None = None) -> Column:
    """The number at ``path``, null if something else stands there or it lies outside the bounds."""
    value = F.when(kind(doc, path) == "number", F.try_variant_get(doc, path, "double"))
    inside = F.lit(True)
    if least is not None:
        inside = inside & (value >= least)
    if most is not None:
        inside = inside & (value <= most)
    return F.when(inside, value)


def text(doc: Column, path: str) -> Column:
    """The text at ``path``, null if something else stands there."""
    return F.when(kind(doc, path) == "text", F.try_variant_get(doc, path, "string"))


def holds(doc: Column, path: str, value: str) -> Column:
    """Whether the array at ``path`` has the text ``value`` among its elements; false for anything but an array."""
    items = F.when(kind(doc, path) == "array", F.try_variant_get(doc, path, "array<variant>"))
    return F.coalesce(F.exists(items, lambda x: F.schema_of_variant(x).eqNullSafe("STRING") & F.try_variant_get(x, "$", "string").eqNullSafe(value)), F.lit(False))


def guarded(doc: Column, numbers: dict[str, tuple[float, float]], flags: tuple[str, ...] = (), choices: dict[str, tuple[str, ...]] | None = None) -> Column:
    """An allow-listed extract of settings as a map of texts: numbers in their range, flags, and texts of a choice; anything else is ``unknown``."""
    unknown, pairs = F.lit("unknown"), []
    for name, (least, most) in numbers.items():
        value = number(doc, f"$.{name}", least, most)
        pairs += [F.lit(name), F.when(value.isNotNull(), F.try_variant_get(doc, f"$.{name}", "string")).otherwise(unknown)]
    for name in flags:
        pairs += [F.lit(name), F.when(kind(doc, f"$.{name}") == "boolean", F.try_variant_get(doc, f"$.{name}", "string")).otherwise(unknown)]
    for name, allowed in (choices or {}).items():
        pairs += [F.lit(name), F.when(text(doc, f"$.{name}").isin(*allowed), text(doc, f"$.{name}")).otherwise(unknown)]
    return F.create_map(*pairs)
