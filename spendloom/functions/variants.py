"""JSON texts as variants, and small tools for expressions used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_json(text: Column) -> Column:
    """The variant of a JSON text, or null if it is not one JSON value."""
    return F.try_variant_get(only_item(text), ITEM, "variant")


#: Where :func:`only_item` has the value.
ITEM = "$[0]"


def only_item(text: Column) -> Column:
    """A list with the variant of a JSON text, or null if the text is not one JSON value.

    The value is read by paths below :data:`ITEM`, as taking it out copies it.

    Spark's parser stops after the first value, so the text is read as the item
    of a list or as a field.  Text behind an object or list is hidden from the
    list only if ``]`` follows the value, or gives a second item; it is hidden
    from the field only if ``}`` or a comma and a name follow.  A text without
    such a place is parsed once.  Others, and single values, are read both ways:
    whatever follows breaks one of them.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    is_object, is_list = text.rlike(r"^\s*\{"), text.rlike(r"^\s*\[")
    seen_in_list = (is_object & ~text.rlike(r"\}\s*\]")) | (is_list & ~text.rlike(r"\]\s*\]"))

    def alone(items: Column) -> Column:
        return F.when(F.try_variant_get(items, "$[1]", "variant").isNull(), items)

    return F.when(seen_in_list | as_field.isNotNull(), let(as_item, alone))


def fields_of(value: Column, path: str = "$") -> Column:
    """Fields of an object as a map of variants; null for anything else."""
    return F.try_variant_get(value, path, "map<string,variant>")


def items_of(value: Column) -> Column:
    """Items of a list as variants; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def text_of(value: Column, path: str = "$") -> Column:
    """A scalar as plain text, a list or object as JSON, JSON null as null."""
    return F.try_variant_get(value, path, "string")


def records_of(value: Column, path: str = "$") -> Column:
    """Items of a list as the texts of their fields, an item that is no object as null; null for anything else."""
    return F.try_variant_get(value, path, "array<map<string,string>>")


def texts_of_items(value: Column) -> Column:
    """Items of a list as texts; null for anything else."""
    return F.try_variant_get(value, "$", "array<string>")
