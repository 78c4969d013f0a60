"""JSON payloads of several shapes as transaction rows.

A payload table has ``payload_id`` and ``body``.  Accepted bodies, in the order
in which they are tried: a list of records; fields that are lists of one length
(single values are repeated); a list under ``data`` or ``transactions``; one
record.  All of it may lie under ``data``, beside a ``config``.

Everything is decided inside the payload's own row, so reading needs no
shuffle.  A payload is taken or rejected as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions import fixed
from spendloom.functions.variants import (
    ITEM,
    fields_of,
    let,
    only_item,
    records_of,
    text_of,
    texts_of_items,
)

KNOWN = ("merchant", "amount", "description", "memo", "category")
# Values of columns that no record of a payload has.
DEFAULTS = {"amount": "0.0", "description": ""}


def transactions(payloads: DataFrame) -> DataFrame:
    """Rows of the accepted payloads.

    ``position`` counts the rows of a payload.  ``_has_amount`` is false where a
    payload of columns brings no amounts at all.  Further fields are in
    ``extra``, as texts.
    """
    return rows_of(read(payloads))


def rejects(payloads: DataFrame) -> DataFrame:
    """The other payloads with the reason: ``payload_id, request_id, reason``."""
    return rejects_of(read(payloads))


def rows_of(found: DataFrame, *kept: str) -> DataFrame:
    """The rows of what :func:`read` gives; ``kept`` columns go with them."""
    # The outer form keeps Spark from copying the reading into a filter of its
    # own, which would read every payload twice.
    return (
        found.select("payload_id", "request_id", *kept, F.posexplode_outer("_read.rows").alias("position", "_row"))
        .filter(F.col("position").isNotNull())
        .select("payload_id", "request_id", F.col("position").cast("long"), *kept, "_row.*")
    )


def rejects_of(found: DataFrame) -> DataFrame:
    return (
        found.select("payload_id", "request_id", F.explode_outer(F.array("_read.reason")).alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def configs(payloads: DataFrame) -> DataFrame:
    """The ``config`` object that came with a payload, as JSON text."""
    found = payloads.select("payload_id", F.explode_outer(F.array(config_text())).alias("config"))
    return found.filter("config is not null")


def config_text() -> Column:
    """The ``config`` of a body, null without one."""
    return text_of(only_item(F.col("body")), f"{ITEM}.config")


def request_tag() -> Column:
    """The same body always has the same tag."""
    digest = F.md5(F.coalesce("body", F.lit("")))
    return F.concat(F.lit("req-"), F.substring(digest, 1, 8))


def read(payloads: DataFrame, *, beside: Callable[[Column], Column] | None = None) -> DataFrame:
    """``payload_id, request_id, _read``: the rows of a payload or the reason of its reject.

    ``beside`` makes a further column ``_beside`` of the parsed body (as
    ``variants.only_item`` gives it), so that one parsing serves both.
    """

    def of_body(body: Column) -> Column:
        found = F.coalesce(_split_envelope(body), _reject(fixed.REJECT_NOT_JSON)).alias("_read")
        return F.struct(found, *([beside(body).alias("_beside")] if beside else []))

    found = payloads.select(
        "payload_id", request_tag().alias("request_id"), let(only_item(F.col("body")), of_body).alias("_found")
    )
    return found.select("payload_id", "request_id", "_found.*")


_ROW = (
    "struct<" + ",".join(f"{c}:string" for c in KNOWN) + ",extra:map<string,string>,_has_amount:boolean>"
)


def _reject(reason: str) -> Column:
    return F.struct(
        F.lit(reason).alias("reason"), F.lit(None).cast(f"array<{_ROW}>").alias("rows")
    )


def _accept(rows: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("reason"), rows.cast(f"array<{_ROW}>").alias("rows"))


def _split_envelope(body: Column) -> Column:
    """Null for a body that is no JSON, else what was read."""

    def of_object(fields: Column) -> Column:
        rest = F.map_filter(fields, lambda k, _: k != "config")
        return let(F.coalesce(fields_of(body, f"{ITEM}.data"), rest), _read_object)

    def read_any(records: Column) -> Column:
        return (
            F.when(records.isNotNull(), _read_records(records))
            .when(fields_of(body, ITEM).isNotNull(), let(fields_of(body, ITEM), of_object))
            .when(body.isNotNull(), _reject(fixed.REJECT_TYPE))
        )

    # A list is read as records at once; variants in between would each be a copy.
    return let(F.coalesce(records_of(body, ITEM), records_of(body, f"{ITEM}.data")), read_any)


def _read_object(fields: Column) -> Column:
    return let(
        F.transform_values(fields, lambda _, v: texts_of_items(v)),
        lambda lists: _read_fields(fields, lists),
    )


def _read_fields(fields: Column, lists: Column) -> Column:
    """An object, with the texts of those of its fields that are lists."""
    sizes = F.array_distinct(
        F.transform(F.filter(F.map_values(lists), lambda v: v.isNotNull()), lambda v: F.size(v))
    )
    is_list = {name: lists[name].isNotNull() for name in ("merchant", "data", "transactions")}
    return (
        F.when(is_list["merchant"] & (F.size(sizes) <= 1), _read_columns(fields, lists))
        .when(is_list["data"], let(records_of(fields["data"]), _read_records))
        .when(is_list["transactions"], let(records_of(fields["transactions"]), _read_records))
        .when(
            F.map_contains_key(fields, "merchant") & ~is_list["merchant"],
            let(F.array(F.transform_values(fields, lambda _, v: text_of(v))), _read_records),
        )
        .otherwise(_reject(fixed.REJECT_SHAPE))
    )


def _read_columns(fields: Column, lists: Column) -> Column:
    """Columns to rows.  Columns that are not there stay null."""
    n_rows = F.size(lists["merchant"])
    columns = F.transform_values(
        fields, lambda k, v: F.coalesce(lists[k], F.array_repeat(text_of(v), n_rows))
    )

    def rows(table: Column) -> Column:
        others = F.array_except(F.map_keys(table), F.array(*map(F.lit, KNOWN)))
        # One row per merchant.
        return F.transform(
            table["merchant"],
            lambda _, i: F.struct(
                *[F.get(table[c], i).alias(c) for c in KNOWN],
                F.map_from_arrays(
                    others, F.transform(others, lambda k: F.get(table[k], i))
                ).alias("extra"),
                F.map_contains_key(table, "amount").alias("_has_amount"),
            ),
        )

    return _accept(let(columns, rows))


def _read_records(records: Column) -> Column:
    """Records to rows.  A key that only other records have reads as ''."""

    def value(record: Column, key: Column) -> Column:
        return F.coalesce(record[key], F.when(~F.map_contains_key(record, key), F.lit("")))

    def rows(names: Column) -> Column:
        others = F.array_except(names, F.array(*map(F.lit, KNOWN)))
        # Told once for a payload, not for each record.
        given = F.struct(others.alias("others"), *[F.array_contains(names, c).alias(c) for c in KNOWN])
        return let(given, of_given)

    def of_given(given: Column) -> Column:
        others = given["others"]
        no_others = F.size(others) == 0
        return F.transform(
            records,
            lambda r: F.struct(
                *[F.when(given[c], value(r, F.lit(c))).otherwise(F.lit(DEFAULTS.get(c))).alias(c) for c in KNOWN],
                F.when(no_others, F.create_map().cast("map<string,string>")).otherwise(
                    F.map_from_arrays(others, F.transform(others, lambda k: value(r, k)))
                ).alias("extra"),
                F.lit(True).alias("_has_amount"),
            ),
        )

    names = F.array_distinct(F.flatten(F.transform(records, F.map_keys)))
    no_merchant = F.exists(records, lambda r: ~F.map_contains_key(r, "merchant"))
    return (
        F.when(F.size(records) == 0, _reject(fixed.REJECT_EMPTY))
        .when(F.exists(records, lambda r: r.isNull()), _reject(fixed.REJECT_ITEM))
        .when(no_merchant, _reject(fixed.REJECT_MERCHANT))
        .otherwise(_accept(let(names, rows)))
    )
