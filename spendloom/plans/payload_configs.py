"""Cleaning payloads that bring their own options, each as a request of its own."""

from __future__ import annotations

from dataclasses import Field, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.config import CleanConfig
from spendloom.functions import fixed
from spendloom.functions.variants import ITEM, let, only_item, text_of
from spendloom.operators.insights import insights
from spendloom.plans.cleaning import run
from spendloom.session import write_shared
from spendloom.sources import payloads as source

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity)\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"
OPTIONS = "_options"
ROWS = "_n_rows"


@dataclass(frozen=True)
class PayloadRun:
    """Cleaned rows, rejects, and the usage of each payload."""

    rows: DataFrame
    rejects: DataFrame
    usage: DataFrame
    cache: DataFrame | None = None


def own_options(body: Column, default: CleanConfig) -> tuple[Column, Column]:
    """The options of a body as a struct, and whether they are valid.

    The rules are those of :class:`CleanConfig`: numbers may be texts, a switch
    must be a boolean, and unknown keys are ignored.
    """
    found = let(only_item(body), lambda value: options_of(value, default))
    return found["options"], found["valid"]


def options_of(body: Column, default: CleanConfig) -> Column:
    """A struct of the options and ``valid``, from a body parsed by ``variants.only_item``.

    The options that are given are taken out at once, each as a variant, and
    the rest of the body is not copied.
    """

    def chosen(each: Column) -> Column:
        values = F.struct(*[each[f.name]["value"].alias(f.name) for f in known])
        return F.struct(values.alias("options"), reduce(Column.__and__, [each[f.name]["ok"] for f in known]).alias("valid"))

    def read(given: Column) -> Column:
        checked = F.struct(*[_option(given[f.name], f, default).alias(f.name) for f in known])
        # Null stands for no config; anything else but an object is not valid.
        return (
            F.when(given.isNotNull(), let(checked, chosen))
            .when(text_of(body, config).isNull(), F.struct(usual.alias("options"), F.lit(True).alias("valid")))
            .otherwise(F.struct(usual.alias("options"), F.lit(False).alias("valid")))
        )

    config = f"{ITEM}.config"
    known = [f for f in fields(CleanConfig) if f.name != "extra"]
    usual = F.struct(*[F.lit(getattr(default, f.name)).alias(f.name) for f in known])
    # A null here is an option that is not given; a given null is a variant.
    return let(F.try_variant_get(body, config, f"struct<{','.join(f'{f.name}:variant' for f in known)}>"), read)


def _option(given: Column, f: Field, default: CleanConfig) -> Column:
    """The value of an option and whether it is valid; a given null is not."""
    standard = F.lit(getattr(default, f.name))

    def read(raw: Column) -> Column:
        return let(F.schema_of_variant(raw), lambda kind: of_kind(raw, kind))

    def of_kind(raw: Column, kind: Column) -> Column:
        if f.type == "bool":
            return judged(F.try_variant_get(raw, "$", "boolean"), kind == "BOOLEAN")
        number = F.when(kind == "STRING", text_of(raw).try_cast("double")).otherwise(F.try_variant_get(raw, "$", "double"))
        return let(number, lambda n: of_number(n, raw, kind))

    def of_number(number: Column, raw: Column, kind: Column) -> Column:
        pattern = F.lit(_NUMBER if f.type == "float" else _WHOLE)
        ok = number.isNotNull() & ~F.isnan(number) & ((kind != "STRING") | F.regexp_like(F.lower(text_of(raw)), pattern))
        value = number if f.type == "float" else number.cast("int")
        if f.name == "duplicate_threshold":
            ok = ok & (number >= 0)
        if f.name == "chunk_size":
            ok = ok & (value >= 1)
        return judged(value, ok)

    def judged(value: Column, ok: Column) -> Column:
        return F.struct(F.coalesce(value, standard).alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))

    absent = F.struct(standard.alias("value"), F.lit(True).alias("ok"))
    return F.when(given.isNull(), absent).otherwise(let(given, read))


def clean_payloads(payloads: DataFrame, default: CleanConfig = CleanConfig(), **models_and_cache) -> PayloadRun:
    """Clean each payload alone; its ``config`` overrides ``default``.

    All payloads go through one run, with their options beside their rows, so
    the number of distinct configs does not matter.  Payloads with options that
    are not valid are rejected.  Each body is parsed once for its rows and its
    options, in as many tasks as a shuffle has; the parsed rows are written and every later step reads them.
    """
    # Few bytes are much work here, so the number of tasks is given.
    tasks = int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = payloads.select("payload_id", "body").repartition(tasks, "payload_id")
    read = source.read(spread, beside=lambda body: options_of(body, default))
    read = read.select("*", F.col("_beside.options").alias(OPTIONS), F.col("_beside.valid").alias("_valid"))
    read = write_shared(read.drop("_beside").withColumn(ROWS, F.size("_read.rows")), "payload-rows")
    rows = source.rows_of(read.filter("_valid"), OPTIONS, ROWS)
    bad = read.filter("NOT _valid AND _read.reason IS NULL").select(
        "payload_id", "request_id", F.lit(fixed.REJECT_CONFIG).alias("reason")
    )
    rejects = source.rejects_of(read).unionByName(bad)
    result = run(rows, default, order_by="position", scope=["payload_id"], own_options=OPTIONS, scope_rows=ROWS, **models_and_cache)
    return PayloadRun(result.rows, rejects, result.usage, result.cache)


def clean_payloads_by_config(payloads: DataFrame, default: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows and rejects."""
    result = clean_payloads(payloads, default)
    return result.rows, result.rejects


def payload_insights(rows: DataFrame, usage: DataFrame) -> DataFrame:
    """The insights of each payload, from its written rows and its usage."""
    return insights(rows, usage.drop("cleaner_version"), scope=["payload_id"], small_scopes=True)
