"""Vendor names: keyword rules, rule tables, and a slow resolver as fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spendloom.functions import fixed
from spendloom.functions.rules import keyword_vendor


def standardise_vendors(
    df: DataFrame,
    resolve: Callable[[Column], Column] = keyword_vendor,
    *,
    keep_raw: bool = False,
) -> DataFrame:
    """Overwrite ``merchant`` with its standard name; a null merchant is unknown.

    ``keep_raw`` saves the old name as ``merchant_raw``, which an unknown
    vendor would otherwise lose.
    """
    if "merchant" not in df.columns:
        return df
    if keep_raw:
        df = df.withColumn("merchant_raw", F.col("merchant"))
    return df.withColumn("merchant", resolve(F.coalesce("merchant", F.lit("None"))))


def standardise_vendors_by_table(
    df: DataFrame,
    rules: DataFrame,
    *,
    shard_bytes: int = 16 << 20,
    names_per_task: int = 500_000,
) -> DataFrame:
    """The same with rules ``(keyword, vendor, priority)`` from a table of any size.

    The rule with the least priority wins, then the first keyword, then the
    first vendor.  Distinct merchants are read once by an automaton of the
    keywords, which costs their length and not the number of rules, and are then
    joined back.  Rules of at most ``shard_bytes`` go to all tasks; more are
    dealt into shards of about that size, which meet slices of the merchants in
    a shuffle, so no task and no driver holds the whole table.
    """
    rules = rules.filter(F.length("keyword") > 0).select(F.lower("keyword").alias("keyword"), "vendor", "priority")
    names = df.select("merchant").distinct().withColumn("_name", F.lower("merchant")).filter(F.length("_name") > 0)
    size = F.sum(F.octet_length("keyword") + F.coalesce(F.octet_length("vendor"), F.lit(0)) + 64)
    shards = -(-(rules.agg(size).first()[0] or 0) // shard_bytes)
    best = _by_one_shard(names, rules) if shards <= 1 else _by_shards(names, rules, shards, names_per_task)
    vendor = F.coalesce("_vendor", F.lit(fixed.UNKNOWN_VENDOR))
    return df.join(best, "merchant", "left").select(
        *[vendor.alias(c) if c == "merchant" else F.col(c) for c in df.columns]
    )


def _by_one_shard(names: DataFrame, rules: DataFrame) -> DataFrame:
    shared = names.sparkSession.sparkContext.broadcast(rules.toArrow().to_pylist())

    def match(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        best_rule = None
        for column in columns:
            best_rule = best_rule or _automaton(shared.value)
            found = [best_rule(name) for name in column.to_pylist()]
            yield pa.array([rule and rule["vendor"] for rule in found], pa.string())

    return names.select("merchant", F.arrow_udf(match, "string")("_name").alias("_vendor"))


def _by_shards(names: DataFrame, rules: DataFrame, shards: int, names_per_task: int) -> DataFrame:
    """Each slice of merchants meets each shard of rules; the best of all shards is kept."""
    slices = -(-names.count() // names_per_task) or 1
    rules = rules.groupBy("keyword").agg(F.min(F.struct("priority", "vendor")).alias("_least"))
    rules = rules.select("keyword", "_least.*", F.pmod(F.xxhash64("keyword"), F.lit(shards)).cast("int").alias("_shard"))
    rules = rules.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    names = names.withColumn("_slice", F.pmod(F.xxhash64("merchant"), F.lit(slices)).cast("int"))
    names = names.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    result = T.StructType([T.StructField("merchant", T.StringType()), *(rules.schema[c] for c in ("priority", "keyword", "vendor"))])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in result])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        best_rule = _automaton(right.select(["keyword", "vendor", "priority"]).to_pylist())
        found = ((m, best_rule(n)) for m, n in zip(left["merchant"].to_pylist(), left["_name"].to_pylist()))
        return pa.Table.from_pylist([{"merchant": m, **rule} for m, rule in found if rule], schema)

    keys = "_shard", "_slice"
    matched = names.groupBy(*keys).cogroup(rules.groupBy(*keys)).applyInArrow(match, result)
    return matched.groupBy("merchant").agg(F.min_by("vendor", F.struct("priority", "keyword")).alias("_vendor"))


def _automaton(rules: list[dict]) -> Callable[[str], dict | None]:
    """Reads a name once and tells the best rule whose keyword is inside."""
    from ahocorasick import Automaton

    def order(rule: dict) -> tuple:  # nulls first, as in Spark
        return tuple((rule[c] is not None, rule[c]) for c in ("priority", "keyword", "vendor"))

    keywords = Automaton()
    rules = sorted(rules, key=order)
    for rank, rule in enumerate(rules):
        if rule["keyword"] not in keywords:
            keywords.add_word(rule["keyword"], rank)
    keywords.make_automaton()

    def best(name: str) -> dict | None:
        rank = min((rank for _, rank in keywords.iter(name)), default=None)
        return None if rank is None else rules[rank]

    return best if rules else lambda name: None


def unmatched_by_rules(df: DataFrame) -> DataFrame:
    """Rows whose merchant no keyword rule knows."""
    known = keyword_vendor(F.coalesce("merchant", F.lit("None")))
    return df.filter(known == fixed.UNKNOWN_VENDOR)
