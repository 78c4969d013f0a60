"""The batch job; ``job.py`` beside the package submits it.

Reads a transaction table, or with --payloads a table of JSON payloads
(``payload_id, body``), and writes the cleaned rows and their insights below
OUTPUT.  Payloads bring their own options in ``config``; their insights and
usage are per payload, and rejected payloads go to OUTPUT/rejects.  A model of
the user is named as module:function (a ``make_model``); with --cache, stored
replies are used and the grown cache is written to OUTPUT/cache; with --cache-log
they are read from a log in a folder and the new ones are appended to it.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession

from spendloom.config import CleanConfig
from spendloom.operators.insights import insights
from spendloom.operators.order import add_txn_id
from spendloom.operators.reply_log import ReplyLog
from spendloom.plans import payload_configs
from spendloom.plans.cleaning import run
from spendloom.session import temporary_tables
from spendloom.sources import tables

CACHE_SCHEMA = "kind string, key string, reply string, seq long"


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spendloom", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--format", default="parquet", help="format of the input")
    parser.add_argument("--output-format", default="parquet")
    parser.add_argument("--config", default="{}", help="options as a JSON object")
    parser.add_argument("--payloads", action="store_true")
    for kind in ("vendor", "category", "analysis"):
        parser.add_argument(f"--{kind}-model", help="module:function that makes the model")
    parser.add_argument("--cache", help="a table of earlier replies (kind, key, reply, seq), or 'new'")
    parser.add_argument("--cache-log", help="the folder of a log of replies, made if it is missing")
    parser.add_argument("--order-by", action="append", default=[], help="columns that give rows without txn_id their order")
    options = parser.parse_args(arguments)
    config = CleanConfig.from_dict(json.loads(options.config))
    spark = SparkSession.builder.appName("spendloom").getOrCreate()
    with temporary_tables(spark):
        _work(spark, options, config)


def _named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _work(spark: SparkSession, options: argparse.Namespace, config: CleanConfig) -> None:
    def save(df, table):
        target = f"{options.output}/{table}"
        df.write.mode("overwrite").format(options.output_format).save(target)
        return spark.read.format(options.output_format).schema(df.schema).load(target)

    named = {k: getattr(options, f"{k}_model") for k in ("vendor", "category", "analysis")}
    asking = {"models": {k: _named(path) for k, path in named.items() if path}}
    if options.cache:
        empty = spark.createDataFrame([], CACHE_SCHEMA)
        asking["cache"] = empty if options.cache == "new" else spark.read.format(options.format).load(options.cache)
    if options.cache_log:
        asking["cache"] = ReplyLog(spark, options.cache_log)
    if options.payloads:
        source = spark.read.format(options.format).load(options.input)
        result = payload_configs.clean_payloads(source, config, **asking)
        save(result.rejects, "rejects")
        scope = ["payload_id"]
    else:
        rows = tables.read_transactions(spark, options.input, format=options.format)
        if "txn_id" not in rows.columns:
            rows = add_txn_id(rows, order_by=options.order_by)
        result = run(rows, config, **asking)
        scope = []
    written = save(result.rows, "rows")
    usage = save(result.usage, "usage")
    save(insights(written, usage.drop("cleaner_version"), scope=scope), "insights")
    if result.cache is not None and not options.cache_log:
        save(result.cache, "cache")


if __name__ == "__main__":
    main()
