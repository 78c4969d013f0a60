"""Asking a model once per distinct request, with a table of earlier replies.

The model is a callable of the user: ``make_model()`` is called once per task
and returns ``model(prompts, max_tokens, temperature) -> replies``.  No client
is included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import fixed
from spendloom.functions.prompts import PROMPTS, request_key
from spendloom.functions.replies import analysis_reply, category_reply, vendor_reply
from spendloom.operators.categories import apply_analysis, gate_category
from spendloom.operators.reply_log import ReplyLog
from spendloom.operators.vendors import unmatched_by_rules
from spendloom.session import write_shared

MakeModel = Callable[[], Callable[[list[str], int, float], list[str]]]
REPLY_SCHEMA = "kind string, key string, reply string, error string"


def _with_inputs(df: DataFrame) -> DataFrame:
    """Columns a request reads; those the table lacks are empty texts."""
    missing = {c: F.lit("") for c in ("description", "memo") if c not in df.columns}
    return df.withColumns(missing) if missing else df


def requests(df: DataFrame, kind: str) -> DataFrame:
    """Distinct requests of a table: ``kind, key, prompt``."""
    return (
        _with_inputs(df)
        .groupBy(request_key(kind).alias("key"))
        .agg(F.min(PROMPTS[kind]()).alias("prompt"))
        .select(F.lit(kind).alias("kind"), "key", "prompt")
    )


def request_keys(df: DataFrame, kind: str) -> DataFrame:
    """The rows with the key of their request, as a column ``key``."""
    return _with_inputs(df).withColumn("key", request_key(kind))


def newest(cache: DataFrame) -> DataFrame:
    """One entry per ``kind`` and ``key``: the newest with a reply (highest ``seq``)."""
    order = F.struct("seq", "reply") if "seq" in cache.columns else F.struct("reply")
    best = cache.filter(F.col("reply") != "").groupBy("kind", "key").agg(F.max(order).alias("_best"))
    values = [F.col(c) if c in ("kind", "key") else F.col(f"_best.{c}").alias(c) for c in cache.columns if c in ("kind", "key", "seq", "reply")]
    return best.select(*values)


def cache_hits(asked: DataFrame, cache: DataFrame | ReplyLog) -> DataFrame:
    """Requests with a stored reply, as ``kind, key, reply``.  Empty replies do not count."""
    if isinstance(cache, ReplyLog):
        return cache.hits(asked)
    stored = newest(cache).select("kind", "key", "reply")
    return asked.join(stored, ["kind", "key"]).select("kind", "key", "reply")


def cache_misses(asked: DataFrame, cache: DataFrame | ReplyLog) -> DataFrame:
    if isinstance(cache, ReplyLog):
        return cache.misses(asked)
    stored = cache.filter(F.col("reply") != "").select("kind", "key")
    return asked.join(stored, ["kind", "key"], "left_anti")


def trim_cache(cache: DataFrame, *, size: int = 1000, parts: int = 64) -> DataFrame:
    """Keep the ``size`` newest entries (highest ``seq``) of each kind.

    There are only a few kinds, so each is first cut down in ``parts`` pieces.
    """
    newest = F.desc("seq"), F.desc("key")
    piece = F.pmod(F.xxhash64("key"), F.lit(parts))
    in_piece = Window.partitionBy("kind", "_piece").orderBy(*newest)
    in_kind = Window.partitionBy("kind").orderBy(*newest)
    return (
        cache.withColumn("_piece", piece)
        .withColumn("_n", F.row_number().over(in_piece))
        .filter(F.col("_n") <= size)
        .withColumn("_n", F.row_number().over(in_kind))
        .filter(F.col("_n") <= size)
        .select(*cache.columns)
    )


def store_replies(cache: DataFrame | ReplyLog, replies: DataFrame, *, size: int | None = None) -> DataFrame:
    """The cache (``kind, key, reply, seq``) with the new replies as its newest entries.

    One entry per request is kept, so storing replies again changes nothing but
    their age.  Failed requests and analyses are not stored.  All entries stay
    unless a ``size`` to trim to is given.  A log gets the new replies appended
    and keeps its older ones.
    """
    if isinstance(cache, ReplyLog):
        cache.append(replies)
        kept = newest(cache.table())
        return kept if size is None else trim_cache(kept, size=size)
    last = F.coalesce(cache.agg(F.max("seq")).scalar(), F.lit(0))
    fresh = replies.filter(~F.col("cached") & F.col("reply").isNotNull())
    fresh = fresh.filter(F.col("kind") != "analysis").withColumn("seq", last + 1)
    kept = newest(cache.unionByName(fresh.select(*cache.columns)))
    return kept if size is None else trim_cache(kept, size=size)


def ask(asked: DataFrame, make_model: MakeModel, kind: str, *, batch: int = 64) -> DataFrame:
    """Replies to distinct requests, written once so that no retry asks again.

    A batch that fails is asked one by one; a request that fails alone has a
    null reply and its error.
    """
    max_tokens = fixed.REQUEST_MAX_TOKENS[kind]
    temperature = fixed.REQUEST_TEMPERATURE[kind]

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                model = model or make_model()
                yield part[["kind", "key"]].assign(**replies(model, list(part["prompt"])))

    def replies(model, prompts: list[str]) -> dict[str, list]:
        try:
            found = list(model(prompts, max_tokens, temperature))
            if len(found) == len(prompts):
                return {"reply": found, "error": [None] * len(found)}
            problem = "wrong number of replies"
        except Exception as e:  # a model may fail in any way
            problem = str(e) or type(e).__name__
        if len(prompts) == 1:
            return {"reply": [None], "error": [problem]}
        single = [replies(model, [p]) for p in prompts]
        return {k: [s[k][0] for s in single] for k in ("reply", "error")}

    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = asked.repartition(tasks, "key")
    return write_shared(spread.mapInPandas(call, REPLY_SCHEMA), f"replies-{kind}")


def replies_for(
    df: DataFrame, kind: str, make_model: MakeModel, cache: DataFrame | ReplyLog | None = None
) -> DataFrame:
    """``kind, key, reply, error, cached`` for every distinct request of ``df``."""
    asked = requests(df, kind)
    if cache is None or kind == "analysis":
        return ask(asked, make_model, kind).withColumn("cached", F.lit(False))
    hits = cache_hits(asked, cache).withColumn("error", F.lit(None).cast("string"))
    fresh = ask(cache_misses(asked, cache), make_model, kind)
    return hits.withColumn("cached", F.lit(True)).unionByName(
        fresh.withColumn("cached", F.lit(False))
    )


def _attach(df: DataFrame, replies: DataFrame, kind: str) -> DataFrame:
    keyed = _with_inputs(df).withColumn("_key", request_key(kind))
    answers = replies.select(F.col("key").alias("_key"), F.col("reply").alias("_reply"))
    return keyed.join(answers, "_key", "left")


def apply_vendor_replies(df: DataFrame, replies: DataFrame) -> DataFrame:
    attached = _attach(df, replies, "vendor")
    return attached.withColumn("merchant", vendor_reply(F.col("_reply"))).select(*df.columns)


def apply_category_replies(
    df: DataFrame, replies: DataFrame, *, threshold: float | Column = 0.7
) -> DataFrame:
    """The gate applied to model replies.  ``confidence`` is kept as a column."""
    attached = _attach(df, replies, "category").withColumn(
        "_answer", category_reply(F.col("_reply"))
    )
    answer = F.col("_answer")
    gated = gate_category(attached, answer["category"], answer["confidence"], threshold=threshold)
    columns = list(dict.fromkeys([*df.columns, "category", "confidence"]))
    return gated.withColumn("confidence", answer["confidence"]).select(*columns)


def apply_analysis_replies(df: DataFrame, replies: DataFrame) -> DataFrame:
    attached = _attach(df, replies, "analysis").withColumn(
        "_answer", analysis_reply(F.col("_reply"))
    )
    columns = list(dict.fromkeys([*df.columns, "business_impact", "risk_level"]))
    return apply_analysis(attached, F.col("_answer")).select(*columns)


def resolve_unmatched(
    df: DataFrame,
    rules: Callable[[Column], Column],
    make_model: MakeModel,
    cache: DataFrame | ReplyLog | None = None,
) -> DataFrame:
    """Keyword rules first; only rows they do not know are asked."""
    replies = replies_for(unmatched_by_rules(df), "vendor", make_model, cache)
    return apply_unmatched_replies(df, rules, replies)


def apply_unmatched_replies(
    df: DataFrame, rules: Callable[[Column], Column], replies: DataFrame
) -> DataFrame:
    by_rule = rules(F.coalesce("merchant", F.lit("None")))
    vendor = F.when(by_rule != fixed.UNKNOWN_VENDOR, by_rule).otherwise(
        vendor_reply(F.col("_reply"))
    )
    return _attach(df, replies, "vendor").withColumn("merchant", vendor).select(*df.columns)
