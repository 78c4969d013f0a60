"""Entry points: the flagship query, all queries, and their SQL counterparts."""

from __future__ import annotations

import pathlib
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import entry_sql as sql
from spendloom.config import CleanConfig
from spendloom.functions import fixed, rules
from spendloom.functions.prompts import PROMPTS, request_key
from spendloom.functions.replies import analysis_reply, category_reply
from spendloom.functions.similarity import similarity
from spendloom.functions.text import money
from spendloom.operators import (
    categories,
    clean,
    dedup,
    insight_buffers,
    insights,
    model_requests,
    order,
    outliers,
    quality,
    usage,
    vendors,
)
from spendloom.operators.reply_log import ReplyLog
from spendloom.plans import cleaning, payload_configs
from spendloom.session import shared_dir, write_shared
from spendloom.sources import payloads, tables
from spendloom.streaming import payload_stream

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from spendloom.llm import entry as llm_entry
except ImportError:
    llm_entry = None


def entry(spark: SparkSession) -> DataFrame:
    """The cleaned transactions of the smallest test tables."""
    return q_clean_transactions(spark, "/root/testdata/sf0.001")


# --- inputs ----------------------------------------------------------------


def _derive(spark: SparkSession, sf: str, text: str) -> DataFrame:
    for table in ("orders", "events"):
        text = text.replace(f"FROM {table}", f"FROM parquet.`{sf}/{table}.parquet`")
    return spark.sql(text)


def _transactions(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, sql.TRANSACTIONS)


def _tidy(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed transactions with parsed amounts."""
    return clean.parse_amount(clean.trim_texts(_transactions(spark, sf)))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Tidy transactions with standard vendors and categories."""
    return categories.categorise(vendors.standardise_vendors(_tidy(spark, sf)))


def _spellings(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, sql.SPELLINGS).select("txn_id", "merchant", "amount")


def _upper_model():
    """A stand-in for a model: answers in capitals, fails on one merchant."""

    def make():
        def model(prompts, max_tokens, temperature):
            names = [p.split("Merchant: ")[1].split("\n")[0] for p in prompts]
            if any("ZOOM" in n for n in names):
                raise RuntimeError("no answer")
            return [f" {n.upper()} " for n in names]

        return model

    return make


def _category_model():
    def make():
        def model(prompts, max_tokens, temperature):
            names = [p.split("Merchant: ")[1].split("\n")[0] for p in prompts]
            share = {True: "0.9", False: "0.6"}
            return [
                '{"category": "Banking & Finance", "confidence": %s}' % share["STRIPE" in n]
                for n in names
            ]

        return model

    return make


# --- sources and sinks -----------------------------------------------------


def q_ingest_payloads(spark, sf):
    rows = payloads.transactions(_derive(spark, sf, sql.PAYLOADS))
    return rows.select(
        "payload_id", "position", "merchant",
        money(F.col("amount"), rows.schema["amount"].dataType).alias("amount"),
        "description", "memo",
    )


def q_ingest_rejects(spark, sf):
    return payloads.rejects(_derive(spark, sf, sql.PAYLOADS)).select("payload_id", "request_id", "reason")


def q_ingest_columnar(spark, sf):
    rows = payloads.transactions(_derive(spark, sf, sql.COLUMN_PAYLOADS))
    return rows.select(
        "payload_id", "position", "merchant",
        money(F.col("amount"), rows.schema["amount"].dataType).alias("amount"),
        "description", "memo", F.col("extra")["note"].alias("note"),
    )


def q_ingest_records(spark, sf):
    rows = payloads.transactions(_derive(spark, sf, sql.RECORD_PAYLOADS))
    return rows.select(
        "payload_id", "position", "merchant", "amount", "description", "memo", "category",
        F.col("extra")["tag"].alias("tag"),
    )


def q_ingest_configs(spark, sf):
    return payloads.configs(_derive(spark, sf, sql.PAYLOADS))


def q_scan_transactions(spark, sf):
    return tables.canonical_columns(_transactions(spark, sf))


def q_sink_json_rows(spark, sf):
    """Whole records, written as JSON lines and read back."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    tables.as_json_rows(_transactions(spark, sf)).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "json")


def q_union_chunks(spark, sf):
    rows = _transactions(spark, sf)
    late, early = rows.filter("memo = 'O'"), rows.filter("memo <> 'O'").drop("category")
    return tables.stack([early, late])


def q_outlier_by_chunk(spark, sf):
    rows = order.add_chunk(_tidy(spark, sf).select("txn_id", "amount"), chunk_size=1000)
    return outliers.flag_outliers(rows, threshold=1.5, scope=["chunk_id"])


# --- cleaning --------------------------------------------------------------


def q_clean_text(spark, sf):
    rows = _transactions(spark, sf)
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    return clean.trim_texts(rows.withColumns({c: F.concat(F.lit("\t \n"), c, F.lit("  \r")) for c in texts}))


def q_drop_empty_rows(spark, sf):
    rows = _transactions(spark, sf)
    gone = F.col("txn_id") % 10 == 3
    return clean.drop_empty_rows(rows.withColumns({c: F.when(~gone, F.col(c)) for c in rows.columns if c != "txn_id"}))


def q_parse_amount(spark, sf):
    rows = _transactions(spark, sf).select("txn_id", F.col("amount").alias("raw"), "amount")
    return clean.parse_amount(rows)


def q_fill_blanks(spark, sf):
    return clean.fill_blanks(_transactions(spark, sf)).select("txn_id", "description", "category")


def q_validate_schema(spark, sf):
    return clean.complete_columns(_transactions(spark, sf).drop("merchant"))


# --- duplicates ------------------------------------------------------------


def q_dedup_exact(spark, sf):
    return dedup.drop_exact_duplicates(_tidy(spark, sf))


def q_dedup_near(spark, sf):
    return dedup.drop_near_duplicates(_spellings(spark, sf))


def q_near_dup_pairs(spark, sf):
    return dedup.near_duplicate_matches(_spellings(spark, sf))


def q_dedup_report(spark, sf):
    return dedup.duplicate_report(_spellings(spark, sf))


def q_similar_vendor_pairs(spark, sf):
    return dedup.similar_name_pairs(_spellings(spark, sf), "merchant").select(
        "first_name", "second_name", F.round("score", 6).alias("score")
    )


def q_similar_vendor_groups(spark, sf):
    return dedup.similar_name_groups(_spellings(spark, sf), "merchant")


def q_dedup_near_hot_cell(spark, sf):
    """No row has an amount, so all names are in one cell."""
    return dedup.drop_near_duplicates(_derive(spark, sf, sql.HOT_CELL).select("txn_id", "merchant", "amount"))


def q_dedup_near_chain(spark, sf):
    """Each row only matches its two neighbours in order."""
    return dedup.drop_near_duplicates(_derive(spark, sf, sql.CHAIN))


def q_text_similarity(spark, sf):
    rows = _derive(spark, sf, sql.SPELLINGS)
    score = similarity(F.lower("name"), F.lower("merchant"))
    return rows.select("txn_id", F.round(score, 6).alias("score"))


# --- vendors and categories ------------------------------------------------


def q_vendor_standardize(spark, sf):
    rows = vendors.standardise_vendors(_transactions(spark, sf), keep_raw=True)
    return rows.select("txn_id", "merchant", "merchant_raw")


def q_vendor_rules(spark, sf):
    merchant = F.coalesce("merchant", F.lit("None"))
    return _transactions(spark, sf).select(
        "txn_id", "merchant", rules.keyword_vendor(merchant).alias("vendor")
    )


def q_vendor_rules_table(spark, sf):
    table = spark.createDataFrame(
        [
            (keyword, vendor, priority)
            for priority, (keywords, vendor) in enumerate(fixed.VENDOR_RULES)
            for keyword in keywords
        ],
        "keyword string, vendor string, priority int",
    )
    return vendors.standardise_vendors_by_table(_transactions(spark, sf), table).select(
        "txn_id", "merchant"
    )


def q_vendor_unmatched(spark, sf):
    rows = _tidy(spark, sf)
    return model_requests.resolve_unmatched(rows, rules.keyword_vendor, _upper_model()).select(
        "txn_id", "merchant"
    )


def q_category_rules(spark, sf):
    merchant = F.coalesce("merchant", F.lit("None"))
    category, confidence = categories.keyword_suggestion(merchant)
    return _transactions(spark, sf).select(
        "txn_id", category.alias("category"), confidence.alias("confidence")
    )


def q_category_gate(spark, sf):
    rows = _tidy(spark, sf)
    confidence = F.when(F.col("amount") > 100000, 0.7).otherwise(0.69)
    return categories.gate_category(
        rows, rules.keyword_category(F.coalesce("merchant", F.lit("None"))), confidence
    ).select("txn_id", "category")


def q_category_off_taxonomy(spark, sf):
    rows = _transactions(spark, sf).withColumn(
        "category", F.when(F.col("memo") == "O", F.col("description")).otherwise(F.col("category"))
    )
    return categories.off_list_categories(rows).select("txn_id", "category")


def _prompt(kind):
    def query(spark, sf):
        return _tidy(spark, sf).select("txn_id", PROMPTS[kind]().alias("prompt"))

    return query


def q_response_key(spark, sf):
    return _tidy(spark, sf).select(
        "txn_id", request_key("vendor").alias("vendor_key"), request_key("category").alias("category_key")
    )


def q_resolve_distinct(spark, sf):
    rows = _tidy(spark, sf)
    replies = model_requests.replies_for(rows, "vendor", _upper_model())
    return model_requests.apply_vendor_replies(rows, replies).select("txn_id", "merchant")


def q_category_by_model(spark, sf):
    rows = _tidy(spark, sf)
    replies = model_requests.replies_for(rows, "category", _category_model())
    return model_requests.apply_category_replies(rows, replies).select(
        "txn_id", "category", "confidence"
    )


def q_parse_category_reply(spark, sf):
    answer = category_reply(F.col("reply"))
    return _derive(spark, sf, sql.REPLIES).select("reply_id", answer.alias("a")).select("reply_id", "a.*")


def q_parse_analysis_reply(spark, sf):
    answer = analysis_reply(F.col("reply"))
    return _derive(spark, sf, sql.REPLIES).select("reply_id", answer.alias("a")).select("reply_id", "a.*")


def q_enrich_description(spark, sf):
    return categories.enrich_description(clean.fill_blanks(_transactions(spark, sf))).select(
        "txn_id", "description", "business_impact", "risk_level"
    )


def _cache(spark, sf):
    """Replies of an earlier run, which saw the orders in status F."""
    rows = _tidy(spark, sf).filter("memo = 'F'")
    return (
        rows.groupBy(request_key("vendor").alias("key"))
        .agg(F.max("merchant").alias("reply"), F.min("txn_id").alias("seq"))
        .select(F.lit("vendor").alias("kind"), "key", F.coalesce("reply", F.lit("")).alias("reply"), "seq")
    )


def q_cache_hits(spark, sf):
    return model_requests.cache_hits(
        model_requests.requests(_tidy(spark, sf), "vendor"), _cache(spark, sf)
    )


def q_cache_misses(spark, sf):
    asked = model_requests.requests(_tidy(spark, sf), "vendor")
    return model_requests.cache_misses(asked, _cache(spark, sf)).select("kind", "key")


def q_cache_store(spark, sf):
    """The same replies stored twice, as by a job that is run again."""
    replies = model_requests.replies_for(_tidy(spark, sf), "vendor", _upper_model())
    empty = _cache(spark, sf).limit(0)
    return model_requests.store_replies(model_requests.store_replies(empty, replies), replies)


def _worn_cache(spark, sf):
    """The cache with an older reply for each of its keys."""
    cache = _cache(spark, sf)
    return cache.unionByName(cache.withColumns({"reply": F.lit("Old"), "seq": F.col("seq") - 1000000}))


def _reply_log(spark, sf):
    """A log of two runs: the replies of each of the orders in status F, the newer one after an older."""
    log = ReplyLog(spark, f"{shared_dir(spark)}/reply-log-{uuid.uuid4().hex}", buckets=8)
    replies = _worn_cache(spark, sf).withColumn("cached", F.lit(False))
    log.append(replies.filter("reply <> 'Old'"), seq=2)
    log.append(replies.filter("reply = 'Old'"), seq=1)
    return log


def q_cache_log_lookup(spark, sf):
    """Each request with the reply the log has for it, if any."""
    asked, log = model_requests.requests(_tidy(spark, sf), "vendor"), _reply_log(spark, sf)
    missing = log.misses(asked).select("kind", "key", F.lit(None).cast("string").alias("reply"))
    return log.hits(asked).unionByName(missing)


def q_cache_log_compact(spark, sf):
    log = _reply_log(spark, sf)
    log.compact()
    return log.table().select("kind", "key", "reply")


def q_resolve_with_cache(spark, sf):
    config = CleanConfig(ai_category_enabled=False, duplicate_threshold=1.0)
    rows = _tidy(spark, sf)
    result = cleaning.run(rows, config, models={"vendor": _upper_model()}, cache=_worn_cache(spark, sf))
    return result.rows.select("txn_id", "merchant")


def q_cache_grown(spark, sf):
    """The cache that a run with a model gives back."""
    config = CleanConfig(ai_category_enabled=False, duplicate_threshold=1.0)
    rows = _tidy(spark, sf)
    result = cleaning.run(rows, config, models={"vendor": _upper_model()}, cache=_worn_cache(spark, sf))
    return result.cache.select("kind", "key", "reply")


def q_usage_with_cache(spark, sf):
    config = CleanConfig(ai_category_enabled=False, duplicate_threshold=1.0)
    rows = _tidy(spark, sf)
    result = cleaning.run(rows, config, models={"vendor": _upper_model()}, cache=_worn_cache(spark, sf))
    return result.usage.withColumn("ai_cost", F.round("ai_cost", 2))


def q_vendor_unmatched_cached(spark, sf):
    found = model_requests.resolve_unmatched(
        _tidy(spark, sf), rules.keyword_vendor, _upper_model(), _worn_cache(spark, sf)
    )
    return found.select("txn_id", "merchant")


def q_cache_trim_fifo(spark, sf):
    entries = _tidy(spark, sf).select(
        F.when(F.col("memo") == "O", "vendor").otherwise("category").alias("kind"),
        F.md5(F.col("txn_id").cast("string")).alias("key"),
        F.col("memo").alias("reply"),
        F.col("txn_id").alias("seq"),
    )
    return model_requests.trim_cache(entries, size=1000)


# --- outliers, insights, whole run -----------------------------------------


def q_outlier_flag(spark, sf):
    rows = _tidy(spark, sf).select("txn_id", "amount")
    return outliers.flag_outliers(rows, threshold=1.5)


def q_insights_outliers(spark, sf):
    found = insights.outlier_summary(q_outlier_flag(spark, sf))
    return found.withColumn("outlier_percentage", F.round("outlier_percentage", 6))


def q_insights_amounts(spark, sf):
    found = insights.amount_summary(_tidy(spark, sf).select("amount"))
    return found.select(
        "total_rows",
        *[F.round(c, 2).alias(c) for c in found.columns if c != "total_rows"],
    )


def q_top_vendors(spark, sf):
    return insights.top_vendors(vendors.standardise_vendors(_tidy(spark, sf)))


def q_unique_vendors(spark, sf):
    return insights.unique_vendors(_tidy(spark, sf))


def q_insights_merged(spark, sf):
    """Buffers of batches, merged twice, against what a second reading of the table counts."""
    rows = _tidy(spark, sf).select("merchant", "amount", (F.col("txn_id") % 16).alias("batch"))
    parts = write_shared(insight_buffers.buffers(rows, ["batch"]), "buffers")
    halves = insight_buffers.merge(parts.withColumn("half", F.col("batch") % 2), ["half"])
    merged = write_shared(insight_buffers.summary(insight_buffers.merge(halves)), "summary")
    median, vendors_found = merged.select("median_amount", "unique_vendors").first()
    again = rows.agg(
        (F.count_if(F.col("amount") <= median) / F.count("amount") >= 0.495).alias("high"),
        (F.abs(F.lit(vendors_found) / F.count_distinct("merchant") - 1) <= 0.03).alias("vendors"),
        (F.count_if(F.col("amount") < median) / F.count("amount") <= 0.505).alias("under"),
    )
    near = again.select(F.struct((F.col("high") & F.col("under")).alias("m"), F.col("vendors").alias("v"))).scalar()
    return merged.select(
        "total_rows",
        *[F.round(c, 2).alias(c) for c in ("total_amount", "average_amount", "min_amount", "max_amount", "std_amount")],
        near["m"].alias("median_is_near"),
        near["v"].alias("vendors_are_near"),
    )


def q_category_breakdown(spark, sf):
    return insights.category_breakdown(_named(spark, sf))


def q_quality_score(spark, sf):
    return quality.quality_score(_transactions(spark, sf)).select(
        F.round("data_quality_score", 6).alias("data_quality_score")
    )


def q_column_completeness(spark, sf):
    return quality.column_completeness(_transactions(spark, sf)).select(
        "column_name", F.round("share", 6).alias("share")
    )


def q_clean_transactions(spark, sf):
    config = CleanConfig(outlier_z_threshold=1.5)
    return cleaning.clean_transactions(_transactions(spark, sf), config)


def q_clean_with_analysis(spark, sf):
    config = CleanConfig(ai_analysis_enabled=True, ai_vendor_enabled=False)
    return cleaning.clean_transactions(_transactions(spark, sf), config)


def q_clean_rows_only(spark, sf):
    """No vendor, category or analysis step: cleaning and duplicates alone."""
    return cleaning.clean_transactions(_transactions(spark, sf), CleanConfig(enable_ai=False))


def q_clean_by_chunk(spark, sf):
    config = CleanConfig(chunked=True, chunk_size=1000, outlier_z_threshold=1.5)
    return cleaning.clean_transactions(_transactions(spark, sf), config)


def q_insights_all(spark, sf):
    config = CleanConfig(outlier_z_threshold=1.5)
    _, found = cleaning.clean_and_summarise(_transactions(spark, sf), config)
    return found.select("section", "name", F.round("value", 2).alias("value"))


# --- usage -----------------------------------------------------------------


def _log(spark, sf):
    return _derive(spark, sf, sql.REQUEST_LOG)


def q_usage_run(spark, sf):
    result = cleaning.run(_transactions(spark, sf), CleanConfig(ai_analysis_enabled=True))
    return result.usage.withColumn("ai_cost", F.round("ai_cost", 2))


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def q_usage_client(spark, sf):
    return _rounded(usage.client_usage(_log(spark, sf)), "total_cost", "average_cost_per_request")


def q_usage_hit_rate(spark, sf):
    return _rounded(usage.hit_rate(_log(spark, sf)), "cache_hit_rate", "true_hit_rate")


def q_usage_rollup(spark, sf):
    return _rounded(
        usage.service_rollup(_log(spark, sf)),
        "total_cost", "average_cost_per_request", "requests_per_hour",
    )


def q_usage_by_chunk(spark, sf):
    return _rounded(usage.usage_by_run(_log(spark, sf)), "ai_cost")


# --- streaming -------------------------------------------------------------


def q_stream_clean_batches(spark, sf):
    """Payload files read one per micro-batch; the rows written by all of them."""
    source = _derive(spark, sf, sql.STREAM_PAYLOADS).select("payload_id", "body")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source.repartition(2, "payload_id").write.parquet(f"{root}/in")
    stream = (
        spark.readStream.schema(source.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{root}/in")
    )
    query = payload_stream.clean_stream(stream, f"{root}/out", f"{root}/progress")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out/rows").select(
        "payload_id", "position", "merchant", "amount", "description", "category", "is_outlier"
    )


_PAYLOAD_ROW = ("payload_id", "position", "merchant", "amount", "description", "memo", "category", "is_outlier")


def q_stream_insights(spark, sf):
    """The insights of each payload of a stream, from all micro-batches."""
    source = _derive(spark, sf, sql.STREAM_PAYLOADS).select("payload_id", "body")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source.repartition(2, "payload_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    payload_stream.clean_stream(stream, f"{root}/out", f"{root}/progress").awaitTermination()
    found = spark.read.parquet(f"{root}/out/insights").select("payload_id", "section", "name", "value")
    return found.withColumn("value", F.round("value", 4))


def q_stream_usage_totals(spark, sf):
    """The running totals after all micro-batches of a stream."""
    source = _derive(spark, sf, sql.STREAM_PAYLOADS).select("payload_id", "body")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source.repartitionByRange(3, "payload_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    payload_stream.clean_stream(stream, f"{root}/out", f"{root}/progress").awaitTermination()
    return payload_stream.running_totals(spark, f"{root}/out")


def q_clean_payloads(spark, sf):
    return payload_configs.clean_payloads(_derive(spark, sf, sql.PAYLOADS)).rows.select(*_PAYLOAD_ROW)


def _own_configs(spark, sf):
    return payload_configs.clean_payloads(_derive(spark, sf, sql.CONFIG_PAYLOADS).select("payload_id", "body"))


def q_clean_payloads_own_config(spark, sf):
    """Options differ from customer to customer."""
    return _own_configs(spark, sf).rows.select(*_PAYLOAD_ROW)


def q_config_rejects(spark, sf):
    return _own_configs(spark, sf).rejects.select("payload_id", "reason")


def q_usage_by_payload(spark, sf):
    return _rounded(_own_configs(spark, sf).usage, "ai_cost")


def q_insights_by_payload(spark, sf):
    result = _own_configs(spark, sf)
    found = payload_configs.payload_insights(write_shared(result.rows, "rows"), result.usage)
    return found.withColumn("value", F.round("value", 4))


def q_clean_payloads_by_chunk(spark, sf):
    return payload_configs.clean_payloads(_derive(spark, sf, sql.CHUNK_PAYLOADS)).rows.select(*_PAYLOAD_ROW)


def q_clean_payload_extras(spark, sf):
    found = payload_configs.clean_payloads(_derive(spark, sf, sql.EXTRA_PAYLOADS)).rows
    return found.select("payload_id", "position", "merchant", "amount", F.col("extra")["note"].alias("note"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        name.removeprefix("q_"): function
        for name, function in globals().items()
        if name.startswith("q_")
    }
    found |= {f"prompt_{kind}": _prompt(kind) for kind in PROMPTS}
    if llm_entry:
        found |= llm_entry.queries() | {"pipeline": corpus_pipeline.run}
    return found


# --- SQL -------------------------------------------------------------------

_NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
_PLAIN = "replace(replace(amount,'$',''),',','')"
_AMOUNT = (
    f"coalesce(CASE WHEN regexp_full_match({_PLAIN}, '{_NUMBER}') THEN try_cast({_PLAIN} AS DOUBLE) END, 0.0)"
)


def _vendor_sql(m: str) -> str:
    m = f"lower(coalesce({m},'None'))"
    return (
        f"CASE WHEN contains({m},'google') THEN 'Google Workspace' "
        f"WHEN contains({m},'meta') OR contains({m},'facebook') THEN 'Meta' "
        f"WHEN contains({m},'amazon') THEN 'Amazon' WHEN contains({m},'digitalocean') THEN 'DigitalOcean' "
        f"WHEN contains({m},'stripe') THEN 'Stripe' ELSE 'Unknown Vendor' END"
    )


def _category_sql(m: str) -> str:
    m = f"lower(coalesce({m},'None'))"
    return (
        f"CASE WHEN contains({m},'meta') OR contains({m},'facebook') THEN 'Marketing & Advertising' "
        f"WHEN contains({m},'notion') OR contains({m},'zoom') OR contains({m},'slack') THEN 'Software & Technology' "
        f"WHEN contains({m},'amazon') THEN 'Office Supplies & Equipment' ELSE 'Other' END"
    )


def _clean_sql(scope: str = "0") -> str:
    """Tables t (raw), tidy, and kept: the survivors among similar rows.

    The names of ``t`` are alike only if equal, so a row goes if an earlier one
    has its name and amount, or its name and an amount less than a cent away.
    """
    return f"""
WITH t AS ({sql.TRANSACTIONS}),
tidy AS (SELECT txn_id, trim(merchant) AS merchant, {_AMOUNT} AS amount, description, memo, category,
  {scope} AS scope FROM t),
firsts AS (SELECT scope, lower(coalesce(merchant,'None')) AS name, amount, min(txn_id) AS txn_id
  FROM tidy GROUP BY ALL),
kept AS (SELECT tidy.* FROM tidy WHERE txn_id IN (SELECT txn_id FROM firsts) AND txn_id NOT IN (
  SELECT b.txn_id FROM firsts a JOIN firsts b ON a.scope = b.scope AND a.name = b.name AND a.txn_id < b.txn_id
    AND a.amount <> b.amount AND abs(a.amount - b.amount) < 0.01))"""


def _finished_sql(scope: str = "0", z: str = "1.5") -> str:
    return (
        _clean_sql(scope)
        + f""",
stats AS (SELECT scope, avg(amount) AS m, stddev_pop(amount) AS s FROM kept GROUP BY scope),
vendored AS (SELECT kept.* REPLACE ({_vendor_sql('merchant')} AS merchant) FROM kept),
done AS (SELECT txn_id, merchant, amount, coalesce(description,'No description') AS description, memo,
  {_category_sql('merchant')} AS category,
  CASE WHEN s > 0 THEN abs((amount - m) / s) > {z} ELSE false END AS is_outlier
  FROM vendored JOIN stats USING (scope))"""
    )


_CHUNK = "CAST(floor((row_number() OVER (ORDER BY txn_id) - 1) / 1000) AS BIGINT)"
_TIDY = f"WITH t AS ({sql.TRANSACTIONS}), tidy AS (SELECT * REPLACE (trim(merchant) AS merchant, {_AMOUNT} AS amount) FROM t)"
_RAW = f"WITH t AS ({sql.TRANSACTIONS})"
_D = f"WITH d AS ({sql.SPELLINGS}), f AS (SELECT *, min(txn_id) OVER (PARTITION BY family, amount) AS kept_id FROM d)"
_LOG = f"WITH log AS (SELECT *, CASE WHEN kind = 'analysis' THEN 2 ELSE 1 END AS cents FROM ({sql.REQUEST_LOG}) l)"
_DOLLARS = "'$' || format('{:,.2f}', amount)"
_VKEY = "md5('vendor|' || coalesce(merchant,'') || '|' || coalesce(description,'') || '|' || coalesce(memo,''))"
_CKEY = (
    "md5('category|' || coalesce(merchant,'') || '|' || coalesce(description,'') || '|' || "
    "CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR) || '|' || coalesce(memo,''))"
)
_CACHE = f"""{_TIDY}, cache AS (SELECT 'vendor' AS kind, {_VKEY} AS key, coalesce(max(merchant),'') AS reply
  FROM tidy WHERE memo = 'F' GROUP BY ALL),
asked AS (SELECT DISTINCT 'vendor' AS kind, {_VKEY} AS key FROM tidy)"""


def _prompt_sql(before: str, amount: bool) -> str:
    money_line = f" || chr(10) || 'Amount: ' || {_DOLLARS}" if amount else ""
    return (
        f"{_TIDY} SELECT txn_id, '{before}Merchant: ' || coalesce(merchant,'') || chr(10) || 'Description: ' || "
        f"coalesce(description,''){money_line} || chr(10) || 'Memo: ' || coalesce(memo,'') AS prompt FROM tidy"
    )


#: done: the rows of payloads with options of their own; used: their requests.
_OWN = f"""WITH p AS (SELECT *, cust % 5 <> 0 AS ai, cust % 7 <> 0 AS gate FROM ({sql.CONFIG_PAYLOADS}) c WHERE cust % 11 <> 0),
done AS (SELECT payload_id, CAST(i AS BIGINT) AS position, ai, gate,
 CASE WHEN ai THEN CASE WHEN i < 2 THEN 'Amazon' ELSE 'Unknown Vendor' END WHEN i = 0 THEN name WHEN i = 1 THEN name || '.' ELSE slack END AS merchant,
 CASE WHEN i < 2 THEN c / 100 ELSE (c + 10000) / 100 END AS amount,
 CASE WHEN ai AND gate AND i < 2 THEN 'Office Supplies & Equipment' ELSE 'Other' END AS category, cust % 3 = 0 AS is_outlier
 FROM p, (VALUES (0),(1),(2)) v(i) WHERE i <> 1 OR cust % 2 = 1),
used AS (SELECT payload_id, CASE WHEN any_value(ai) THEN count(*) * CASE WHEN any_value(gate) THEN 2 ELSE 1 END ELSE 0 END AS requests
 FROM done GROUP BY payload_id)"""


def _by_payload_sql(counters: str) -> str:
    return f""", v AS (SELECT payload_id, 'summary' AS section, unnest(['total_rows','data_quality_score','total_amount','average_amount',
  'median_amount','min_amount','max_amount','std_amount','unique_vendors','outlier_count','outlier_percentage','outliers_flagged']) AS name,
 unnest([count(*), 1.0, sum(amount), avg(amount), median(amount), min(amount), max(amount), stddev_samp(amount),
  count(DISTINCT merchant), count(*) FILTER (WHERE is_outlier), count(*) FILTER (WHERE is_outlier) / count(*) * 100,
  count(*) FILTER (WHERE is_outlier)]::DOUBLE[]) AS value FROM done GROUP BY payload_id
UNION ALL SELECT payload_id, 'top_vendors', merchant, CAST(count(*) AS DOUBLE) FROM done GROUP BY ALL
UNION ALL SELECT payload_id, 'category_breakdown', category, CAST(count(*) AS DOUBLE) FROM done GROUP BY ALL
{counters})
SELECT payload_id, section, name, round(value, 4) AS value FROM v WHERE value IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    found = _own_sql()
    if llm_entry:
        found |= llm_entry.oracle_sql()
        found |= {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return found


def _own_sql() -> dict[str, str]:
    shop, order_id = "'Shop ' || CAST(o_custkey AS VARCHAR)", "CAST(o_orderkey AS VARCHAR)"
    price = "round(o_totalprice*100)/100"
    shape = "o_orderkey % 14"
    reply = "o_orderkey % 10"
    reasons = {
        6: fixed.REJECT_SHAPE, 7: fixed.REJECT_EMPTY, 8: fixed.REJECT_MERCHANT.replace("'", "''"),
        9: fixed.REJECT_ITEM, 10: fixed.REJECT_SHAPE, 11: fixed.REJECT_TYPE, 13: fixed.REJECT_NOT_JSON,
    }
    reason = " ".join(f"WHEN {k} THEN '{v}'" for k, v in reasons.items())
    confidence = f"""CASE {reply} WHEN 0 THEN (10 + o_custkey % 90) / 100.0 WHEN 1 THEN 0.9 WHEN 3 THEN 0.5
      WHEN 8 THEN 0.75 ELSE 0 END"""
    category = f"""CASE {reply} WHEN 0 THEN 'Software & Technology' WHEN 1 THEN {shop} WHEN 2 THEN {shop}
      ELSE 'Other' END"""
    category_list = "; ".join(fixed.CATEGORIES)
    return {
        "ingest_payloads": f"""
SELECT o_orderkey AS payload_id, CAST(0 AS BIGINT) AS position, {shop} AS merchant,
 CASE {shape} WHEN 2 THEN 0.0 WHEN 5 THEN 1234.5 WHEN 12 THEN 1.0 ELSE {price} END AS amount,
 CASE WHEN {shape} IN (0,2,3,4) THEN '' END AS description,
 CASE WHEN {shape} IN (4,12) THEN o_orderstatus END AS memo
FROM orders WHERE {shape} IN (0,1,2,3,4,5,12)
UNION ALL SELECT o_orderkey, 1, 'Corner', CASE {shape} WHEN 0 THEN 0.0 WHEN 1 THEN 25.0 ELSE 2.0 END,
 CASE WHEN {shape} = 0 THEN '' END, CASE WHEN {shape} = 12 THEN o_orderstatus END
FROM orders WHERE {shape} IN (0,1,12)""",
        "ingest_rejects": f"""
SELECT payload_id, 'req-' || substr(md5(body), 1, 8) AS request_id,
 CASE payload_id % 14 {reason} END AS reason FROM ({sql.PAYLOADS}) p
WHERE payload_id % 14 IN ({",".join(map(str, reasons))})""",
        "ingest_configs": f"""
SELECT o_orderkey AS payload_id, '{{"enable_ai":false}}' AS config FROM orders WHERE {shape} = 5""",
        "ingest_columnar": f"""
SELECT o_orderkey AS payload_id, CAST(i AS BIGINT) AS position,
 CASE i WHEN 0 THEN {shop} WHEN 1 THEN 'B' END AS merchant,
 CASE i WHEN 0 THEN {price} WHEN 1 THEN 0.0 ELSE 5.0 END AS amount, CAST(NULL AS VARCHAR) AS description,
 o_orderstatus AS memo, CASE i WHEN 0 THEN 'x' WHEN 1 THEN {order_id} ELSE 'true' END AS note
FROM orders, (VALUES (0),(1),(2)) v(i)""",
        "ingest_records": f"""
SELECT o_orderkey AS payload_id, CAST(i AS BIGINT) AS position,
 CASE i WHEN 0 THEN {shop} WHEN 1 THEN 'B' END AS merchant, '0.0' AS amount, '' AS description,
 CASE WHEN i > 0 THEN '' END AS memo, CASE WHEN i = 2 THEN 'Z' ELSE '' END AS category,
 CASE WHEN i = 1 THEN o_orderstatus ELSE '' END AS tag
FROM orders, (VALUES (0),(1),(2)) v(i)""",
        "scan_transactions": sql.TRANSACTIONS,
        "sink_json_rows": f"""{_RAW} SELECT '{{"txn_id":' || txn_id || {" || ".join(
            f"""',"{c}":' || coalesce('"' || {c} || '"', 'null')""" for c in ("merchant", "amount", "description", "memo", "category")
        )} || '}}' AS json FROM t""",
        "union_chunks": f"""{_RAW} SELECT * REPLACE (CASE WHEN memo = 'O' THEN category END AS category) FROM t""",
        "outlier_by_chunk": f"""{_TIDY}, c AS (SELECT txn_id, amount, {_CHUNK} AS chunk_id FROM tidy),
s AS (SELECT chunk_id, avg(amount) AS m, stddev_pop(amount) AS s FROM c GROUP BY chunk_id)
SELECT txn_id, amount, chunk_id, CASE WHEN s > 0 THEN abs((amount - m) / s) > 1.5 ELSE false END AS is_outlier
FROM c JOIN s USING (chunk_id)""",
        "clean_text": f"{_RAW} SELECT * REPLACE (trim(merchant) AS merchant) FROM t",
        "drop_empty_rows": f"{_RAW} SELECT * FROM t WHERE txn_id % 10 <> 3",
        "parse_amount": f"{_RAW} SELECT txn_id, amount AS raw, {_AMOUNT} AS amount FROM t",
        "fill_blanks": f"""{_RAW} SELECT txn_id, coalesce(description,'No description') AS description,
 coalesce(category,'Other') AS category FROM t""",
        "validate_schema": f"{_RAW} SELECT * REPLACE ('' AS merchant, {_AMOUNT} AS amount) FROM t",
        "dedup_near_hot_cell": f"""WITH d AS ({sql.HOT_CELL}), m AS (SELECT min(txn_id) AS txn_id FROM d GROUP BY family)
SELECT txn_id, merchant, amount FROM d JOIN m USING (txn_id)""",
        "dedup_near_chain": f"WITH d AS ({sql.CHAIN}) SELECT * FROM d WHERE txn_id % 2 = 0",
        "cache_store": f"""{_TIDY} SELECT DISTINCT 'vendor' AS kind, {_VKEY} AS key,
 ' ' || upper(coalesce(merchant,'')) || ' ' AS reply, 2 AS seq FROM tidy WHERE NOT contains(coalesce(merchant,''), 'ZOOM')""",
        "resolve_with_cache": f"""{_TIDY} SELECT min(txn_id) AS txn_id, CASE WHEN memo = 'F' THEN coalesce(merchant, 'Old')
 WHEN contains(merchant, 'ZOOM') THEN 'Unknown Vendor' ELSE upper(coalesce(merchant,'')) END AS merchant
FROM tidy GROUP BY tidy.merchant, amount, description, memo, category""",
        "vendor_unmatched_cached": f"""{_TIDY} SELECT txn_id, CASE WHEN {_vendor_sql('merchant')} <> 'Unknown Vendor'
 THEN {_vendor_sql('merchant')} WHEN memo = 'F' THEN coalesce(merchant, 'Old') WHEN contains(merchant, 'ZOOM') THEN 'Unknown Vendor'
 ELSE upper(coalesce(merchant,'')) END AS merchant FROM tidy""",
        "cache_grown": f"""{_TIDY} SELECT DISTINCT 'vendor' AS kind, {_VKEY} AS key,
 CASE WHEN memo = 'F' THEN coalesce(merchant, 'Old') ELSE ' ' || upper(coalesce(merchant,'')) || ' ' END AS reply
FROM tidy WHERE memo = 'F' OR NOT contains(coalesce(merchant,''), 'ZOOM')""",
        "usage_with_cache": f"""{_TIDY}, k AS (SELECT {_VKEY} AS key, memo = 'F' AS stored, contains(coalesce(merchant,''), 'ZOOM') AS fails
 FROM tidy GROUP BY merchant, amount, description, memo, category)
SELECT 'v4.2' AS cleaner_version, (SELECT count(*) FROM tidy) AS rows_processed, count(*) AS ai_requests, round(count(*) / 100, 2) AS ai_cost,
 count(*) FILTER (WHERE stored OR NOT fails) - count(DISTINCT key) FILTER (WHERE NOT stored AND NOT fails) AS cache_hits FROM k""",
        "dedup_exact": f"""{_TIDY} SELECT min(txn_id) AS txn_id, merchant, amount, description, memo, category
FROM tidy GROUP BY merchant, amount, description, memo, category""",
        "dedup_near": f"{_D} SELECT txn_id, merchant, amount FROM f WHERE txn_id = kept_id",
        "near_dup_pairs": f"{_D} SELECT txn_id, kept_id FROM f WHERE txn_id <> kept_id",
        "dedup_report": f"""{_D}, n AS (SELECT count(*) AS a, (SELECT count(*) FROM (SELECT DISTINCT merchant, amount FROM d)) AS b,
 count(*) FILTER (WHERE txn_id = kept_id) AS k FROM f)
SELECT a AS rows_in, a - b AS exact_removed, b - k AS near_removed, k AS rows_out FROM n""",
        "similar_vendor_pairs": f"""{_D}, v AS (SELECT DISTINCT lower(merchant) AS m, lower(name) AS n FROM d)
SELECT a.m AS first_name, b.m AS second_name,
 round(2.0 * length(a.n) / (length(a.m) + length(b.m)), 6) AS score
FROM v a JOIN v b ON a.n = b.n AND a.m < b.m""",
        "similar_vendor_groups": f"""{_D}, v AS (SELECT lower(merchant) AS m, lower(name) AS n, min(txn_id) AS id FROM d GROUP BY ALL)
SELECT m AS name, first_value(m) OVER (PARTITION BY n ORDER BY id) AS representative FROM v""",
        "text_similarity": f"""{_D} SELECT txn_id,
 round(CAST(2 * length(name) AS DOUBLE) / (length(name) + length(merchant)), 6) AS score FROM d""",
        "vendor_standardize": f"""{_RAW} SELECT txn_id, {_vendor_sql('merchant')} AS merchant,
 merchant AS merchant_raw FROM t""",
        "vendor_rules": f"{_RAW} SELECT txn_id, merchant, {_vendor_sql('merchant')} AS vendor FROM t",
        "vendor_rules_table": f"{_RAW} SELECT txn_id, {_vendor_sql('merchant')} AS merchant FROM t",
        "vendor_unmatched": f"""{_TIDY} SELECT txn_id, CASE WHEN {_vendor_sql('merchant')} <> 'Unknown Vendor'
 THEN {_vendor_sql('merchant')} WHEN contains(merchant, 'ZOOM') THEN 'Unknown Vendor'
 ELSE upper(coalesce(merchant,'')) END AS merchant FROM tidy""",
        "category_rules": f"""{_RAW} SELECT txn_id, {_category_sql('merchant')} AS category,
 CAST(0.85 AS DOUBLE) AS confidence FROM t""",
        "category_gate": f"""{_TIDY} SELECT txn_id, CASE WHEN amount > 100000 THEN {_category_sql('merchant')}
 ELSE category END AS category FROM tidy""",
        "category_off_taxonomy": f"""{_RAW} SELECT txn_id, description AS category FROM t
WHERE memo = 'O' AND description IS NOT NULL""",
        "prompt_vendor": _prompt_sql(
            "Name the company behind this purchase. Answer with its usual name only.' || chr(10) || '", False
        ),
        "prompt_category": _prompt_sql(
            f"Choose the spend category of this purchase from: {category_list}.' || chr(10) || '"
            'Answer as {"category": text, "confidence": number from 0 to 1}.\' || chr(10) || \'', True
        ),
        "prompt_analysis": _prompt_sql(
            "Assess this purchase. Answer as an object with the texts vendor, category, business_impact, "
            "risk_level (High, Medium or Low) and recommendation, and the number confidence from 0 to 1.'"
            " || chr(10) || '", True
        ),
        "response_key": f"{_TIDY} SELECT txn_id, {_VKEY} AS vendor_key, {_CKEY} AS category_key FROM tidy",
        "resolve_distinct": f"""{_TIDY} SELECT txn_id, CASE WHEN contains(merchant, 'ZOOM') THEN 'Unknown Vendor'
 ELSE upper(coalesce(merchant,'')) END AS merchant FROM tidy""",
        "category_by_model": f"""{_TIDY} SELECT txn_id, CASE WHEN contains(merchant, 'STRIPE') THEN 'Banking & Finance'
 ELSE category END AS category, CAST(CASE WHEN contains(merchant, 'STRIPE') THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence
FROM tidy""",
        "parse_category_reply": f"""SELECT o_orderkey AS reply_id, {category} AS category,
 CAST({confidence} AS DOUBLE) AS confidence FROM orders""",
        "parse_analysis_reply": f"""SELECT o_orderkey AS reply_id, {category} AS category,
 CAST({confidence} AS DOUBLE) AS confidence,
 CASE WHEN {reply} = 8 THEN {shop} ELSE 'Unknown Vendor' END AS vendor,
 CASE WHEN {reply} = 8 THEN 'High' ELSE 'Standard expense' END AS business_impact,
 CASE WHEN {reply} = 8 THEN 'Medium' ELSE 'Low' END AS risk_level,
 CASE WHEN {reply} = 8 THEN 'r' ELSE '' END AS recommendation FROM orders""",
        "enrich_description": f"""{_RAW} SELECT txn_id,
 coalesce(description,'No description') || ' | Standard operational expense' AS description,
 'Standard operational expense' AS business_impact, 'Low' AS risk_level FROM t""",
        "cache_hits": f"{_CACHE} SELECT kind, key, reply FROM cache JOIN asked USING (kind, key) WHERE reply <> ''",
        "cache_misses": f"""{_CACHE} SELECT kind, key FROM asked
WHERE key NOT IN (SELECT key FROM cache WHERE reply <> '')""",
        "cache_log_lookup": f"""{_CACHE} SELECT kind, key, CASE WHEN reply = '' THEN 'Old' ELSE reply END AS reply
FROM asked LEFT JOIN cache USING (kind, key)""",
        "cache_log_compact": f"{_CACHE} SELECT kind, key, CASE WHEN reply = '' THEN 'Old' ELSE reply END AS reply FROM cache",
        "cache_trim_fifo": f"""{_RAW}, e AS (SELECT CASE WHEN memo = 'O' THEN 'vendor' ELSE 'category' END AS kind,
 md5(CAST(txn_id AS VARCHAR)) AS key, memo AS reply, txn_id AS seq FROM t)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seq DESC) <= 1000""",
        "outlier_flag": f"""{_TIDY}, s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM tidy)
SELECT txn_id, amount, CASE WHEN s > 0 THEN abs((amount - m) / s) > 1.5 ELSE false END AS is_outlier FROM tidy, s""",
        "insights_outliers": f"""{_TIDY}, s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM tidy)
SELECT count(*) FILTER (WHERE abs((amount - m) / s) > 1.5) AS outlier_count,
 round(count(*) FILTER (WHERE abs((amount - m) / s) > 1.5) / count(*) * 100, 6) AS outlier_percentage FROM tidy, s""",
        "insights_amounts": f"""{_TIDY} SELECT count(*) AS total_rows, round(sum(amount),2) AS total_amount,
 round(avg(amount),2) AS average_amount, round(median(amount),2) AS median_amount, round(min(amount),2) AS min_amount,
 round(max(amount),2) AS max_amount, round(stddev_samp(amount),2) AS std_amount FROM tidy""",
        "top_vendors": f"""{_RAW} SELECT {_vendor_sql('merchant')} AS merchant, count(*) AS n_rows FROM t
GROUP BY 1 ORDER BY n_rows DESC, merchant LIMIT 10""",
        "insights_merged": f"""{_TIDY} SELECT count(*) AS total_rows, round(sum(amount),2) AS total_amount,
 round(avg(amount),2) AS average_amount, round(min(amount),2) AS min_amount, round(max(amount),2) AS max_amount,
 round(stddev_samp(amount),2) AS std_amount, true AS median_is_near, true AS vendors_are_near FROM tidy""",
        "unique_vendors": f"{_TIDY} SELECT count(DISTINCT merchant) AS unique_vendors FROM tidy",
        "category_breakdown": f"""{_RAW}, v AS (SELECT {_vendor_sql('merchant')} AS merchant FROM t)
SELECT {_category_sql('merchant')} AS category, count(*) AS n_rows FROM v GROUP BY 1""",
        "quality_score": f"""{_RAW} SELECT round((count(merchant) / count(*) + count(amount) / count(*) +
 count(category) / count(*)) / 3, 6) AS data_quality_score FROM t""",
        "column_completeness": f"""{_RAW} SELECT 'merchant' AS column_name, round(count(merchant) / count(*), 6) AS share FROM t
UNION ALL SELECT 'amount', round(count(amount) / count(*), 6) FROM t
UNION ALL SELECT 'category', round(count(category) / count(*), 6) FROM t""",
        "clean_transactions": _finished_sql() + " SELECT * FROM done",
        "clean_by_chunk": _finished_sql(_CHUNK) + " SELECT * FROM done",
        "clean_with_analysis": _clean_sql() + f""", s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM kept)
SELECT txn_id, merchant, amount, coalesce(description,'No description') || ' | Standard operational expense' AS description,
 memo, {_category_sql('merchant')} AS category, abs((amount - m) / s) > 3 AS is_outlier,
 'Standard operational expense' AS business_impact, 'Low' AS risk_level FROM kept, s""",
        "clean_rows_only": _clean_sql() + """, s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM kept)
SELECT txn_id, merchant, amount, coalesce(description,'No description') AS description, memo,
 coalesce(category,'Other') AS category, abs((amount - m) / s) > 3 AS is_outlier FROM kept, s""",
        "insights_all": _finished_sql() + """, v AS (
SELECT 'summary' AS section, unnest(['total_rows','data_quality_score','total_amount','average_amount','median_amount',
  'min_amount','max_amount','std_amount','unique_vendors','outlier_count','outlier_percentage','ai_requests','ai_cost','cache_hits',
  'rows_processed','outliers_flagged']) AS name,
 unnest([count(*), 1.0, sum(amount), avg(amount), median(amount), min(amount), max(amount), stddev_samp(amount),
  count(DISTINCT merchant), count(*) FILTER (WHERE is_outlier), count(*) FILTER (WHERE is_outlier) / count(*) * 100,
  2 * count(*), 0.02 * count(*), 0.0, (SELECT count(*) FROM t), count(*) FILTER (WHERE is_outlier)]::DOUBLE[]) AS value FROM done
UNION ALL (SELECT 'top_vendors', merchant, CAST(count(*) AS DOUBLE) AS n FROM done GROUP BY merchant ORDER BY n DESC, merchant LIMIT 10)
UNION ALL SELECT 'category_breakdown', category, CAST(count(*) AS DOUBLE) FROM done GROUP BY category)
SELECT section, name, round(value, 2) AS value FROM v""",
        "usage_run": _clean_sql() + """ SELECT 'v4.2' AS cleaner_version, (SELECT count(*) FROM t) AS rows_processed,
 3 * count(*) AS ai_requests, round(4 * count(*) / 100, 2) AS ai_cost, CAST(0 AS BIGINT) AS cache_hits FROM kept""",
        "usage_client": f"""{_LOG} SELECT count(*) AS request_count, round(sum(cents) / 100, 6) AS total_cost,
 round(sum(cents) / 100 / greatest(count(*), 1), 6) AS average_cost_per_request FROM log WHERE NOT cached""",
        "usage_hit_rate": f"""{_LOG} SELECT round(least(0.3, count(DISTINCT CASE WHEN kind <> 'analysis' THEN key END) /
 greatest(count(*) FILTER (WHERE NOT cached), 1)), 6) AS cache_hit_rate,
 round(count(*) FILTER (WHERE cached) / count(*), 6) AS true_hit_rate FROM log""",
        "usage_rollup": f"""{_LOG} SELECT count(DISTINCT run_id) AS total_requests, count(*) AS total_ai_calls,
 round(sum(cents) / 100, 6) AS total_cost, round(sum(cents) / 100 / count(DISTINCT run_id), 6) AS average_cost_per_request,
 round(count(DISTINCT run_id) / greatest(epoch_us(max(ts)) / 3600000000 - epoch_us(min(ts)) / 3600000000, 1), 6) AS requests_per_hour
FROM log""",
        "usage_by_chunk": f"""{_LOG} SELECT run_id, count(*) AS ai_requests, round(sum(cents) / 100, 6) AS ai_cost,
 count(*) FILTER (WHERE cached) AS cache_hits FROM log GROUP BY run_id""",
        "clean_payloads": f"""
SELECT o_orderkey AS payload_id, CAST(0 AS BIGINT) AS position,
 CASE WHEN {shape} = 5 THEN {shop} ELSE 'Unknown Vendor' END AS merchant,
 CASE {shape} WHEN 2 THEN 0.0 WHEN 5 THEN 1234.5 WHEN 12 THEN 1.0 ELSE {price} END AS amount,
 CASE WHEN {shape} IN (0,2,3,4) THEN '' ELSE 'No description' END AS description,
 CASE WHEN {shape} IN (4,12) THEN o_orderstatus END AS memo, 'Other' AS category, false AS is_outlier
FROM orders WHERE {shape} IN (0,1,2,3,4,5,12)
UNION ALL SELECT o_orderkey, 1, 'Unknown Vendor', CASE {shape} WHEN 0 THEN 0.0 WHEN 1 THEN 25.0 ELSE 2.0 END,
 CASE WHEN {shape} = 0 THEN '' ELSE 'No description' END, CASE WHEN {shape} = 12 THEN o_orderstatus END, 'Other', false
FROM orders WHERE {shape} IN (0,1,12)""",
        "clean_payloads_own_config": _OWN + """ SELECT payload_id, position, merchant, amount, '' AS description, CAST(NULL AS VARCHAR) AS memo,
 category, is_outlier FROM done""",
        "config_rejects": f"""SELECT payload_id, '{fixed.REJECT_CONFIG}' AS reason FROM ({sql.CONFIG_PAYLOADS}) p WHERE cust % 11 = 0""",
        "usage_by_payload": _OWN + """ SELECT payload_id, 'v4.2' AS cleaner_version, 3 AS rows_processed, requests AS ai_requests,
 round(requests / 100, 6) AS ai_cost, CAST(0 AS BIGINT) AS cache_hits, 1 AS chunks_processed FROM used""",
        "insights_by_payload": _OWN + _by_payload_sql("""UNION ALL SELECT payload_id, 'summary', unnest(['ai_requests','ai_cost','cache_hits','rows_processed','chunks_processed']),
 unnest([requests, requests / 100, 0, 3, 1]::DOUBLE[]) FROM used"""),
        "stream_insights": f"""WITH done AS (SELECT payload_id, 'Amazon' AS merchant,
 CASE WHEN i = 0 THEN c / 100 WHEN i = 1 THEN 7.0 ELSE 8.0 END AS amount, 'Office Supplies & Equipment' AS category, false AS is_outlier
FROM ({sql.STREAM_PAYLOADS}) p, (VALUES (0),(1),(2)) v(i) WHERE i = 0 OR (i = 1 AND payload_id % 2 = 1) OR (i = 2 AND payload_id % 3 <> 0)),
used AS (SELECT payload_id, count(*) AS n FROM done GROUP BY payload_id)""" + _by_payload_sql("""UNION ALL SELECT payload_id, 'summary',
 unnest(['ai_requests','ai_cost','cache_hits','rows_processed','chunks_processed']), unnest([2 * n, 0.02 * n, 0, 3, 1]::DOUBLE[]) FROM used"""),
        "stream_usage_totals": f"""WITH used AS (SELECT payload_id, 1 + (payload_id % 2 = 1)::INT + (payload_id % 3 <> 0)::INT AS n
FROM ({sql.STREAM_PAYLOADS}) p)
SELECT CAST(3 AS BIGINT) AS batches, count(*) AS payloads, CAST(3 * count(*) AS BIGINT) AS rows_processed,
 CAST(sum(2 * n) AS BIGINT) AS ai_requests, round(sum(2 * n) / 100, 2) AS ai_cost FROM used""",
        "clean_payloads_by_chunk": f"""SELECT payload_id, CAST(i AS BIGINT) AS position,
 CASE WHEN i = 3 THEN 'Other ' ELSE 'Acme ' END || o_custkey AS merchant, CASE WHEN i = 3 THEN 9.0 ELSE 5.0 END::DOUBLE AS amount,
 '' AS description, CAST(NULL AS VARCHAR) AS memo, 'Other' AS category, false AS is_outlier
FROM (SELECT o_orderkey AS payload_id, o_custkey FROM orders) p, (VALUES (0),(2),(3)) v(i)""",
        "clean_payload_extras": f"""SELECT o_orderkey AS payload_id, CAST(0 AS BIGINT) AS position, {shop} AS merchant,
 CAST(1 AS DOUBLE) AS amount, 'hi' AS note FROM orders""",
        "stream_clean_batches": f"""SELECT payload_id, CAST(i AS BIGINT) AS position, 'Amazon' AS merchant,
 CASE WHEN i = 0 THEN c / 100 WHEN i = 1 THEN 7.0 ELSE 8.0 END AS amount, '' AS description,
 'Office Supplies & Equipment' AS category, false AS is_outlier
FROM ({sql.STREAM_PAYLOADS}) p, (VALUES (0),(1),(2)) v(i)
WHERE i = 0 OR (i = 1 AND payload_id % 2 = 1) OR (i = 2 AND payload_id % 3 <> 0)""",
    }
