"""The whole cleaning run, composed from the operators.

The order of the steps is part of the result: near duplicates are judged by raw
merchants, categories by standard vendor names, outliers after duplicates are
gone and before blanks are filled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.config import CleanConfig
from spendloom.functions import fixed
from spendloom.functions.rules import keyword_vendor
from spendloom.operators import clean, model_requests
from spendloom.operators.categories import categorise, enrich_description
from spendloom.operators.dedup import (
    drop_duplicates_side_by_side,
    drop_exact_duplicates,
    near_duplicate_survivors,
    near_duplicates_apply,
)
from spendloom.operators.insights import insights
from spendloom.operators.order import add_chunk
from spendloom.operators.reply_log import ReplyLog
from spendloom.operators.outliers import flag_outliers
from spendloom.operators.usage import count_hits, run_usage
from spendloom.operators.vendors import standardise_vendors, unmatched_by_rules
from spendloom.session import write_shared

#: Marks payload rows whose payload brings amounts.
HAS_AMOUNT = "_has_amount"
#: Up to this many rows a payload is searched for duplicates where it is read.
FEW_ROWS = 32


@dataclass(frozen=True)
class CleanRun:
    """A cleaned table, its usage report (one row, or one per scope), and the grown cache, if one was given."""

    rows: DataFrame
    usage: DataFrame
    cache: DataFrame | None = None


class Options:
    """The options of a run: of the config, or of a struct column of the rows.

    A switch is True or False for a config and a column otherwise.
    """

    def __init__(self, config: CleanConfig, own: str | None) -> None:
        self.config, self.own = config, own

    def value(self, name: str) -> Column | float | int | bool:
        return F.col(self.own)[name] if self.own else getattr(self.config, name)

    def step(self, name: str) -> Column | bool:
        possible = getattr(self.config, name)
        if not possible or not self.own:
            return possible and self.config.enable_ai
        return self.value("enable_ai") & self.value(name)


def clean_transactions(df: DataFrame, config: CleanConfig = CleanConfig(), **options) -> DataFrame:
    """Clean a table of transactions; the options are those of :func:`run`."""
    return run(df, config, **options).rows


def run(
    df: DataFrame,
    config: CleanConfig = CleanConfig(),
    *,
    order_by: str = "txn_id",
    scope: Sequence[str] = (),
    models: Mapping[str, model_requests.MakeModel] | None = None,
    cache: DataFrame | ReplyLog | None = None,
    own_options: str | None = None,
    scope_rows: str | None = None,
) -> CleanRun:
    """Clean a table of transactions.

    ``order_by`` is a whole number, unique within ``scope`` and never null.
    Each scope is cleaned as if it came alone.  ``models`` replaces the keyword
    rules of the steps it names: vendor, category, analysis.  ``cache`` has
    earlier replies (``kind, key, reply, seq``) and comes back with the new ones;
    a ``ReplyLog`` gets them appended.

    ``own_options`` names a struct column with a field for each option of
    ``config``, the same within a scope, that is used in its place; ``config``
    then says only which steps are possible at all.  The column is dropped.

    ``scope_rows``, beside ``own_options``, names a column with the number of
    rows of the scope, which is dropped too.  The rows of a scope then follow
    each other in one partition, and ``order_by`` counts them from 0.
    """
    models = models or {}
    scope = list(scope)
    columns = [c for c in df.columns if c not in (HAS_AMOUNT, own_options, scope_rows)]
    options = Options(config, own_options)
    rows_in = df
    inner = list(scope)
    if own_options or config.chunked:
        df = add_chunk(
            df, chunk_size=options.value("chunk_size"), order_by=order_by, scope=scope, column="_chunk",
            numbered=scope_rows is not None,
        )
        if own_options:
            df = df.withColumn("_chunk", F.when(options.value("chunked"), F.col("_chunk")).otherwise(0))
        inner.append("_chunk")
    marks = [c for c in (HAS_AMOUNT, own_options, scope_rows) if c in df.columns]
    rows = clean.trim_texts(df, stringify_nulls=options.value("stringify_nulls"), skip=inner)
    rows = clean.drop_empty_rows(
        rows, order_by=order_by, scope=inner, skip=[*marks, *(c for c in ("request_id",) if marks)]
    )
    rows = clean.parse_amount(rows)
    rows = without_amount_marked(rows)
    if scope_rows:
        rows = survivors = _without_duplicates_in_place(rows, options, order_by, inner, scope_rows)
    else:
        rows, survivors = _without_duplicates(rows, options, order_by, inner)

    options = Options(_possible_steps(config, rows.columns, own_options), own_options)
    # Without an amount there is no category request.
    confidence = F.when(~F.isnan("amount"), F.lit(fixed.KEYWORD_CONFIDENCE))
    asked, replies = survivors, []
    if (on := options.step("ai_vendor_enabled")) is not False:
        rows = _only(rows, on, ["merchant"], lambda r: _vendor_step(r, on, options, models, cache, replies))
    if (on := options.step("ai_category_enabled")) is not False:
        old = F.col("category") if "category" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("category", old)
        gate = options.value("ai_confidence_threshold")
        if "category" in models:
            to_ask = _where(rows, on)
            found = model_requests.replies_for(to_ask, "category", models["category"], cache)
            replies.append((model_requests.request_keys(to_ask, "category"), found))
            rows = _only(rows, on, ["category"], lambda r: model_requests.apply_category_replies(r, found, threshold=gate), "amount")
            confidence, asked = F.when(~F.isnan("amount"), F.col("confidence")), rows
        else:
            rows = _only(rows, on, ["category"], lambda r: categorise(r, threshold=gate), "amount")
    hits = count_hits([(k.select(*scope, "key"), r) for k, r in replies], scope) if replies else None
    usage = run_usage(rows_in, asked, options, confidence, scope=scope, hits=hits)

    rows = flag_outliers(
        rows, threshold=options.value("outlier_z_threshold"), scope=inner, stats_from=survivors,
        small_scopes=scope_rows is not None,
    )
    rows = clean.fill_blanks(rows)
    if (on := options.step("ai_analysis_enabled")) is not False:
        if "analysis" in models:
            found = model_requests.replies_for(_where(rows, on), "analysis", models["analysis"], cache)
            rows = _only(rows, on, ["description"], lambda r: model_requests.apply_analysis_replies(r, found))
        else:
            rows = _only(rows, on, ["description"], enrich_description)
    rows = clean.complete_columns(rows)
    internal = ("_chunk", HAS_AMOUNT, own_options, scope_rows)
    added = [c for c in rows.columns if c not in columns and c not in internal]
    for _, found in replies:
        cache = None if cache is None else model_requests.store_replies(cache, found)
    return CleanRun(rows.select(*columns, *added), usage, cache)


def _without_duplicates(
    rows: DataFrame, options: Options, order_by: str, scope: list[str]
) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and a narrow table of them (or the rows again)."""
    config, own = options.config, options.own
    has_both = {"merchant", "amount"} <= set(rows.columns)
    if not (has_both if own else near_duplicates_apply(rows, config.duplicate_threshold)):
        return (kept := drop_exact_duplicates(rows, order_by=order_by)), kept
    # Copies in all columns agree in merchant and amount too, so the near step
    # alone keeps the same rows, and only its narrow columns are shuffled before
    # the survivors are known.
    near, names = F.lit(True), list(scope)
    carried = []
    if HAS_AMOUNT in rows.columns:
        near = near & F.col(HAS_AMOUNT)
    if own:
        carried = [own]
        rows = rows.withColumn("_threshold", options.value("duplicate_threshold"))
        near = near & (F.col("_threshold") < 1)
        names.append("_threshold")
    narrow = near_duplicate_survivors(
        rows.filter(near), threshold=config.duplicate_threshold, order_by=order_by, scope=names,
        own_threshold="_threshold" if own else None,
    ).select(*scope, order_by, "amount")
    if HAS_AMOUNT in rows.columns or own:
        exact = drop_exact_duplicates(rows.filter(~near).drop("_threshold"), order_by=order_by)
        narrow = narrow.unionByName(exact.select(*scope, order_by, "amount"))
    survivors = write_shared(narrow, "survivors")
    rows = rows.drop("_threshold").join(survivors.select(*scope, order_by), [*scope, order_by], "left_semi")
    # The options of a row are looked up by its scope, so they are taken from the rows.
    return rows, (rows if carried else survivors)


def _without_duplicates_in_place(
    rows: DataFrame, options: Options, order_by: str, scope: list[str], scope_rows: str
) -> DataFrame:
    """The rows that stay, written.

    Scopes of few rows are judged where they lie; those of more rows take the
    way of a table of any size, if there are any.
    """
    few, many = rows.filter(F.col(scope_rows) <= FEW_ROWS), rows.filter(F.col(scope_rows) > FEW_ROWS)
    near = F.col("_threshold") < 1
    if HAS_AMOUNT in rows.columns:
        near = near & F.col(HAS_AMOUNT)
    few = few.withColumn("_threshold", options.value("duplicate_threshold"))
    kept = drop_duplicates_side_by_side(few, near=near, threshold="_threshold", order_by=order_by, scope=scope)
    kept = kept.drop("_threshold")
    if not many.isEmpty():
        kept = kept.unionByName(_without_duplicates(many, options, order_by, scope)[0])
    return write_shared(kept, "kept-rows")


def _where(rows: DataFrame, on: Column | bool) -> DataFrame:
    return rows if on is True else rows.filter(on)


def _only(rows: DataFrame, on: Column | bool, changed: Sequence[str], step, needs_amount: str = "") -> DataFrame:
    """``step`` of the rows; where ``on`` is false, ``changed`` stays and new columns are null.

    ``needs_amount``: rows without an amount stay as well.
    """
    if needs_amount:
        there = ~F.isnan(needs_amount)
        on = there if on is True else there & on
    if on is True:
        return step(rows)
    kept = {f"_old_{c}": F.col(c) for c in changed}
    done = step(rows.withColumns(kept).withColumn("_on", F.coalesce(on, F.lit(False))))
    back = {c: F.when(F.col("_on"), F.col(c)).otherwise(F.col(f"_old_{c}")) for c in changed}
    # The confidence of a category is kept for the usage report.
    new = [c for c in done.columns if c not in rows.columns and not c.startswith("_o") and c != "confidence"]
    back |= {c: F.when(F.col("_on"), F.col(c)) for c in new}
    return done.withColumns(back).drop("_on", *kept)


def _possible_steps(config: CleanConfig, columns: Sequence[str], own: str | None = None) -> CleanConfig:
    """Switch off the steps whose columns the table does not have."""
    columns = set(columns)
    return replace(
        config,
        ai_vendor_enabled=(bool(own) or config.ai_vendor_enabled) and "merchant" in columns,
        ai_category_enabled=(bool(own) or config.ai_category_enabled) and {"merchant", "amount"} <= columns,
        ai_analysis_enabled=(bool(own) or config.ai_analysis_enabled) and {"merchant", "description"} <= columns,
    )


def without_amount_marked(rows: DataFrame) -> DataFrame:
    """Give rows whose payload has no amounts NaN, which becomes 0 at the end.

    They take no part in near duplicates, categories and outliers.
    """
    if not {HAS_AMOUNT, "amount"} <= set(rows.columns):
        return rows
    amount = F.when(F.col(HAS_AMOUNT), F.col("amount")).otherwise(float("nan"))
    return rows.withColumn("amount", amount)


def _vendor_step(
    rows: DataFrame,
    on: Column | bool,
    options: Options,
    models: Mapping[str, model_requests.MakeModel],
    cache: DataFrame | ReplyLog | None,
    replies: list[tuple[DataFrame, DataFrame]],
) -> DataFrame:
    if "vendor" not in models:
        return standardise_vendors(rows)
    asked, by_rule_first = _where(rows, on), options.value("use_ai_for_unmatched_only")
    if by_rule_first is not False:
        known = unmatched_by_rules(asked)
        asked = known if by_rule_first is True else known.unionByName(asked.filter(~by_rule_first))
    found = model_requests.replies_for(asked, "vendor", models["vendor"], cache)
    replies.append((model_requests.request_keys(asked, "vendor"), found))
    if by_rule_first is False:
        return model_requests.apply_vendor_replies(rows, found)
    if by_rule_first is True:
        return model_requests.apply_unmatched_replies(rows, keyword_vendor, found)
    ruled = F.when(by_rule_first, keyword_vendor(F.coalesce("merchant", F.lit("None"))))
    ruled = F.when(ruled != fixed.UNKNOWN_VENDOR, ruled)
    done = model_requests.apply_vendor_replies(rows.withColumn("_old_ruled", ruled), found)
    return done.withColumn("merchant", F.coalesce("_old_ruled", "merchant")).drop("_old_ruled")


def clean_and_summarise(
    df: DataFrame, config: CleanConfig = CleanConfig(), *, path: str | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, written once, and its insights with the run counters."""
    result = run(df, config, **options)
    if path is None:
        rows = write_shared(result.rows, "clean")
    else:
        result.rows.write.mode("overwrite").parquet(path)
        rows = df.sparkSession.read.schema(result.rows.schema).parquet(path)
    scope = options.get("scope", ())
    return rows, insights(rows, result.usage.drop("cleaner_version"), scope=scope)
