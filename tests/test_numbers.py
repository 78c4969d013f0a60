"""Outliers, slices, insights, completeness and usage."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from spendloom.operators import insight_buffers, insights, order, quality, usage
from spendloom.operators.outliers import flag_outliers


def amounts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "txn_id long, amount double")


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.0] * 11 + [1000.0], {11}),
        ([1.0] * 9 + [1000.0], set()),
        ([5.0] * 20, set()),
        ([1.0] * 11 + [1000.0, float("nan")], set()),
        ([1.0] * 11 + [1000.0, float("inf")], set()),
        ([], set()),
    ],
)
def test_outliers(spark, values, expected):
    out = flag_outliers(amounts(spark, values))
    assert {r.txn_id for r in out.collect() if r.is_outlier} == expected
    assert out.filter("is_outlier is null").count() == 0


def test_outliers_by_scope(spark):
    values = [1.0] * 11 + [1000.0]
    df = amounts(spark, values * 2).withColumn("part", F.when(F.col("txn_id") < 12, 0).otherwise(F.col("txn_id")))
    out = flag_outliers(df, scope=["part"])
    assert {r.txn_id for r in out.collect() if r.is_outlier} == {11}


def test_outlier_plan_moves_no_rows(spark):
    plan = flag_outliers(spark.range(10).withColumn("amount", F.col("id") * 1.0))._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_chunks(spark, parts):
    ids = random.Random(1).sample(range(10**6), 103)
    df = spark.createDataFrame([(i,) for i in ids], "txn_id long").repartition(3)
    out = order.add_chunk(df, chunk_size=10, parts=parts).collect()
    assert {r.txn_id: r.chunk_id for r in out} == {i: n // 10 for n, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_chunks_of_scopes(spark, parts):
    """One scope holds most rows; it spans several ranges, others share one."""
    rows = [(0 if i % 5 else i % 35, i) for i in random.Random(2).sample(range(10**6), 400)]
    df = spark.createDataFrame(rows, "scope long, txn_id long").repartition(3)
    out = order.add_chunk(df, chunk_size=7, scope=["scope"], parts=parts)
    places = {s: sorted(i for t, i in rows if t == s) for s, _ in rows}
    assert out.columns == ["scope", "txn_id", "chunk_id"]
    assert sorted(map(tuple, out.collect())) == sorted((s, i, places[s].index(i) // 7) for s, i in rows)


def test_chunks_need_no_unpartitioned_window(spark):
    df = spark.range(100).select(F.col("id").alias("txn_id"))
    out = order.add_chunk(df, chunk_size=7)
    assert "Window" not in out._jdf.queryExecution().toString()
    assert order.add_chunk(df.limit(0), chunk_size=7).count() == 0


def test_ids_for_rows_without(spark):
    out = order.add_txn_id(spark.range(50).select(F.lit("a").alias("merchant")).repartition(4))
    assert out.select("txn_id").distinct().count() == 50
    assert out.collect() == out.collect()


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("max_values", [1, 40, 10**6])
def test_exact_median(spark, seed, max_values):
    rng = random.Random(seed)
    n = rng.choice([200, 301])
    values = [rng.choice([0.0, 0.0, round(rng.gauss(0, 100), 2), 5.0]) for _ in range(n)]
    if seed == 3:
        values = [1.0] * 100 + [2.0] * 100
    if max_values == 1:  # narrowing can leave two values around the middle
        max_values = 2
    assert insights.exact_median(amounts(spark, values), max_values=max_values) == pytest.approx(statistics.median(values))


def test_exact_median_outside_the_expected_place(spark):
    values = [float(i % 97) for i in range(1000)]
    for around in ((-5.0, -1.0), (200.0, 300.0), (10.0, 20.0), (), None):
        assert insights.exact_median(amounts(spark, values), around=around) == statistics.median(values)
    odd = [float("nan")] * 6 + [1.0, 2.0, 3.0]
    assert math.isnan(insights.exact_median(amounts(spark, odd)))
    assert insights.exact_median(amounts(spark, [float("nan"), 1.0, 2.0])) == 2.0


def test_buffers_of_batches_merge(spark):
    rng = random.Random(5)
    rows = [(i % 7, f"m{rng.randrange(900)}", None if i % 11 == 0 else 1e7 + round(rng.gauss(0, 3), 2)) for i in range(9000)]
    rows += [(8, None, None), (9, "only", 1e7)]
    df = spark.createDataFrame(rows, "batch int, merchant string, amount double")
    parts = insight_buffers.buffers(df, ["batch"])
    halves = insight_buffers.merge(parts.withColumn("half", F.col("batch") % 2), ["half"])
    found = insight_buffers.summary(insight_buffers.merge(halves)).first()
    known = sorted(v for *_, v in rows if v is not None)
    assert found.total_rows == len(rows) and (found.min_amount, found.max_amount) == (known[0], known[-1])
    assert found.total_amount == pytest.approx(math.fsum(known)) and found.average_amount == pytest.approx(statistics.mean(known))
    assert found.std_amount == pytest.approx(statistics.stdev(known), rel=1e-6)
    assert known[int(0.495 * len(known))] <= found.median_amount <= known[int(0.505 * len(known))]
    names = len({m for _, m, _ in rows if m})
    assert abs(found.unique_vendors / names - 1) <= 0.03
    assert abs(insights.unique_vendors(df, approximate=True).first()[0] / names - 1) <= 0.03
    each = {r.batch: r for r in insight_buffers.summary(parts, ["batch"]).collect()}
    assert each[8].total_rows == 1 and each[8].median_amount is None and each[8].total_amount is None
    assert each[9].std_amount is None and each[9].median_amount == 1e7
    none = insight_buffers.summary(insight_buffers.merge(insight_buffers.buffers(df.filter("false")))).first()
    assert (none.total_rows, none.unique_vendors, none.median_amount) == (0, 0, None)
    assert insight_buffers.summary(insight_buffers.merge(parts.filter("false"))).first().total_rows == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "txn_id long, merchant string, amount double, category string, is_outlier boolean")
    assert insights.exact_median(df) is None
    found = {(r.section, r.name): r.value for r in insights.insights(df).collect()}
    assert found == {("summary", "total_rows"): 0.0, ("summary", "data_quality_score"): 0.0}


def test_one_row_has_no_deviation(spark):
    row = insights.amount_summary(amounts(spark, [4.0])).first()
    assert (row.total_rows, row.median_amount, row.std_amount) == (1, 4.0, None)


def test_counters_replace_summary(spark):
    df = spark.createDataFrame([("a", 1.0)], "merchant string, amount double")
    counters = spark.createDataFrame([(7, 0.5)], "total_rows int, ai_cost double")
    found = {(r.section, r.name): r.value for r in insights.insights(df, counters).collect()}
    assert found["summary", "total_rows"] == 7 and found["summary", "ai_cost"] == 0.5
    assert found["top_vendors", "a"] == 1


def test_top_vendor_ties_go_by_name(spark):
    df = spark.createDataFrame([(c,) for c in "cbbaaz"] + [(None,)], "merchant string")
    assert [tuple(r) for r in insights.top_vendors(df, 3).collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_completeness(spark):
    df = spark.createDataFrame([("a", 1.0), (None, float("nan"))], "merchant string, amount double")
    assert quality.quality_score(df).first()[0] == 0.5
    assert quality.quality_score(df.filter("false")).first()[0] == 0.0
    assert quality.quality_score(df.select(F.lit(1).alias("x"))).first()[0] == 0.0
    shares = {r.column_name: r.share for r in quality.column_completeness(df).collect()}
    assert shares == {"merchant": 0.5, "amount": 0.5}


def test_usage(spark):
    log = spark.createDataFrame(
        [(1, "vendor", "a", False, "2024-01-01 00:00:00"), (1, "vendor", "a", True, "2024-01-01 01:00:00"),
         (2, "category", "b", False, "2024-01-01 02:00:00"), (2, "analysis", "c", False, "2024-01-01 04:00:00")],
        "run_id long, kind string, key string, cached boolean, ts string",
    ).withColumn("ts", F.to_timestamp("ts"))
    client = usage.client_usage(log).first()
    assert (client.request_count, client.total_cost) == (3, 0.04)
    rate = usage.hit_rate(log).first()
    assert (rate.cache_hit_rate, rate.true_hit_rate) == (0.3, 0.25)
    assert usage.hit_rate(log, caching=False).first().cache_hit_rate == 0.0
    total = usage.service_rollup(log).first()
    assert (total.total_requests, total.total_ai_calls, total.total_cost) == (2, 4, 0.05)
    assert (total.average_cost_per_request, total.requests_per_hour) == (0.025, 0.5)
    empty = usage.service_rollup(log.filter("false")).first()
    assert (empty.total_requests, empty.total_cost, empty.requests_per_hour) == (0, 0.0, 0.0)
    assert usage.client_usage(log.filter("false")).first().average_cost_per_request == 0.0
    by_run = {r.run_id: (r.ai_requests, r.ai_cost, r.cache_hits) for r in usage.usage_by_run(log).collect()}
    assert by_run == {1: (2, 0.02, 1), 2: (2, 0.03, 0)}
