import random

import pytest
from pyspark.sql import functions as F

from spendloom.config import CleanConfig
from spendloom.functions import rules
from spendloom.operators import vendors
from spendloom.operators.dedup import drop_near_duplicates
from spendloom.plans.cleaning import clean_and_summarise, clean_transactions, run
from spendloom.sources import tables
from spendloom.streaming import payload_stream

# The demo batch.
DEMO = [
    (0, "PAYPAL*DIGITALOCEAN", 50.00, "DigitalOcean hosting", "Monthly hosting"),
    (1, "SQ *COFFEE SHOP NYC", 4.50, "Coffee purchase", "Morning coffee"),
    (2, "UBER EATS DEC15", 23.75, "Food delivery", "Lunch delivery"),
    (3, "MONTHLY.RECURRING.CHG*NETFLIX", 15.99, "Netflix subscription", "Entertainment"),
    (4, "POS PURCHASE - STARBUCKS #12345", 6.85, "Coffee purchase", "Coffee break"),
    (5, "WM SUPERCENTER #1234", 234.56, "Grocery shopping", "Weekly shopping"),
    (6, "TARGET DEBIT CRD PURCHASE", 89.12, "Shopping", "Target run"),
]
SCHEMA = "txn_id long, merchant string, amount double, description string, memo string"


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame(DEMO, SCHEMA)


def test_demo_batch(demo):
    rows, found = clean_and_summarise(demo)
    by_id = {r.txn_id: r for r in rows.collect()}
    assert [by_id[i].merchant for i in range(7)] == ["DigitalOcean"] + ["Unknown Vendor"] * 6
    assert {r.category for r in by_id.values()} == {"Other"}
    assert not any(r.is_outlier for r in by_id.values())
    values = {(r.section, r.name): r.value for r in found.collect()}
    expected = {
        "total_rows": 7, "total_amount": 424.77, "average_amount": 60.681429, "median_amount": 23.75,
        "min_amount": 4.5, "max_amount": 234.56, "std_amount": 82.231414, "unique_vendors": 2,
        "data_quality_score": 1.0, "ai_requests": 14, "ai_cost": 0.14, "outlier_count": 0,
    }
    for name, value in expected.items():
        assert values["summary", name] == pytest.approx(value, abs=1e-6), name
    assert values["top_vendors", "Unknown Vendor"] == 6 and values["top_vendors", "DigitalOcean"] == 1
    assert values["category_breakdown", "Other"] == 7


def test_small_batch(demo):
    result = run(demo.drop("memo").filter("txn_id < 3"))
    rows = result.rows.orderBy("txn_id").collect()
    assert [r.merchant for r in rows] == ["DigitalOcean", "Unknown Vendor", "Unknown Vendor"]
    usage = result.usage.first()
    assert (usage.cleaner_version, usage.rows_processed, usage.ai_requests) == ("v4.2", 3, 6)
    assert usage.ai_cost == pytest.approx(0.06)


def test_without_vendor_step_software_is_found(spark):
    df = spark.createDataFrame([(1, "Zoom.us", 1.0), (2, "Slack Inc", 2.0)], "txn_id long, merchant string, amount double")
    config = CleanConfig(ai_vendor_enabled=False)
    assert {r.category for r in clean_transactions(df, config).collect()} == {"Software & Technology"}
    assert {r.category for r in clean_transactions(df).collect()} == {"Other"}


def test_gate_keeps_old_category(spark):
    df = spark.createDataFrame([(1, "x", 1.0, "Mine"), (2, "y", 2.0, None)], "txn_id long, merchant string, amount double, category string")
    out = clean_transactions(df, CleanConfig(ai_confidence_threshold=0.86))
    assert {r.txn_id: r.category for r in out.collect()} == {1: "Mine", 2: "Other"}
    out = clean_transactions(df, CleanConfig(ai_confidence_threshold=0.85))
    assert {r.category for r in out.collect()} == {"Other"}


def test_switched_off(demo):
    out = clean_transactions(demo, CleanConfig(enable_ai=False, ai_analysis_enabled=True))
    assert out.columns == [*demo.columns, "is_outlier"]
    assert {r.merchant for r in out.collect()} == {d[1] for d in DEMO}


def test_analysis(demo):
    row = clean_transactions(demo, CleanConfig(ai_analysis_enabled=True)).filter("txn_id = 0").first()
    assert row.description == "DigitalOcean hosting | Standard operational expense"
    assert (row.business_impact, row.risk_level) == ("Standard operational expense", "Low")


def test_no_amount_column(spark):
    df = spark.createDataFrame([(1, "Amazon"), (2, "Amazon"), (3, "Amazon ")], "txn_id long, merchant string")
    result = run(df)
    rows = result.rows.collect()
    # After trimming all three are exact copies; there is no near step and no category.
    assert [tuple(r) for r in rows] == [(1, "Amazon", 0.0)]
    assert result.usage.first().ai_requests == 1


def test_no_merchant_column(spark):
    df = spark.createDataFrame([(1, "5"), (2, "5")], "txn_id long, amount string")
    assert [tuple(r) for r in clean_transactions(df).collect()] == [(1, 5.0, False, "")]


def test_chunks_are_cleaned_on_their_own(spark):
    data = [(i, f"Shop number {i % 5}", float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(data, "txn_id long, merchant string, amount double")
    config = CleanConfig(chunked=True, chunk_size=30)
    together = {tuple(r) for r in clean_transactions(df, config).collect()}
    apart = set()
    for start in range(0, 100, 30):
        part = df.filter((F.col("txn_id") >= start) & (F.col("txn_id") < start + 30))
        apart |= {tuple(r) for r in clean_transactions(part).collect()}
    assert together == apart
    assert run(df, config).usage.first().chunks_processed == 4
    assert len(together) > clean_transactions(df).count()


def test_result_does_not_depend_on_partitions(spark, demo):
    twice = demo.unionByName(demo.withColumn("txn_id", F.col("txn_id") + 10).withColumn("merchant", F.lower("merchant")))
    expected = {tuple(r) for r in clean_transactions(demo).collect()}
    for n in (1, 7):
        assert {tuple(r) for r in clean_transactions(twice.repartition(n)).collect()} == expected
    once = drop_near_duplicates(twice)
    assert drop_near_duplicates(once).count() == once.count() == 7


def test_plan_is_joins_and_scalars(spark, demo):
    plan = clean_transactions(demo)._jdf.queryExecution().toString()
    for part in ("CartesianProduct", "NestedLoop", "Python", "Window"):
        assert part not in plan


def test_rule_table(spark):
    df = spark.createDataFrame([(1, "The SLACK store"), (2, "ab"), (3, "zz"), (4, None), (5, "")], "txn_id long, merchant string")
    table = spark.createDataFrame(
        [("slack", "Slack", 2), ("the", "Article", 5), ("B", "Bee", 1), ("", "All", 0)],
        "keyword string, vendor string, priority int",
    )
    out = vendors.standardise_vendors_by_table(df, table)
    assert {r.txn_id: r.merchant for r in out.collect()} == {
        1: "Slack", 2: "Bee", 3: "Unknown Vendor", 4: "Unknown Vendor", 5: "Unknown Vendor"
    }


@pytest.mark.parametrize("shard_bytes, names_per_task", [(16 << 20, 10), (300, 10), (100, 10**6)])
def test_rule_table_like_brute_force(spark, shard_bytes, names_per_task):
    """In one shard and in many; keywords repeat, overlap and tie in priority."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abÄ ") for _ in range(rng.randint(1, n)))
    table = [(word(4), f"v{i}", rng.choice([1, 2, 3, None])) for i in range(60)]
    names = [word(9).upper() for _ in range(150)]
    lower = {k: (k or "").lower() for k, _, _ in table}
    order = lambda r: (r[2] is not None, r[2] or 0, lower[r[0]], r[1])

    def best(name):
        return min((r for r in table if lower[r[0]] in name.lower()), key=order, default=(0, "Unknown Vendor"))[1]

    df = spark.createDataFrame(list(enumerate(names)), "txn_id long, merchant string")
    rule_table = spark.createDataFrame(table, "keyword string, vendor string, priority int")
    out = vendors.standardise_vendors_by_table(df, rule_table, shard_bytes=shard_bytes, names_per_task=names_per_task)
    assert {r.txn_id: r.merchant for r in out.collect()} == {i: best(n) for i, n in enumerate(names)}


def test_many_rules(spark):
    """100,000 rules, each of which names one merchant."""
    rules_table = spark.range(100_000).select(
        F.concat(F.lit("Shop "), F.md5(F.col("id").cast("string"))).alias("keyword"),
        F.concat(F.lit("V"), "id").alias("vendor"),
        F.lit(1).alias("priority"),
    )
    df = spark.range(500).select("id", F.concat(F.lit("pay SHOP "), F.md5(F.col("id").cast("string")), F.lit("!")).alias("merchant"))
    for shard_bytes in (16 << 20, 4 << 20):
        out = vendors.standardise_vendors_by_table(df, rules_table, shard_bytes=shard_bytes)
        assert out.filter(F.col("merchant") == F.concat(F.lit("V"), "id")).count() == 500


def test_no_rules(spark, demo):
    none = spark.createDataFrame([], "keyword string, vendor string, priority int")
    assert {r.merchant for r in vendors.standardise_vendors_by_table(demo, none).collect()} == {"Unknown Vendor"}


@pytest.mark.parametrize(
    "name, vendor, category",
    [
        ("GOOGLE facebook", "Google Workspace", "Marketing & Advertising"),
        ("metamorph amazon", "Meta", "Marketing & Advertising"),
        ("Amazon zoom", "Amazon", "Software & Technology"),
        ("x DigitalOcean stripe", "DigitalOcean", "Other"),
        ("STRIPE", "Stripe", "Other"),
        ("", "Unknown Vendor", "Other"),
    ],
)
def test_keyword_rules(spark, name, vendor, category):
    row = spark.range(1).select(rules.keyword_vendor(F.lit(name)), rules.keyword_category(F.lit(name))).first()
    assert tuple(row) == (vendor, category)


def test_tables(spark, demo, tmp_path):
    tables.write_result(demo, demo.limit(1), str(tmp_path / "out"), format="json")
    back = tables.read_transactions(spark, str(tmp_path / "out" / "rows"), format="json", schema=demo.schema)
    assert back.count() == 7 and back.columns == demo.columns
    with pytest.raises(ValueError):
        tables.canonical_columns(demo.drop("merchant"))
    mixed = tables.canonical_columns(demo.select(F.lit(1).alias("z"), F.lit(2).alias("b"), "memo", "merchant"))
    assert mixed.columns == ["merchant", "memo", "b", "z"]
    assert tables.within_row_limit(demo, 7) and not tables.within_row_limit(demo, 6)
    assert tables.as_json_rows(demo.select("txn_id", F.lit(None).cast("string").alias("n"))).first().json == '{"txn_id":0,"n":null}'
    both = tables.stack([demo, demo.drop("memo")])
    assert both.count() == 14 and both.filter("memo is null").count() == 7


PAYLOADS = [
    (1, '[{"merchant":"Acme Corp","amount":5},{"merchant":"ACME CORP","amount":"$5.00"},{"merchant":"Stripe","amount":1}]'),
    (2, '[{"merchant":"Acme Corp","amount":5}]'),
    (3, '{"merchant":["Amazon","Amazon","AMAZON"],"memo":"m"}'),
    (4, '{"invalid":"data"}'),
    (5, '{"merchant":"Meta","amount":2,"tag":"t"}'),
]


def test_stream_is_the_batch_form(spark, tmp_path):
    df = spark.createDataFrame(PAYLOADS, "payload_id long, body string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    df.withColumn("payload_id", F.col("payload_id") + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    everything = spark.read.parquet(str(tmp_path / "in"))
    expected = [r.asDict() for r in payload_stream.clean_payloads(everything).orderBy("payload_id", "position").collect()]
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    payload_stream.clean_stream(source, out, str(tmp_path / "progress")).awaitTermination()
    written = spark.read.parquet(f"{out}/rows")
    assert written.select("batch_id").distinct().count() == 2
    found = [r.asDict() for r in written.drop("batch_id").orderBy("payload_id", "position").collect()]
    assert found == expected
    first = {(r["payload_id"], r["position"]): r for r in found}
    assert set(first) == {(p + d, n) for d in (0, 100) for p, n in [(1, 0), (1, 2), (2, 0), (3, 0), (3, 2), (5, 0)]}
    # No amounts in payload 3: exact copies go, no category, amount 0 at the end.
    assert first[3, 0]["amount"] == 0.0 and first[3, 0]["category"] == "Other" and not first[3, 0]["is_outlier"]
    assert first[5, 0]["extra"] == {"tag": "t"}
    assert spark.read.parquet(f"{out}/rejects").count() == 2
    totals = payload_stream.usage_totals(spark.read.parquet(f"{out}/usage")).first()
    assert (totals.batches, totals.rows_processed) == (2, 16)
    assert payload_stream.running_totals(spark, out).first() == totals


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    df = spark.createDataFrame(PAYLOADS, "payload_id long, body string")
    out = str(tmp_path / "out")
    for batch_id, rows in ((0, df), (1, df.filter("payload_id < 3")), (1, df.filter("payload_id < 3")), (2, df.filter("payload_id = 4"))):
        payload_stream.clean_batch(rows, batch_id, out)
    found = payload_stream.running_totals(spark, out).first()
    assert found == payload_stream.usage_totals(spark.read.parquet(f"{out}/usage")).first()
    assert (found.batches, found.payloads, found.rows_processed) == (2, 6, 12)
    payload_stream.clean_batch(df.filter("payload_id = 2"), 7, out)  # the batch before left no totals
    assert payload_stream.running_totals(spark, out).first().payloads == 7


@pytest.mark.parametrize(
    "options", [{"enable_ai": "false"}, {"duplicate_threshold": "x"}, {"chunk_size": 0}, {"duplicate_threshold": -1},
                {"outlier_z_threshold": float("nan")}]
)
def test_bad_options(options):
    with pytest.raises((TypeError, ValueError)):
        CleanConfig.from_dict(options)


def test_options():
    config = CleanConfig.from_dict({"duplicate_threshold": "0.9", "chunk_size": "5", "mine": 1})
    assert (config.duplicate_threshold, config.chunk_size, dict(config.extra)) == (0.9, 5, {"mine": 1})
    assert CleanConfig() == CleanConfig.from_dict(None)
