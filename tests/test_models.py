import pytest
from pyspark.sql import functions as F

from spendloom.config import CleanConfig
from spendloom.functions.replies import analysis_reply, category_reply
from spendloom.functions.rules import keyword_vendor
from spendloom.operators import model_requests as m
from spendloom.operators.reply_log import ReplyLog
from spendloom.plans.cleaning import clean_transactions, run

REPLIES = [
    ('{"category":"Software & Technology","confidence":0.88}', "Software & Technology", 0.88),
    ('Sure: {"category":"X","confidence":"0.9"} done', "X", 0.9),
    ('{"category":"X"}', "X", 0.0),
    ('{"confidence":0.5}', "Other", 0.5),
    ('{"category":"X","confidence":null}', "Other", 0.0),
    ('{"category":"X","confidence":"high"}', "Other", 0.0),
    ('{"category":"X","confidence":[1]}', "Other", 0.0),
    ('{"category":"X","confidence":true}', "X", 1.0),
    ('{"category":null,"confidence":1}', None, 1.0),
    ("{bad", "Other", 0.0), ("no json", "Other", 0.0), ("[1]", "Other", 0.0), (None, "Other", 0.0),
    ('{"category":"X"} and {"category":"Y"}', "Other", 0.0),
    ('line\n{"category":\n"X","confidence":1e-1}\nline', "X", 0.1),
]


def test_category_replies(spark):
    df = spark.createDataFrame(REPLIES, "reply string, category string, confidence double")
    out = df.select("*", category_reply(F.col("reply")).alias("a")).collect()
    wrong = [r for r in out if (r.a.category, r.a.confidence) != (r.category, r.confidence)]
    assert wrong == []


def test_analysis_replies(spark):
    df = spark.createDataFrame(
        [('{"vendor":"V","risk_level":"High","confidence":0.5}',), ('{"vendor":"V","confidence":null}',)], "r string"
    )
    first, second = (r.a.asDict() for r in df.select(analysis_reply(F.col("r")).alias("a")).collect())
    assert first == {"vendor": "V", "category": "Other", "business_impact": "Standard expense",
                     "risk_level": "High", "recommendation": "", "confidence": 0.5}
    assert second["vendor"] == "Unknown Vendor" and second["confidence"] == 0.0


def upper_model():
    def make():
        def model(prompts, max_tokens, temperature):
            assert (max_tokens, temperature) == (50, 0.1)
            names = [p.split("Merchant: ")[1].split("\n")[0] for p in prompts]
            if "boom" in names:
                raise ValueError("boom")
            return [n.upper() for n in names]

        return model

    return make


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, ["aaa", "bbb", "boom", "google x"][i % 4], float(i), "d", "m") for i in range(40)]
    return spark.createDataFrame(data, "txn_id long, merchant string, amount double, description string, memo string")


def test_each_request_is_asked_once(rows):
    replies = m.replies_for(rows, "vendor", upper_model())
    found = {r.reply: r.error for r in replies.collect()}
    assert found == {"AAA": None, "BBB": None, None: "boom", "GOOGLE X": None}
    assert replies.count() == 4
    out = m.apply_vendor_replies(rows, replies)
    assert out.columns == rows.columns
    counts = {r.merchant: r["count"] for r in out.groupBy("merchant").count().collect()}
    assert counts == {"AAA": 10, "BBB": 10, "Unknown Vendor": 10, "GOOGLE X": 10}


def test_cache(spark, rows):
    asked = m.requests(rows, "vendor")
    keys = {r.prompt.split("Merchant: ")[1].split("\n")[0]: r.key for r in asked.collect()}
    cache = spark.createDataFrame(
        [("vendor", keys["aaa"], "Stored", 1), ("vendor", keys["bbb"], "", 2), ("category", keys["boom"], "x", 3)],
        "kind string, key string, reply string, seq long",
    )
    assert [r.reply for r in m.cache_hits(asked, cache).collect()] == ["Stored"]
    assert m.cache_misses(asked, cache).count() == 3
    replies = m.replies_for(rows, "vendor", upper_model(), cache)
    assert {(r.reply, r.cached) for r in replies.collect()} == {
        ("Stored", True), ("BBB", False), (None, False), ("GOOGLE X", False)
    }


def test_store(spark, rows):
    cache = spark.createDataFrame([("vendor", "k", "Old", 4)], "kind string, key string, reply string, seq long")
    replies = m.replies_for(rows, "vendor", upper_model(), cache)
    stored = m.store_replies(cache, replies)
    assert {(r.reply, r.seq) for r in stored.collect()} == {("Old", 4), ("AAA", 5), ("BBB", 5), ("GOOGLE X", 5)}
    assert {r.reply for r in m.store_replies(cache, replies, size=3).collect()} == {"AAA", "BBB", "GOOGLE X"}
    again = m.replies_for(rows, "vendor", upper_model(), stored)
    assert {(r.reply, r.cached) for r in again.collect()} == {
        ("AAA", True), ("BBB", True), ("GOOGLE X", True), (None, False)
    }
    assert m.store_replies(cache.filter("false"), replies).count() == 3


@pytest.fixture
def log(spark, tmp_path):
    return ReplyLog(spark, str(tmp_path / "log"), buckets=4)


def replies_of(spark, *rows):
    return spark.createDataFrame(list(rows), "kind string, key string, reply string, cached boolean")


def test_reply_log(spark, log):
    first = [("vendor", "a", "A1", False), ("vendor", "b", "", False), ("category", "a", "C", False), ("vendor", "c", "C1", True)]
    log.append(replies_of(spark, *first), seq=1)
    second = [("vendor", "a", "A2", False), ("vendor", "d", None, False), ("analysis", "e", "E", False), ("vendor", "b", "", False)]
    log.append(replies_of(spark, *second), seq=2)
    asked = spark.createDataFrame([(k, key, "p") for k, key in [("vendor", "a"), ("vendor", "b"), ("vendor", "c"), ("category", "a")]], "kind string, key string, prompt string")
    expected = [("category", "a", "C"), ("vendor", "a", "A2")]
    for _ in range(2):
        assert sorted(map(tuple, log.hits(asked).collect())) == expected
        assert sorted((r.key, r.prompt) for r in log.misses(asked).collect()) == [("b", "p"), ("c", "p")]
        log.compact(buckets=3)  # another number of buckets; the answers stay
    assert sorted((r.kind, r.key, r.reply) for r in log.table().collect()) == expected


def test_reply_log_is_found_again(spark, log, tmp_path):
    log.append(replies_of(spark, ("vendor", "a", "A", False)))
    log.compact()
    # A compaction that was lost: its files are there, but they do not count.
    half = tmp_path / "log" / "generation=2-buckets=4"
    half.mkdir()
    (half / "part").write_text("no parquet")
    again = ReplyLog(spark, str(tmp_path / "log"))
    assert [r.reply for r in again.table().collect()] == ["A"]
    again.append(replies_of(spark, ("vendor", "a", "B", False)))
    again.compact()
    assert [r.reply for r in again.table().collect()] == ["B"]
    # Only the newest generation and the one before it are left.
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["generation=1-buckets=4", "generation=2-buckets=4"]


def test_reply_log_is_not_shuffled(spark, log, rows):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = m.requests(rows, "vendor")
        alone = asked._jdf.queryExecution().executedPlan().toString().count("Exchange")
        for found in (log.hits(asked), log.misses(asked)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange") == alone + 1  # the requests meet the buckets
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_run_with_a_log(spark, log, rows):
    first = m.replies_for(rows, "vendor", upper_model(), log)
    assert {r.cached for r in first.collect()} == {False}
    m.store_replies(log, first)
    again = m.replies_for(rows, "vendor", upper_model(), log)
    assert {(r.reply, r.cached) for r in again.collect()} == {("AAA", True), ("BBB", True), ("GOOGLE X", True), (None, False)}
    assert m.store_replies(log, again).count() == 3


@pytest.mark.parametrize("size", [1, 7, 1500])
def test_trim_cache(spark, size):
    cache = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "vendor").otherwise("category").alias("kind"),
        F.md5(F.col("id").cast("string")).alias("key"), F.lit("r").alias("reply"), F.col("id").alias("seq"),
    )
    kept = {(r.kind, r.seq) for r in m.trim_cache(cache, size=size).collect()}
    vendor = [i for i in range(3999, -1, -1) if i % 3 == 0][:size]
    category = [i for i in range(3999, -1, -1) if i % 3][:size]
    assert kept == {("vendor", i) for i in vendor} | {("category", i) for i in category}


def test_rules_before_model(rows):
    out = m.resolve_unmatched(rows, keyword_vendor, upper_model())
    assert {r.merchant for r in out.collect()} == {"AAA", "BBB", "Unknown Vendor", "Google Workspace"}


def test_models_in_the_whole_run(rows):
    def categories():
        def model(prompts, max_tokens, temperature):
            return ['{"category":"Utilities & Rent","confidence":%s}' % (0.7 if "AAA" in p else 0.69) for p in prompts]

        return model

    result = run(rows, CleanConfig(), models={"vendor": upper_model(), "category": categories})
    found = {(r.merchant, r.category) for r in result.rows.collect()}
    assert found == {("AAA", "Utilities & Rent"), ("BBB", "Other"), ("Unknown Vendor", "Other"), ("GOOGLE X", "Other")}
    assert "confidence" in result.rows.columns
    usage = result.usage.first()
    assert (usage.rows_processed, usage.ai_requests, round(usage.ai_cost, 2)) == (40, 50, 0.5)


def test_fallback_switch(rows):
    config = CleanConfig(use_ai_for_unmatched_only=True, ai_category_enabled=False)
    out = clean_transactions(rows, config, models={"vendor": upper_model()})
    assert "category" not in out.columns
    assert {r.merchant for r in out.collect()} == {"AAA", "BBB", "Unknown Vendor", "Google Workspace"}


def test_analysis_model(rows):
    def analysis():
        return lambda prompts, max_tokens, temperature: ['{"business_impact":"Big","risk_level":"High"}'] * len(prompts)

    config = CleanConfig(ai_analysis_enabled=True, ai_vendor_enabled=False, ai_category_enabled=False)
    row = clean_transactions(rows, config, models={"analysis": analysis}).first()
    assert (row.description, row.business_impact, row.risk_level) == ("d | Big", "Big", "High")
