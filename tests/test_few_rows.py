import json
import random

import pytest
from pyspark.sql import functions as F

from spendloom.operators import order
from spendloom.operators.insights import insights
from spendloom.plans import cleaning
from spendloom.plans.payload_configs import clean_payloads, payload_insights
from spendloom.session import write_shared

NAMES = ["Acme", "ACME", "acme.", "Acme X", " acme ", "Amazon", "Amazon Mktplace", "amazon mktplce", "B", "", None, "x" * 150 + "y" * 60, "x" * 150 + "z" * 60, "y" * 60]


def bodies():
    """Payloads of all kinds, among them some with more rows than are judged in place."""
    rng = random.Random(5)
    for i in range(60):
        n = rng.choice([1, 2, 3, 5, 9, 40])
        names = [rng.choice(NAMES) for _ in range(n)]
        config = {
            "duplicate_threshold": rng.choice([0, 0.5, 0.85, "0.9", 1]), "chunked": rng.random() < 0.3, "chunk_size": rng.choice([2, 3]),
            "enable_ai": rng.random() < 0.5, "stringify_nulls": rng.random() < 0.2, "outlier_z_threshold": 0.5,
        }
        amounts = [rng.choice([5, 5.004, "5.009", "$6", "-0", 0, "n/a", None, 1e400]) for _ in range(n)]
        notes = [rng.choice([" a", "a", None]) for _ in range(n)]
        data = {"merchant": names, "note": notes}
        if i % 5:
            data["amount"] = amounts
        if i % 2:
            data = [dict(zip(data, values)) for values in zip(*data.values())]
        yield i, json.dumps({"data": data, "config": config}).replace("Infinity", "1e400")


@pytest.fixture(scope="module")
def both(spark):
    """The same payloads judged in place, and by the way of a table of any size."""
    df = spark.createDataFrame(list(bodies()), "payload_id long, body string")
    found, few = [], cleaning.FEW_ROWS
    for cleaning.FEW_ROWS in (few, -1):
        result = clean_payloads(df)
        rows = write_shared(result.rows, "rows")
        found.append((rows, result.usage, payload_insights(rows, result.usage)))
    cleaning.FEW_ROWS = few
    return found


def values(df, digits=9):
    as_text = [F.to_json(F.struct(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])).alias("row")]
    return sorted(r.row for r in df.select(*as_text).collect())


def test_few_rows_are_judged_like_a_table(both):
    here, there = (values(rows) for rows, _, _ in both)
    assert here == there and len(here) > 100


def test_usage_and_insights_agree(both):
    for k in (1, 2):
        assert values(both[0][k], 6) == values(both[1][k], 6)


def test_few_rows_need_no_shuffle(spark, monkeypatch):
    written = {}
    write = cleaning.write_shared
    monkeypatch.setattr(cleaning, "write_shared", lambda df, label: written.update({label: df}) or write(df, label))
    df = spark.createDataFrame(list(bodies())[:5], "payload_id long, body string").filter("length(body) < 400")
    clean_payloads(df)
    assert set(written) == {"kept-rows"}
    assert "Exchange" not in written["kept-rows"]._jdf.queryExecution().executedPlan().toString()


def test_positions_need_no_ranges(spark):
    rows = spark.range(3).select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("at"))
    options = {"chunk_size": 3, "order_by": "at", "scope": ["p"]}
    assert values(order.add_chunk(rows, numbered=True, **options)) == values(order.add_chunk(rows, **options))
    assert "Exchange" not in order.add_chunk(rows, numbered=True, **options)._jdf.queryExecution().executedPlan().toString()


def test_usage_is_joined_once(both):
    plan = both[0][1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_counts_of_a_small_scope_share_its_exchange(both):
    """As many exchanges as counts, and the same insights."""
    rows, usage, _ = both[0]
    usage = usage.drop("cleaner_version")
    plain, small = (insights(rows, usage, scope=["payload_id"], small_scopes=s) for s in (False, True))
    assert values(plain) == values(small)
    shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (plain, small)]
    assert shuffles[1] < shuffles[0]
