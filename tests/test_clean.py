import pytest
from pyspark.sql import functions as F

from spendloom.functions import fixed
from spendloom.operators import clean

MONEY = [
    ("50.00", 50.0), ("$1,234.50", 1234.5), ("$ 5", 5.0), ("1e3", 1000.0), ("+5", 5.0), ("-5", -5.0),
    (".5", 0.5), ("5.", 5.0), ("1_000", 0.0), ("0x10", 0.0), ("5-", 0.0), ("(5)", 0.0), ("5 USD", 0.0),
    ("€5", 0.0), ("N/A", 0.0), ("None", 0.0), ("", 0.0), (None, 0.0), ("nan", 0.0), ("1.0d", 0.0),
    ("1f", 0.0), ("0x1p3", 0.0), ("1e999", 0.0), ("inf", 0.0), ("-inf", 0.0), ("Infinity", 0.0),
    ("1 000", 0.0), (" 7 ", 7.0), ("$$1,2,3", 123.0),
]


def test_money_texts(spark):
    df = spark.createDataFrame(MONEY, "amount string, expected double")
    out = clean.parse_amount(df).collect()
    assert [(r.amount, r.expected) for r in out if r.amount != r.expected] == []


def test_money_numbers(spark):
    values = [(1.5,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    out = clean.parse_amount(spark.createDataFrame(values, "amount double"))
    assert [r.amount for r in out.collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]
    whole = clean.parse_amount(spark.range(2).select(F.col("id").alias("amount")))
    assert [r.amount for r in whole.collect()] == [0.0, 1.0]
    assert dict(whole.dtypes)["amount"] == "double"
    flags = spark.createDataFrame([(True,)], "amount boolean")
    assert clean.parse_amount(flags).first().amount == 0.0


def test_white_space_is_that_of_python():
    assert set(fixed.WHITE_SPACE) == {c for c in map(chr, range(0x3100)) if c.isspace()}


def test_trim(spark):
    texts = ["\t a b\n", " x　", "\x1cq\x85", "", "  ", None]
    df = spark.createDataFrame([(t, 1) for t in texts], "merchant string, n int")
    expected = [t if t is None else t.strip() for t in texts]
    assert [r.merchant for r in clean.trim_texts(df).collect()] == expected
    parity = clean.trim_texts(df, stringify_nulls=True).collect()
    assert parity[-1].merchant == "None"
    assert clean.trim_texts(df, skip=["merchant"]).collect() == df.collect()


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, None, 1.0)], "txn_id long, a string, b double")
    assert [r.txn_id for r in clean.drop_empty_rows(df).collect()] == [2, 3]
    assert clean.drop_empty_rows(df.select("txn_id")).count() == 3


def test_fill_and_complete(spark):
    df = spark.createDataFrame([(1, None, None)], "txn_id long, category string, description string")
    row = clean.fill_blanks(df).first()
    assert (row.category, row.description) == ("Other", "No description")
    assert clean.fill_blanks(df.select("txn_id")).columns == ["txn_id"]
    done = clean.complete_columns(df).first()
    assert (done.merchant, done.amount) == ("", 0.0)


@pytest.mark.parametrize("column", ["merchant", "description"])
def test_cleaning_stays_in_the_jvm(spark, column):
    df = spark.createDataFrame([("a", "1", "d")], "merchant string, amount string, description string")
    out = clean.fill_blanks(clean.parse_amount(clean.trim_texts(df))).select(column)
    assert "Python" not in out._jdf.queryExecution().toString()
