import json
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from spendloom.config import CleanConfig
from spendloom.functions import fixed
from spendloom.functions.variants import strict_json
from spendloom.plans.cleaning import clean_transactions
from spendloom.plans.payload_configs import clean_payloads, clean_payloads_by_config, own_options
from spendloom.sources import payloads

X = {"merchant": "X", "amount": "50", "description": ""}
ACCEPTED = [
    ('{"data":[{"merchant":"X","amount":50},{"merchant":"Y"}]}',
     [X, {"merchant": "Y", "amount": "", "description": ""}]),
    ('{"merchant":["X","Y"],"amount":[50,25]}',
     [{"merchant": "X", "amount": "50"}, {"merchant": "Y", "amount": "25"}]),
    ('{"transactions":[{"merchant":"X"}]}', [{"merchant": "X", "amount": "0.0", "description": ""}]),
    ('[{"merchant":"X","amount":50}]', [X]),
    ('{"merchant":"X","amount":50}', [X]),
    ('{"data":{"merchant":["X"],"amount":["$1,234.50"]},"config":{"enable_ai":false}}',
     [{"merchant": "X", "amount": "$1,234.50"}]),
    ('{"merchant":["X","Y"],"amount":[1,2],"memo":"m"}',
     [{"merchant": "X", "amount": "1", "memo": "m"}, {"merchant": "Y", "amount": "2", "memo": "m"}]),
    ('{"data":{"data":[{"merchant":"X","amount":50}]}}', [X]),
    ('{"data":{"merchant":"X","amount":50}}', [X]),
    ('{"data":5,"merchant":"X","amount":50}', [{**X, "extra": {"data": "5"}}]),
    ('{"merchant":"X","amount":50,"config":{"a":1}}', [X]),
    ('{"data":{"merchant":"X","amount":50,"config":1}}', [{**X, "extra": {"config": "1"}}]),
    ('{"merchant":["X"]}', [{"merchant": "X", "_has_amount": False}]),
    ('{"merchant":[]}', []),
    ('{"merchant":null,"amount":null}', [{"description": ""}]),
    ('[{"merchant":"X","a b":{"c":[1]}},{"merchant":"Y","memo":null,"z":true}]',
     [{"merchant": "X", "amount": "0.0", "description": "", "memo": "", "extra": {"a b": '{"c":[1]}', "z": ""}},
      {"merchant": "Y", "amount": "0.0", "description": "", "memo": None, "extra": {"a b": "", "z": "true"}}]),
    ('{"merchant":["X",null],"amount":[1,null],"tag":[true,{"k":1}],"n":null}',
     [{"merchant": "X", "amount": "1", "extra": {"tag": "true", "n": None}},
      {"extra": {"tag": '{"k":1}', "n": None}}]),
]
REJECTED = [
    ('{"invalid":"data"}', fixed.REJECT_SHAPE),
    ('{"data":[]}', fixed.REJECT_EMPTY),
    ("[]", fixed.REJECT_EMPTY),
    ('{"data":[{"merchant":"X"},{"amount":1}]}', fixed.REJECT_MERCHANT),
    ('{"data":[{"merchant":"X"},5]}', fixed.REJECT_ITEM),
    ('{"merchant":["X","Y"],"amount":[1]}', fixed.REJECT_SHAPE),
    ("5", fixed.REJECT_TYPE),
    ('"text"', fixed.REJECT_TYPE),
    ("null", fixed.REJECT_TYPE),
    ("{bad", fixed.REJECT_NOT_JSON),
    ("", fixed.REJECT_NOT_JSON),
    (None, fixed.REJECT_NOT_JSON),
    ('{"merchant":"X"} {"merchant":"Y"}', fixed.REJECT_NOT_JSON),
    ('{"merchant":"X"}],[1', fixed.REJECT_NOT_JSON),
]


@pytest.fixture(scope="module")
def read(spark):
    bodies = [b for b, _ in ACCEPTED + REJECTED]
    df = spark.createDataFrame(list(enumerate(bodies)), "payload_id long, body string")
    rows = payloads.transactions(df).orderBy("payload_id", "position").collect()
    return rows, payloads.rejects(df).collect(), payloads.configs(df).collect()


@pytest.mark.parametrize("number", range(len(ACCEPTED)))
def test_accepted(read, number):
    blank = dict.fromkeys(payloads.KNOWN) | {"extra": {}, "_has_amount": True}
    rows = [r.asDict() for r in read[0] if r.payload_id == number]
    assert [r["position"] for r in rows] == list(range(len(rows)))
    found = [{k: r[k] for k in blank} for r in rows]
    assert found == [blank | e for e in ACCEPTED[number][1]]


def test_rejected(read):
    found = {r.payload_id: r.reason for r in read[1]}
    assert found == {len(ACCEPTED) + i: reason for i, (_, reason) in enumerate(REJECTED)}
    assert {r.payload_id for r in read[0]}.isdisjoint(found)


def test_request_tag_and_config(read):
    assert all(r.request_id.startswith("req-") and len(r.request_id) == 12 for r in read[0] + read[1])
    assert {r.payload_id: r.config for r in read[2]} == {5: '{"enable_ai":false}', 10: '{"a":1}'}


def test_reading_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "[]")], "payload_id long, body string")
    for out in (payloads.transactions(df), payloads.rejects(df)):
        assert "Exchange" not in out._jdf.queryExecution().toString()


def test_own_configs(spark):
    records = '[{"merchant":"Amazon","amount":5},{"merchant":"amazon.","amount":5}]'
    bodies = [
        (1, records),
        (2, '{"data":%s,"config":{"enable_ai":false}}' % records),
        (3, '{"data":%s,"config":{"duplicate_threshold":"0.99","enable_ai":false}}' % records),
        (4, '{"data":%s,"config":{"enable_ai":"no"}}' % records),
        (5, '{"data":%s,"config":5}' % records),
        (6, "[]"),
    ]
    df = spark.createDataFrame(bodies, "payload_id long, body string")
    rows, rejects = clean_payloads_by_config(df)
    found = sorted((r.payload_id, r.position, r.merchant, r.category) for r in rows.collect())
    assert found == [
        (1, 0, "Amazon", "Office Supplies & Equipment"),
        (2, 0, "Amazon", "Other"),
        (3, 0, "Amazon", "Other"),
        (3, 1, "amazon.", "Other"),
    ]
    assert {r.payload_id: r.reason for r in rejects.collect()} == {
        4: fixed.REJECT_CONFIG, 5: fixed.REJECT_CONFIG, 6: fixed.REJECT_EMPTY
    }
    nothing, rejects = clean_payloads_by_config(df.filter("payload_id > 3"))
    assert nothing.count() == 0 and rejects.count() == 3


def test_options_of_a_payload_are_read_like_a_config(spark):
    """Every value is accepted or refused as by CleanConfig, with the same result."""
    given = [
        {"duplicate_threshold": v} for v in (0.5, "0.9", 1, -1, "x", None, True, "nan", [1], "1e-1")
    ] + [{"chunk_size": v} for v in (5, "7", 0, "7.5", 7.9, None)] + [{"enable_ai": v} for v in (True, "true", 1, None)]
    given += [{}, {"unknown": 5}, {"chunked": True, "chunk_size": 3}]
    bodies = [(i, json.dumps({"data": [{"merchant": "x"}], "config": c})) for i, c in enumerate(given)]
    df = spark.createDataFrame(bodies, "payload_id long, body string")
    options, valid = own_options(F.col("body"), CleanConfig())
    for row in df.select("payload_id", options.alias("o"), valid.alias("valid")).collect():
        try:
            expected = CleanConfig.from_dict(given[row.payload_id])
        except (TypeError, ValueError):
            expected = None
        assert row.valid == (expected is not None), given[row.payload_id]
        if expected:
            assert row.o.asDict() == {k: v for k, v in asdict(expected).items() if k != "extra"}


def test_a_payload_is_cleaned_as_if_alone(spark):
    body = '{"data":[{"merchant":"Acme","amount":5},{"merchant":"ACME","amount":5},{"merchant":"Acme","amount":5}],"config":{"chunked":true,"chunk_size":2}}'
    alone = clean_payloads(spark.createDataFrame([(1, body)], "payload_id long, body string")).rows
    both = clean_payloads(spark.createDataFrame([(1, body), (2, body)], "payload_id long, body string")).rows
    assert sorted(r.position for r in alone.collect()) == [0, 2]
    assert sorted((r.payload_id, r.position) for r in both.collect()) == [(1, 0), (1, 2), (2, 0), (2, 2)]


def test_own_column_of_the_old_marker_name(spark):
    df = spark.createDataFrame([(1, "x", 5.0, False), (2, "y", 6.0, True)], "txn_id long, merchant string, amount double, has_amount boolean")
    out = {r.txn_id: (r.amount, r.has_amount) for r in clean_transactions(df).collect()}
    assert out == {1: (5.0, False), 2: (6.0, True)}


def test_a_body_is_parsed_once_for_its_rows(spark):
    """Everything after the parsed rows reads the written table."""
    df = spark.createDataFrame([(1, '[{"merchant":"x","amount":1}]')], "payload_id long, body string")
    result = clean_payloads(df)
    for table in (result.rows, result.rejects, result.usage):
        assert "try_parse_json" not in table._jdf.queryExecution().toString().lower()
        assert "parse_json" not in table._jdf.queryExecution().toString().lower()


def test_nothing_hides_behind_a_value(spark):
    """Against Python's parser, for texts whose parts end and go on in every way."""
    values = ['{"a":1}', '[1]', '[{"a":[2]}]', '{"a":{"b":[{}]}}', '{}', '[]', '5', '"}]"', "null", '{"a":"} ]"}', '[[1],[2]]', '{"b":[{"c":1}]}']
    tails = ["", " ", "\n", ",", "]", "}", ",5", ",null", ', {"a":2}', "] x", "} x", "]]", ']} , "v":1', '} , "w":2', ',"w":2', ' ] , [1', " x", "][", ',"v":{"a":1}']
    texts = [lead + v + t for lead in ("", " \t") for v in values for t in tails] + ["", " ", "{", "[", "x"]

    def valid(text):
        try:
            return json.loads(text) is not ...
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "body string")
    found = df.select("body", F.to_json(strict_json(F.col("body"))).alias("v"), strict_json(F.col("body")).isNotNull().alias("ok")).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.ok == valid(r.body), r.body
        assert not r.ok or json.loads(r.v) == json.loads(r.body), r.body


def test_long_payload(spark):
    df = spark.range(1).select(
        F.lit(1).alias("payload_id"),
        F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda i: i.cast("string")).alias("merchant"))).alias("body"),
    )
    out = payloads.transactions(df)
    assert out.agg(F.count("*"), F.count_distinct("merchant"), F.max("position")).first() == (20000, 20000, 19999)


def test_reading_is_spread_and_options_share_the_parsing(spark, monkeypatch):
    """A table that comes as one task is read by as many as a shuffle has, and each body is parsed once."""
    from spendloom.plans import payload_configs

    written = {}
    write = payload_configs.write_shared
    monkeypatch.setattr(payload_configs, "write_shared", lambda df, label: written.update({label: df}) or write(df, label))
    body = F.format_string('{"data":[{"merchant":"x","amount":%d}],"config":{"enable_ai":false}}', "id")
    df = spark.range(200).coalesce(1).select(F.col("id").alias("payload_id"), body.alias("body"))
    clean_payloads(df)
    read = written["payload-rows"]
    assert read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = read._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("parse_json") <= 8
