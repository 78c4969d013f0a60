"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


OWN = sorted(n for n in entry.queries() if n != "pipeline" and not n.startswith("op"))


def test_every_own_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_payload_shapes_are_json_but_the_broken_ones(con):
    """Shapes 11 and 13 alone hold no JSON object or list; shape 5 brings the config."""
    import json

    import entry_sql

    for payload_id, body in con.execute(entry_sql.PAYLOADS).fetchall():
        if payload_id % 14 not in (11, 13):
            found = json.loads(body)
            assert payload_id % 14 != 5 or found["config"] == {"enable_ai": False}
