"""The registered queries against SQL or brute force, and the pipeline stage by stage."""

import os

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from oracle import compare, connect
from spendloom.llm import entry
from spendloom.session import write_shared
from test_exact_dedup import lower
from test_packing import check
from test_simhash import fingerprint, roots

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_like_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    kept = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs = write_shared(docs, "stage")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean, distinct, unlike, hidden = kept.values()
    assert toxic <= set(clean) and all(before[d] == t for d, t in clean.items())
    largest = {}
    for d, t in clean.items():
        largest[lower(t)] = max(d, largest.get(lower(t), d))
    assert set(distinct) == set(largest.values())
    ids = sorted(distinct)
    root = roots([fingerprint(distinct[d]) for d in ids])
    assert set(unlike) == {ids[r] for r in set(root)}
    assert set(hidden) == set(unlike)
    assert not any("@mail" in t for t in hidden.values())
    same = [d for d in unlike if hidden[d] == unlike[d]]
    assert len(same) >= 0.5 * len(unlike)
    assert all(hidden[d].count(" ") == unlike[d].count(" ") for d in unlike)
    n, total = check(docs.collect(), list(hidden.items()), 2048)
    assert n <= np.ceil(total / 2048) * 1.05 + 1
    assert os.path.isfile(public_tokenizers.path("byte_bpe_50k.json"))
