import hashlib
from collections import defaultdict

import pytest

from odd import odd_rows
from spendloom.llm import exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, keep):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    best = {}
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        best[t] = (max(known) if keep == "largest" else min(known)) if known else None
    return sorted(
        ((d, best[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in rows), key=repr
    ), len(groups)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 4])
def test_like_brute_force(docs_of, keep, fan_in):
    rows = odd_rows()
    found = exact_dedup.exact_duplicates(docs_of(rows, 7), keep=keep, fan_in=fan_in).collect()
    wanted, n_groups = expected(rows, keep)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in found), key=repr) == wanted
    kept = [r for r in found if r.kept]
    assert len(kept) == n_groups and all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay_keep_their_columns(docs_of):
    docs = docs_of(odd_rows())
    found = exact_dedup.drop_exact_duplicates(docs)
    assert found.columns == docs.columns
    assert found.count() == expected(odd_rows(), "largest")[1]
    assert len({lower(r.text) for r in found.collect()}) == found.count()


def test_empty(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0


def test_equal_keys_are_told_apart_by_the_whole_digest(spark):
    rows = [(1, 7, b"a" * 32, 1, 0), (2, 7, b"b" * 32, 1, 1), (3, 7, b"a" * 32, 1, 2)]
    runs = spark.createDataFrame(rows, "doc_id long, key long, digest binary, n_bytes long, row long").repartition(3)
    found = exact_dedup.merge_runs(runs, "largest", 2, 4).collect()
    assert sorted((r.keep_id, r.copies) for r in found) == [(2, 1), (3, 2)]
