import random
import string

import pytest
from pyspark.sql import functions as F

from greedy import near_duplicate_removers
from spendloom.operators.dedup import (
    NearDupSizes,
    drop_exact_duplicates,
    drop_near_duplicates,
    duplicate_report,
    near_duplicate_matches,
    similar_name_groups,
    similar_name_pairs,
)
from spendloom.operators.similar_names import Matcher

SCHEMA = "txn_id long, merchant string, amount double"
TINY = NearDupSizes(split_cell=2, hot_piece=5, first_batch=40, tail_pairs=10)
ROUNDS = NearDupSizes(split_cell=8, first_batch=1000, tail_pairs=0)


def survivors(df, **options):
    return {r.txn_id for r in drop_near_duplicates(df, **options).collect()}


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("Acme Corp", 5.0), ("ACME CORP", 5.0)], {0}),
        ([("Acme Corp", 5.0), ("Acme Corp", 5.02)], {0, 1}),
        ([("Acme Corp", 10.00), ("Acme Corp", 10.01)], {0}),
        ([("Acme Corp", 0.01), ("Acme Corp", 0.02)], {0, 1}),
        ([("", 1.0), ("", 1.0)], {0}),
        ([(None, 1.0), ("none", 1.0), ("None", 1.0)], {0}),
        ([("abcdefghijklmnopqrst", 3.0), ("abcdefghijklmnopqrXY", 3.0),
          ("abcdefghijklmnopWZXY", 3.0)], {0, 2}),
        ([("Acme", float("inf")), ("Acme", float("inf")), ("Acme", float("nan"))], {0, 1, 2}),
        ([("Acme", 1e18), ("Acme", 1e18), ("Acme", 7e13), ("Acme", -1e300)], {0, 2, 3}),
    ],
)
def test_cases(spark, rows, expected):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    assert survivors(df) == expected


def random_rows(seed, n, names, amounts):
    rng = random.Random(seed)
    return [(i, rng.choice(names), rng.choice(amounts)) for i in rng.sample(range(10 * n), n)]


def spellings(seed, bases, per_base, edits):
    rng = random.Random(seed)
    names = []
    for _ in range(bases):
        base = "".join(rng.choice("abcdeé #1") for _ in range(rng.randint(0, 24)))
        for _ in range(per_base):
            name = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randint(0, len(name))
                if rng.random() < 0.5 and name:
                    name.pop(min(at, len(name) - 1))
                else:
                    name.insert(at, rng.choice(string.ascii_letters[:6] + "é "))
            names.append("".join(name))
    return [*names, None, "", "nan"]


@pytest.mark.parametrize("sizes", [NearDupSizes(), TINY, ROUNDS], ids=["default", "tiny", "rounds"])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_greedy_scan(spark, sizes, seed):
    names = spellings(seed, 12, 12, 5)
    rows = random_rows(seed, 400, names, [0.0] * 6 + [10.00, 10.01, 10.02, 10.03, -4.5])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = near_duplicate_removers(rows)
    assert len(expected) > 50
    found = near_duplicate_matches(df, sizes=sizes).collect()
    assert {r.txn_id: r.kept_id for r in found} == expected
    assert len(found) == len(expected)
    assert survivors(df, sizes=sizes) == {r[0] for r in rows} - set(expected)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.7, 0.95])
def test_other_thresholds(spark, threshold):
    rows = random_rows(7, 150, spellings(7, 8, 8, 6), [0.0, 0.0, 5.0, 5.01])
    df = spark.createDataFrame(rows, SCHEMA)
    expected = near_duplicate_removers(rows, threshold)
    assert survivors(df, threshold=threshold, sizes=TINY) == {r[0] for r in rows} - set(expected)


def test_threshold_one_removes_nothing(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0)], SCHEMA)
    assert survivors(df, threshold=1.0) == {0, 1}


def test_scopes_are_independent(spark):
    names = spellings(3, 5, 6, 4)
    rows = random_rows(3, 200, names, [0.0, 0.0, 1.0])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.col("txn_id") % 3)
    expected = set()
    for part in range(3):
        mine = [r for r in rows if r[0] % 3 == part]
        expected |= {r[0] for r in mine} - set(near_duplicate_removers(mine))
    assert survivors(df, scope=["part"], sizes=TINY) == expected


def test_hot_group_of_similar_rows_is_not_paired_with_itself(spark):
    """A third of all rows: numbered spellings of one shop, all without amount."""
    hot = spark.range(3000).select(
        F.col("id").alias("txn_id"),
        F.format_string("pos purchase - coffee house downtown #%05d", "id").alias("merchant"),
        F.lit(0.0).alias("amount"),
    )
    kept = survivors(hot, sizes=NearDupSizes(first_batch=400))
    rows = [tuple(r) for r in hot.collect()]
    assert kept == {r[0] for r in rows} - set(near_duplicate_removers(rows))


@pytest.mark.parametrize("tail_pairs", [60, 100])
def test_long_chain_in_order(spark, tail_pairs):
    """Each row matches the next one only, so rounds settle one row each."""
    rows = [(i, "Meter reading", round(i * 0.006, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {r[0] for r in rows} - set(near_duplicate_removers(rows))
    assert survivors(df, sizes=NearDupSizes(tail_pairs=tail_pairs)) == expected


def test_plan_has_no_pair_loop(spark):
    df = spark.createDataFrame(random_rows(5, 100, spellings(5, 5, 5, 3), [0.0, 1.0]), SCHEMA)
    plan = drop_near_duplicates(df, sizes=TINY)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def nodes_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "_id long, _name string, _amount double" + more).na.fill("none")


def test_keys_are_shuffled_once(spark):
    """One exchange for the keys of both sides, one for distinct pairs; the rest joins rows by number."""
    matcher = Matcher(nodes_of(spark, random_rows(5, 200, spellings(5, 9, 9, 3), [0.0, 1.0])), 0.85, sizes=NearDupSizes(split_cell=2))
    plan = matcher._blocks(matcher.nodes.withColumn("_fresh", F.lit(True)), False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def unlike_names(seed, n):
    """Names of few kinds of letters, some edited a little, with common beginnings and ends."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 20, 32, 47, 60]))) for _ in range(n)]
    for name in names[: n // 3]:
        edited = list(name)
        for _ in range(rng.randint(1, 5)):
            edited[rng.randrange(len(edited))] = rng.choice(["", "0", "x", "ab"])
        names.append("".join(edited))
    return names + [x + " X" for x in names[::3]] + ["pos purchase - " + x for x in names[::5]]


@pytest.mark.parametrize("threshold", [0.7, 0.82, 0.85, 0.93])
def test_every_pair_above_the_threshold_is_found(spark, threshold):
    from difflib import SequenceMatcher

    names = sorted(set(unlike_names(11, 120)))
    rows = [(i, n, 0.0) for i, n in enumerate(names)]
    expected = {
        (a, b) for a, _, _ in rows for b, _, _ in rows
        if a < b and SequenceMatcher(None, names[a], names[b]).ratio() > threshold
    }
    assert len(expected) > 20
    for sizes in (NearDupSizes(split_cell=10), NearDupSizes(split_cell=10, hot_piece=3)):
        matcher = Matcher(nodes_of(spark, rows), threshold, sizes=sizes)
        found = [(r._src, r._dst) for r in matcher.pairs(matcher.nodes).collect()]
        assert set(found) == expected and len(found) == len(expected)


def test_a_low_threshold_of_one_scope_leaves_the_others_alone(spark):
    rows = [(i, n, 0.0, s, 0.85) for s in (1, 2) for i, n in enumerate(unlike_names(s, 60))]
    more = ", part long, own double"
    low = [(i, n, 0.0, 3, 0.0) for i, n in enumerate(unlike_names(3, 30))]

    def met(rows):
        matcher = Matcher(nodes_of(spark, rows, more), "own", ["part", "own"], NearDupSizes(split_cell=10))
        found = matcher._blocks(matcher.nodes.withColumn("_fresh", F.lit(True)), False)
        named = found.join(matcher.nodes.select(F.col("_node").alias("_l_node"), "part"), "_l_node")
        return {r.part: r["count"] for r in named.groupBy("part").count().collect()}

    alone, together = met(rows), met(rows + low)
    assert together.pop(3) > 0 and together == alone


@pytest.mark.parametrize("tail_pairs", [30, 1000])
def test_components_are_read_in_order(spark, tail_pairs):
    """Many chains, each of which takes many rounds, and one that is longer than a task may read."""
    rows = [(1000 * c + i, f"Meter {c}" * 3, round(i * 0.006, 3)) for c in range(12) for i in range(20 if c else 150)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {r[0] for r in rows} - set(near_duplicate_removers(rows, 0.97))
    assert survivors(df, threshold=0.97, sizes=NearDupSizes(tail_pairs=tail_pairs)) == expected


def test_groups_of_names(spark):
    rows = random_rows(4, 150, spellings(4, 8, 8, 3), [1.0])
    first = {}
    for i, n, _ in sorted(rows):
        first.setdefault(("None" if n is None else n).lower(), i)
    removers = near_duplicate_removers([(i, n, 0.0) for n, i in first.items()])
    name_of = {i: n for n, i in first.items()}
    found = similar_name_groups(spark.createDataFrame(rows, SCHEMA), "merchant").collect()
    assert {r.name: r.representative for r in found} == {n: name_of[removers.get(i, i)] for n, i in first.items()}
    assert len(found) == len(first)


def test_exact_duplicates(spark):
    rows = [(3, "a", None, {"k": "1"}), (1, "a", None, {"k": "1"}), (2, "a", "x", {"k": "1"}),
            (4, "a", None, {"k": "2"})]
    df = spark.createDataFrame(rows, "txn_id long, merchant string, memo string, more map<string,string>")
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert {r.txn_id for r in out.collect()} == {1, 2, 4}


def test_report(spark):
    rows = [(0, "Acme", 1.0), (1, "Acme", 1.0), (2, "ACME", 1.0), (3, "Other", 1.0)]
    out = duplicate_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in out] == [(4, 1, 1, 2)]


@pytest.mark.parametrize("sizes", [NearDupSizes(), TINY], ids=["default", "tiny"])
def test_similar_names(spark, sizes):
    from difflib import SequenceMatcher

    names = {("None" if n is None else n).lower() for n in spellings(9, 10, 8, 4)}
    expected = {
        (a, b): SequenceMatcher(None, a, b).ratio()
        for a in names for b in names
        if a < b and SequenceMatcher(None, a, b).ratio() > 0.85
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = similar_name_pairs(df, "name", sizes=sizes).collect()
    assert {(r.first_name, r.second_name): r.score for r in found} == expected
    assert len(found) == len(expected) > 20


@pytest.mark.parametrize("more", [0, 12])
def test_long_chain_is_read_in_ranges(spark, monkeypatch, more):
    """A chain through all ranges, alone or among rows that match several, needs no labels of components."""
    from spendloom.operators import dedup

    monkeypatch.setattr(dedup, "components", lambda links: pytest.fail("components of a chain"))
    rng = random.Random(more)
    rows = [(i, "Meter reading", round(i * 0.006, 3)) for i in range(500)]
    rows += [(500 + i, rng.choice(["Meter reading", "Meter reading."]), rng.randrange(500) * 0.006 + 0.002) for i in range(more)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.col("txn_id") % 1)
    expected = {r[0] for r in rows} - set(near_duplicate_removers(rows))
    assert survivors(df, scope=["part"], sizes=NearDupSizes(tail_pairs=150)) == expected


def test_ranges_agree_with_reading_in_order(spark):
    """Random earlier partners of every kind, in two scopes with the same ids, read in several levels of ranges."""
    from spendloom.operators import dedup

    rng = random.Random(3)
    partners, node = {}, lambda s, i: 1000 * (i % 7) + 2 * i + s
    for s in (0, 1):
        for i in range(1, 400):
            for j in {max(0, i - rng.choice([1, 1, 1, 1, 2, 5])) for _ in range(rng.choice([1, 1, 1, 2]))}:
                partners.setdefault((s, i), set()).add(j)
    pairs = [(s, j, i, node(s, j), node(s, i)) for (s, i), js in partners.items() for j in js]
    df = spark.createDataFrame(pairs, "part long, _src long, _dst long, _src_node long, _dst_node long")
    stays = {}
    for s, i in sorted((s, i) for s in (0, 1) for i in range(400)):
        stays[s, i] = not any(stays[s, j] for j in partners.get((s, i), ()))
    gone = dedup._by_ranges(df, ("part",), len(pairs), 400).collect()
    assert {(r.part, r._id) for r in gone} == {k for k, v in stays.items() if not v}
    assert len(gone) == len({r._node for r in gone})


def test_fresh_rows_are_not_compared_with_each_other(monkeypatch):
    """Across batches a key with f fresh and k kept rows costs f * k comparisons each way, not (f + k) squared."""
    import numpy as np
    import pyarrow as pa

    from spendloom.operators import similar_names

    n, n_kept = 500, 20
    columns = {
        "_length": np.full(2 * n, 8, "int32"), "_node": np.tile(np.arange(n), 2), "_amount": np.zeros(2 * n),
        "_fresh": np.tile(np.arange(n) >= n_kept, 2), "_threshold": np.full(2 * n, 0.85), "_block": np.zeros(2 * n, "int64"),
        "_share": np.zeros(2 * n, "int32"), "_role": np.repeat(np.array([0, 1], "int8"), n),
    }
    columns |= {c: np.zeros(2 * n, "int64") for c in ("_bits", "_bits0", "_bits1", "_bits2", "_bits3")}
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda bits: counted.append(bits.size) or count(bits))
    found = list(similar_names._compare(True)(iter([pa.RecordBatch.from_pydict(columns)])))
    pairs = {(a, b) for batch in found for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    assert pairs == {(a, b) for a in range(n_kept) for b in range(n_kept, n)}
    assert sum(counted) <= 5 * 2 * n_kept * (n - n_kept)
