import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from greedy import near_duplicate_removers
from spendloom.functions.similarity import similarity
from spendloom.operators import name_index
from spendloom.operators.dedup import NearDupSizes, drop_near_duplicates, near_duplicate_matches
from spendloom.operators.similar_names import Matcher

#: Every cell of more than two names is searched by segments, in many small tiles.
INDEXED = NearDupSizes(split_cell=2, index_cell=2, tile=30, few_pairs=0, first_batch=40, tail_pairs=50)


def edited(rng, name, edits, letters):
    name = list(name)
    for _ in range(edits):
        at = rng.randint(0, len(name))
        name[at : at + rng.choice([0, 0, 1])] = rng.choice(["", rng.choice(letters)])
    return "".join(name)


def alike_names(seed, bases, per_base, longest=44):
    rng, names = random.Random(seed), []
    for n in range(bases):
        letters = ["ab", "0123456789abcdef", "abcdefgh é中#"][n % 3]
        base = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        names += [edited(rng, base, rng.randint(0, 2 + len(base) // 5), letters) for _ in range(per_base)]
    return names


def common_letters(first, second):
    """Letters in the longest common subsequence: no fewer than similarity matches."""
    row = [0] * (len(second) + 1)
    for x in first:
        before = 0
        for j, y in enumerate(second, 1):
            row[j], before = before + 1 if x == y else max(row[j], row[j - 1]), row[j]
    return row[-1]


def unit(names, homes, fresh, tiles, threshold):
    rows = [(0, h, i, n, 0.0, f, threshold) for i, (n, h, f) in enumerate(zip(names, homes, fresh))]
    columns = ["_group", "_home", "_node", "_name", "_amount", "_fresh", "_threshold"]
    batch = pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*sorted(rows, key=lambda r: r[5]))))))
    packed = pa.Table.from_batches(list(name_index._pack(6)(iter([batch])))).to_pylist()
    for k, part in enumerate(packed):
        part["_tile"] = k % tiles
    return packed


def met(packed, tiles, across):
    """What the units of all pairs of tiles find."""
    meet, found = name_index._meet(across, 0), []
    for first in range(tiles):
        for second in range(0 if across else first, tiles):
            parts = []
            for part in packed:
                for side, t in enumerate((first, second)):
                    fits = part["_tile"] == t and (part["_fresh"] == (side == 0) if across else side == 0 or first < second)
                    if fits:
                        parts.append({**part, "_first": first, "_second": second, "_side": bool(side)})
            if parts:
                out = meet(pa.Table.from_pylist(parts))
                found += [tuple(sorted(p)) for p in zip(out["_l_node"].to_pylist(), out["_r_node"].to_pylist())]
    return found


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.91, 0.97])
def test_every_pair_that_may_be_similar_meets_once(threshold, across):
    rng = random.Random(int(threshold * 100))
    names = alike_names(int(threshold * 100), 12, 12)
    homes = [rng.random() < 0.9 for _ in names]
    fresh = [not across or rng.random() < 0.5 for _ in names]
    tiles = 2 if across else 3
    found = met(unit(names, homes, fresh, tiles, threshold), tiles, across)
    expected = set()
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            # The shorter, or the earlier of equally long ones, is at home; or both are.
            ahead = len(a) < len(b) or len(a) == len(b) and (i < j or homes[j])
            if i != j and homes[i] and ahead and not (across and fresh[i] == fresh[j]):
                if 2 * common_letters(a, b) > threshold * (len(a) + len(b)):
                    expected.add((min(i, j), max(i, j)))
    assert len(found) == len(set(found)) and expected <= set(found) and len(expected) > 50


def test_unlike_names_are_not_compared(monkeypatch):
    """Of 3,000 unlike names each is compared with itself, as it finds its own segments, and few others."""
    rng = random.Random(5)
    names = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(3000)]
    packed = unit(names, [True] * len(names), [True] * len(names), 1, 0.85)
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda bits: counted.append(bits.size) or count(bits))
    assert met(packed, 1, False) == []
    assert sum(counted) < 100 * len(names)


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.93])
def test_same_as_greedy_scan(spark, threshold):
    rng = random.Random(8)
    names = [*alike_names(8, 9, 12), *alike_names(9, 3, 8, longest=70), None, "", "nan"]
    amounts = [0.0] * 6 + [10.00, 10.01, 10.02, 10.03, -4.5]
    rows = [(i, rng.choice(names), rng.choice(amounts)) for i in rng.sample(range(4000), 350)]
    df = spark.createDataFrame(rows, "txn_id long, merchant string, amount double").repartition(3)
    expected = near_duplicate_removers(rows, threshold)
    assert len(expected) > 50
    found = near_duplicate_matches(df, threshold=threshold, sizes=INDEXED).collect()
    assert {r.txn_id: r.kept_id for r in found} == expected and len(found) == len(expected)


def test_scopes_with_thresholds_of_their_own(spark):
    names = alike_names(3, 8, 10)
    rows = [(1000 * s + i, n, 0.0, s, t) for s, t in ((1, 0.85), (2, 0.95), (3, 0.5)) for i, n in enumerate(names)]
    nodes = spark.createDataFrame(sorted(set(rows)), "_id long, _name string, _amount double, part long, own double")
    matcher = Matcher(nodes, "own", ["part", "own"], INDEXED)
    found = [(r._src, r._dst) for r in matcher.pairs(matcher.nodes).collect()]
    expected = {
        (a[0], b[0]) for a in rows for b in rows
        if a[3] == b[3] and a[0] < b[0] and (a[1] == b[1] or SequenceMatcher(None, a[1], b[1]).ratio() > a[4])
    }
    assert set(found) == expected and len(found) == len(expected)
    assert matcher.plan.filter("_group IS NOT NULL").select("part").distinct().count() == 2


def test_names_of_an_indexed_cell_have_no_keys(spark):
    """Unlike names without an amount: no key of theirs is shuffled.  Where all share a segment, pieces are used."""
    rows = spark.range(3000).select(F.col("id").alias("_id"), F.md5(F.col("id").cast("string")).alias("_name"), F.lit(0.0).alias("_amount"))
    sizes = NearDupSizes(index_cell=1000)
    matcher = Matcher(rows, 0.85, sizes=sizes)
    assert matcher.any_indexed and not matcher.any_small
    assert matcher.nodes.filter("size(_blocks) + size(_longer_blocks) > 0").isEmpty()
    shop = rows.withColumn("_name", F.concat(F.lit("pos purchase - coffee house"), F.substring("_name", 1, 5)))
    assert not Matcher(shop, 0.85, sizes=sizes).any_indexed


def test_hot_cell_of_unlike_names(spark):
    rows = spark.range(1200).select(
        F.col("id").alias("txn_id"),
        F.concat(F.md5(F.floor(F.col("id") / 4).cast("string")), F.element_at(F.array(*map(F.lit, ("", ".", " X", ""))), (F.col("id") % 4 + 1).cast("int"))).alias("merchant"),
        F.lit(0.0).alias("amount"),
    )
    kept = drop_near_duplicates(rows, sizes=NearDupSizes(index_cell=100, tile=200, few_pairs=1000)).select("txn_id").collect()
    assert sorted(r.txn_id for r in kept) == list(range(0, 1200, 4))


def test_a_name_inside_the_other(spark):
    rows = [("", ""), ("", "a"), ("a", ""), ("abc", "xabcx"), ("xabcx", "abc"), ("ab" * 150, "ab" * 140), ("b" * 250, "ab" + "b" * 250)]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity("a", "b").alias("r")).collect()
    assert [r.r for r in found] == [SequenceMatcher(None, r.a, r.b).ratio() for r in found]
