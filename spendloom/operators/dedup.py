"""Exact and near duplicate removal.

Near duplicates follow a greedy rule: rows are read in order, and a row that is
still there removes every later row with a similar merchant and the same amount
(less than one cent apart).  A removed row removes nothing.  So for rows A~B
and B~C without A~C, both A and C stay.  That is the first maximal independent
set in row order, found here with joins:

1. Rows of one merchant and amount are reduced to the earliest of them by a
   grouped minimum, which Spark combines before the shuffle.
2. Only rows in touching amount cells are compared, and in a cell with many
   merchants only rows that share a piece of their names (``similar_names``).
3. Bounds on letters, lengths and edits drop pairs before the exact similarity
   runs, once for each distinct pair of names.
4. If cells are large, rows are taken in order in batches of growing size.  A
   batch is first compared with the rows kept so far, so a large group of
   similar rows is removed by its first rows and never paired with itself.
5. Inside a batch the greedy rule is applied to the matching pairs in rounds,
   and to connected components in parallel where rounds settle little.

Nothing is capped: every step only skips pairs that cannot match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.functions.text import compare_name, is_finite
from spendloom.operators.components import components
from spendloom.operators.similar_names import Matcher, NearDupSizes
from spendloom.session import write_shared

# Each batch ends at this many times the rows where the one before it ended.
_GROWTH = 8.0


def drop_exact_duplicates(df: DataFrame, *, order_by: str = "txn_id") -> DataFrame:
    """Keep the earliest of rows that agree in all columns but ``order_by``.

    Nulls are equal to each other.  Maps and variants are compared as JSON.
    """
    others = [c for c in df.columns if c != order_by]
    as_json = {c for c in others if _holds_map(df.schema[c].dataType)}
    keys = [F.to_json(c).alias(f"_key_{c}") if c in as_json else F.col(c) for c in others]
    values = [F.min_by(c, order_by).alias(c) for c in others if c in as_json]
    return df.groupBy(*keys).agg(F.min(order_by).alias(order_by), *values).select(*df.columns)


def _holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_holds_map(f.dataType) for f in data_type.fields)
    return False


def near_duplicates_apply(df: DataFrame, threshold: float) -> bool:
    """No similarity exceeds 1, and without both columns there is no rule."""
    return threshold < 1 and {"merchant", "amount"} <= set(df.columns)


def drop_near_duplicates(
    df: DataFrame,
    *,
    threshold: float = 0.85,
    order_by: str = "txn_id",
    scope: Sequence[str] = (),
    sizes: NearDupSizes = NearDupSizes(),
) -> DataFrame:
    """Rows that survive the greedy rule.  ``amount`` must be numeric.

    ``order_by`` is a whole number, unique within ``scope``; rows of different
    scopes are never compared.
    """
    if not near_duplicates_apply(df, threshold):
        return df
    kept = near_duplicate_survivors(
        df, threshold=threshold, order_by=order_by, scope=scope, sizes=sizes
    )
    return df.join(kept.select(*scope, order_by), [*scope, order_by], "left_semi")


def near_duplicate_survivors(
    df: DataFrame,
    *,
    threshold: float = 0.85,
    order_by: str = "txn_id",
    scope: Sequence[str] = (),
    own_threshold: str | None = None,
    sizes: NearDupSizes = NearDupSizes(),
) -> DataFrame:
    """``(scope, order_by, amount)`` of the surviving rows, as a narrow table.

    ``own_threshold`` names a column of the scope with the scope's threshold,
    which is then used instead of ``threshold``.
    """
    rows, removed, _ = _resolve(df, threshold, order_by, tuple(scope), sizes, own_threshold)
    kept = rows.join(removed, [*scope, "_id"], "left_anti")
    return kept.select(*scope, F.col("_id").alias(order_by), F.col("_amount").alias("amount"))


def drop_duplicates_side_by_side(
    df: DataFrame, *, near: Column, threshold: str, order_by: str, scope: Sequence[str]
) -> DataFrame:
    """Both rules where the rows of a scope follow each other in one partition, in order, as a payload's do.

    Where ``near`` (the same within a scope), rows follow the greedy rule with
    the threshold of that column; elsewhere exact copies go.  Whether a row
    stays depends only on the rows of its scope before it, so the rows are read
    once as they come, without a shuffle.  Each row meets the kept rows of its
    scope: for scopes of few rows.
    """
    schema, scope = df.schema, list(scope)
    others = [
        (F.col(f.name) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
        for f in schema.fields
        if f.name != order_by
    ]
    judged = df.withColumns(
        {
            "_name": F.when(near, compare_name(F.col("merchant"))),
            "_amount": F.col("amount").cast("double"),
            "_copy": F.when(~near, F.to_json(F.struct(*others))),
        }
    )
    read = [*scope, "_name", "_amount", "_copy", threshold]
    columns = schema.fieldNames()

    # All that the workers need is inside, so they need not have this package.
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher
        from math import isfinite

        def alike(first: str, second: str, least: float) -> bool:
            if first == second:
                return True
            both, shorter = len(first) + len(second), min(len(first), len(second))
            if 2.0 * shorter / both <= least:
                return False
            # A name inside the other is matched as a whole; from 200 letters on, frequent ones do not count.
            if len(second) < 200 and (first in second or second in first):
                return True
            matcher = SequenceMatcher(None, first, second)
            return matcher.quick_ratio() > least and matcher.ratio() > least

        at, kept, copies = None, [], set()
        for batch in batches:
            stays = []
            for *of, name, amount, copy, least in zip(*(batch.column(c).to_pylist() for c in read)):
                if of != at:
                    at, kept, copies = of, [], set()
                if name is None:
                    stays.append(copy not in copies)
                    copies.add(copy)
                elif not isfinite(amount):
                    stays.append(True)
                else:
                    new = not any(abs(amount - a) < 0.01 and alike(n, name, least) for n, a in kept)
                    stays.append(new)
                    if new:
                        kept.append((name, amount))
            yield batch.select(columns).filter(pa.array(stays, pa.bool_()))

    return judged.mapInArrow(scan, schema)


def near_duplicate_matches(
    df: DataFrame,
    *,
    threshold: float = 0.85,
    order_by: str = "txn_id",
    scope: Sequence[str] = (),
    sizes: NearDupSizes = NearDupSizes(),
) -> DataFrame:
    """One row per removed row: its id and ``kept_id``, the row that removes it.

    That is the first surviving earlier row that matches it.
    """
    rows, removed, pairs = _resolve(df, threshold, order_by, tuple(scope), sizes)
    removed_as_src = removed.withColumnRenamed("_id", "_src")
    remover = (
        pairs.join(removed_as_src, [*scope, "_src"], "left_anti")
        .groupBy(*scope, F.col("_dst").alias("_id"))
        .agg(F.min("_src").alias("_kept"))
    )
    # A copy of the earliest row goes with it, or else was removed by it.
    first = rows.join(remover, [*scope, "_id"], "left").withColumn(
        "_kept", F.coalesce("_kept", "_id")
    )
    first = first.filter(F.col("_lone").isNull()).drop("_id", "_lone")
    return (
        _rows(df, order_by, scope)
        .join(first, [*scope, "_name", "_amount"])
        .filter(F.col("_id") != F.col("_kept"))
        .select(*scope, F.col("_id").alias(order_by), F.col("_kept").alias("kept_id"))
    )


def duplicate_report(
    df: DataFrame, *, threshold: float = 0.85, order_by: str = "txn_id"
) -> DataFrame:
    """One row: how many rows each stage removes."""
    distinct = drop_exact_duplicates(df, order_by=order_by)
    kept = drop_near_duplicates(df, threshold=threshold, order_by=order_by)
    n_rows, n_distinct, n_kept = (
        t.agg(F.count(F.lit(1))).scalar() for t in (df, distinct, kept)
    )
    return df.sparkSession.range(1).select(
        n_rows.alias("rows_in"),
        (n_rows - n_distinct).alias("exact_removed"),
        (n_distinct - n_kept).alias("near_removed"),
        n_kept.alias("rows_out"),
    )


def similar_name_pairs(
    df: DataFrame, name: str, *, threshold: float = 0.85, sizes: NearDupSizes = NearDupSizes()
) -> DataFrame:
    """Pairs of distinct lower-cased names above the threshold, in text order."""
    distinct = df.select(compare_name(F.col(name)).alias("_name")).distinct()
    matcher = Matcher(distinct.select(F.col("_name").alias("_id"), "_name", F.lit(0.0).alias("_amount")), threshold, sizes=sizes)
    return matcher.pairs(matcher.nodes).select(
        F.col("_src").alias("first_name"),
        F.col("_dst").alias("second_name"),
        F.col("_score").alias("score"),
    )


def similar_name_groups(
    df: DataFrame,
    name: str,
    *,
    threshold: float = 0.85,
    order_by: str = "txn_id",
    sizes: NearDupSizes = NearDupSizes(),
) -> DataFrame:
    """One row per distinct lower-cased name: the name that stands for it.

    Names are read in the order of their first rows by the greedy rule: a name
    that nothing stands for stands for itself and for every later name like it.
    So k spellings give k rows, not k * k pairs.  A null name reads 'none'.

    Returns name, representative.
    """
    names = df.groupBy(compare_name(F.col(name)).alias("merchant")).agg(F.min(order_by).alias(order_by))
    names = write_shared(names.withColumn("amount", F.lit(0.0)), "names")
    found = near_duplicate_matches(names, threshold=threshold, order_by=order_by, sizes=sizes)
    kept = names.select(F.col(order_by).alias("kept_id"), F.col("merchant").alias("representative"))
    found = names.join(found, order_by, "left").withColumn("kept_id", F.coalesce("kept_id", order_by))
    return found.join(kept, "kept_id").select(F.col("merchant").alias("name"), "representative")


# --- the greedy rule -------------------------------------------------------


def _rows(df: DataFrame, order_by: str, scope: Sequence[str]) -> DataFrame:
    """Identity, comparable name and amount of each row.

    A row without a finite amount matches nothing; ``_lone`` keeps it apart.
    """
    amount = F.col("amount").cast("double")
    return df.select(
        *scope,
        F.col(order_by).alias("_id"),
        compare_name(F.col("merchant")).alias("_name"),
        amount.alias("_amount"),
        F.when(~is_finite(amount), F.col(order_by)).alias("_lone"),
    )


def _resolve(
    df: DataFrame,
    threshold: float,
    order_by: str,
    scope: tuple[str, ...],
    sizes: NearDupSizes,
    own_threshold: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Earliest rows per name and amount, which of them go, and matching pairs."""
    spark = df.sparkSession
    rows = write_shared(
        _rows(df, order_by, scope)
        .groupBy(*scope, "_name", "_amount", "_lone")
        .agg(F.min("_id").alias("_id")),
        "earliest-rows",
    )
    matcher = Matcher(rows.filter(F.col("_lone").isNull()).drop("_lone"), own_threshold or threshold, scope, sizes)
    nodes = matcher.nodes
    removed = spark.createDataFrame([], T.StructType([nodes.schema[c] for c in (*scope, "_id", "_node")]))
    pairs = kept = None
    batches = list(_batches(nodes, matcher.largest_cell, sizes))
    for batch in batches:
        if kept is not None:
            both = kept.withColumn("_fresh", F.lit(False)).unionByName(batch.withColumn("_fresh", F.lit(True)))
            found = write_shared(matcher.pairs(both, across=True).drop("_score"), "pairs-with-kept")
            pairs = pairs.unionByName(found)
            gone = _gone(found, scope)
            removed = removed.unionByName(gone)
            batch = write_shared(batch.join(gone.select("_node"), "_node", "left_anti"), "batch")
        found = write_shared(matcher.pairs(batch).drop("_score"), "pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
        gone = _greedy(found, scope, sizes.tail_pairs)
        staying = batch.join(gone.select("_node"), "_node", "left_anti")
        if len(batches) > 1:
            gone, staying = write_shared(gone, "removed"), write_shared(staying, "kept")
        removed = removed.unionByName(gone)
        kept = staying if kept is None else kept.unionByName(staying)
    return rows, removed.select(*scope, "_id"), pairs.select(*scope, "_src", "_dst")


def _batches(nodes: DataFrame, largest_cell: int, sizes: NearDupSizes) -> Iterator[DataFrame]:
    """Rows in order, in growing batches, starting small if a cell is large."""
    steps = max(0, math.ceil(math.log(max(1, largest_cell) / sizes.first_batch, _GROWTH)))
    if not steps:
        yield nodes
        return
    shares = [_GROWTH**-k for k in range(steps, 0, -1)]
    # Any bounds are right; approximate ones only make uneven batches.
    bounds = nodes.agg(F.percentile_approx("_id", shares)).first()[0]
    previous = None
    for bound in [*sorted(set(bounds)), None]:
        part = nodes
        if previous is not None:
            part = part.filter(F.col("_id") > previous)
        if bound is not None:
            part = part.filter(F.col("_id") <= bound)
        previous = bound
        yield part


def _gone(pairs: DataFrame, scope: Sequence[str]) -> DataFrame:
    return pairs.select(*scope, F.col("_dst").alias("_id"), F.col("_dst_node").alias("_node")).distinct()


def _greedy(pairs: DataFrame, scope: tuple[str, ...], tail_pairs: int) -> DataFrame:
    """Rows removed by the greedy rule (scope, _id, _node), from pairs ``_src`` earlier than ``_dst``.

    A round settles the rows that no open row precedes: they stay, and what
    they match goes.  Groups of alike rows need one round.  What settles slowly,
    as long chains of rows do, is read in ranges (``_by_ranges``).  If that leaves
    too much open, it is divided into connected components, and each
    component is read in order by itself, all of them in parallel.  Of components
    with more than ``tail_pairs`` pairs the earliest pairs are read, then the
    rounds go on.
    """
    settled = []

    def settle(open_pairs: DataFrame, gone: DataFrame) -> tuple[DataFrame, int]:
        gone = write_shared(gone, "removed")
        settled.append(gone)
        for end in ("_dst_node", "_src_node"):
            open_pairs = open_pairs.join(gone.select(F.col("_node").alias(end)), end, "left_anti")
        open_pairs = write_shared(open_pairs, "open-pairs")
        return open_pairs, open_pairs.count()

    open_pairs, n_open = pairs, pairs.count()
    while n_open:
        before = n_open
        later = open_pairs.select(F.col("_dst_node").alias("_src_node")).distinct()
        first = open_pairs.select("_src_node").distinct().join(later, "_src_node", "left_anti")
        open_pairs, n_open = settle(open_pairs, _gone(open_pairs.join(first, "_src_node", "left_semi"), scope))
        if not tail_pairs or 2 * n_open <= before:
            continue
        by_ranges = _by_ranges(open_pairs, scope, n_open, tail_pairs)
        if by_ranges is not None:
            settled.append(by_ranges)
            break
        # Links of rows that follow each other come together, so chains shrink within a task.
        links = open_pairs.repartitionByRange("_src").sortWithinPartitions("_src")
        roots = components(links.select(F.col("_src_node").alias("a"), F.col("_dst_node").alias("b")))
        roots = roots.select(F.col("node").alias("_src_node"), F.col("root").alias("_root"))
        whole = open_pairs.join(roots, "_src_node", "left").withColumn("_root", F.coalesce("_root", "_src_node"))
        whole = write_shared(whole, "components")
        large = whole.groupBy("_root").count().filter(F.col("count") > tail_pairs)
        large = write_shared(large, "large-components")
        gone = write_shared(_in_order(whole.join(large, "_root", "left_anti"), scope), "removed")
        settled.append(gone)
        most = large.agg(F.max("count")).first()[0]
        if most is None:
            break
        rest = whole.join(large.select("_root"), "_root", "left_semi")
        # Any bound is right, as a row's fate follows from the pairs of earlier rows alone.
        bounds = rest.groupBy("_root").agg(F.percentile_approx("_src", tail_pairs / most).alias("_bound"))
        rest = rest.join(bounds, "_root")
        early = F.col("_src") <= F.col("_bound")
        gone = _in_order(rest.filter(early), scope)
        open_pairs, n_open = settle(rest.filter(~early).drop("_root", "_bound"), gone)
    if not settled:
        return _gone(pairs, scope)
    return reduce(DataFrame.unionByName, settled)


def _by_ranges(pairs: DataFrame, scope: tuple[str, ...], n_pairs: int, tail_pairs: int) -> DataFrame | None:
    """The rows that go, or None if ranges settle too little.

    A row stays if none of its earlier partners stays.  All ranges of rows are
    read in order at once.  What a range does not know is the fate of rows of
    earlier ranges; a row that follows such a fate, or its opposite, is written
    with that row, and a row that needs several of them with all of them.  Only
    the rows that others are written with, and those that need several, are left
    for the next reading in fewer ranges.  A chain that crosses all ranges leaves
    one row in each.
    """
    place = [*scope, "_dst", "_dst_node"]
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_pairs // tail_pairs))
    rows = pairs.select(*place, "_src", "_src_node", F.lit(False).alias("_same"), F.lit(_SEVERAL).alias("_state"))

    def solve(rows: DataFrame, n: int, parts: int) -> DataFrame | None:
        found = write_shared(_read_range(rows, scope, parts), "range-fates")
        known = found.filter(F.col("_state") <= _STAYS).select(*place, (F.col("_state") == _STAYS).alias("_stays"))
        if parts == 1:
            return known
        follows, several = found.filter(F.col("_state") == _FOLLOWS), found.filter(F.col("_state") == _SEVERAL)
        asked = follows.unionByName(several).select(F.col("_src_node").alias("_dst_node")).distinct()
        left = several.unionByName(found.filter(F.col("_state") < _SEVERAL).join(asked, "_dst_node", "left_semi"))
        left = write_shared(left.select(*rows.columns), "open-fates")
        n_left = left.count()
        if n_left > tail_pairs and 2 * n_left > n:
            return None
        fewer = 1 if n_left <= tail_pairs else max(-(-parts * n_left // n), -(-n_left // tail_pairs))
        fates = solve(left, n_left, fewer)
        if fates is None:
            return None
        fates = write_shared(fates.select("_dst_node", "_stays"), "fates")
        # A row that is asked for and has no earlier partner stays.
        stays = F.coalesce("_stays", F.lit(True)) == F.col("_same")
        follows = follows.join(fates.select(F.col("_dst_node").alias("_src_node"), "_stays"), "_src_node", "left")
        several = several.select(*place).distinct().join(fates, "_dst_node")
        return known.unionByName(follows.select(*place, stays.alias("_stays"))).unionByName(several)

    fates = solve(rows, n_pairs, parts)
    if fates is None:
        return None
    return fates.filter(~F.col("_stays")).select(*scope, F.col("_dst").alias("_id"), F.col("_dst_node").alias("_node"))


#: What a range tells of a row: it goes, it stays, it follows the fate of another row or of several.
_GOES, _STAYS, _FOLLOWS, _SEVERAL = range(4)


def _read_range(rows: DataFrame, scope: tuple[str, ...], parts: int) -> DataFrame:
    """Each range in order: one line for a row whose fate is known or follows another's, else one per condition.

    A line of ``rows`` is a condition of the row _dst_node: that _src_node stays
    (_same) or that it does not; or the row's fate, if _state tells it.
    """
    schema = rows.schema
    # Inside the workers there need not be this package.
    goes, stays, one, several = _GOES, _STAYS, _FOLLOWS, _SEVERAL
    names, scope, whole = schema.fieldNames(), list(scope), parts == 1

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fates, begin, last, conditions, out = {}, None, None, {}, []

        def finish() -> None:
            of_scope, dst, node = last
            if conditions is None:
                fates[node] = False
                out.append((*of_scope, dst, node, dst, node, False, goes))
            elif not conditions:
                fates[node] = True
                out.append((*of_scope, dst, node, dst, node, False, stays))
            elif len(conditions) == 1:
                ((src_node, (src, same)),) = conditions.items()
                fates[node] = src, src_node, same
                out.append((*of_scope, dst, node, src, src_node, same, one))
            else:
                fates[node] = dst, node, True
                out.extend((*of_scope, dst, node, src, n, same, several) for n, (src, same) in conditions.items())

        for frame in frames:
            scopes = zip(*(frame[c].tolist() for c in scope)) if scope else [()] * len(frame)
            columns = (frame[c].tolist() for c in ("_dst", "_dst_node", "_src", "_src_node", "_same", "_state"))
            for of_scope, dst, node, src, src_node, same, state in zip(scopes, *columns):
                if begin is None:
                    begin = of_scope, dst
                if last is None or last[2] != node:
                    if last is not None:
                        finish()
                    last, conditions = (of_scope, dst, node), {}
                if conditions is None or state == stays:
                    continue
                if state == goes:
                    conditions = None
                    continue
                fate = fates.get(src_node)
                if fate is None:
                    # A row of this range that was not read has no earlier partner.
                    here = whole or of_scope != begin[0] or src >= begin[1]
                    fate = True if here else (src, src_node, True)
                if isinstance(fate, bool):
                    if fate != same:
                        conditions = None
                    continue
                at, of, alike = fate
                alike = alike == same
                if conditions.setdefault(of, (at, alike))[1] != alike:
                    conditions = None
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if last is not None:
            finish()
            yield pd.DataFrame(out, columns=names)

    place = [*scope, "_dst", "_dst_node"]
    spread = rows.repartition(1) if whole else rows.repartitionByRange(parts, *place)
    return spread.sortWithinPartitions(*place).mapInPandas(scan, schema)


def _in_order(pairs: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """The rows that go, from whole components (_root) whose pairs are read in order."""
    schema = _gone(pairs, scope).schema

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, gone = None, set()
        for frame in frames:
            found = []
            for at, (of, earlier, later) in enumerate(zip(frame["_root"], frame["_src_node"], frame["_dst_node"])):
                if of != root:
                    root, gone = of, set()
                if earlier not in gone and later not in gone:
                    gone.add(later)
                    found.append(at)
            rows = frame.iloc[found].rename(columns={"_dst": "_id", "_dst_node": "_node"})
            yield rows[schema.fieldNames()]

    spread = pairs.repartition("_root").sortWithinPartitions("_root", "_src", "_dst")
    return spread.mapInPandas(scan, schema)
