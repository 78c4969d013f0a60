"""Connected components of a table of links."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.session import write_shared


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (long columns a, b) as rows (node, root).

    root is the smallest node of the component and gives no row itself.  Each
    task first reduces its links to a forest.  Then large-star and small-star
    rounds: each is two grouped minima and two plain joins, so a node with very
    many links is pre-aggregated and split like any skewed join key.  The rounds
    end when the table no longer changes; each is written to the shared folder.
    No links give no rows.
    """
    stars = write_shared(_ordered(links.select("a", "b").mapInArrow(_forests(), "a long, b long")), "links")
    state = _state(stars)
    for _ in itertools.count():
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = write_shared(_ordered(moved.union(small.select("a", F.col("m").alias("b")))), "links")
        before, state = state, _state(stars)
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _forests():
    """Links of each batch from every node to the smallest one that the batch reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
            a, b = at.reshape(2, -1)
            label = np.arange(len(nodes))
            while True:
                before, least = label, np.minimum(label[a], label[b])
                label = label.copy()
                for end in (a, b):
                    np.minimum.at(label, end, least)
                    np.minimum.at(label, before[end], least)
                label = label[label]
                if np.array_equal(label, before):
                    break
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

    # All that the workers need is inside, so they need not have this package.
    return run


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return links.filter("a <> b").select(larger, smaller).distinct()


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    mix = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(mix, 20)), F.bit_xor(mix)).first())
