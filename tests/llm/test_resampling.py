import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import odd_rows
from spendloom.llm import resampling


def features(text, ngrams=1):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def brute_force(rows, target, buckets, ngrams, least, percent, seed="2024"):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = collections.Counter(bucket(f) for _, t in rows for f in features(t, ngrams)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x, ngrams)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out, eligible = [], []
    for at, (d, text) in enumerate(rows):
        words, found = features(text, ngrams)
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
            for b in map(bucket, found)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(found), weight, score, None])
        if len(words) >= least:
            eligible.append((-score, d is None, d or 0, at))
    for rank, (*_, at) in enumerate(sorted(eligible)[: percent * len(eligible) // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("buckets, ngrams, least, percent", [(10_000, 1, 20, 10), (100, 2, 3, 50), (1, 3, 0, 100)])
def test_like_brute_force(spark, docs_of, buckets, ngrams, least, percent):
    rows = odd_rows()
    target = ["alpha beta Gamma, alpha", None, "", "日本 é x x x"]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(docs_of(rows), texts, buckets=buckets, ngrams=ngrams, least_words=least, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    found = sorted(map(tuple, found.collect()), key=repr)
    assert found == brute_force(rows, target, buckets, ngrams, least, percent)


def test_plane_sums_are_exact():
    random.seed(3)
    for gains in ([0], [-1, 5, 0, -70_000, 123_456], [random.randrange(-9000, 9000) for _ in range(200)]):
        planes = resampling.GainPlanes(gains)
        docs = [{random.randrange(len(gains)): random.choice([1, 2, 7, 10**6]) for _ in range(random.randrange(20))} for _ in range(30)]
        where = np.array([b for d in docs for b in d], np.int64)
        times = np.array([n for d in docs for n in d.values()], np.int64)
        found = planes.sums(where, times, np.array([len(d) for d in docs]))
        assert found.tolist() == [sum(n * gains[b] for b, n in d.items()) for d in docs]


def test_ranks_over_many_ranges(spark):
    rows = spark.range(0, 5000, 1, 16).select(
        F.col("id").alias("doc_id"), F.col("id").alias("nth"), F.pmod(F.hash("id"), F.lit(50)).cast("long").alias("score")
    )
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = resampling.draw(rows, F.col("doc_id") % 3 != 0, 30).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    chosen = sorted((-r.score, r.doc_id) for r in found if r.doc_id % 3)
    ranks = {d: i for i, (_, d) in enumerate(chosen[: 30 * len(chosen) // 100], 1)}
    assert {r.doc_id: r.rank for r in found if r["rank"]} == ranks and len(found) == 5000


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs_of([]), none).count() == 0
    found = resampling.resample(docs_of([(1, "a b"), (2, None)]), none, least_words=1, percent=100).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in found} == {(1, 2, 1), (2, 0, None)}
