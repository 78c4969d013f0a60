import collections
import random
import re
import zlib

import numpy as np
import pytest

from odd import odd_rows
from spendloom.llm import spelling


def counted(rows, least_letters, least_count, modulus):
    n = collections.Counter()
    for d, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if modulus and h % modulus == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least_letters:
                n[word] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(n, ratio):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def rows_of(seed, size=250):
    random.seed(seed)
    rows = list(odd_rows())
    words = ["".join(random.choice("abcÀéz") for _ in range(random.randrange(4, 11))) for _ in range(60)]
    for i in range(size):
        text = []
        for _ in range(random.randrange(30)):
            word = words[int(random.random() ** 3 * len(words))]
            if random.random() < 0.2:
                at = random.randrange(len(word))
                word = random.choice([word[:at] + word[at + 1 :], word[:at] + "b" + word[at + 1 :], word[:at] + "c" + word[at:]])
            text.append(random.choice([word, word, word.upper() if word.isascii() else word]))
        rows.append((1000 + i, random.choice([" ", "1", "-"]).join(text)))
    rows += [(5000, "q" * 6000 + " " + "q" * 5999 + " " + "q" * 3000 + "r" + "q" * 2999)] * 2
    return rows


@pytest.mark.parametrize("least_letters, least_count, ratio, modulus", [(7, 2, 10, 31), (4, 2, 2, 3), (1, 1, 1000, 0)])
def test_like_brute_force(docs_of, least_letters, least_count, ratio, modulus):
    rows = rows_of(7, 250 if least_letters > 1 else 60)
    options = {"least_letters": least_letters, "least_count": least_count, "modulus": modulus}
    found = spelling.variant_forms(docs_of(rows), ratio=ratio, **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())
    assert found == brute_force(counted(rows, **options), ratio)


@pytest.mark.parametrize("groups, tile", [(1, 3), (2, 16), (6, 1)])
def test_tiles_and_groups_change_nothing(spark, docs_of, groups, tile):
    n = counted(rows_of(8), 4, 1, 0)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r.word, r.n_near, r.best.n, r.best.word) for r in spelling.near_words(words, groups, tile).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = set()
    for w in n:
        near = [x for x in n if is_near(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            expected.add((w, len(near), n[best], best))
    assert found == expected


def test_long_chains_of_forms(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)], "word string, root string")
    assert {r.root for r in spelling.follow(links).collect()} == {"w100"}


def test_distances_of_long_words_are_exact():
    def block(*words):
        return spelling._Block(np.array([list(w.encode("latin-1")) for w in words], np.uint8), np.ones(len(words), np.int64))

    long = "a" * 5000
    i, j = spelling.near_pairs(block(long), block(long + "a", long[:-2] + "bcd", "b" + long))
    assert (i.tolist(), j.tolist()) == ([0, 0], [0, 2])


def test_empty(docs_of):
    assert spelling.variant_forms(docs_of([])).count() == 0
    assert spelling.variant_forms(docs_of([(1, None), (2, "no long word")])).count() == 0
