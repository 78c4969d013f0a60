import random
import re

import numpy as np
import xxhash

from odd import odd_rows
from spendloom.llm import common, simhash_dedup


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, radius=3):
    found = list(range(len(prints)))
    prints = np.array(prints, np.uint64)
    while True:
        before = list(found)
        for i in range(len(prints)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius)
            least = min(found[j] for j in near)
            for j in near:
                found[j] = least
        if found == before:
            return found


def test_fingerprints(docs_of):
    rows = odd_rows()
    found = simhash_dedup.fingerprints(docs_of(rows)).collect()
    wanted = sorted(((d, fingerprint(t)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.fingerprint % (1 << 64)) for r in found), key=repr) == wanted


def test_components_like_brute_force(docs_of):
    rows = [(d, t) for d, t in odd_rows(3) if d is not None]
    rows += [(500 + i, " ".join(["word%d" % (j % 97) for j in range(400)] + ["w%d" % i] * (i % 3))) for i in range(20)]
    found = {(r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(docs_of(rows)).collect()}
    root = roots([fingerprint(t) for _, t in rows])
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min(d, least.get(r, d))
    assert found == {(d, least[r]) for (d, _), r in zip(rows, root)}


def test_close_links_connect_what_is_close(spark):
    random.seed(4)
    prints = [random.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains of near prints
        prints.append(random.choice(prints) ^ sum(1 << b for b in random.sample(range(64), random.randrange(1, 6))))
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    links = simhash_dedup.close_links(table, tile=8)
    found = {r.node: r.root for r in common.components(links).collect()}
    root = roots(prints)
    groups = {}
    for p, r in zip(signed, root):
        groups.setdefault(r, []).append(p)
    assert found == {p: min(g) for g in groups.values() for p in g if p != min(g)}


def test_one_of_each_group_stays(docs_of):
    rows = [(d, t) for d, t in odd_rows() if d is not None]
    docs = docs_of(rows)
    stay = simhash_dedup.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    root = roots([fingerprint(t) for _, t in rows])
    assert stay.count() == len(set(root))


def test_empty(docs_of):
    assert simhash_dedup.near_duplicates(docs_of([])).count() == 0


def test_null_and_equal_ids_with_unlike_texts_stay(docs_of):
    texts = [" ".join("t%d_%d" % (i, j) for j in range(60)) for i in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3])]
    found = simhash_dedup.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(
        [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], key=repr
    )
