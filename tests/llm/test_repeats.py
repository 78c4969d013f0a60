import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from odd import odd_rows
from spendloom.llm import debruijn_dedup, grams, suffix_dedup


def random_rows(seed, letters="ab c"):
    random.seed(seed)
    base = ["".join(random.choice(letters) for _ in range(200)) for _ in range(5)]
    parts = [
        lambda: random.choice(base)[random.randrange(150) :][: random.randrange(200)],
        lambda: "".join(random.choice("abcdé \n") for _ in range(random.randrange(60))),
        lambda: "a" * random.randrange(60),
        lambda: "xy " * random.randrange(40),
    ]
    rows = [(d, "".join(random.choice(parts)() for _ in range(random.randrange(8)))) for d in range(60)]
    return rows + [(None, base[0]), (61, None)]


def byte_windows(rows, k):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(b[i : i + k] for _, b in texts for i in range(len(b) - k + 1))
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if times[b[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        yield d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def word_windows(rows, k):
    texts = [(float("inf") if d is None else d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - k + 1):
            s = b" ".join(w[i : i + k])
            least[s] = min(d, least.get(s, d))
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[b" ".join(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield None if d == float("inf") else d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "most"), [(20, 1000), (20, 2), (100, 1000), (1, 10)])
def test_suffix_sort_like_brute_force(docs_of, length, most):
    rows = random_rows(length)
    found = suffix_dedup.remove_repeats(docs_of(rows), length=length, most_kinds=most).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == sorted(byte_windows(rows, length), key=repr)


def test_suffix_sort_of_odd_rows(docs_of):
    rows = odd_rows()
    found = suffix_dedup.remove_repeats(docs_of(rows), length=100).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == sorted(byte_windows(rows, 100), key=repr)
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in found)


@pytest.mark.parametrize("words", [13, 3, 1])
def test_word_windows_like_brute_force(docs_of, words):
    for rows in (odd_rows(), random_rows(words)):
        found = debruijn_dedup.remove_repeats(docs_of(rows), words=words).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr) == sorted(word_windows(rows, words), key=repr)


def test_empty(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0
    assert debruijn_dedup.remove_repeats(docs_of([])).count() == 0


def test_suffix_order_is_sorted():
    random.seed(5)
    data = np.frombuffer("".join(random.choice("ab") for _ in range(400)).encode(), np.uint8)
    start = np.array([random.randrange(400) for _ in range(150)])
    size = np.minimum(400 - start, 90)
    order, common = suffix_dedup.suffix_order(data, start, size)
    texts = [data[s : s + n].tobytes() for s, n in zip(start, size)]
    assert [texts[i] for i in order] == sorted(texts)
    for a, b, n in zip(order, order[1:], common):
        x, y = texts[a], texts[b]
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_suffixes_of_other_anchors_are_not_compared(monkeypatch):
    random.seed(6)
    data = np.frombuffer("".join(random.choice("ab") for _ in range(2000)).encode(), np.uint8)
    start = np.array([random.randrange(1900) for _ in range(600)])
    group = np.array([random.randrange(250) for _ in start], np.uint64) << np.uint64(50)
    size = np.full(600, 90)
    asked = []
    starting = grams.Prefix.starting
    monkeypatch.setattr(grams.Prefix, "starting", lambda self, at: asked.append(len(at)) or starting(self, at))
    order, common = suffix_dedup.suffix_order(data, start, size, group)
    found = [(group[i], data[start[i] : start[i] + 90].tobytes()) for i in order]
    assert found == sorted(found) and sorted(order.tolist()) == list(range(600))
    assert [n < 0 for n in common] == [a != b for (a, _), (b, _) in zip(found, found[1:])]
    assert sum(asked) < 2 * 600 * 7  # all 600 in one order ask over 40 times each


@pytest.mark.parametrize(
    ("run", "units", "size", "at_least"), [(suffix_dedup, "byte_units", "length", 100), (debruijn_dedup, "word_units", "words", 13)]
)
def test_documents_without_answers_are_not_cut_again(docs_of, tmp_path, monkeypatch, run, units, size, at_least):
    words = [f"{i:05d}" for i in range(4000)]
    rows = [(d, " ".join(words[100 * d : 100 * d + 100])) for d in range(40)] + [(40, " ".join(words[30:60])), (41, None)]
    cut, log = getattr(run, units), tmp_path / "cut"

    def logged(texts):
        with log.open("a") as file:
            file.write("x" * len(texts))
        return cut(texts)

    monkeypatch.setattr(run, units, logged)
    found = {r.doc_id: r for r in run.remove_repeats(docs_of(rows), **{size: at_least}).collect()}
    assert len(found) == 42 and found[40].n_removed > 0 and found[1].n_removed == 0
    assert found[1].kept_sha256 == hashlib.sha256(rows[1][1].encode()).hexdigest()
    assert 42 < len(log.read_text()) <= 42 + 3 * 2


def test_a_hash_collision_is_cut_to_the_bytes_that_agree():
    data = np.frombuffer(b"abcdeXabcdfY", np.uint8)
    assert suffix_dedup._verified(data, np.array([0]), np.array([6]), np.array([5])).tolist() == [4]


def test_anchors_are_the_leftmost_minimum():
    values = np.array([random.randrange(5) for _ in range(300)], np.uint64)
    for width in (1, 2, 7, 300):
        found = grams._leftmost_minimum(values, width).tolist()
        assert found == [i + int(np.argmin(values[i : i + width])) for i in range(300 - width + 1)]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    units, counts = grams.byte_units([b"abc" * 500, b"", b"xabcabc" * 30])
    whole = grams.pieces(units, counts, 20, 5)
    monkeypatch.setattr(grams, "PART", 64)
    parts = grams.pieces(units, counts, 20, 5)
    assert np.array_equal(np.sort(grams.spread(whole.first, whole.windows)[0]), grams.spread(parts.first, parts.windows)[0])


def test_pieces_do_not_depend_on_the_texts_beside_them(monkeypatch):
    monkeypatch.setattr(grams, "PART", 64)
    random.seed(7)
    texts = ["".join(random.choice("ab c") for _ in range(n)).encode() for n in (50, 300, 7, 0, 63, 64, 65, 40, 129)]
    for units_of, k, q in ((grams.byte_units, 20, 5), (grams.word_units, 3, 2)):
        alone = [grams.pieces(*units_of([t]), k, q) for t in texts]
        for start in range(len(texts)):
            found = grams.pieces(*units_of(texts[start:]), k, q)
            for i, own in enumerate(alone[start:]):
                for name in ("windows", "left", "key", "whole"):
                    assert np.array_equal(getattr(found, name)[found.text == i], getattr(own, name))
