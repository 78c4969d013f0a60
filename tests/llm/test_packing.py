import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from odd import odd_rows
from spendloom.llm import packing
from spendloom.llm.bpe import BytePairs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*" \n\taBcé日😀'1٣ſ!<|>", "<|endoftext|>", "'s"]), max_size=30))
def test_ids_are_those_of_the_library(parts):
    text = "".join(parts)
    whole = test_ids_are_those_of_the_library.whole
    assert np.frombuffer(test_ids_are_those_of_the_library.own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


test_ids_are_those_of_the_library.whole = Tokenizer.from_file(PATH)
test_ids_are_those_of_the_library.own = BytePairs(PATH)


def check(found, rows, capacity):
    whole = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    sequences = defaultdict(list)
    for r in found:
        pieces = [x[r.start : r.start + r.length] for x in ids[r.doc_id]]
        assert any(len(x) == r.length and zlib.crc32(x.tobytes()) == r.ids_crc32 for x in pieces)
        assert 0 < r.length <= capacity and (r.piece == 0 or r.length == capacity)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in found) == sum(len(x) for xs in ids.values() for x in xs)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r.length for r in found)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_round_trip(docs_of, capacity):
    rows = odd_rows()
    n, total = check(packing.pack_documents(docs_of(rows), PATH, capacity).collect(), rows, capacity)
    assert n <= 1.1 * total / capacity + 2


def test_empty(docs_of):
    assert packing.pack_documents(docs_of([]), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=12))
def test_plans_hold_all_lengths(counts):
    plan = packing.plan_sequences(counts, 20)
    used = Counter()
    for lengths, times in plan:
        assert times > 0 and sum(lengths) <= 20
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)


def test_exact_complements_of_one_two_and_three():
    assert packing.plan_sequences({12: 1, 8: 1}, 20) == [((12, 8), 1)]
    assert packing.plan_sequences({12: 2, 5: 2, 3: 2}, 20) == [((12, 5, 3), 2)]
    assert packing.plan_sequences({11: 1, 4: 1, 3: 1, 2: 1}, 20) == [((11, 4, 3, 2), 1)]
    assert packing.plan_sequences({10: 3}, 20) == [((10, 10), 1), ((10,), 1)]


def test_exact_fillings_never_cost_sequences():
    """The plan is never larger than best-fit alone, holds every piece once and never overflows."""
    import random

    random.seed(12)
    better = 0
    for trial in range(60):
        capacity = random.choice([12, 40, 200])
        lengths = random.sample(range(1, capacity + 1), random.randrange(1, min(capacity, 60)))
        counts = {n: random.choice([1, 2, 3, 50, 1000]) for n in lengths}
        plan = packing.plan_sequences(counts, capacity)
        alone = sum(n for _, n in packing._best_fit(counts, capacity))
        used = {}
        for kind, times in plan:
            assert sum(kind) <= capacity and times > 0
            for n in kind:
                used[n] = used.get(n, 0) + times
        assert used == counts
        better += sum(n for _, n in plan) < alone
        assert sum(n for _, n in plan) <= alone
    assert better


def test_sums_find_every_exact_filling():
    import itertools

    for counts in ({1: 1, 2: 1, 5: 2, 9: 1}, {3: 3, 4: 1}, {7: 1}, {2: 2, 6: 1, 1: 1}):
        pieces = [n for n, c in counts.items() for _ in range(c)]
        for first in counts:
            rest = list(pieces)
            rest.remove(first)
            for gap in range(1, 20):
                reachable = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(rest, k))
                found = packing._Sums(counts, 20).complement(gap, first)
                assert (found is not None) == reachable and (found is None or sum(found) == gap)
