import array
import random

import public_tokenizers
import pytest
import tiktoken

from odd import odd_rows
from spendloom.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_pairs.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.BytePairCoder(PATH, PATTERN)


def ids(coder, text):
    return array.array("I", coder.encode(text)).tolist()


def test_like_the_library(coder, library):
    random.seed(4)
    parts = ["a", "b", " ", "\n", "'s", "é", "日", "1", "\x1c", "\x85", " ", "́", "\x00", "\t", "th", "ing", "<|endoftext|>"]
    parts += [random.choice(byte_pairs.later_characters()) for _ in range(3)]
    for _ in range(2000):
        text = "".join(random.choice([*parts, "x" * random.randrange(1, 40)]) for _ in range(random.randrange(30)))
        assert ids(coder, text) == library.encode_ordinary(text), text
        assert coder.decode(coder.encode(text)) == text.encode()


def test_very_long_words(coder, library):
    random.seed(5)
    for text in ("a" * 200_000, "ab" * 60_001, " " * 50_000 + "x", "".join(random.choice("abcde") for _ in range(150_000))):
        assert ids(coder, text) == library.encode_ordinary(text)


def test_merges_are_the_leftmost_of_the_lowest_rank(tmp_path):
    """Ranks in any order, where a merge can make a pair of a lower rank than its own."""
    import base64

    random.seed(6)
    for _ in range(40):
        tokens = {bytes([b]) for b in range(256)}
        tokens |= {bytes(random.choice(b"abc") for _ in range(random.randrange(2, 6))) for _ in range(40)}
        tokens = sorted(tokens, key=lambda t: random.random())
        ranks = {t: i for i, t in enumerate(tokens)}
        path = tmp_path / "ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
        coder = byte_pairs.BytePairCoder(str(path), PATTERN)
        for _ in range(30):
            piece = bytes(random.choice(b"abc") for _ in range(random.randrange(1, 25)))
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not pairs:
                    break
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert coder.merge(piece) == [ranks[p] for p in parts]


def test_the_memory_is_bounded(library):
    coder = byte_pairs.BytePairCoder(PATH, PATTERN, most_words=10)
    text = " ".join("word%dx" % i for i in range(200)) + " " + "y" * 100
    assert ids(coder, text) == library.encode_ordinary(text) and len(coder._known) <= 10


def test_round_trip_of_a_table(docs_of, library):
    rows = odd_rows()
    found = byte_pairs.decode(byte_pairs.encode(docs_of(rows), PATH, PATTERN, to="key"), PATH, PATTERN, ids_col="key", to="out")
    assert found.columns == [*docs_of(rows).columns, "out"]
    found = [(r.doc_id, r.text, array.array("I", r.key).tolist(), bytes(r.out)) for r in found.collect()]
    assert sorted(found, key=repr) == sorted([(d, t, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows], key=repr)
    assert byte_pairs.encode(docs_of([]), PATH, PATTERN).count() == 0
