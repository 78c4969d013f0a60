import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odd import odd_rows
from spendloom.llm import piece_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN, LIBRARY = piece_tokens.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["  ", "the", "ing", "tion", "aaaa", "lllo", "--", "==", "<s>", "▁", *" \n\taBcé日本😀'1٣ſ!\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_ids_are_those_of_the_library(parts):
    text = "".join(parts)
    ids = np.frombuffer(OWN.encode([text])[0], "<u4").tolist()
    assert ids == LIBRARY.encode(text)
    assert OWN.decode(ids) == text.replace("▁", " ")


def test_columns(docs_of):
    rows = odd_rows()
    docs = docs_of(rows)
    found = piece_tokens.decode(piece_tokens.encode(docs, PATH), PATH, to="back")
    assert found.columns == [*docs.columns, "ids", "back"]
    assert found.filter(F.col("back") != F.coalesce("text", F.lit(""))).count() == 0
    for r in found.filter("doc_id < 11").collect():
        assert r.ids == (LIBRARY.encode(r.text) if r.text else [])
    assert piece_tokens.encode(docs_of([]), PATH).count() == 0


def test_the_memory_only_changes_speed():
    small = piece_tokens.Pieces(PATH, most_words=2)
    texts = [t or "" for _, t in odd_rows()]
    assert [small.encode([t])[0] for t in texts] == OWN.encode(texts)


def test_bytes_that_are_no_text():
    assert OWN.decode([OWN.byte_ids[0xFF], OWN.byte_ids[0x41]]) == "�A"
