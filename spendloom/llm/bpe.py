"""Byte-level BPE ids of whole texts.

The ids are those of the tokenizers library for the same file; the merges are
done by tiktoken over the same vocabulary, which takes a fifth of the time.
"""

from __future__ import annotations

import array
import functools
import json

import tiktoken
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Fixed: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(1)
def byte_pairs(path: str) -> BytePairs:
    """The coder of a file; a Python worker makes it once, not for each task."""
    return BytePairs(path)


class BytePairs:
    def __init__(self, path: str) -> None:
        self._path, self._whole = path, None
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        letters = _bytes_of_letters()
        ranks = {
            bytes(letters[c] for c in piece): i
            for piece, i in vocabulary["model"]["vocab"].items()
            if piece not in special
        }
        self._special = list(special)
        self._merge = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self._special):
            self._whole = self._whole or Tokenizer.from_file(self._path)
            ids = self._whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self._merge.encode_ordinary(text)
        return array.array("I", ids).tobytes()


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary stands for.

    Printable bytes stand for themselves; the others are the letters from 256
    on, in their order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    found = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    if set(found) != set(ByteLevel.alphabet()):
        raise RuntimeError("unknown byte alphabet")
    return found
