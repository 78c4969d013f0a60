"""SentencePiece BPE encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words: runs that start with the word mark and are
never crossed by a piece.  The distinct new words of a batch are sorted, which
puts them in the depth-first order of their trie, and encoded one after another;
the forward states of the prefix that a word shares with the one before it are
kept, so each node of the trie is computed once.

The forward state of a prefix is its best path's last piece.  A path scores by
whether all its neighbouring pieces stand: two pieces stand if merging their
joined text by the model's scores gives just these two.  A sequence whose
neighbours all stand is what merging the whole word gives, and there is one
such path, so the ids equal those of the sentencepiece library.  Characters
that no piece has become byte pieces.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import slices

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class Pieces:
    """A SentencePiece BPE model: identity normaliser, dummy prefix, byte fallback."""

    def __init__(self, path: str, most_words: int = 250_000) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  x") != f"{MARK}ﬁ{MARK}{MARK}x":
            raise ValueError("only models that leave a text as it is, with a dummy prefix")
        self.ids, self.scores, self.bytes_of = {}, {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: Lengths of the longer pieces by their last three characters, the longest first.
        self._longer: dict[str, list[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                self._longer.setdefault(piece[-3:], set()).add(len(piece))
        self._longer = {end: sorted(n, reverse=True) for end, n in self._longer.items()}
        self._lengths: dict[str, list[int]] = {}
        self._stands: dict[int, bool] = {}
        self._whole: dict[str, bool] = {}
        self._memory: dict[str, bytes] = {}
        self._most = most_words

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [_WORDS(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self._memory) > self._most:
            self._memory.clear()
        memory = self._memory
        self._learn(sorted({w for words in split for w in words if w not in memory}))
        return [b"".join([memory[w] for w in words]) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        of = self.bytes_of
        text = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def _candidates(self, end: str) -> list[int]:
        """Lengths of pieces that may end like this (two or three characters)."""
        found = self._longer.get(end, []) if len(end) > 2 else []
        found = found + [2] * (end[-2:] in self.ids and len(end) > 1)
        if len(self._lengths) > 200_000:
            self._lengths.clear()
        self._lengths[end] = found
        return found

    def _stand(self, left: str, piece: str) -> bool:
        return self.merge(left + piece) == [left, piece]

    def _learn(self, words: list[str]) -> None:
        """Encode sorted distinct words, going down and up their trie."""
        before, last, last_id = "", [""], [-1]  # the last piece of the best path of the first i characters
        lengths, stands, whole, ids = self._lengths, self._stands, self._whole, self.ids
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], last_id[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                tail = word[end - 3 : end] if end > 2 else word[:end]
                at = lengths.get(tail)
                if at is None:
                    at = self._candidates(tail)
                for n in at:
                    if n > end:
                        continue
                    piece = word[end - n : end]
                    own = ids.get(piece)
                    if own is None:
                        continue
                    ok = whole.get(piece)
                    if ok is None:
                        ok = whole[piece] = self.merge(piece) == [piece]
                    if not ok:
                        continue
                    left = last[end - n]
                    if not left:
                        break
                    left_id = last_id[end - n]
                    if left_id < 0:  # a character without a piece
                        ok = self._stand(left, piece)
                    else:
                        pair = left_id << 32 | own
                        ok = stands.get(pair)
                        if ok is None:
                            if len(stands) > 500_000:
                                stands.clear()
                            ok = stands[pair] = self._stand(left, piece)
                    if ok:
                        break
                else:
                    piece = word[end - 1]
                    own = ids.get(piece, -1)
                last.append(piece)
                last_id.append(own)
            before = word
            path, at = [], len(word)
            while at:
                path.append(last[at])
                at -= len(last[at])
            self._memory[word] = self._ids(reversed(path))

    def _ids(self, path: Iterable[str]) -> bytes:
        found = array.array("I")
        for piece in path:
            known = self.ids.get(piece)
            if known is None:
                found.extend(self.byte_ids[b] for b in piece.encode())
            else:
                found.append(known)
        return found.tobytes()

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best scored neighbours first, from the left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def encode(docs: DataFrame, model: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with a column ``to`` of the ids of its texts; a null or empty text has none."""

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(model)
        for column in columns:
            found = []
            for part in slices(pa.record_batch([column], ["text"]), "text", 4 << 20):
                found += pieces.encode([t or "" for t in part.column("text").to_pylist()])
            offsets = array.array("i", [0])
            for ids in found:
                offsets.append(offsets[-1] + len(ids) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(found))])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return docs.withColumn(to, run(F.col(text_col)))


def decode(docs: DataFrame, model: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``docs`` with a column ``to`` of the texts of its ids; null ids give the empty text.

    Decoding gives back what was encoded, except that a word mark character in
    a text comes back as a space.
    """

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(model)
        for column in columns:
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            known = column.is_valid().to_pylist()
            spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), known)
            yield pa.array([pieces.decode(values[a:b].tolist() if k else ()) for a, b, k in spans], pa.string())

    return docs.withColumn(to, run(F.col(ids_col)))
