"""Repeated word windows by a compacted De Bruijn graph.

The edges of the graph are the windows of ``words`` words; each leads from its
first words to its last.  A piece (windows with one anchor, see ``grams``) is a
path of edges.  Pieces repeated as a whole are compacted: they are one path,
known by the hash of all its words, and their windows are settled together.
Pieces that share an anchor but differ, where the graph branches or a document
ends, are opened into their single edges, which meet by their own hashes.  The
paths of a document that are joined end to end are its long repeated spans; they
are rebuilt from the coordinates of their pieces in the document's own text.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendloom.llm import repeats
from spendloom.llm.grams import Prefix, covered, mix, pieces, spread, word_units
from spendloom.llm.repeats import NO_ID, OPEN, SETTLED, Answers

WORDS, ANCHOR = 13, 5
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start long, length long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Words of each document covered by windows that a smaller doc_id has.

    A window is ``words`` consecutive words (runs without ASCII white space) of
    one document; all windows are judged on the input.  Null texts have no
    words; shorter texts have no windows.  A null id counts as larger than any
    other; rows with equal ids do not remove each other's words.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    a space) and spans: the removed runs as word places.
    """
    anchor = max(1, min(ANCHOR, words))
    parts = repeats.parts_for(docs, text_col)
    rows = repeats.rows_of(docs, id_col, text_col)
    found = repeats.piece_rows(rows, word_units, words, anchor, parts)
    told = repeats.keep_table(repeats.answers(found, repeats.decide_pieces(True, 0), parts), "pieces")
    texts = repeats.text_rows(rows, parts)

    def open_windows(texts: pa.Table, told: pa.Table) -> pa.Table:
        answers, out = Answers(told), []
        for ids, own in repeats.texts_of(texts, answers.told):
            units, counts = word_units(own)
            found = pieces(units, counts, words, anchor)
            code = answers.code(ids[found.text], found.whole)
            opened = np.flatnonzero(code & (2 * OPEN))
            first, piece = spread(found.first[opened], found.windows[opened])
            key = mix(Prefix(units).of(first, first + words))
            bucket = (key >> np.uint64(40)).astype(np.int64) % parts
            out += repeats.cut(bucket, key, ids[found.text[opened]][piece])
        return pa.Table.from_batches([repeats.packed(["bucket", "key", "id"], list(repeats.together(out)))])

    edges = repeats.with_answers(texts, told, open_windows, "bucket int, key binary, id binary")
    single = repeats.keep_table(repeats.answers(edges, repeats.decide_windows(True), parts), "windows")

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        answers, out = Answers(told), []
        for ids, own in repeats.texts_of(texts, answers.untold):
            for doc_id, text in zip(ids.tolist(), own):
                kept = text.split()
                out.append((None if doc_id == NO_ID else doc_id, len(kept), 0, hashlib.sha256(b" ".join(kept)).hexdigest(), []))
        for ids, own in repeats.texts_of(texts, answers.told):
            units, counts = word_units(own)
            found = pieces(units, counts, words, anchor)
            code = answers.code(ids[found.text], found.whole)
            whole = np.flatnonzero(code & SETTLED)
            opened = np.flatnonzero(code & (2 * OPEN))
            first, piece = spread(found.first[opened], found.windows[opened])
            key = mix(Prefix(units).of(first, first + words))
            hit = answers.code(ids[found.text[opened]][piece], key) > 0
            gone = covered(
                [
                    (found.first[whole], found.first[whole] + found.windows[whole] + words - 1),
                    (first[hit], first[hit] + words),
                ],
                len(units),
            )
            at = 0
            for doc_id, text, n in zip(ids.tolist(), own, counts.tolist()):
                mask = gone[at : at + n]
                at += n
                kept = text.split() if not mask.any() else compress(text.split(), (~mask).tolist())
                edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"start": a, "length": b - a} for a, b in zip(edges[::2], edges[1::2])]
                sha = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((None if doc_id == NO_ID else doc_id, n, int(mask.sum()), sha, spans))
        return result_table(out)

    return repeats.with_answers(texts, told.union(single), finish, _RESULT)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
)


def result_table(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
