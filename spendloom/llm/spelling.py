"""Spelling variants by blocked Gram matrices of letter counts.

One inserted or deleted letter changes the letter counts of a word by a squared
distance of 1, one replaced letter by 2 at most.  So two words can be one edit
apart only if their counts are at most 2 apart and their lengths at most 1.
The squared distances of a block of words from another are |a|^2 + |b|^2 - 2ab,
one matrix product; pairs at most 2 apart are compared letter by letter.

Blocks are the words of one length, cut by how many letters of each of ``GROUPS``
groups of letters they hold.  One edit moves one count by 1, or one up and
another down, so a block meets itself, the blocks one such step away and the
blocks one letter shorter, and no pair beyond them can be near.  A word visits
each of these blocks; the members of a large block are dealt into tiles and its
visitors come to every tile.  A task reads the members of a tile and streams its
visitors past them, so its memory does not grow with either.

What leaves a task is not pairs: for each word of a block pair the number of its
near words and the best of them, which Spark adds up.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import shuffle_partitions, slices
from spendloom.session import write_shared

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LETTERS, LEAST_COUNT, RATIO, MODULUS, GROUPS, TILE = 7, 2, 10, 31, 6, 2048


def variant_forms(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    modulus: int = MODULUS,
) -> DataFrame:
    """The words of the texts, their near words, and the form that each is a variant of.

    A word is near another if they differ by exactly one inserted, deleted or
    replaced letter.  Its form is its most frequent near word (ties: the
    smallest), if that is at least ``ratio`` times as frequent; ``root`` is
    where following forms ends, the word itself if it has none.

    Null and empty texts have no words.  A null id counts as an empty one.
    Repeated rows count each for itself.  Without words there are no rows.

    Returns word, form, root, n, n_near, form_n.
    """
    words = write_shared(word_counts(docs, id_col, text_col, least_letters, least_count, modulus), "words")
    return forms(words, write_shared(near_words(words), "near-words"), ratio)


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    modulus: int = MODULUS,
) -> DataFrame:
    """Words of at least ``least_letters`` letters and ``least_count`` occurrences, and how often they occur (n).

    Letters are A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased.  If
    ``modulus`` divides the crc32 of ``<id>:<word>``, the letter at the crc32
    modulo the length goes from all occurrences of the word in this document.
    A modulus of 0 leaves the words as they are.
    """
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_letters).findall  # a shorter run has no match inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen: Counter[str] = Counter()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    start = b"" if doc_id is None else b"%d" % doc_id
                    start = zlib.crc32(start + b":")
                    for word, n in Counter(runs(text.translate(lower))).items():
                        h = zlib.crc32(word.encode(), start) if modulus else 1
                        if modulus and h % modulus == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_letters:
                                continue
                        seen[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def forms(words: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Choose each word's form from ``near`` (word, n_near, best) and follow forms to their roots."""
    found = words.join(near, "word", "left")
    enough = F.col("best.n") >= ratio * F.col("n")
    found = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, F.col("best.n")).alias("form_n"),
    )
    found = write_shared(found, "forms")
    roots = follow(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    found = found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def follow(links: DataFrame) -> DataFrame:
    """Where the links (word, root) lead in the end.

    Every round doubles the steps taken.  Forms grow by the ratio with every
    step, so chains, and rounds with them, are few.
    """
    while True:
        links = write_shared(links, "roots")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        links = links.join(further, "root", "left")
        if links.filter("_further IS NOT NULL").isEmpty():
            return links.select("word", "root")
        links = links.select("word", F.coalesce("_further", "root").alias("root"))


def near_words(words: DataFrame, groups: int = GROUPS, tile: int = TILE) -> DataFrame:
    """n_near and best (most frequent, then smallest, near word with its n) of the words that have near words."""
    cells = words.select("word", "n", F.array(*_group_counts(words, groups)).alias("own"))
    cell = F.concat_ws(".", "own")
    length = F.length("word")
    # A long word takes more room, so fewer of them make a tile.
    shares = F.ceil(F.sum(F.greatest(length, F.lit(32))) / (32 * tile)).cast("int")
    large = cells.groupBy(cell.alias("cell")).agg(shares.alias("shares")).filter("shares > 1")
    large = write_shared(large, "large-blocks")
    place = F.pmod(F.xxhash64("word"), F.col("shares")).cast("int")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _steps(groups)])
    around = F.transform(steps, lambda s: F.zip_with("own", s, lambda x, y: x + y))
    around = F.filter(around, lambda c: F.array_min(c) >= 0)
    visits = cells.select("word", "n", F.concat_ws(".", "own").alias("home"), F.explode(around).alias("at"))
    visits = visits.select("word", "n", "home", F.concat_ws(".", "at").alias("cell"))
    visits = visits.join(large, "cell", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    # At home a word is a member of its own tile and visits the tiles before it.
    home = F.col("home") == F.col("cell")
    last = F.when(home, place).otherwise(F.col("shares") - 1)
    visits = visits.withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
    role = F.when(~home, F.lit(2)).when(F.col("tile") == place, F.lit(0)).otherwise(F.lit(1))
    rows = visits.select(
        "cell", "tile", role.cast("byte").alias("role"), length.alias("length"),
        F.encode("word", "ISO-8859-1").alias("word"), "n",
    )
    # Few bytes are much work here, so the number of tasks is given.
    rows = rows.repartition(shuffle_partitions(words.sparkSession), "cell", "tile").sortWithinPartitions("cell", "tile", "role", "length")
    found = rows.mapInArrow(_compare, "word string, n_near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def _steps(groups: int) -> list[tuple[int, ...]]:
    """To the own block, to one of each two blocks a replaced letter away, and to those a letter shorter."""

    def step(up: int | None, down: int | None) -> tuple[int, ...]:
        return tuple((g == up) - (g == down) for g in range(groups))

    swaps = [step(a, b) for a, b in itertools.combinations(range(groups), 2)]
    return [step(None, None), *swaps, *[step(None, g) for g in range(groups)]]


def _group_counts(words: DataFrame, groups: int) -> list[Column]:
    """How many letters of each group a word has; groups are of about equal weight in the words."""
    parts = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    counts = {r["letter"]: r["count"] for r in parts.collect()}  # at most one row a letter
    held, weight = [""] * groups, [0] * groups
    for letter in sorted(LETTERS, key=lambda c: (-counts.get(c, 0), c)):
        lightest = weight.index(min(weight))
        held[lightest] += letter
        weight[lightest] += counts.get(letter, 0)
    length = F.length("word")
    return [length - F.length(F.translate("word", letters, "")) for letters in held]


# --- comparing blocks ------------------------------------------------------

_AT = np.zeros(256, np.intp)
_AT[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


class _Block:
    """Words of one length: their letters, letter counts and frequencies."""

    def __init__(self, letters: np.ndarray, n: np.ndarray) -> None:
        self.letters, self.n = letters, n
        # Sums of squares must stay whole numbers.
        self.kind = np.float32 if letters.shape[1] <= 4096 else np.float64
        self._counts = None

    def counts(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        if self._counts is None or self._counts[0].dtype != kind:
            rows, width = self.letters.shape
            at = _AT[self.letters] + np.arange(rows)[:, None] * len(LETTERS)
            counts = np.bincount(at.ravel(), minlength=rows * len(LETTERS)).reshape(rows, -1).astype(kind)
            self._counts = counts, (counts * counts).sum(axis=1)
        return self._counts

    def part(self, start: int, end: int) -> _Block:
        return _Block(self.letters[start:end], self.n[start:end])


def near_pairs(members: _Block, others: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Indices of near words; ``others`` are as long as the members or one letter longer."""
    kind = np.float64 if np.float64 in (members.kind, others.kind) else np.float32
    a, a_square = members.counts(kind)
    b, b_square = others.counts(kind)
    distance = a_square[:, None] + b_square[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(distance <= 2)
    found = ([], [])
    strip = max(1, (1 << 22) // max(1, others.letters.shape[1]))
    for at in range(0, len(i), strip):
        x, y = i[at : at + strip], j[at : at + strip]
        one, other = members.letters[x], others.letters[y]
        if one.shape[1] == other.shape[1]:
            near = (one != other).sum(axis=1) == 1
        else:
            lead = np.logical_and.accumulate(one == other[:, :-1], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((one == other[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            near = lead + tail >= one.shape[1]
        found[0].append(x[near])
        found[1].append(y[near])
    return tuple(np.concatenate(f) if f else np.zeros(0, np.intp) for f in found)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and tile, members first: each member meets all others and the visitors."""
    key, members, gathered = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        # Runs of rows that agree in cell, tile, role and length.
        cell, tile, role = (batch.column(c) for c in ("cell", "tile", "role"))
        length = batch.column("length").to_numpy()
        whole = np.stack([cell.dictionary_encode().indices.to_numpy(), tile.to_numpy(), role.to_numpy(), length])
        cuts = np.flatnonzero((whole[:, 1:] != whole[:, :-1]).any(axis=0)) + 1
        counts, out = batch.column("n").to_numpy(), []
        for start, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            run = batch.column("word").slice(start, end - start).cast(pa.binary())
            width = int(length[start])
            data = np.frombuffer(run.buffers()[2], np.uint8)
            offset = np.frombuffer(run.buffers()[1], np.int32)[run.offset]
            block = _Block(data[offset : offset + width * len(run)].reshape(-1, width), counts[start:end])
            at = cell[start].as_py(), tile[start].as_py()
            if at != key:
                key, members, gathered = at, None, []
            if role[start].as_py() == 0:
                # A tile's members may come in several batches; each batch meets those before it and itself.
                for before in gathered:
                    out.append(_tally(before, block, same=False))
                out.append(_tally(block, block, same=True))
                gathered.append(block)
                continue
            if members is None and gathered:
                members = _Block(np.concatenate([b.letters for b in gathered]), np.concatenate([b.n for b in gathered]))
            if members is not None:
                step = max(1, (1 << 22) // len(members.n))
                for first in range(0, len(block.n), step):
                    out.append(_tally(members, block.part(first, first + step), same=False))
        out = [t for t in out if t is not None]
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def _tally(members: _Block, others: _Block, same: bool) -> pa.RecordBatch | None:
    """For each word with near words among the others: their number and the best of them."""
    if same and len(members.n) < 2:
        return None
    i, j = near_pairs(members, others)
    if not len(i):
        return None
    sides = [(members, i, others, j)] if same else [(members, i, others, j), (others, j, members, i)]
    parts = []
    for own, x, other, y in sides:
        # The best comes first: larger n, then the smaller word.
        names = np.array([w.tobytes() for w in other.letters[y]], object)
        order = np.lexsort([np.argsort(np.argsort(names, kind="stable"), kind="stable"), -other.n[y], x])
        x, y = x[order], y[order]
        at = np.flatnonzero(np.diff(x, prepend=-1))
        parts.append((own.letters[x[at]], np.diff(at, append=len(x)), other.n[y[at]], other.letters[y[at]]))
    columns = [[w.tobytes().decode("latin-1") for p in parts for w in p[0]]]
    columns += [np.concatenate([p[k] for p in parts]) for k in (1, 2)]
    columns += [[w.tobytes().decode("latin-1") for p in parts for w in p[3]]]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n_near", "best_n", "best_word"])
