"""Pairs of rows with similar names and amounts less than a cent apart.

Rows meet in amount cells.  A small cell compares its rows with each other.  In
a large one two rows must also share a piece of their names: names of a and b
letters above the threshold t match in M > t (a + b) / 2 letters, so at most
e < (1 - t)(a + b) letters of both are left over.  These make at most e gaps,
and pieces of q letters (marked ends included) are lost only at gaps: more than
(a + b) / 2 * ((2q - 1) t - 2 (q - 1)) + q - 1 pieces are shared.  If pieces have
one order, one of the shared pieces is among the first n - shared + 1 of the n
pieces of each name.  These are the keys of the row.

How long the pieces are is decided for each cell, and for short and long names
apart, by counting what each choice would cost there: long pieces are rare, but
more of them must be looked at; short ones can leave out the frequent parts of
names, as pieces are ordered from rare to frequent.  Thresholds may differ by
scope; each scope's bounds and choices follow from its own.  A very large cell
whose names have rare segments, which is counted first, needs no pieces for its
short names: they are looked up by these segments (``name_index``).

The rows of a key are compared in a task by 64 bits that stand for the letters
of a name, and by 256 if these agree enough: a bit in which two names differ stands for a letter without partner.
Keys with many rows are dealt into shares.  The pairs that are left are compared
by edit distance, and each distinct pair of names above it is verified once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.similarity import similarity
from spendloom.functions.variants import let
from spendloom.operators.name_index import LEAST_THRESHOLD, MOST_LETTERS, index_pairs, segment_hashes
from spendloom.session import write_shared

_SLOTS = 4096
#: Names up to this length may use pieces that longer names could not.
_SHORT = MOST_LETTERS
#: Lengths of pieces to choose from, for short and for long names.
_CHOICES = ((1, 2, 3, 4), (1, 2, 3))
#: What a key costs next to the comparison of two rows.
_KEY_COST = 200
#: Segments are rare if a name shares them with at most this many names of its length.
_MOST_MET = 500


@dataclass(frozen=True)
class NearDupSizes:
    """Sizes that steer the plan.  They change the speed, never the result."""

    # A cell with more names than this is split by the pieces of the names.
    split_cell: int = 100
    # Rows that share a key beyond this number are dealt into shares.
    hot_piece: int = 2000
    # Rows of the largest cell in the first batch.
    first_batch: int = 1024
    # Matching pairs of one component that one task may read in order.
    tail_pairs: int = 2_000_000
    # A cell with more names than this may be searched by segments of the names.
    index_cell: int = 20_000
    # Names of such a cell that one task compares with as many others.
    tile: int = 400_000
    # Pairs of names of two lengths that are compared without an index.
    few_pairs: int = 1 << 20


class Matcher:
    """Finds the pairs of rows above the threshold and within one cent.

    Rows have the scope, _id, _name and _amount.  ``threshold`` is a number or a
    column of the scope.
    """

    def __init__(
        self, nodes: DataFrame, threshold: float | str, scope: Sequence[str] = (), sizes: NearDupSizes = NearDupSizes()
    ) -> None:
        self.scope, self.sizes = list(scope), sizes
        self.known = None if isinstance(threshold, str) else float(threshold)
        self.own = threshold if isinstance(threshold, str) else None
        self.threshold = F.col(self.own) if self.own else F.lit(float(threshold))
        nodes = nodes.withColumn("_node", F.monotonically_increasing_id()).withColumn("_length", F.length("_name"))
        #: Rows with a number of their own, unique over all scopes, and what is computed once for each.
        self.nodes = write_shared(nodes.withColumn("_cell", _cell(F.col("_amount"))), "nodes")
        cells = self.nodes.groupBy(*self.scope, "_cell").count()
        self.split = write_shared(cells.filter(F.col("count") > sizes.split_cell), "split-cells")
        self.largest_cell = self.split.agg(F.max("count")).first()[0] or 0
        if self.largest_cell:
            self._plan()
            self.nodes = write_shared(self._keyed(), "keyed-nodes")
            self.any_small = not self.nodes.filter("_blocks IS NULL").isEmpty()

    def pairs(self, rows: DataFrame, *, across: bool = False) -> DataFrame:
        """Matches among ``rows`` of ``nodes``: scope, _src, _dst (the later row), their nodes and _score.

        With ``across``, only matches of a row that is ``_fresh`` with one that is not.
        """
        return self._verified(self.candidates(rows, across=across))

    def candidates(self, rows: DataFrame, *, across: bool = False) -> DataFrame:
        """Pairs that pass all bounds, with their names."""
        if not across:
            rows = rows.withColumn("_fresh", F.lit(True))
        shared = [*self.scope, "_id", "_name", "_node", "_amount", "_length", "_fresh"]
        if not self.largest_cell:
            around = F.explode(_around(F.col("_amount"))).alias("_cell")
            return self._small(rows.select("_cell", *shared), rows.select(around, *shared), across)
        met = self._blocks(rows, across)
        if self.any_indexed:
            met = met.unionByName(self._looked_up(rows, across))
        met = self._named(met, rows)
        if not self.any_small:
            return met
        shorter = rows.filter("_blocks IS NULL").select("_cell", *shared)
        longer = rows.select(F.explode("_small_cells").alias("_cell"), *shared)
        return self._small(shorter, longer, across).unionByName(met)

    # --- small cells ---

    def _small(self, shorter: DataFrame, longer: DataFrame, across: bool) -> DataFrame:
        l_len, r_len = F.col("l._length"), F.col("r._length")
        t = F.col(f"l.{self.own}") if self.own else self.threshold
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*self.scope, "_cell"]]
        on += [
            (l_len < r_len) | ((l_len == r_len) & (F.col("l._node") < F.col("r._node"))),
            F.abs(F.col("l._amount") - F.col("r._amount")) < 0.01,
            2 * l_len + 1e-9 > t * (l_len + r_len),
            _few_edits(F.col("l._name"), F.col("r._name"), t),
        ]
        if across:
            on.append(F.col("l._fresh") != F.col("r._fresh"))
        # The join makes its own exchanges, which adaptive execution may split or coalesce.
        joined = shorter.alias("l").join(longer.alias("r").hint("merge"), reduce(Column.__and__, on))
        return joined.select(*[F.col(f"l.{c}").alias(c) for c in self.scope], *_both_sides())

    # --- large cells ---

    def _lengths(self, long: int = 0) -> list[int]:
        """Lengths of pieces that come into question."""
        least = 1 if self.own else 1 + (self.known > 2 / 3 + 1e-6)
        return [q for q in _CHOICES[long] if q >= least]

    def _share(self, q: int) -> Column:
        return (2 * q - 1) * self.threshold - 2 * (q - 1)

    def _usable(self, q: int, long: bool) -> Column:
        """Whether names of the class always share a piece of q letters."""
        if q == 1:
            return self.threshold <= 2 / 3 + 1e-6
        least = 0.0 if long else 0.01 - _base(q)
        return self._share(q) * (1 if long else _SHORT) > least

    def _taken(self, q: int, *, longer_side: bool, long: bool) -> Column:
        """How many of its first pieces a row must look at."""
        length, share = F.col("_length"), self._share(q)
        if longer_side:
            least, most = 2 * length / (2 - self.threshold), 2 * length
        else:
            least, most = 2 * length, 2 * length / F.greatest(self.threshold, F.lit(0.5))
            most = most if long else F.least(most, length + _SHORT)
        shared = F.floor(F.when(share >= 0, share * least / 2).otherwise(share * most / 2) + _base(q) - 1e-6) + 1
        return (length + _base(q) - F.greatest(shared, F.lit(1)) + 1).cast("int")

    def _plan(self) -> None:
        """Choose the length of pieces for each large cell, and find the keys with many rows."""
        met = [*self.scope, "_cell"]
        cells = self._by_segments()
        rows = self.nodes.select(*met, "_name", "_length").join(cells, met)
        rows = rows.filter(F.col("_group").isNull() | self._meets_long())
        ranks = _piece_ranks(rows, self._lengths())
        self._pieces = {q: _pieces(q, ranks[q]) for q in self._lengths()}
        options = [
            F.when(
                self._usable(q, bool(long)) & (F.col("_length") > _SHORT if long else (F.col("_length") <= _SHORT) & F.col("_group").isNull()),
                F.struct(
                    F.lit(long).alias("_class"),
                    F.lit(q).alias("_q"),
                    F.slice(self._pieces[q], 1, self._taken(q, longer_side=True, long=bool(long))).alias("_keys"),
                ),
            )
            for long in (0, 1)
            for q in self._lengths(long)
        ]
        options = F.explode(F.filter(F.array(*options), lambda o: o.isNotNull()))
        keys = rows.select(*met, options.alias("_o")).select(*met, "_o._class", "_o._q", F.explode("_o._keys").alias("_key"))
        counts = write_shared(keys.groupBy(*met, "_class", "_q", "_key").count(), "key-counts")
        cost = F.sum(F.col("count").cast("double") * (F.col("count") + _KEY_COST)).alias("_cost")
        costs = counts.groupBy(*met, "_class", "_q").agg(cost)
        chosen = costs.groupBy(*met).agg(
            *[F.min_by("_q", F.when(F.col("_class") == c, F.col("_cost"))).alias(f"_q{c}") for c in (0, 1)]
        )
        usual = F.when(self._usable(2, True), 2).otherwise(1)
        plan = cells.join(chosen, met, "left")
        pieces = [F.coalesce(f"_q{c}", usual) for c in (0, 1)]
        short = F.when(F.col("_group").isNull(), pieces[0]).otherwise(0)
        self.plan = write_shared(plan.select(*met, "_group", short.alias("_q0"), pieces[1].alias("_q1")), "plan")
        used = counts.join(self.plan.drop("_group"), met).filter(F.col("_q") == F.when(F.col("_class") == 0, F.col("_q0")).otherwise(F.col("_q1")))
        shares = F.ceil(F.col("count") / self.sizes.hot_piece).cast("int").alias("_shares")
        block = self._block(F.col("_class"), F.col("_key")).alias("_block")
        self.hot = write_shared(used.filter(F.col("count") > self.sizes.hot_piece).select(block, shares), "hot-keys")
        self.any_hot = not self.hot.isEmpty()

    def _by_segments(self) -> DataFrame:
        """The large cells, those whose short names are found by their segments with a _group of their own."""
        met = [*self.scope, "_cell"]
        none = F.lit(None).cast("long").alias("_group")
        self.any_indexed = False
        if self.largest_cell <= self.sizes.index_cell or (self.known or LEAST_THRESHOLD) < LEAST_THRESHOLD:
            return self.split.select(*met, none)
        large = self.split.filter((F.col("count") > self.sizes.index_cell) & (self.threshold >= LEAST_THRESHOLD))
        rows = self.nodes.filter(F.col("_length") <= _SHORT).join(large.select(*met, "count"), met)
        hashes = F.explode(segment_hashes(F.col("_name"), F.col("_length"), self.threshold)).alias("_segment")
        meet = rows.select(*met, F.col("count").alias("_rows"), "_length", hashes).groupBy(*met, "_rows", "_length", "_segment").count()
        meet = meet.groupBy(*met, "_rows").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("_meet"))
        rare = meet.filter(F.col("_meet") <= F.col("_rows").cast("double") * _MOST_MET)
        rare = write_shared(rare.select(*met, F.monotonically_increasing_id().alias("_group")), "cells-by-segments")
        self.any_indexed = not rare.isEmpty()
        return self.split.select(*met).join(rare, met, "left") if self.any_indexed else self.split.select(*met, none)

    def _meets_long(self) -> Column:
        """Whether a name can be similar to one of more than the letters of short names."""
        return (F.col("_length") > _SHORT) | ((2 - self.threshold) * F.col("_length") + 1e-6 > self.threshold * _SHORT)

    def _block(self, of_class: Column, key: Column) -> Column:
        """The key of rows that meet.  Blocks that fall together by chance only add pairs, which are checked."""
        return F.xxhash64(*self.scope, "_cell", of_class, key)

    def _keyed(self) -> DataFrame:
        """The nodes with their letter bits, their blocks as the shorter name and as the longer one.

        _blocks is null in a small cell.  As the longer name a row also meets
        the cells around its own; _small_cells are the small ones of them, and
        _groups those in which a short name is looked up by its segments.
        """
        met = [*self.scope, "_cell"]
        nodes = self.nodes.join(self.plan, met, "left")
        nodes = nodes.withColumn("_blocks", self._keys(longer_side=False)).drop("_q0", "_q1")
        around = self.nodes.select(*self.scope, "_node", "_name", "_length", F.explode(_around(F.col("_amount"))).alias("_cell"))
        around = around.join(self.plan, met, "left").withColumn("_met", self._keys(longer_side=True))
        around = around.groupBy("_node").agg(
            F.flatten(F.collect_list("_met")).alias("_longer_blocks"),
            F.collect_list(F.when(F.col("_met").isNull(), F.col("_cell"))).alias("_small_cells"),
            F.collect_list(F.when(F.col("_length") <= _SHORT, F.col("_group"))).alias("_groups"),
        )
        nodes = nodes.withColumnRenamed("_group", "_home").join(around, "_node")
        # Only rows with keys are compared by their bits.
        keyed = (F.size("_blocks") > 0) | (F.size("_longer_blocks") > 0)
        nodes = nodes.withColumn("_letters", F.when(keyed, _letters(F.col("_name"))))
        nodes = nodes.withColumn("_bits", _bits(F.col("_letters")))
        for k in range(4):
            nodes = nodes.withColumn(f"_bits{k}", _quarter(F.col("_letters"), k))
        return nodes.drop("_letters")

    def _keys(self, *, longer_side: bool) -> Column:
        """The blocks of a row in its cell by the plan of the cell; null in a small cell."""
        length = F.col("_length")
        if longer_side:
            belongs = length <= _SHORT, length > _SHORT
        else:
            belongs = length <= _SHORT, self._meets_long()
        classes = []
        for long in (0, 1):
            keys = F.when(~belongs[long] | (F.col(f"_q{long}") == 0), F.array().cast("array<long>"))
            for q in self._lengths(long):
                taken = F.slice(self._pieces[q], 1, self._taken(q, longer_side=longer_side, long=bool(long)))
                keys = keys.when(F.col(f"_q{long}") == q, taken)
            of_class = F.lit(long)
            classes.append(F.transform(keys, lambda key: self._block(of_class, key)))
        return F.when(F.col("_q0").isNotNull(), F.concat(*classes))

    def _dealt(self, rows: DataFrame, *, copy: bool) -> DataFrame:
        """Give each row of a hot key one of its shares, or a copy in every share."""
        if not self.any_hot:
            return rows.withColumn("_share", F.lit(0))
        shares = F.coalesce("_shares", F.lit(1))
        share = F.explode(F.sequence(F.lit(0), shares - 1)) if copy else F.pmod(F.xxhash64("_node"), shares).cast("int")
        return rows.join(self.hot, "_block", "left").withColumn("_share", share).drop("_shares")

    def _blocks(self, rows: DataFrame, across: bool) -> DataFrame:
        """Nodes of rows that meet at a key and pass the bounds on letters, lengths and amounts."""
        carried = ["_length", "_node", "_bits", *_QUARTERS, "_amount", "_fresh", self.threshold.alias("_threshold")]
        sides = []
        for role, keys in enumerate(("_longer_blocks", "_blocks")):
            side = self._dealt(rows.select(F.explode(keys).alias("_block"), *carried), copy=role == 1)
            sides.append(side.withColumn("_role", F.lit(role).cast("byte")))
        # Few bytes are much work here, so the number of tasks is given.
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = sides[0].unionByName(sides[1]).repartition(tasks, "_block", "_share")
        both = both.sortWithinPartitions("_block", "_share", "_role", "_length")
        return both.mapInArrow(_compare(across), "_l_node long, _r_node long").distinct()

    def _looked_up(self, rows: DataFrame, across: bool) -> DataFrame:
        """Nodes of rows in cells that are searched by segments."""
        home = F.coalesce(F.col("_group") == F.col("_home"), F.lit(False)).alias("_home")
        carried = ["_home", "_node", "_name", "_amount", "_fresh", self.threshold.alias("_threshold")]
        rows = rows.select(F.explode("_groups").alias("_group"), *carried)
        rows = rows.select("_group", home, *[c for c in rows.columns if c not in ("_group", "_home")])
        return index_pairs(rows, across=across, tile=self.sizes.tile, few_pairs=self.sizes.few_pairs)

    def _named(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """The pairs with their rows; pairs of different scopes and with too many edits go."""
        for side in "lr":
            own = [F.col(c).alias(f"_{side}{c}") for c in self.scope]
            names = rows.select(*own, *[F.col(c).alias(f"_{side}{c.removeprefix('_id')}") for c in ("_id", "_name", "_node")])
            pairs = pairs.join(names, f"_{side}_node")
        for c in self.scope:
            pairs = pairs.filter(F.col(f"_l{c}") == F.col(f"_r{c}")).withColumn(c, F.col(f"_l{c}"))
        pairs = pairs.filter(_few_edits(F.col("_l_name"), F.col("_r_name"), self.threshold))
        return pairs.select(*self.scope, *[f"_{side}{c}" for side in "lr" for c in ("", "_name", "_node")])

    # --- verification ---

    def _verified(self, candidates: DataFrame) -> DataFrame:
        """The candidates above the threshold.  Each distinct ordered pair of names is verified once."""
        names = ["", "_name", "_node"]

        def pair(first: str, second: str) -> Column:
            return F.struct(*[F.col(f"_{s}{c}").alias(f"{to}{c}") for s, to in ((first, "_src"), (second, "_dst")) for c in names])

        in_order = F.when(F.col("_l") < F.col("_r"), pair("l", "r")).otherwise(pair("r", "l"))
        found = candidates.select(*self.scope, in_order.alias("_pair")).select(*self.scope, "_pair.*")
        found = write_shared(found, "candidates")
        both = ["_src_name", "_dst_name"]
        # Few bytes can be much work here, so the number of tasks is given.
        tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        scores = found.groupBy(*both).agg(F.min(self.threshold).alias("_least")).repartition(tasks, *both)
        scores = scores.withColumn("_score", similarity(*both)).filter("_score > _least").drop("_least")
        found = found.join(scores, both).filter(F.col("_score") > self.threshold)
        return found.select(*self.scope, "_src", "_dst", "_src_node", "_dst_node", "_score")


def _both_sides() -> list[Column]:
    return [F.col(f"{s}.{c}").alias(f"_{s}{c.removeprefix('_id')}") for s in "lr" for c in ("_id", "_name", "_node")]


def _base(q: int) -> int:
    """Pieces of a name beyond its letters."""
    return max(1, q - 1)


def _cell(amount: Column) -> Column:
    """Cells two cents wide, with borders between whole cents."""
    return F.floor(amount * 50 + 0.25)


def _around(amount: Column) -> Column:
    """The cells of all amounts less than a cent away."""
    reach = F.when(F.abs(amount) < 2.0**47, 0.0125 + F.abs(amount) * 2.0**-50).otherwise(0.0)
    return F.sequence(_cell(amount - reach), _cell(amount + reach))


def _few_edits(first: Column, second: Column, threshold: Column) -> Column:
    """Edit distance within the letters that may be left unmatched."""
    unmatched = (1 - threshold) * (F.length(first) + F.length(second)) + 1e-9
    return F.call_function("levenshtein", first, second, F.ceil(unmatched).cast("int") - 1) >= 0


def _slot(piece: Column) -> Column:
    return F.pmod(piece, F.lit(_SLOTS)).cast("int")


def _piece_ranks(rows: DataFrame, lengths: Sequence[int]) -> dict[int, Column]:
    """Rank of each slot of pieces by how often it occurs: at most ``_SLOTS`` numbers a length."""
    slots = [
        F.struct(F.lit(q).alias("q"), F.transform(_texts(q), lambda x: _slot(F.xxhash64(x))).alias("slots")) for q in lengths
    ]
    found = rows.select(F.explode(F.array(*slots)).alias("_s")).select("_s.q", F.explode("_s.slots").alias("slot"))
    seen = {(row["q"], row["slot"]): row["count"] for row in found.groupBy("q", "slot").count().collect()}
    ranks = {}
    for q in lengths:
        order = sorted(range(_SLOTS), key=lambda slot: (seen.get((q, slot), 0), slot))
        of_slot = [0] * _SLOTS
        for rank, slot in enumerate(order):
            of_slot[slot] = rank
        ranks[q] = F.from_json(F.lit(str(of_slot)), "array<int>")
    return ranks


def _pieces(q: int, ranks: Column) -> Column:
    """All pieces of a name as numbers, from rare to frequent; the n-th copy of a piece is its own."""

    def ranked(piece: Column) -> Column:
        return F.struct(F.element_at(ranks, _slot(piece) + 1).alias("rank"), piece.alias("piece"))

    found = F.sort_array(F.transform(F.transform(_texts(q), lambda x: F.xxhash64(x)), ranked))
    return _numbered_copies(F.transform(found, lambda p: p["piece"]))


def _texts(q: int) -> Column:
    """The pieces of a name with marked ends."""
    marked = F.concat(F.lit("\u0001" * _base(q)), F.col("_name"), F.lit("\u0002" * (q - 1)))
    return F.transform(
        F.sequence(F.lit(1), F.length("_name") + _base(q)), lambda i: F.substring(marked, i, F.lit(q))
    )


def _numbered_copies(pieces: Column) -> Column:
    """Pieces, equal ones side by side, where the n-th copy of a piece is a number of its own."""
    return let(
        pieces,
        lambda found: F.transform(
            found,
            lambda p, i: let(
                i + 1 - F.array_position(found, p), lambda copy: F.when(copy > 0, F.xxhash64(p, copy)).otherwise(p)
            ),
        ),
    )


def _letters(name: Column) -> Column:
    """The letters of a name as numbers; the n-th copy of a letter is a number of its own."""
    letters = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.xxhash64(F.substring(name, i, F.lit(1))))
    letters = F.when(F.length(name) > 0, letters).otherwise(F.array().cast("array<long>"))
    return _numbered_copies(F.sort_array(letters))


def _bits(places: Column) -> Column:
    """64 bits, those at ``places`` (modulo 64) set.

    A bit in which two names differ stands for at least one letter that has no
    partner in the other name.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return F.aggregate(
        places, none, lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", one, F.pmod(p, F.lit(64)).cast("int")))
    )


def _quarter(letters: Column, k: int) -> Column:
    """One of four times 64 bits, which together tell more letters apart."""
    return _bits(F.filter(F.transform(letters, lambda x: F.shiftright(x, 8)), lambda p: F.shiftright(p, 6).bitwiseAND(F.lit(3)) == k))


_QUARTERS = ["_bits0", "_bits1", "_bits2", "_bits3"]
_COMPARED = ["_length", "_node", "_bits", *_QUARTERS, "_amount", "_fresh", "_threshold"]


def _compare(across: bool):
    """Rows sorted by block and share, the members first and by length: visitors meet members not shorter."""

    # All that the workers need is inside, so they need not have this package.
    def meet(visitors: dict, members: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of visitors of one length with members that are as long or longer."""
        a, t = int(visitors["_length"][0]), float(visitors["_threshold"][0])
        lengths = members["_length"]
        longest = (2 * a + 1e-9) / t - a if t > 0 else np.inf
        first, last = np.searchsorted(lengths, a), np.searchsorted(lengths, longest, "left")
        if first >= last:
            return []
        bits = members["_bits"][first:last]
        most = np.ceil((1 - t) * (a + lengths[first:last]) + 1e-9) - 1
        most = np.minimum(most, 255).astype(np.uint8)
        found, step = [], max(1, (1 << 18) // len(bits))
        for at in range(0, len(visitors["_bits"]), step):
            differing = np.bitwise_count(visitors["_bits"][at : at + step, None] ^ bits[None, :])
            i, j = np.nonzero(differing <= most[None, :])
            limit = most[j]
            i, j = i + at, j + first
            differing = sum(np.bitwise_count(visitors[c][i] ^ members[c][j]) for c in _QUARTERS)
            i, j = (k[differing <= limit] for k in (i, j))
            left, right = visitors["_node"][i], members["_node"][j]
            fits = (lengths[j] > a) | (left < right)
            fits &= np.abs(visitors["_amount"][i] - members["_amount"][j]) < 0.01
            if fits.any():
                found.append((left[fits], right[fits]))
        return found

    def chosen(rows: dict, which: np.ndarray) -> dict:
        return {c: values[which] for c, values in rows.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, members = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            block, share, role = columns["_block"], columns["_share"], columns["_role"]
            for c in ("_bits", *_QUARTERS):
                columns[c] = columns[c].view(np.uint64)
            # The members of a key are taken at once, its visitors length by length.
            new = [columns[c][1:] != columns[c][:-1] for c in ("_block", "_share", "_role", "_length", "_threshold")]
            cuts = np.flatnonzero(new[0] | new[1] | new[2] | (role[1:] == 1) & (new[3] | new[4])) + 1
            out = []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                at = block[start], share[start]
                if at != key:
                    key, gathered, members = at, [], None
                part = {c: columns[c][start:end] for c in _COMPARED}
                if role[start] == 0:
                    gathered.append(part)
                elif gathered:
                    if members is None:
                        members = {c: np.concatenate([g[c] for g in gathered]) for c in _COMPARED}
                        # Fresh rows only meet the others, so the sides are parted before they are compared.
                        members = [chosen(members, ~members["_fresh"]), chosen(members, members["_fresh"])] if across else [members]
                    visitors = [chosen(part, part["_fresh"]), chosen(part, ~part["_fresh"])] if across else [part]
                    for come, there in zip(visitors, members):
                        if len(come["_node"]) and len(there["_node"]):
                            out += meet(come, there)
            if out:
                left, right = (np.concatenate([o[k] for o in out]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["_l_node", "_r_node"])

    return compare
