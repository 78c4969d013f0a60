"""Pairs of similar names in large groups of short names, by an index of segments.

Names of a <= b letters above the threshold t match in M > t (a + b) / 2 letters
in the same order, so of both at most e = a + b - 2M letters are lost.  The
shorter name is cut into segments that may lose one letter each (and, for an
even e, one in the middle that may lose none), so that they may lose e + 1 less
their number together: some segment loses no more than it may.  It is then found
in the longer name unchanged, less one of its letters, or with one letter in
between.

Where it is found is bounded.  Let S(i) be what the first i segments lose less
what would be one too many for each of them.  S begins at 0 and ends below; at
the first segment with S(i) < 0 the letters lost on its left exceed those that
the segments there stand for by at most what the segment could still lose, and
so do those on its right.  A segment is therefore looked up at few places, the
outer ones nearly at their own, and all choices are exact.

Seven letters in one of few places are rare where names are unlike, so the pairs
that are looked at hardly grow with the square of the names.  What does is the
look-up itself: tiles of names meet each other, each pair of tiles in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.session import write_shared

#: Names of a threshold below are cut into segments of too few letters.
LEAST_THRESHOLD = 0.8
#: Longer names have too many places for a segment.
MOST_LETTERS = 48

_PACKED = "_group long, _fresh boolean, _threshold double, _count long, _nodes binary, _amounts binary, _homes binary, _lengths binary, _letters binary"


def segment_hashes(name: Column, length: Column, threshold: Column) -> Column:
    """The segments that a name has next to names of its length, to count how rare they are."""
    n = (F.floor((1 - threshold) * length + 1e-6) + 1).cast("int")

    def end(i: Column) -> Column:
        return F.floor(i * length / n).cast("int")

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(i, F.substring(name, end(i) + 1, end(i + 1) - end(i))))


def index_pairs(rows: DataFrame, *, across: bool, tile: int, few_pairs: int) -> DataFrame:
    """Nodes of rows of a group that may be similar, less than a cent apart (_l_node, _r_node).

    Rows have _group, _home (whether the group is that of the row's own cell),
    _node, _name, _amount, _fresh and _threshold, which is one in a group.  Of
    rows that are both not at home no pair is given.  With ``across``, only pairs
    of a fresh row and one that is not.  Tiles have about ``tile`` rows; up to
    ``few_pairs`` pairs of two lengths are compared without an index.
    """
    rows = rows.select("_group", "_home", "_node", "_name", "_amount", "_fresh", "_threshold")
    packed = write_shared(rows.sortWithinPartitions("_group", "_fresh").mapInArrow(_pack(min(tile, 1 << 11)), _PACKED), "packed-names")
    fresh, tasks = F.col("_fresh"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tiles(n: Column) -> Column:
        """Of about ``tile`` rows, or smaller ones as long as there are less pairs of tiles than tasks."""
        smaller = F.least(F.ceil(16 * n / tile), F.lit(round(tasks**0.5)))
        return F.greatest(F.ceil(n / tile), smaller).cast("int")

    sums = [F.coalesce(F.sum(F.when(of, F.col("_count"))), F.lit(0)) for of in (fresh, ~fresh)]
    counts = packed.groupBy("_group").agg(*[tiles(n).alias(c) for c, n in zip(("_f", "_k"), sums)])
    units = F.col("_f") * F.col("_k") if across else F.col("_f") * (F.col("_f") + 1) / 2
    counts = write_shared(counts.withColumn("_units", units.cast("long")), "tiles")
    n_units = counts.agg(F.sum("_units")).first()[0] or 0
    # Groups are large, so they are few.
    packed = packed.join(F.broadcast(counts.filter("_units > 0")), "_group")
    own, others = (F.when(fresh, F.col(a)).otherwise(F.col(b)) for a, b in (("_f", "_k"), ("_k", "_f")))
    packed = packed.withColumn("_tile", F.pmod(F.xxhash64("_nodes"), own).cast("int"))
    met = F.sequence(F.lit(0), (others if across else own) - 1)
    packed = packed.withColumn("_other", F.explode(met))
    second = ~fresh if across else F.col("_tile") > F.col("_other")
    unit = ["_group", "_first", "_second"]
    packed = packed.select(
        *_columns(),
        F.when(second, F.col("_other")).otherwise(F.col("_tile")).alias("_first"),
        F.when(second, F.col("_tile")).otherwise(F.col("_other")).alias("_second"),
        second.alias("_side"),
    )
    # Few bytes are much work here, so the number of tasks is given: pairs of tiles seldom share one.
    units = packed.repartition(max(tasks, min(4 * n_units, 4096)), *unit).groupBy(*unit)
    return units.applyInArrow(_meet(across, few_pairs), "_l_node long, _r_node long")


def _columns() -> list[str]:
    return [c.split()[0] for c in _PACKED.split(", ")]


def _pack(most: int):
    """Rows of a group side by side become rows of up to ``most`` names, with a byte for each letter.

    Letters beyond ASCII may share a byte, which only adds pairs, which are checked.
    """
    names = _columns()

    # All that the workers need is inside, so they need not have this package.
    def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        return ((flat ^ flat >> 7 ^ flat >> 14) if flat.size and flat.max() > 127 else flat).astype(np.uint8), lengths

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, fresh, home, node, amount, threshold = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("_group", "_fresh", "_home", "_node", "_amount", "_threshold")
            )
            flat, lengths = letters(batch.column("_name"))
            at = np.concatenate([[0], np.cumsum(lengths)])
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (fresh[1:] != fresh[:-1])) + 1
            out = []
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                for a in range(start, stop, most):
                    b = min(a + most, stop)
                    parts = node[a:b], amount[a:b], home[a:b], lengths[a:b].astype(np.uint8), flat[at[a] : at[b]]
                    out.append((int(group[a]), bool(fresh[a]), float(threshold[a]), b - a, *[p.tobytes() for p in parts]))
            kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    return pack


def _meet(across: bool, few_pairs: int):
    """Compares the two tiles of a unit, or a tile with itself."""
    kinds = {"_nodes": np.int64, "_amounts": np.float64, "_homes": np.bool_, "_lengths": np.uint8, "_letters": np.uint8}

    # All that the workers need is inside, so they need not have this package.
    step, most_bits, at_once = 1 << 16, 27, 1 << 20
    rng = np.random.default_rng(7)
    value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power, inverse = np.ones(64, np.uint64), np.ones(64, np.uint64)
    base = 0x9E3779B97F4A7C15
    back = pow(base, -1, 1 << 64)
    for k in range(1, 64):
        power[k] = int(power[k - 1]) * base % (1 << 64)
        inverse[k] = int(inverse[k - 1]) * back % (1 << 64)
    # Of 256 bits, the one that stands for a letter and the one behind it.
    place = rng.integers(0, 256, 1 << 16).astype(np.uint8)
    single = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def segments(a: int, b: int, t: float):
        """How names of a and b letters may meet: the letters lost, and (start, length, whole, less one, one more) of each segment.

        The last three are the shifts at which to look for the segment as it is, less a letter and with one more.
        """
        least = int(np.floor(t * (a + b) / 2 - 1e-6)) + 1
        if least > a:
            return None
        lost_a, lost_b = a - least, b - least
        units = lost_a + lost_b + 1
        may = [1] * (units // 2)
        if units % 2:
            may.insert(len(may) // 2, 0)
        # What may lose a letter is a letter and a half longer, so that all are about equally rare.
        weights = np.array([1.0 if m else max(0.25, 1 - 1.5 * len(may) / (a + 1.5)) for m in may])
        ends = np.rint(np.concatenate([[0], np.cumsum(weights)]) * a / weights.sum()).astype(int).tolist()
        found = []
        for i, m in enumerate(may):
            start, length = ends[i], ends[i + 1] - ends[i]
            left, right = i + sum(may[:i]), len(may) - 1 - i + sum(may[i + 1 :])

            def shifts(loses: int, gains: int) -> list[int]:
                slack = m - loses - gains
                places = []
                for d in range(-lost_a, lost_b + 1):
                    r = b - a - d + loses - gains
                    fits = abs(d) <= left + slack and abs(r) <= right + slack
                    fits = fits and max(-d, 0) + max(-r, 0) + loses <= lost_a and max(d, 0) + max(r, 0) + gains <= lost_b
                    if fits and start + d >= 0 and start + d + length - loses + gains <= b:
                        places.append(d)
                return places

            found.append((start, length, shifts(0, 0), shifts(1, 0) if m and length else [], shifts(0, 1) if m and length > 1 else []))
        return lost_a + lost_b, found

    def tile(parts: list[dict]) -> dict[int, dict]:
        """The rows of a tile by the length of their names; letters lie place by place."""
        rows = {c: np.concatenate([np.frombuffer(p[c], kind) for p in parts]) for c, kind in kinds.items()}
        starts = np.concatenate([[0], np.cumsum(rows["_lengths"], dtype=np.int64)])[:-1]
        by_length = {}
        for n in np.unique(rows["_lengths"]).tolist():
            which = np.flatnonzero(rows["_lengths"] == n)
            letters = np.ascontiguousarray(rows["_letters"][starts[which, None] + np.arange(n)].T)
            by_length[n] = {
                "node": rows["_nodes"][which], "amount": rows["_amounts"][which], "home": rows["_homes"][which],
                "letters": letters, "bits": bits(letters),
            }
        return by_length

    def bits(letters: np.ndarray) -> np.ndarray:
        """256 bits of the two letters at each place of each name.

        A bit in which two names differ stands for two letters that are not side
        by side in both; each letter that is lost parts three such pairs at most.
        """
        found = np.zeros((letters.shape[1], 4), np.uint64)
        flat, own = found.reshape(-1), np.arange(0, found.size, 4)
        for k in range(len(letters) - 1):
            at = place[letters[k].astype(np.int64) << 8 | letters[k + 1]]
            flat[own + (at >> 6)] |= single[at & 63]
        return found

    def chosen(rows: dict, which: np.ndarray) -> dict:
        return rows if which.all() else {c: v[:, which] if c == "letters" else v[which] for c, v in rows.items()}

    def sums(letters: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings of the given places."""
        found = np.zeros((len(letters) + 1, letters.shape[1]), np.uint64)
        for k, letter in enumerate(letters):
            np.add(found[k], value.take(letter) * power[k], out=found[k + 1])
        return found

    def whole(h: np.ndarray, s: int, e: int) -> np.ndarray:
        return (h[e] - h[s]) * inverse[s]

    def without(h: np.ndarray, s: int, e: int, k: int) -> np.ndarray:
        """The hash of the places from s to e but k."""
        return ((h[k] - h[s]) + (h[e] - h[k + 1]) * inverse[1]) * inverse[s]

    def indexed(short: dict, start: int, length: int, less: bool):
        """The names by the hash of a segment, sorted, the distinct hashes, and tables of their first bits."""
        n = short["letters"].shape[1]
        low = np.uint64((1 << max(1, int(n - 1).bit_length())) - 1)
        keys = np.empty((1 + (length if less else 0), n), np.uint64)
        for at in range(0, n, step):
            h = sums(short["letters"][start : start + length, at : at + step])
            keys[0, at : at + step] = whole(h, 0, length)
            for k in range(len(keys) - 1):
                keys[k + 1, at : at + step] = without(h, 0, length, k)
        keys &= ~low
        keys |= np.arange(n, dtype=np.uint64)
        keys = np.sort(keys, axis=None)
        n_bits = min(most_bits, max(9, int(16 * len(keys)).bit_length()))
        first = (keys >> np.uint64(64 - n_bits)).view(np.int64)
        byte, bit = first >> 3, np.uint8(1) << (first & 7).astype(np.uint8)
        runs = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        table = np.zeros(1 << (n_bits - 3), np.uint8)
        table[byte[runs]] = np.bitwise_or.reduceat(bit, runs)
        names, keys = (keys & low).astype(np.int32), keys & ~low
        runs = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, runs = keys[runs], np.append(runs, len(keys))
        # Where the hashes with the same first bits begin; about one each.
        n_first = max(1, int(len(keys)).bit_length())
        drawer = np.uint64(64 - n_first)
        begins = np.zeros((1 << n_first) + 1, np.int64)
        np.cumsum(np.bincount((keys >> drawer).view(np.int64), minlength=1 << n_first), out=begins[1:])
        return names, keys, runs, low, table, np.uint64(64 - n_bits), begins, drawer

    def looked_up(index, h: np.ndarray, origin: int, segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names whose hashes are in the index, and where their matches begin and end there."""
        _, keys, runs, low, table, shift, begins, drawer = index
        start, length, as_is, less, more = segment
        hits, who = [], []

        def look(key: np.ndarray) -> None:
            at = (key >> shift).view(np.int64)
            found = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(found):
                hits.append(key[found])
                who.append(found)

        for d in as_is:
            look(whole(h, start + d - origin, start + d - origin + length))
        for d in less:
            look(whole(h, start + d - origin, start + d - origin + length - 1))
        for d in more:
            s = start + d - origin
            for k in range(s + 1, s + length):
                look(without(h, s, s + length + 1, k))
        if not hits:
            return (np.empty(0, np.int64),) * 3
        hits, who = np.concatenate(hits) & ~low, np.concatenate(who)
        at = (hits >> drawer).view(np.int64)
        at, end = begins[at], begins[at + 1]
        found = [(np.empty(0, np.int64),) * 2]
        while len(hits):
            there = at < end
            at, end, hits, who = at[there], end[there], hits[there], who[there]
            key = keys[at]
            same = key == hits
            found.append((who[same], at[same]))
            there = key < hits
            at, end, hits, who = at[there] + 1, end[there], hits[there], who[there]
        who, at = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return who, runs[at], runs[at + 1]

    def alike(short: dict, long: dict, i: np.ndarray, j: np.ndarray, most: int, in_order: np.ndarray | None):
        """Of the pairs, those that pass the bounds on letters side by side and amounts."""
        differing = np.bitwise_count(short["bits"].take(i, axis=0) ^ long["bits"].take(j, axis=0))
        # The sum of four bytes; 256 reads 0, which only keeps the pair.
        few = differing.view(np.uint32).ravel() * np.uint32(0x01010101) >> np.uint32(24) <= 3 * most
        i, j = i[few], j[few]
        fits = np.abs(short["amount"][i] - long["amount"][j]) < 0.01
        if in_order is not None:
            fits &= in_order[j] | (short["node"][i] < long["node"][j])
        return i[fits], j[fits]

    def in_common(short: dict, long: dict, i: np.ndarray, j: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the pairs that have ``least`` letters in the same order, found by the bits of the shorter name."""
        left, right = [], []
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            a, b = short["letters"][:, p].T.copy(), long["letters"][:, q]
            equal = np.zeros((len(p), 64), np.bool_)
            open_places = np.full(len(p), ~np.uint64(0))
            for letter in b:
                np.equal(a, letter[:, None], out=equal[:, : a.shape[1]])
                met = open_places & np.packbits(equal, axis=1, bitorder="little").view("<u8").ravel()
                open_places = (open_places + met) | (open_places - met)
            enough = np.bitwise_count(~open_places) >= least
            left.append(short["node"][p[enough]])
            right.append(long["node"][q[enough]])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))

    def compare(short: dict, longs: list[tuple], a: int, t: float) -> Iterator[tuple]:
        """Pairs of names of a letters with names that are not shorter, given as (letters, rows, in_order)."""
        n, by_index = len(short["node"]), {}
        for b, long, in_order in longs:
            m = len(long["node"])
            way = segments(a, b, t) if n and m else None
            if way is None:
                continue
            most, parts = way
            if n * m > few_pairs:
                by_index.setdefault(most, []).append((b, long, in_order, parts, []))
                continue
            columns = max(1, at_once // n)
            for at in range(0, m, columns):
                stop = min(m, at + columns)
                i, j = np.divmod(np.arange(n * (stop - at)), stop - at)
                i, j = alike(short, long, i, j + at, most, in_order)
                yield in_common(short, long, i, j, (a + b - most) // 2)
        # The segments follow from the letters that may be lost.
        for most, others in by_index.items():
            for nth, (start, length, *_) in enumerate(others[0][3]):
                index = indexed(short, start, length, any(o[3][nth][3] for o in others))
                for b, long, in_order, parts, pairs in others:
                    meet_in(index, short, long, b, most, parts[nth], in_order, pairs)
            for b, long, in_order, parts, pairs in others:
                if pairs:
                    i, j = np.divmod(np.unique(np.concatenate(pairs)), len(long["node"]))
                    yield in_common(short, long, i, j, (a + b - most) // 2)

    def meet_in(index, short: dict, long: dict, b: int, most: int, segment, in_order, pairs: list) -> None:
        """Adds the pairs of one segment, as i * m + j for m longer names."""
        start, length, *shifts = segment
        reach = sum(shifts, [])
        if not reach:
            return
        names, m = index[0], len(long["node"])
        origin, last = start + min(reach), min(b, start + max(reach) + length + 1)
        for at in range(0, m, step):
            who, begin, stop = looked_up(index, sums(long["letters"][origin:last, at : at + step]), origin, segment)
            ends = np.cumsum(stop - begin)
            total = int(ends[-1]) if len(ends) else 0
            for first in range(0, total, at_once):
                nth = np.arange(first, min(first + at_once, total))
                which = np.searchsorted(ends, nth, "right")
                i, j = alike(short, long, names[stop[which] - ends[which] + nth].astype(np.int64), who[which] + at, most, in_order)
                pairs.append(np.unique(i * m + j))
            if sum(map(len, pairs)) > 4 * at_once:
                pairs[:] = [np.unique(np.concatenate(pairs))]

    def met(parts: list[dict]) -> Iterator[tuple]:
        t = parts[0]["_threshold"]
        sides = [tile(side) if side else {} for side in ([p for p in parts if p["_side"] == of] for of in (False, True))]
        one = parts[0]["_first"] == parts[0]["_second"] and not across
        for x, y in ((0, 0),) if one else ((0, 1), (1, 0)):
            for a, shorter in sides[x].items():
                short, longs = chosen(shorter, shorter["home"]), []
                for b, long in sides[y].items():
                    in_order = None
                    if a == b:
                        # Each pair once: two rows at home meet from one side, others from that of the earlier node.
                        if (x, y) == (1, 0):
                            long = chosen(long, ~long["home"])
                        in_order = long["home"] if (x, y) == (0, 1) else np.zeros(len(long["node"]), bool)
                    if a <= b:
                        longs.append((b, long, in_order))
                yield from compare(short, longs, a, t)

    def run(unit: pa.Table) -> pa.Table:
        found = list(met(unit.to_pylist()))
        left, right = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"_l_node": pa.array(left, pa.int64()), "_r_node": pa.array(right, pa.int64())})

    return run
