"""Distances of items that have vectors (idx, v), reduced in the tasks that compute them: sums, minima, ranks, neighbours.

Items are dealt to blocks and each two blocks to a tile, one task's work; what leaves a tile is a row for each of its items
(or counts of value ranges), never its pairs. Distances are whole numbers of 10^-digits, so that sums are exact and a
quantile is found by counting. A tile's distances come from products of matrices; those that rounding errors of that form
could change are computed again, entry by entry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6
SIDE = 16384  # items a block has at most, on average
SIDE_BYTES = 8 << 20  # bytes of vectors a block has at most, on average
CHUNK = 512  # rows and columns of distances that are in memory at once: 2 MB
SQUARE_BITS = 12
SQUARE = 1 << SQUARE_BITS  # rows and columns of pairs that are put in order at once: 128 MB
COUNTED = 4096  # ranges of values that a pass counts, for each rank


def dealt(items: DataFrame, keys: tuple[str, ...] = (), extra: tuple[str, ...] = (), side: int | None = None) -> DataFrame:
    """Each item of items (keys..., idx, v, extra...) once for every tile (keys..., p <= q) of its block b. Only items of equal keys meet."""
    r = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dims")).first()
    side = side or max(CHUNK, min(SIDE, SIDE_BYTES // (8 * max(r["dims"], 1)), -(-r["n"] // 16)))
    one = items.select(*keys, F.col("idx").cast("int").alias("idx"), F.col("v").cast("array<double>").alias("v"), *extra)
    if keys:
        sizes = items.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("_k"))
        one, tiles = one.join(F.broadcast(sizes), list(keys)), 64
    else:
        blocks = max(1, -(-r["n"] // side))
        one, tiles = one.withColumn("_k", F.lit(blocks)), blocks * (blocks + 1) // 2
    placed = one.withColumn("b", F.pmod(F.xxhash64("idx"), "_k").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    out = placed.select(*keys, "idx", "v", *extra, "b", F.least("b", "_o").alias("p"), F.greatest("b", "_o").alias("q"))
    return out.repartition(min(tiles, 2000), *keys, "p", "q")


def squares(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows of a to all of b, from their squared lengths, and how far they may be off."""
    d = a @ b.T
    d *= -2
    d += na[:, None]
    d += nb
    return np.maximum(d, 0, out=d), (a.shape[1] + 4) * 4.5e-16 * float(na.max() + nb.max())


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a to rows j of b, entry by entry."""
    out = np.empty(len(i))
    for at in range(0, len(i), 8192):
        gap = a[i[at : at + 8192]] - b[j[at : at + 8192]]
        gap *= gap
        out[at : at + 8192] = np.sqrt(gap.sum(axis=1))
    return out


def units(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, unit: float) -> np.ndarray:
    """Distances as whole numbers of 1 / unit."""
    d, off = squares(a, b, na, nb)
    np.sqrt(d, out=d)
    d *= unit
    near = np.rint(d)
    d -= near
    np.abs(d, out=d)
    # Above this length an error of the square is one of at most `slack` units of the distance.
    low = math.sqrt(off) * 1e4
    slack = unit * off / low + 4e-16 * float(near.max()) if off else 0.0
    doubt = (d > 0.5 - slack) | (near < low * unit + 1)
    if doubt.any():
        i, j = np.nonzero(doubt)
        near[i, j] = np.rint(exact(a, b, i, j) * unit)
    return near


class Tile:
    """The items of a tile: its left and right side (the same for a block with itself), sorted by the `order` column if it is given."""

    def __init__(self, table: pa.Table, digits: int = DIGITS, order: str | None = None):
        t = table.combine_chunks()
        b, ids = t["b"].to_numpy(), t["idx"].to_numpy()
        flat = pa.concat_arrays(t["v"].chunks).flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 1))
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        self.same, self.unit = p == q, 10.0**digits
        self.at = [np.flatnonzero(b == x) for x in (p, q)]
        if order:
            by = t[order].to_numpy()
            self.at = [x[np.argsort(by[x], kind="stable")] for x in self.at]
            self.by = [by[x] for x in self.at]
        self.ids = [ids[x] for x in self.at]
        self.v = [v[x] for x in self.at]
        self.n = [(x * x).sum(axis=1) for x in self.v]
        self.empty = not len(self.at[0]) or not len(self.at[1])  # blocks are filled by a hash

    def parts(self) -> Iterator[tuple[slice, slice, bool]]:
        """Rows and columns of each part of the tile, and whether it lies on the diagonal of a block with itself."""
        for r in range(0, len(self.at[0]), CHUNK):
            for c in range(r if self.same else 0, len(self.at[1]), CHUNK):
                yield slice(r, r + CHUNK), slice(c, c + CHUNK), self.same and r == c

    def units(self, r: slice, c: slice) -> np.ndarray:
        return units(self.v[0][r], self.v[1][c], self.n[0][r], self.n[1][c], self.unit)

    def squares(self, r: slice, c: slice) -> tuple[np.ndarray, float]:
        return squares(self.v[0][r], self.v[1][c], self.n[0][r], self.n[1][c])

    def values(self) -> Iterator[np.ndarray]:
        """The distances of the tile's pairs, each once."""
        for r, c, diagonal in self.parts():
            d = self.units(r, c)
            yield d[np.triu_indices(len(d), 1)] if diagonal else d.ravel()

    def whole(self) -> list[tuple[np.ndarray, int]]:
        """Numbers of the sides that have items of their own: both, or one of a block with itself."""
        return [0] if self.same else [0, 1]


def _reduced(items: DataFrame, keys: tuple[str, ...], extra: tuple[str, ...], run: Callable[[pa.Table], dict], schema: str, side: int | None) -> DataFrame:
    """run() on every tile: its columns, after those of the keys."""
    tiles = dealt(items, keys, extra, side)
    types = dict(items.dtypes)
    head = "".join(f"{k} {types[k]}, " for k in keys)

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        n = len(next(iter(out.values())))
        same = {k: pa.array([table[k][0].as_py()] * n, table[k].type) for k in keys}
        return pa.table(same | {k: pa.array(v) for k, v in out.items()})

    return tiles.groupBy(*keys, "p", "q").applyInArrow(one, head + schema)


def nearest(items: DataFrame, keys: tuple[str, ...] = (), digits: int = DIGITS, side: int | None = None) -> DataFrame:
    """keys, idx, nn: the least distance of each item to another of equal keys. Items alone have no row."""

    def run(table: pa.Table) -> dict:
        t = Tile(table, digits)
        low = [np.full(len(x), np.inf) for x in t.ids]
        for r, c, diagonal in t.parts():
            d = t.units(r, c)
            if diagonal:
                np.fill_diagonal(d, np.inf)
            np.minimum(low[0][r], d.min(axis=1), out=low[0][r])
            to = low[0] if t.same else low[1]
            np.minimum(to[c], d.min(axis=0), out=to[c])
        ids, d = (np.concatenate([x[k] for k in t.whole()]) for x in (t.ids, low))
        some = np.isfinite(d)
        return {"idx": ids[some], "nn": d[some] / t.unit}

    return _reduced(items, keys, (), run, "idx int, nn double", side).groupBy(*keys, "idx").agg(F.min("nn").alias("nn"))


def sums(items: DataFrame, digits: int = DIGITS, side: int | None = None) -> DataFrame:
    """idx, other, total, n: of items (idx, v, cluster INT), the sum of distances of each to the others of every cluster, and their number."""

    def run(table: pa.Table) -> dict:
        t = Tile(table, digits, "cluster")
        if t.empty:
            return {"idx": np.zeros(0, np.int32), "other": np.zeros(0, np.int32), "s": np.zeros(0), "n": np.zeros(0, np.int64)}
        starts = [np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) for by in t.by]
        group = [np.cumsum(np.r_[False, by[1:] != by[:-1]]) for by in t.by]
        total = [np.zeros((len(t.ids[k]), len(starts[1 - k]))) for k in (0, 1)]
        for r, c, diagonal in t.parts():
            d = t.units(r, c)
            for k, (mine, others, m) in enumerate(((r, c, d), (c, r, d.T))):
                if diagonal and k:
                    continue
                g = group[1 - k][others]
                cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                total[0 if t.same else k][mine, g[cut]] += np.add.reduceat(m, cut, axis=1)
        ids, other, s, n = [], [], [], []
        for k in t.whole():
            names, counts = t.by[1 - k][starts[1 - k]], np.bincount(group[1 - k])
            n_of = np.broadcast_to(counts, total[k].shape).copy()
            if t.same:
                n_of[np.arange(len(n_of)), group[0]] -= 1
            ids.append(np.repeat(t.ids[k], len(names)))
            other.append(np.tile(names, len(t.ids[k])))
            s.append(total[k].ravel())
            n.append(n_of.ravel())
        ids, other, s, n = (np.concatenate(x) for x in (ids, other, s, n))
        some = n > 0
        return {"idx": ids[some], "other": other[some], "s": s[some], "n": n[some].astype(np.int64)}

    per = _reduced(items.withColumn("cluster", F.col("cluster").cast("int")), (), ("cluster",), run, "idx int, other int, s double, n long", side)
    return per.groupBy("idx", "other").agg((F.sum("s") / F.lit(10.0**digits)).alias("total"), F.sum("n").alias("n"))


def spread(items: DataFrame, keys: tuple[str, ...] = (), digits: int = DIGITS, side: int | None = None) -> DataFrame:
    """keys, n, mean, std (population), lo, hi of the distances of all pairs of equal keys."""

    def run(table: pa.Table) -> dict:
        t = Tile(table, digits)
        n, mean, m2, lo, hi = 0, 0.0, 0.0, np.inf, -np.inf
        for d in t.values():
            if len(d):
                lo, hi, here = min(lo, float(d.min())), max(hi, float(d.max())), float(d.mean())
                d -= here
                gap, both = here - mean, n + len(d)
                m2 += float(d @ d) + gap * gap * n * len(d) / both
                mean, n = mean + gap * len(d) / both, both
        return {"n": np.array([n] if n else [], np.int64), **{k: np.array([x / u] if n else [], float) for k, x, u in (("mean", mean, t.unit), ("m2", m2, t.unit**2), ("lo", lo, t.unit), ("hi", hi, t.unit))}}

    per = _reduced(items, keys, (), run, "n long, mean double, m2 double, lo double, hi double", side)
    all_ = per.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("m2").alias("_in"), F.collect_list(F.struct("n", "mean")).alias("_t"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    between = F.aggregate("_t", F.lit(0.0), lambda acc, x: acc + x["n"] * (x["mean"] - F.col("mean")) ** 2)  # a number for each tile
    return all_.select(*keys, "n", "mean", F.sqrt((F.col("_in") + between) / F.col("n")).alias("std"), "lo", "hi")


def order_statistics(items: DataFrame, places: dict[tuple, list[int]], keys: tuple[str, ...] = (), digits: int = DIGITS, side: int | None = None) -> dict[tuple, list[float]]:
    """The distances with the given places (from 0) in ascending order, for each value of the keys (one, (), without keys).

    A pass counts each open range of values in COUNTED parts, until a part is one value: two passes for unit vectors at six
    digits. A range's parts are all that is gathered.
    """
    top = items.agg(F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))).first()[0] or 0.0
    bits = max(1, math.ceil(2 * math.sqrt(top) * 10**digits + 2).bit_length())
    step = COUNTED.bit_length() - 1
    state = {k: {p: (0, p) for p in at} for k, at in places.items()}  # place: start of its range, place within it
    first = True
    while bits > 0:
        shift = max(0, bits - step)
        spans = {k: sorted({lo for lo, _ in at.values()}) for k, at in state.items()}

        def run(table: pa.Table, shift: int = shift, bits: int = bits, spans: dict = spans, first: bool = first) -> dict:
            mine = spans.get(tuple(table[k][0].as_py() for k in keys), [])
            held = np.zeros((len(mine), 1 << (bits - shift)), np.int64)
            if mine:
                t = Tile(table, digits)
                for d in t.values() if first else ():
                    held[0] += np.bincount(d.astype(np.int64) >> shift, minlength=held.shape[1])
                for r, c, diagonal in () if first else t.parts():
                    near, off = t.squares(r, c)
                    if diagonal:
                        near[np.tril_indices(len(near))] = np.inf
                    for row, lo in enumerate(mine):
                        low, high = max(lo - 1, 0) / t.unit, (lo + (1 << bits)) / t.unit
                        a, b = np.nonzero((near >= low * low - off) & (near <= high * high + off))
                        # few are within a range; where many are, products of matrices are cheaper
                        d = np.rint(exact(t.v[0][r], t.v[1][c], a, b) * t.unit) if len(a) * 8 < near.size else t.units(r, c)[a, b]
                        y = d.astype(np.int64) - lo
                        held[row] += np.bincount(y[(y >= 0) & (y < 1 << bits)] >> shift, minlength=held.shape[1])
            row, part = np.nonzero(held)
            return {"row": row.astype(np.int32), "part": part.astype(np.int32), "c": held[row, part]}

        counted = _reduced(items, keys, (), run, "row int, part int, c long", side).groupBy(*keys, "row", "part").agg(F.sum("c").alias("c")).collect()
        table: dict = {}
        for x in counted:
            table.setdefault((tuple(x[k] for k in keys), x["row"]), []).append((x["part"], x["c"]))
        for k, at in state.items():
            for p, (lo, left) in at.items():
                for part, c in sorted(table.get((k, spans[k].index(lo)), [])):
                    if left < c:
                        at[p] = (lo + (part << shift), left)
                        break
                    left -= c
        bits, first = shift, False
    return {k: [state[k][p][0] / 10.0**digits for p in at] for k, at in places.items()}


def quantiles(items: DataFrame, qs: list[float], keys: tuple[str, ...] = (), digits: int = DIGITS, side: int | None = None, value: Callable[[float], float] = lambda x: x) -> dict[tuple, list[float]]:
    """Exact quantiles of the distances of all pairs, linearly interpolated, for each value of the keys that has a pair. value() is a rising function that distances go through first."""
    sizes = {tuple(r[k] for k in keys): r["_n"] for r in items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).collect()}
    at = {k: [q * (n * (n - 1) // 2 - 1) for q in qs] for k, n in sizes.items() if n > 1}
    got = order_statistics(items, {k: [p for x in xs for p in (math.floor(x), math.ceil(x))] for k, xs in at.items()}, keys, digits, side) if at else {}
    return {k: [value(a) + (x - math.floor(x)) * (value(b) - value(a)) for x, a, b in zip(at[k], v[::2], v[1::2])] for k, v in got.items()}


def quantile(items: DataFrame, q: float, digits: int = DIGITS, value: Callable[[float], float] = lambda x: x) -> float | None:
    """One quantile of all pairs; None without pairs."""
    return quantiles(items, [q], digits=digits, value=value).get((), [None])[0]


def _lows(d: np.ndarray, axis: int, k: int) -> np.ndarray:
    """For each row (axis 1) or column (axis 0), the least of 2 k parts of what it holds: k of them are no less than its k least."""
    n = d.shape[axis]
    g = min(max(2 * k, 16), n)
    if axis:
        return d[:, : n // g * g].reshape(len(d), n // g, g).min(axis=1)
    return d[: n // g * g].reshape(n // g, g, d.shape[1]).min(axis=0).T


def knn(items: DataFrame, k: int = 10, digits: int | None = DIGITS, side: int | None = None) -> DataFrame:
    """i, j, d, rank of the k nearest of each item; ties by j. A tile hands on k rows for each of its items.

    A tile keeps a bound for each item's k-th nearest and looks closely at what is within it.
    """

    def run(table: pa.Table) -> dict:
        t = Tile(table, 0 if digits is None else digits)
        if t.empty:
            return {"i": np.zeros(0, np.int32), "j": np.zeros(0, np.int32), "d": np.zeros(0)}
        best = [np.full((len(x), k), np.inf) for x in t.ids]
        if t.same:
            best[1] = best[0]
        found: list = [[], []]
        slack = 2.0 / t.unit if digits is not None else 0.0

        def within(d: np.ndarray, off: float, bound: np.ndarray) -> np.ndarray:
            return (np.sqrt(np.maximum(bound, 0) + off) + slack) ** 2 + 2 * off

        for r, c, diagonal in t.parts():
            d, off = t.squares(r, c)
            if diagonal:
                np.fill_diagonal(d, np.inf)
            for s, (mine, axis) in enumerate(((r, 1), (c, 0))):
                if diagonal and s:
                    continue
                low = np.concatenate([best[s][mine], _lows(d, axis, k)], axis=1)
                best[s][mine] = np.partition(low, k - 1, axis=1)[:, :k]
                limit = within(d, off, best[s][mine].max(axis=1))
                a, b = np.nonzero(d <= (limit[:, None] if axis else limit)) if axis else np.nonzero(d <= limit)[::-1]
                to = 0 if t.same else s
                x, y = (a + r.start, b + c.start) if axis else (a + c.start, b + r.start)
                value = d[a, b] if axis else d[b, a]
                some = np.isfinite(value)
                found[to].append((x[some], y[some], value[some], np.full(int(some.sum()), off)))
        out = []
        for s in t.whole():
            x, y, near, off = (np.concatenate(z) for z in zip(*found[s]))
            some = near <= within(near, off, best[s].max(axis=1)[x])
            x, y = x[some], y[some]
            d = exact(t.v[s], t.v[1 - s], x, y)
            d = d if digits is None else np.rint(d * t.unit) / t.unit
            i, j = t.ids[s][x], t.ids[1 - s][y]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.r_[True, i[1:] != i[:-1]]
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) if len(i) else i
            out.append((i[place < k], j[place < k], d[place < k]))
        i, j, d = (np.concatenate(z) for z in zip(*out))
        return {"i": i, "j": j, "d": d}

    near = _reduced(items, (), (), run, "i int, j int, d double", side)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def closest(items: DataFrame, most: int = 50, digits: int = DIGITS, side: int | None = None) -> DataFrame:
    """i, j, d of the `most` closest pairs; ties by i, j."""

    def run(table: pa.Table) -> dict:
        t = Tile(table, digits)
        kept = [np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        for r, c, diagonal in t.parts():
            d = t.units(r, c)
            if diagonal:
                d[np.tril_indices(len(d))] = np.inf
            limit = kept[0][-1] if len(kept[0]) >= most else np.inf
            some = d[d <= limit]
            if len(some) > most:
                limit = np.partition(some, most - 1)[most - 1]
            a, b = np.nonzero((d <= limit) & (d < np.inf))
            x, y = t.ids[0][r][a], t.ids[1][c][b]
            kept = [np.concatenate(z) for z in zip(kept, (d[a, b], np.minimum(x, y), np.maximum(x, y)))]
            order = np.lexsort((kept[2], kept[1], kept[0]))[:most]
            kept = [z[order] for z in kept]
        return {"i": kept[1].astype(np.int32), "j": kept[2].astype(np.int32), "d": kept[0] / t.unit}

    return _reduced(items, (), (), run, "i int, j int, d double", side).orderBy("d", "i", "j").limit(most)


def euclidean(items: DataFrame, digits: int = DIGITS, side: int | None = None) -> DataFrame:
    """i, j, d of all i < j. A tile's pairs leave it square by square, each in order of distance: equal distances stand together, so that a written table takes half the bytes a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tile(pa.Table.from_batches(list(batches)), digits)
        if t.empty:
            return
        cuts = [np.linspace(0, len(x), -(-len(x) // SQUARE) + 1).astype(int) for x in t.ids]
        for r0, r1 in zip(cuts[0], cuts[0][1:]):
            for c0, c1 in zip(cuts[1], cuts[1][1:]):
                if t.same and c0 < r0:
                    continue
                keys, at = np.empty((r1 - r0) * (c1 - c0), np.int64), 0
                for r in range(r0, r1, CHUNK):
                    for c in range(c0, c1, CHUNK):
                        x, y = slice(r, min(r + CHUNK, r1)), slice(c, min(c + CHUNK, c1))
                        place = (np.arange(r - r0, x.stop - r0)[:, None] << SQUARE_BITS) | np.arange(c - c0, y.stop - c0)
                        d = t.units(x, y)
                        if d.max() >= 2.0 ** (63 - 2 * SQUARE_BITS):
                            raise ValueError("distances are too long to be told apart at so many digits")
                        d = (d.astype(np.int64) << (2 * SQUARE_BITS)) | place
                        d = d[np.arange(r, x.stop)[:, None] < np.arange(c, y.stop)] if t.same and r1 > c0 else d.ravel()
                        keys[at : at + len(d)] = d
                        at += len(d)
                keys = keys[:at]
                keys.sort()
                low = (1 << SQUARE_BITS) - 1
                for k in range(0, at, CHUNK * CHUNK):
                    some = keys[k : k + CHUNK * CHUNK]
                    x, y = t.ids[0][r0:r1][(some >> SQUARE_BITS) & low], t.ids[1][c0:c1][some & low]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array((some >> (2 * SQUARE_BITS)) / t.unit)], ["i", "j", "d"])

    return dealt(items, side=side).groupBy("p", "q").applyInArrow(run, "i int, j int, d double")


def best_sources(sources: DataFrame, targets: DataFrame, tolerance: float, scale: float | None, digits: int = DIGITS, side: int = SIDE) -> DataFrame:
    """dst, dn, src: of sources and targets (idx, v, difficulty), the nearest source of each target from which difficulty falls by no more than the tolerance, in each tile of a block of sources and one of targets. Distances are over the scale, held to 1; ties go to the least source."""
    ns, nt = (-(-max(x.count(), 1) // side) for x in (sources, targets))
    place = lambda x, mine, others: x.select(F.col("idx").cast("int").alias("idx"), F.col("v").cast("array<double>").alias("v"), F.col("difficulty").cast("double").alias("difficulty"), F.pmod(F.xxhash64("idx"), F.lit(mine)).cast("int").alias("_m"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("_o"))
    left = place(sources, ns, nt).select("idx", "v", "difficulty", F.lit(0).alias("b"), F.lit(0).alias("p"), F.lit(1).alias("q"), F.col("_m").alias("x"), F.col("_o").alias("y"))
    right = place(targets, nt, ns).select("idx", "v", "difficulty", F.lit(1).alias("b"), F.lit(0).alias("p"), F.lit(1).alias("q"), F.col("_o").alias("x"), F.col("_m").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, digits, "difficulty")
        n = len(t.ids[1])
        dn, src = np.full(n, np.inf), np.full(n, np.iinfo(np.int32).max, np.int64)
        for r, c, _ in t.parts():
            d = t.units(r, c) / t.unit
            d = np.minimum(d / scale, 1.0) if scale >= 1e-12 else np.zeros_like(d)
            d[t.by[0][r][:, None] > t.by[1][c] + tolerance] = np.inf
            low = d.min(axis=0)
            who = np.where(d == low, t.ids[0][r].astype(np.int64)[:, None], np.iinfo(np.int32).max).min(axis=0)
            src[c] = np.where(low < dn[c], who, np.where(low == dn[c], np.minimum(src[c], who), src[c]))
            dn[c] = np.minimum(dn[c], low)
        some = np.isfinite(dn)
        return pa.table({"dst": t.ids[1][some], "dn": dn[some], "src": src[some].astype(np.int32)})

    tiles = left.unionByName(right).repartition(min(ns * nt, 2000), "x", "y")
    return tiles.groupBy("x", "y").applyInArrow(run, "dst int, dn double, src int")
