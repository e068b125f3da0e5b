"""MinHash near-dedup by a chosen-path set similarity join.

Texts with equal shingle sets form a class; classes are what is compared. Each of several independent trees sends a class
down from its root: a node's key picks some of the MinHash coordinates (1 / threshold of them in expectation), and the
class branches to the children named by its minwise tokens there, so that classes that are alike keep meeting. Small nodes
are compared exhaustively, at every level. In large nodes each class is compared with the node's centre. Classes close to a
centre are a crowd, which branching would not part: they are compared with the rest of all nodes of that centre, in blocks, on
the full sets. The others branch on; what is left after the last level is compared in blocks, too. Every link is confirmed on the
full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, bit_filter, decide, materialize, may_be_in, release, row_key, session, text_md5

COORDINATES = 64
TREES = 12
SMALL = 24  # classes of a node that is compared exhaustively
#: Levels of branching below the roots' children; what is left then is compared across components. A pair at the threshold
#: that stays in crowded nodes down to the last level is apart in all trees with probability 7e-8 (miss()).
DEPTH = 2
BLOCK, BLOCK_BYTES = 8192, 16 << 20  # classes, and bytes of their sets, of a block of a node that is compared at the last level
ONE_TASK = 1 << 20  # links (16 MB) that one task merges
PAIRS = 500  # of a centre that are confirmed by one task
#: Of 64 coordinates two sets at the threshold share 51 in expectation, and fewer than this with probability 1e-6.
AGREE = 35
#: A class that shares so many with a node's centre is part of its crowd. Who shares AGREE with such a class shares at least
#: CROWD + AGREE - COORDINATES with the centre.
CROWD = 40

_U = np.uint64
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_C = _rng.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes. Hashes of words are kept between texts, up to a bound."""

    def __init__(self, width: int = 4, kept: int = 200_000):
        self.width, self.kept, self.cache = width, kept, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both on ASCII alone
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > self.kept:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, _U(k))
        for i in range(k):
            out = out * _C[15] + _mix(h[i : len(h) - k + 1 + i] + _C[i])
        return np.unique(_mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, 32 bits; all ones for an empty set."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[i : i + 2048, None] * _A + _B).min(axis=0))
    return (low >> _U(32)).astype(np.uint32)


def _sketch(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            n, mark, sig = [], [], []
            for text in batch.column(2):
                s = shingler(text.as_py())
                n.append(len(s))
                mark.append(np.array([s.sum(dtype=np.uint64), _mix(s + _C[7]).sum(dtype=np.uint64)]).tobytes())
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "tk", "n", "mark", "sig"])
        del shingler
        release()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _child(key: np.ndarray, coordinate: np.ndarray, sig: np.ndarray) -> np.ndarray:
    return _mix(key * _C[8] + coordinate.astype(np.uint64) * _C[9] + sig[np.arange(len(key)), coordinate].astype(np.uint64))


def _emit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    key, cid, n = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cid), pa.array(n)], ["key", "cid", "n"])


NODE = "key long, cid long, n long"


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From cid, n, sig: the children of each tree's root. A root uses two coordinates of its own."""
    for batch in batches:
        sig, cid, n = _matrix(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = []
        for t in range(TREES):
            for c in (t, COORDINATES - 1 - t):
                parts.append((_child(np.full(len(cid), _mix(np.array([t], np.uint64))[0]), np.full(len(cid), c), sig), cid, n))
        if len(cid):
            yield _emit(parts)


def _branch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key, cid, n, sig: the children that each class goes on to. A key alone picks its coordinates: one, and in half of nodes a second."""
    for batch in batches:
        if batch.num_rows:
            key, cid, n, sig = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
            one = (_mix(key ^ _C[10]) % _U(COORDINATES)).astype(np.int64)
            two = (_mix(key ^ _C[11]) % _U(COORDINATES)).astype(np.int64)
            also = (_mix(key ^ _C[12]) & _U(1) == 0) & (one != two)
            yield _emit([(_child(key, one, sig), cid, n), (_child(key[also], two[also], sig[also]), cid[also], n[also])])


def miss(similarity: float, depth: int = DEPTH) -> float:
    """The probability that a pair in crowded nodes is apart in all trees after so many levels. Trees draw on the same coordinates: they are independent only given how many of these agree."""
    total = 0.0
    for k in range(COORDINATES + 1):
        p, apart = k / COORDINATES, 0.0
        for _ in range(depth):
            one = 1 - p + p * apart
            apart = (one + one * one) / 2
        total += comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) * (1 - p + p * apart) ** (2 * TREES)
    return total


def _shingled(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["cid", "shingles"])
        del shingler
        release()

    return run


class _Sets:
    """A union-find over small numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


class _Met:
    """Which classes of a task are compared in a node with a key below this one: both are in it, and one at least is out there."""

    width = 256

    def __init__(self, keys: list[np.ndarray], outs: list[np.ndarray], key: int):
        self.rows = len(keys)
        owner, flat, out = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys), np.concatenate(outs)
        below = flat < key
        owner, flat, out = owner[below], flat[below], out[below]
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        self.owner, self.at, self.out, self.count = owner[shared], (np.cumsum(times > 1) - 1)[at[shared]], out[shared], int((times > 1).sum())

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        met = np.zeros((len(x), len(y)), bool)
        for low in range(0, self.count, self.width):
            member, out = np.zeros((2, self.rows, self.width), np.float32)
            here = (self.at >= low) & (self.at < low + self.width)
            member[self.owner[here], self.at[here] - low] = 1
            out[self.owner[here], self.at[here] - low] = self.out[here]
            met |= out[x] @ member[y].T + member[x] @ out[y].T > 0
        return met


def _across(percent: int):
    """Of a pair of blocks of a node (key, i, j, home, cid, n, comp, sig, keys, outs, shingles), the first one of what is out:
    links, confirmed on the full sets, that join two components. They are fewer than the classes."""
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        i, j, home, cid, n = (t[x].to_numpy() for x in ("i", "j", "home", "cid", "n"))
        comp, sig = np.unique(t["comp"].to_numpy(), return_inverse=True)[1], _matrix(t["sig"])
        shingles = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        met = _Met([np.array(x, np.int64) for x in t["keys"].to_pylist()], [np.array(x, bool) for x in t["outs"].to_pylist()], t["key"][0].as_py())
        left, right = np.flatnonzero(home == i[0]), np.flatnonzero(home == j[0])
        sets, links = _Sets(int(comp.max()) + 1), []
        columns = np.ascontiguousarray(sig[right].T)
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            agree = np.zeros((len(some), len(right)), np.uint8)
            for c in range(COORDINATES):
                agree += sig[some, c][:, None] == columns[c]
            fits = np.minimum.outer(n[some], n[right]) * 100 >= np.maximum.outer(n[some], n[right]) * percent
            ok = (agree >= AGREE) & fits & (comp[some][:, None] != comp[right]) & ~met(some, right)
            if i[0] == j[0]:
                ok &= some[:, None] < right
            for row in np.flatnonzero(ok.any(axis=1)):
                x = some[row]
                mine = shingles[x]
                tried = right[ok[row]]
                for k in range(0, len(tried), 512):
                    of = sets.roots()[comp]
                    y = tried[k : k + 512]
                    y = y[of[y] != of[x]]
                    if not len(y):
                        continue
                    theirs = np.concatenate([shingles[v] for v in y])
                    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    both = np.add.reduceat(hit, np.cumsum(n[y]) - n[y], dtype=np.int64)
                    for v in y[100 * both >= percent * (n[x] + n[y] - both)]:
                        a, b = sets.find(comp[x]), sets.find(comp[v])
                        if a != b:
                            sets.up[max(a, b)] = min(a, b)
                            links.append((min(cid[x], cid[v]), max(cid[x], cid[v])))
        a, b = zip(*links) if links else ((), ())
        del shingles, sig, columns, t
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From cid, centre, n, sig, the centre's sig, out: whether a class is of its centre's crowd, and whether it can be alike with one that is."""
    for batch in batches:
        if batch.num_rows:
            out = batch.column(5).to_numpy(zero_copy_only=False)
            same = (_matrix(batch.column(3)) == _matrix(batch.column(4))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out & (same >= CROWD)), pa.array(same >= CROWD + AGREE - COORDINATES)], ["cid", "centre", "n", "sig", "out", "kin"])


def _agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1).astype(np.int32)
            keep = same >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(same[keep])], ["a", "b", "same"])


def _confirm(width: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, left = Shingler(width), None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, left = a, shingler(ta.as_py())
                right = shingler(tb.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])
        del shingler
        release()

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) to the least node that each node reaches, but for those that are the least."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while (up[u] != up[v]).any():
        low = np.minimum(up[u], up[v])
        np.minimum.at(up, up[u], low)
        np.minimum.at(up, up[v], low)
        while (up[up] != up).any():
            up = up[up]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    for i in range(0, len(moved), 100_000):
        part = moved[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[up[part]])], ["cid", "comp"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): cid, comp (the smallest cid of its component), for each cid that has a link.

    Up to ONE_TASK links are merged by one task. More are merged by alternating large and small stars: every step joins each
    node's neighbours to its least neighbour, so that paths shrink by a factor. A step is one written table; nothing but its
    size and checksum comes to the driver.
    """
    def written(df: DataFrame, files: int | None) -> tuple[DataFrame, tuple]:
        seen = Observation()
        df = df.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"))
        out = materialize(df.coalesce(files) if files else df, "edges")
        return out, (seen.get["n"], seen.get["x"])

    edges, state = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), None)
    if state[0] <= ONE_TASK:
        return materialize(edges.coalesce(1).mapInArrow(_merge, "cid long, comp long"), "merged")
    while state[0]:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, now = written(small, 8 + state[0] // 500_000)  # in proportion to the links
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp"))


def _sizes_fit(percent: int, x: str, y: str) -> F.Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


class _Join:
    """The state of one similarity join: classes, confirmed links, components."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.texts = src.select("doc_id", F.md5(F.col("text").cast("binary")).alias("tk"), "text")
        sketched = self.texts.mapInArrow(_sketch(width), "doc_id long, tk string, n long, mark binary, sig binary")
        with session(docs.sparkSession, SMALL_BATCHES):
            self.rows = materialize(sketched, "sketches")
        classes = self.rows.where("n > 0").groupBy("mark").agg(F.min("doc_id").alias("doc"), F.min(F.struct("tk", "n", "sig")).alias("x"))
        self.classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "mark", "doc", "x.tk", "x.n", "x.sig"), "classes")
        self.tried: DataFrame | None = None
        self.comp: DataFrame | None = None

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose signatures agree enough, with the number of coordinates that do."""
        sig = self.classes.select("cid", "sig")
        both = pairs.join(sig.withColumnsRenamed({"cid": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"cid": "b", "sig": "sb"}), "b")
        return materialize(both.select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long, same int"), "alike")

    def texts_of(self, cids: DataFrame) -> DataFrame:
        """cid and the text of each class of a written table of distinct cids. A text is read once, whatever its number of copies."""
        wanted = materialize(cids.join(self.classes.select("cid", "tk"), "cid"), "wanted")
        near = may_be_in(self.texts, F.col("tk"), bit_filter(wanted, "tk")).select("tk", "text")
        return near.groupBy("tk").agg(F.min("text").alias("text")).join(wanted, "tk").select("cid", "text")

    def confirm(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b) of a written table on their full sets and merge the components that links join."""
        if pairs.isEmpty():
            return
        wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "cid")
        with session(pairs.sparkSession, SMALL_BATCHES):
            texts = materialize(self.texts_of(wanted), "texts")
            # A class in many pairs, the centre of a crowd, has copies of its text, so that its pairs are not one task's.
            slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("k"))
            copies = texts.withColumnsRenamed({"cid": "a", "text": "ta"}).join(slices, "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("slice"))
            dealt = pairs.join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("slice"))
            both = dealt.join(texts.withColumnsRenamed({"cid": "b", "text": "tb"}), "b").join(copies, ["a", "slice"])
            self.link(materialize(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(self.width, self.percent), "a long, b long"), "links"))

    def link(self, links: DataFrame) -> None:
        """Merge the components that links (a, b) join."""
        merged = components(self.labelled(links, "a", "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
        if self.comp is not None:
            # Known members follow their component's head; heads and classes without links are in `merged` themselves.
            to = merged.select(F.col("cid").alias("comp"), F.col("comp").alias("_to"))
            merged = materialize(self.comp.join(to, "comp", "left").select("cid", F.coalesce("_to", "comp").alias("comp")).unionByName(merged), "components")
        self.comp = merged

    def labelled(self, df: DataFrame, *names: str) -> DataFrame:
        """df with a column <name>_comp for each column of cids."""
        for x in names:
            if self.comp is None:
                df = df.withColumn(f"{x}_comp", F.col(x))
            else:
                df = df.join(self.comp.select(F.col("cid").alias(x), "comp"), x, "left").withColumn(f"{x}_comp", F.coalesce("comp", x)).drop("comp")
        return df

    def try_pairs(self, pairs: DataFrame, best_first: bool = False) -> None:
        """All links among candidate pairs; a pair is tried once."""
        self.try_alike(self.alike(self.untried(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())), best_first)

    def untried(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti")

    def try_alike(self, good: DataFrame, best_first: bool) -> None:
        """All links among pairs (a, b, same) of a written table. best_first: in two rounds, the best partner of each class, then only pairs that still join two components."""
        self.tried = good.select("a", "b") if self.tried is None else self.tried.unionByName(good.select("a", "b"))
        if not best_first:
            self.confirm(good)
            return
        best = good.groupBy("b").agg(F.max(F.struct("same", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b")
        best = materialize(best, "best")
        self.confirm(best)
        self.confirm(materialize(self.apart(good).join(best, ["a", "b"], "left_anti"), "rest"))

    def apart(self, pairs: DataFrame) -> DataFrame:
        return self.labelled(pairs, "a", "b").where("a_comp <> b_comp").select("a", "b")

    def candidates(self, members: DataFrame) -> DataFrame:
        """Pairs of members (key, cid, n, cid_comp, m) of different components: all in small nodes, each with the centre of its size in large ones."""
        small = members.where(F.col("m") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cid", "n", "cid_comp"))).alias("x"))
        each = small.select("x", F.posexplode("x").alias("i", "a")).select("a", F.explode(F.expr("slice(x, i + 2, size(x))")).alias("b"))
        pairs = each.where(_sizes_fit(self.percent, "a.n", "b.n") & (F.col("a.cid_comp") != F.col("b.cid_comp"))).select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"))
        large = members.where(F.col("m") > SMALL).withColumn("size", F.floor(F.ln("n") / F.lit(float(np.log(100 / self.percent)))))
        centres = large.groupBy("key", "size").agg(F.min(F.struct("cid", "cid_comp")).alias("c"))
        stars = large.join(centres, ["key", "size"]).where("cid_comp <> c.cid_comp").select(F.col("c.cid").alias("a"), F.col("cid").alias("b"))
        return pairs.unionByName(stars)

    def members(self, level: DataFrame) -> DataFrame:
        """Of a level (key, cid, n), the nodes that hold more than one component."""
        known = self.labelled(level, "cid")
        nodes = known.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("cid_comp").alias("lo"), F.max("cid_comp").alias("hi")).where("lo < hi").select("key", "m")
        return materialize(known.join(nodes, "key"), "members")

    def run(self) -> None:
        # The first level's links show which nodes are one component already.
        level = materialize(self.classes.select("cid", "n", "sig").mapInArrow(_roots, NODE), "level")
        members = self.members(level)
        self.try_pairs(self.candidates(members), best_first=True)
        left, found, crowds = self.members(members.where(F.col("m") > SMALL).select("key", "cid", "n")), None, None
        for depth in range(DEPTH + 1):
            if left.isEmpty():
                break
            placed = self.placed(left)
            if depth == DEPTH:
                crowd = placed.select("key", "cid", "n", "out")
            else:
                tested = self.against_centres(placed)
                crowd = tested.where("kin").join(tested.where("out").select("centre").distinct(), "centre", "left_semi").select(F.xxhash64("centre", F.lit(depth)).alias("key"), "cid", "n", "out")
            crowds = crowd if crowds is None else crowds.unionByName(crowd)
            if depth == DEPTH:
                break
            stay = placed.select("key", "cid", "centre").join(tested.where("NOT out").select("cid", "centre", "n", "sig"), ["cid", "centre"])
            level = materialize(stay.select("key", "cid", "n", "sig").mapInArrow(_branch, NODE), "level")
            members = self.members(level)
            more = self.candidates(members)
            found = more if found is None else found.unionByName(more)
            left = members.where(F.col("m") > SMALL)
        if found is not None:
            self.try_pairs(found)
        if crowds is not None:
            self.try_blocks(crowds)

    def placed(self, left: DataFrame) -> DataFrame:
        """Of large nodes, a written table: key, cid, n, centre, out. A node's centre is a class of its main component; what is not of that component is out."""
        counts = left.groupBy("key", "cid_comp").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("c"))
        nodes = counts.groupBy("key").agg(F.max(F.struct("k", "cid_comp", "c")).alias("x")).select("key", F.col("x.c").alias("centre"), F.col("x.cid_comp").alias("main"))
        return materialize(left.join(nodes, "key").select("key", "cid", "n", "centre", (F.col("cid_comp") != F.col("main")).alias("out")), "placed")

    def against_centres(self, placed: DataFrame) -> DataFrame:
        """A written table cid, centre, n, sig, out, kin. A class that is close to a centre, but not of its component, is part of
        a crowd, where branching parts nothing: it is out, to be compared with all that shares a node with that centre and can
        agree with it (kin). A crowd stays together in most of its nodes, so a class meets a centre once, not once for each
        node: what is tested and compared grows with classes and centres, not with nodes."""
        met = placed.select("cid", "centre", "n", "out").distinct()  # `out` goes by the components of both
        sig = self.classes.select("cid", "sig")
        both = met.join(sig, "cid").join(sig.withColumnsRenamed({"cid": "centre", "sig": "centre_sig"}), "centre")
        return materialize(both.select("cid", "centre", "n", "sig", "centre_sig", "out").mapInArrow(_near, "cid long, centre long, n long, sig binary, out boolean, kin boolean"), "tested")

    def try_blocks(self, crowds: DataFrame) -> None:
        """Nodes, or all nodes of a centre (key, cid, n, out): what is out is compared with all of the node, on the full sets, in blocks of a bounded
        number of classes and bytes. What is not out meets the blocks of those that are; a pair is compared in the first node
        that both are in, and one of them is out of."""
        left = materialize(self.labelled(crowds, "cid"), "left")
        if left.isEmpty():
            return
        blocks = lambda which: F.coalesce(F.ceil(F.greatest(F.count_if(which) / F.lit(BLOCK), F.sum(F.when(which, F.col("n"))) * 8 / F.lit(BLOCK_BYTES))), F.lit(0)).cast("int")
        nodes = left.groupBy("key").agg(blocks(F.col("out")).alias("p"), blocks(~F.col("out")).alias("q"))
        classes = left.groupBy("cid").agg(F.collect_list(F.struct("key", "out")).alias("in")).select("cid", F.col("in.key").alias("keys"), F.col("in.out").alias("outs"))  # a class is in 2 * TREES * 2 ** DEPTH nodes at most
        with session(left.sparkSession, SMALL_BATCHES):
            sets = self.texts_of(classes.select("cid")).mapInArrow(_shingled(self.width), "cid long, shingles binary")
            held = materialize(classes.join(self.classes.select("cid", "sig"), "cid").join(sets, "cid"), "crowds")
        mix = F.xxhash64("cid")
        placed = left.join(nodes, "key").withColumn("home", F.when(F.col("out"), F.pmod(mix, "p")).otherwise(F.col("p") + F.pmod(mix, "q")).cast("int"))
        others = F.sequence(F.lit(0), F.when(F.col("out"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)
        dealt = placed.select("key", "home", "cid", "n", F.col("cid_comp").alias("comp"), F.explode(others).alias("other")).join(held, "cid")
        dealt = dealt.select("key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "home", "cid", "n", "comp", "sig", "keys", "outs", "shingles")
        self.link(materialize(dealt.groupBy("key", "i", "j").applyInArrow(_across(self.percent), "a long, b long"), "links"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    A set holds the distinct shingles of `width` words (ASCII letters lower-cased; words between ASCII white space) of the
    whole text; with fewer words, the whole sequence as one. Null texts are empty; an empty set links with nothing. Sets
    link where their Jaccard similarity is at least percent / 100; component_id is the least doc_id of all that links
    reach. Equal texts are one class, whatever their number. Rows that repeat a doc_id are judged by their own texts; rows
    without one are linked, but never give the id (a component of such rows alone has component_id null and is kept).
    Other columns are ignored.
    """
    join = _Join(docs, width, percent)
    join.run()
    labelled = join.labelled(join.classes.select("cid", "mark", "doc"), "cid")
    least = labelled.groupBy("cid_comp").agg(F.min("doc").alias("component_id"))
    of = labelled.join(least, "cid_comp").select("mark", "component_id")
    out = join.rows.select("doc_id", "n", "mark").join(of, "mark", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (shingles of five words, similarity 0.8) the document with the least
    doc_id stays, or one without an id where none has one; of different texts under that id, the one of the least digest.
    Rows equal in id and text share their fate. Texts without words stay.
    """
    join = _Join(docs, 5, 80)
    join.run()
    comp = join.labelled(join.classes.select("cid", "mark"), "cid").select("mark", "cid_comp")
    rows = materialize(join.rows.where("n > 0").select("doc_id", "tk", "mark").join(comp, "mark").drop("mark"), "judged")
    heads = rows.groupBy("cid_comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("head"))
    others = rows.join(heads, "cid_comp").where(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tk") == F.col("head.tk"))))
    gone = materialize(others.select(row_key(F.col("tk"), F.col("doc_id")).alias("_key"), F.lit(False).alias("_one")).distinct(), "gone")
    return decide(docs, row_key(text_md5(F.col("text")), F.col("doc_id")), gone)


#: Exhaustive: every pair of documents that share a shingle, for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
-- documents of one set first, so that pairs are between different sets
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * k >= 80 * (m + n - k)),
g AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, c) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT g.v, min(r.c) FROM r JOIN g ON g.u = r.doc_id JOIN recurring.r AS q ON q.doc_id = g.v WHERE r.c < q.c GROUP BY g.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept FROM s JOIN r ON s.doc_id = r.doc_id
"""
