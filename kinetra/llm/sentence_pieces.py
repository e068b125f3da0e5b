"""SentencePiece encoding and decoding as a relational lattice.

Where no piece holds two neighbouring characters side by side, a text can be cut, and what lies between cuts is encoded on
its own: its words. The distinct words are exploded into substrings of bounded length, equi-joined to the piece table and
grouped into a lattice of edges a word, which Spark's higher-order aggregate folds into pieces: for a unigram model by
Viterbi's rule, for a BPE model by its merge rule (the pair with the best score first, the leftmost of equals), since the
best path over BPE scores is not what such a model means.

Documents are cut once, in chunks of a bounded number of bytes: a chunk is its distinct words and its documents as numbers
of them. Chunks get the ids of words that many chunks share from a bounded table that every worker holds, and of the
others by a join.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_BATCHES, bucketed, materialize, release, session

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 32 << 20  # of text a chunk, or one longer document
SHARED = 1 << 17  # words of the table that every worker holds: some 20 bytes each
WORDS_A_TASK = 50_000  # that are folded; each has some dozens of edges
LONG = 60  # characters of a word beyond which the rule runs outside the aggregate, whose state is a number of 64 bits


@dataclass(frozen=True)
class Pieces:
    """A piece table: pieces[i] and scores[i] of id i; plain ids may stand in a text, byte_ids stand for bytes of other characters (empty: unknown is used)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: frozenset[int]
    byte_ids: tuple[int, ...]
    unknown: int
    kind: str = "bpe"

    @property
    def longest(self) -> int:
        return max((len(self.pieces[i]) for i in self.plain), default=1)

    @property
    def bigrams(self) -> frozenset[str]:
        """All pairs of neighbouring characters within a piece. Between two others no piece reaches across, so a text can be cut there."""
        return frozenset(p[k : k + 2] for p in (self.pieces[i] for i in self.plain) for k in range(len(p) - 1))


def load(path: str = MODEL, kind: str = "bpe") -> Pieces:
    """The piece table of a SentencePiece model file, which lies where the driver runs."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    bytes_ = tuple(i for i in ids if p.is_byte(i))
    plain = frozenset(i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)))
    if any(MARK in p.id_to_piece(i).lstrip(MARK) for i in plain):
        raise ValueError("a piece has a space mark inside: words can't be encoded on their own")
    return Pieces(tuple(p.id_to_piece(i) for i in ids), tuple(float(p.get_score(i)) for i in ids), plain, bytes_, p.unk_id(), kind)


# ---- the lattice -----------------------------------------------------------------------------------------------------


def lattice(words: DataFrame, table: Pieces) -> DataFrame:
    """From rows of distinct words (word, and what else they have): each with its edges, the substrings of two characters or more that are pieces.

    An edge is one number, (rank * 256 + start) * 256 + length, where better scores have lower ranks: the least is the best
    edge, the leftmost of equals.
    """
    longest = table.longest
    order = {s: r for r, s in enumerate(sorted({table.scores[i] for i in table.plain}, reverse=True))}
    rows = [("", -1), *((table.pieces[i], order[table.scores[i]]) for i in sorted(table.plain) if len(table.pieces[i]) > 1)]
    pieces = words.sparkSession.createDataFrame(rows, "piece string, rank long").coalesce(1)  # as large as the model, whatever the corpus
    n, names = F.char_length("word"), words.columns
    spans = words.select(*names, F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).alias("start"))
    # Each word has the empty substring once, which meets the empty piece, so that words without edges stay.
    lengths = F.concat(F.when(F.col("start") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(n - F.col("start") >= 2, F.sequence(F.lit(2), F.least(F.lit(longest), n - F.col("start")))).otherwise(F.array().cast("array<int>")))
    spans = spans.select(*names, "start", F.explode(lengths).alias("length"))
    cut = spans.select(*names, "start", "length", F.expr("substring(word, start + 1, length)").alias("piece"))
    edge = (F.col("rank") * 256 + F.col("start")) * 256 + F.col("length")
    return cut.join(F.broadcast(pieces), "piece").groupBy(*names).agg(F.collect_list(F.when(F.col("rank") >= 0, edge)).alias("edges"))


#: The fold over a word's edges. Its state is one number, a bit for each cut between symbols (0 and the end included). A step
#: takes the best edge that runs from cut to cut over exactly one other cut, and clears that cut; the sign tells that none is
#: left. Each edge is first given its ends and what lies between them as bits, once (the outer transform holds them).
MERGE = """transform(array(transform(edges, e -> named_struct('key', e,
    'ends', shiftleft(1L, CAST(shiftright(e, 8) & 255 AS INT)) | shiftleft(1L, CAST((shiftright(e, 8) & 255) + (e & 255) AS INT)),
    'inside', shiftleft(shiftleft(1L, CAST(e & 255 AS INT) - 1) - 1L, CAST(shiftright(e, 8) & 255 AS INT) + 1)))),
  all -> aggregate(sequence(1, least(size(all), char_length(word))), shiftleft(2L, char_length(word)) - 1L,
    (cuts, k) -> IF(cuts < 0, cuts, transform(
      array(array_min(filter(all, e -> (cuts & e.ends) = e.ends AND bit_count(cuts & e.inside) = 1))),
      b -> IF(b IS NULL, cuts | shiftleft(1L, 63), cuts & ~b.inside))[0]),
    cuts -> cuts & ~shiftleft(1L, 63)))[0]"""


def best_path(edges: list[tuple[int, int, float]], n: int, penalty: float) -> list[int]:
    """Brute Viterbi on one word, for words too long for the fold: cuts of the path with the greatest sum of scores."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), -1)] * n
    into: dict[int, list[tuple[int, float]]] = {}
    for a, b, s in edges:
        into.setdefault(b, []).append((a, s))
    for stop in range(1, n + 1):
        ways = into.get(stop, [])
        if not any(a == stop - 1 for a, _ in ways):
            ways = [*ways, (stop - 1, penalty)]
        best[stop] = max((best[a][0] + s, -a) for a, s in ways)
        best[stop] = (best[stop][0], -best[stop][1])
    out = [n]
    while out[-1]:
        out.append(best[out[-1]][1])
    return out[::-1]


def _viterbi(edges: Column, n: Column, penalty: float) -> Column:
    """The same as a fold: the state has the best score and cuts of each prefix; edges are (start, stop, score)."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("cuts")))

    def step(acc: Column, stop: Column) -> Column:
        known = F.transform(F.filter(edges, lambda e: e["stop"] == stop), lambda e: F.struct((-(F.element_at(acc, e["start"] + 1)["score"] + e["score"])).alias("s"), e["start"].alias("start")))
        single = F.array(F.struct((-(F.element_at(acc, stop)["score"] + F.lit(penalty))).alias("s"), (stop - 1).alias("start")))
        has_single = F.exists(edges, lambda e: (e["stop"] == stop) & (e["start"] == stop - 1))
        best = F.array_min(F.when(has_single, known).otherwise(F.concat(known, single)))
        grown = F.transform(F.array(best), lambda b: F.struct((-b["s"]).alias("score"), F.concat(F.element_at(acc, b["start"] + 1)["cuts"], F.array(stop)).alias("cuts")))
        return F.concat(acc, grown)

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.element_at(acc, -1)["cuts"])


def merge_long(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """The merge rule on a heap, for words of any length: edges are (start, stop, score)."""
    score = {(a, b): s for a, b, s in edges}
    left, right = list(range(-1, n)), list(range(1, n + 2))  # of the cut at i: the cuts beside it
    heap = [(-score[i, i + 2], i, i + 2) for i in range(n - 1) if (i, i + 2) in score]
    heapq.heapify(heap)
    alive = [True] * (n + 1)
    while heap:
        _, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] == b or right[right[a]] != b:
            continue
        alive[right[a]] = False
        right[a], left[b] = b, a
        for x, y in ((left[a], b), (a, right[b])):
            if x >= 0 and y <= n and (x, y) in score:
                heapq.heappush(heap, (-score[x, y], x, y))
    return [i for i in range(n + 1) if alive[i]]


def _cuts_of(word: str, table: Pieces, score: dict[str, float]) -> list[int]:
    """The fold's rule in Python, for words beyond LONG characters."""
    n, longest = len(word), table.longest
    low = 1 if table.kind == "unigram" else 2
    edges = [(a, b, score[word[a:b]]) for a in range(n) for b in range(a + low, min(n, a + longest) + 1) if word[a:b] in score]
    return merge_long(n, edges) if table.kind == "bpe" else best_path(edges, n, min(table.scores) - 10)


def _packing(table: Pieces) -> type:
    """How an id is packed where words and their ids travel: two bytes, or four for large tables."""
    return np.uint16 if len(table.pieces) < 1 << 16 else np.int32


def _resolve(table: Pieces):
    """From word, n and cuts (bits or a list; null: a long word) to word, n and packed ids: each symbol's piece, else its bytes, else unknown."""
    kind = _packing(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {table.pieces[i]: [i] for i in table.plain}
        score = {table.pieces[i]: table.scores[i] for i in table.plain}

        def ids(symbol: str) -> list[int]:
            if symbol not in known:
                known[symbol] = [table.byte_ids[x] for x in symbol.encode("utf-8", "surrogatepass")] if table.byte_ids else [table.unknown]
            return known[symbol]

        for batch in batches:
            out = []
            for word, cuts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if cuts is None:
                    cuts = _cuts_of(word, table, score)
                elif isinstance(cuts, int):
                    cuts = [i for i in range(len(word) + 1) if cuts >> i & 1]
                out.append(np.array([x for a, b in zip(cuts, cuts[1:]) for x in ids(word[a:b])], kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["word", "n", "packed"])
        release()

    return run


def encode_words(words: DataFrame, table: Pieces) -> DataFrame:
    """From distinct words (word, n): both and the word's ids, packed. Rows that lie together by word stay so: nothing is shuffled."""
    size = F.char_length("word")
    short, long_ = words.where(size <= LONG), words.where(size > LONG)
    if table.kind == "bpe":
        folded = F.when(F.size("edges") > 0, F.expr(MERGE)).otherwise(F.expr("shiftleft(2L, char_length(word)) - 1L"))
        cut, kind = lattice(short, table).select("word", "n", folded.alias("cuts")), "long"
    else:
        rows = [("", None), *((table.pieces[i], table.scores[i]) for i in sorted(table.plain))]
        pieces = words.sparkSession.createDataFrame(rows, "piece string, score double").coalesce(1)
        spans = short.select("word", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
        lengths = F.sequence(F.when(F.col("start") == 0, 0).otherwise(1), F.least(F.lit(table.longest), size - F.col("start")))
        found = spans.select("*", F.explode(lengths).alias("length")).withColumn("piece", F.expr("substring(word, start + 1, length)")).join(F.broadcast(pieces), "piece")
        edge = F.when(F.col("score").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("stop"), "score"))
        cut = found.groupBy("word", "n").agg(F.collect_list(edge).alias("edges")).select("word", "n", _viterbi(F.col("edges"), size, min(table.scores) - 10).alias("cuts"))
        kind = "array<int>"
    return cut.unionByName(long_.select("word", "n", F.lit(None).cast(kind).alias("cuts"))).mapInArrow(_resolve(table), "word string, n long, packed binary")


# ---- documents -------------------------------------------------------------------------------------------------------


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other; of 32 bits, as Arrow's offsets within an array are."""
    start, length = start[length > 0].astype(np.int32), length[length > 0].astype(np.int32)
    to = np.cumsum(length)
    out = np.ones(to[-1] if len(to) else 0, np.int32)
    if len(to):
        out[0] = start[0]
        out[to[:-1]] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(out, out=out, dtype=np.int32)


def _parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array."""
    offsets = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset) if len(a) else np.zeros(1, np.int32)
    data = a.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and len(data) else np.empty(0, np.uint8)


class Cutter:
    """Cuts texts into words: first at spaces, then the distinct results at every pair of characters that no piece holds."""

    odd = re.compile("(?<= ) +|^ +")

    def __init__(self, table: Pieces):
        inner = table.bigrams
        chars = {c: i + 1 for i, c in enumerate(sorted({c for x in inner for c in x}))}
        self.kind, self.together = np.zeros(0x110000, np.uint16), np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for c, i in chars.items():
            self.kind[ord(c)] = i
        for x in inner:
            self.together[chars[x[0]], chars[x[1]]] = True

    def _at_spaces(self, texts: pa.Array) -> pa.ListArray:
        """Texts as what stands behind each of their marks, the one before a text included. Further spaces in a row stay, as marks."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        if pc.any(odd).as_py():
            texts = pa.array([self.odd.sub(lambda m: MARK * len(m[0]), t) if o else t for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.string())
        return pc.split_pattern(texts, " ")

    def coarse(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Texts as what stands behind each mark, one text after the other, and how many each text has. An empty text has none."""
        lists = self._at_spaces(texts)
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        values = lists.flatten()
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            keep = np.ones(len(values), bool)
            keep[(np.cumsum(size) - size)[empty]] = False
            values, size = values.filter(pa.array(keep)), np.where(empty, 0, size)
        return values.dictionary_encode(), size

    def words(self, coded: list[pa.DictionaryArray]) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
        """From coarse() of several arrays: distinct words, the arrays as numbers of them, and how many words each coarse one has become."""
        one = pa.chunked_array(coded).unify_dictionaries().chunks if len(coded) > 1 else list(coded)
        coded.clear()
        dictionary = one[0].dictionary
        if not len(dictionary):
            return pa.array([], pa.string()), [np.empty(0, np.int32) for _ in one], [np.empty(0, np.int32) for _ in one]
        line = MARK + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(dictionary)], pa.int32()), dictionary), MARK)[0].as_py()
        last = np.cumsum(pc.utf8_length(dictionary).to_numpy() + np.int32(1), dtype=np.int32)
        points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        cut = np.ones(len(points), bool)
        for low in range(0, len(points) - 1, 1 << 20):
            kinds = self.kind[points[low : low + (1 << 20) + 1]]
            cut[low : low + len(kinds) - 1] = ~self.together[kinds[:-1], kinds[1:]]
        cut[last - 1] = True
        stops = np.flatnonzero(cut).astype(np.int32) + np.int32(1)
        width = np.int8(1) + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.zeros(len(stops) + 1, np.int32)
        offsets[1:] = np.cumsum(width, dtype=np.int32)[stops - 1]
        del points, width, cut
        atoms = pa.StringArray.from_buffers(len(stops), pa.py_buffer(offsets), pa.py_buffer(line.encode())).dictionary_encode()
        upto = (np.searchsorted(stops, last) + 1).astype(np.int32)
        length = np.diff(upto, prepend=np.int32(0))
        begin, flat, numbers, sizes = upto - length, atoms.indices.to_numpy(), [], []
        for x in one:
            which = x.indices.to_numpy()
            sizes.append(length[which])
            numbers.append(flat[_runs(begin[which], sizes[-1])])
        return atoms.dictionary, numbers, sizes


def words_of(text: str, table: Pieces) -> list[str]:
    """The words of a text with its spaces as marks and one mark before it; none for an empty text."""
    cutter = Cutter(table)
    words, numbers, _ = cutter.words([cutter.coarse(pa.array([text], pa.string()))[0]])
    return words.take(pa.array(numbers[0])).to_pylist()


CHUNK = "rows array<long>, sizes array<int>, sums binary, words array<string>, z binary"


class _Chunk:
    """Documents as numbers of their distinct words, the most frequent ones first. Texts are not held, but what they were cut into."""

    def __init__(self, cutter: Cutter, check: bool):
        self.cutter, self.check, self.bytes = cutter, check, 0
        self.rows, self.coded, self.sizes, self.sums = [], [], [], []

    def add(self, rows: pa.Array, texts: pa.Array, size: int) -> None:
        coded, sizes = self.cutter.coarse(texts)
        self.rows.append(rows)
        self.coded.append(coded)
        self.sizes.append(sizes)
        self.sums += [xxhash.xxh3_128_digest(t.as_buffer()) for t in texts] if self.check else []
        self.bytes += size

    def batch(self) -> pa.RecordBatch:
        words, numbers, each = self.cutter.words(self.coded)
        # From words of coarse words to words of documents.
        sizes = [np.diff(np.concatenate([np.zeros(1, np.int32), np.cumsum(e, dtype=np.int32)])[np.cumsum(n)], prepend=np.int32(0)) for e, n in zip(each, self.sizes)]
        del each
        counts = sum((np.bincount(x, minlength=len(words)) for x in numbers), np.zeros(len(words), np.int64))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays(
            [one(pa.concat_arrays(self.rows)), one(pa.array(np.concatenate(sizes))), pa.array([b"".join(self.sums)], pa.binary()), one(words.take(pa.array(order))), pa.array([_pack(rank[x] for x in numbers)], pa.binary())],
            ["rows", "sizes", "sums", "words", "z"],
        )


PLANES = ((0, np.uint8), (8, np.uint8), (16, np.uint16))


def _pack(parts: Iterable[np.ndarray]) -> bytes:
    """Numbers as their low bytes, the next ones, and the rest, each compressed behind its length: the high ones are mostly 0."""
    packs, out = [zstandard.ZstdCompressor(level=3).compressobj() for _ in PLANES], [[] for _ in PLANES]
    for x in parts:
        for pack, got, (shift, kind) in zip(packs, out, PLANES):
            got.append(pack.compress((x >> shift).astype(kind)))
    planes = [b"".join([*got, pack.flush()]) for got, pack in zip(out, packs)]
    return b"".join(len(x).to_bytes(8, "little") + x for x in planes)


def _unpack(z: bytes) -> np.ndarray:
    out, at = None, 0
    for shift, kind in PLANES:
        size = int.from_bytes(z[at : at + 8], "little")
        plane = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(z[at + 8 : at + 8 + size]), kind).astype(np.int32) << shift
        out, at = plane if out is None else out + plane, at + 8 + size
    return out


SLICE_BYTES = 2 << 20  # of text that are cut at once


def _chunks(table: Pieces, check: bool, chunk_bytes: int):
    """Documents (row, text) as chunks. A task holds one chunk, and the texts of a slice."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(table)
        chunk = _Chunk(cutter, check)
        for batch in batches:
            at, upto = 0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            while at < batch.num_rows:
                done = int(upto[at - 1]) if at else 0
                stop = min(int(np.searchsorted(upto, done + min(SLICE_BYTES, chunk_bytes - chunk.bytes))) + 1, batch.num_rows)
                chunk.add(batch.column(0)[at:stop], batch.column(1)[at:stop], int(upto[stop - 1]) - done)
                at = stop
                if chunk.bytes >= chunk_bytes:
                    yield chunk.batch()
                    chunk = _Chunk(cutter, check)
                    release()
        if chunk.rows:
            yield chunk.batch()
        release()

    return run


PART = 1 << 19  # words of documents that are put together at once


def _same(decoded: pa.Array | None, which: np.ndarray, bounds: np.ndarray, sums: bytes) -> list[bool]:
    """Whether each document, put together from its decoded words without the space before it, has its checksum."""
    if decoded is None or not len(which):
        return [True] * (len(bounds) - 1)
    stop, text = _parts(decoded.take(pa.array(which)))
    ends = stop[bounds].tolist()
    return [xxhash.xxh3_128_digest(text[a + int(b > a and text[a] == 32) : b]) == sums[16 * k : 16 * k + 16] for k, (a, b) in enumerate(zip(ends, ends[1:]))]


def _assemble(table: Pieces, shared: pa.Table, check: bool):
    """The documents of a chunk from its words' ids; with check also whether each decodes to its text, by its checksum."""
    kind = _packing(table)
    raw = pa.array(raw_pieces(table), pa.binary())
    shared_words, shared_ids = (shared[c].combine_chunks() for c in ("word", "packed"))

    def run(others: pa.Table, chunk: pa.Table) -> pa.Table:
        words = chunk["words"][0].values
        found = pc.index_in(words, value_set=shared_words)
        if found.null_count != others.num_rows:
            raise ValueError("a chunk's words and their ids differ")
        at = found.fill_null(0).to_numpy().copy()
        at[others["place"].to_numpy()] = len(shared_words) + np.arange(others.num_rows)
        known = pa.concat_arrays([shared_ids, *others["packed"].chunks]).take(pa.array(at))
        ends, data = _parts(known)
        ends, flat = ends // np.dtype(kind).itemsize, data[: ends[-1]].view(kind)
        length, decoded = np.diff(ends), None
        if check and len(words):
            stop, text = _parts(raw.take(pa.array(flat)))
            decoded = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(stop[ends].astype(np.int32)), pa.py_buffer(text)])
            decoded = pc.replace_substring(decoded, MARK.encode(), b" ")
        numbers, sums, rows = _unpack(chunk["z"][0].as_py()), chunk["sums"][0].as_py(), chunk["rows"][0].values
        upto = np.concatenate([[0], np.cumsum(chunk["sizes"][0].values.to_numpy(), dtype=np.int64)])
        out, at = [], 0
        while at < len(rows):  # a part of the documents at a time
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PART, "right")) - 1)
            which, bounds = numbers[upto[at] : upto[stop]], upto[at : stop + 1] - upto[at]
            ids = flat[_runs(ends[which], length[which])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length[which])])[bounds], pa.int32()), pa.array(ids))
            exact = pa.nulls(stop - at, pa.bool_()) if not check else pa.array(_same(decoded, which, bounds, sums[16 * at : 16 * stop]), pa.bool_())
            out.append(pa.RecordBatch.from_arrays([rows[at:stop], lists, exact], ["doc_id", "ids", "exact"]))
            at = stop
        release()
        return pa.Table.from_batches(out)

    return run


def _shared(encoded: DataFrame, most: int) -> DataFrame:
    """Of words (word, n, packed) those that stand in the most chunks, `most` at most: the least count that so many words reach is found from counts a twelfth of an octave apart."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 12)
    total, least = 0, None
    for r in encoded.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect():  # 12 rows an octave
        total += r["k"]
        if total > most:
            break
        least = r["step"]
    return encoded.where(step >= least) if least is not None else encoded.limit(0)


def encode(docs: DataFrame, table: Pieces, check: bool = False, chunk_bytes: int = CHUNK_BYTES, shared_words: int = SHARED) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, ids (and exact, with check: whether decoding gives the text back).

    The ids are those of the model's own rules: for a BPE model the same as its library's. Null and empty texts have no ids.
    Repeated rows repeat theirs; a null doc_id stays null; other columns are ignored; docs may be any query. What a task
    holds is a chunk (or one longer document): its words and its documents as numbers.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with session(spark, SMALL_BATCHES):
        # Chunks are named as they are written: whoever reads them later, and how often, sees the same ones. They are written
        # in buckets by their names, so that only words and ids are shuffled, never documents.
        cut = src.mapInArrow(_chunks(table, check, chunk_bytes), CHUNK).select(F.monotonically_increasing_id().alias("chunk"), "*")
        chunks = bucketed(cut, "chunk", "chunks")
    places = chunks.select("chunk", F.posexplode("words").alias("place", "word"))
    size = chunks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    # A task's words are folded from a hash table, without sorting their edges first.
    folding = {
        "spark.sql.shuffle.partitions": 1 + size // (2 * WORDS_A_TASK), "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": 4 * WORDS_A_TASK,
    }
    with session(spark, folding):
        encoded = materialize(encode_words(places.groupBy("word").agg(F.count(F.lit(1)).alias("n")), table), "encoded")
    common = _shared(encoded, shared_words).select("word", "packed")
    others = places.join(F.broadcast(common.select("word")), "word", "left_anti").join(encoded.select("word", "packed"), "word")
    of = others.select(F.col("chunk").alias("of"), "place", "packed").groupBy("of")
    out = of.cogroup(chunks.groupBy("chunk")).applyInArrow(_assemble(table, common.toArrow(), check), "doc_id long, ids array<int>, exact boolean")
    return out if check else out.drop("exact")


def decode_ids(ids: Iterable[int], raw: list[bytes]) -> str:
    """The text of ids: pieces' bytes joined, marks as spaces, the first mark dropped. Bytes that are no UTF-8 become the replacement character."""
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def raw_pieces(table: Pieces) -> list[bytes]:
    raw = [p.encode() if i in table.plain else b"" for i, p in enumerate(table.pieces)]
    for value, i in enumerate(table.byte_ids):
        raw[i] = bytes([value])
    raw[table.unknown] = " ⁇ ".encode()
    return raw


def decode(encoded: DataFrame, table: Pieces) -> DataFrame:
    """Adds column decoded: the text of column ids (null: null). Exact for what encode() gave, but for texts that hold the space mark itself."""
    names = [*encoded.columns, "decoded"]
    raw, at, schema = raw_pieces(table), encoded.columns.index("ids"), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, raw) for x in (v.as_py() for v in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, and whether decoding the ids gives the text back."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(), check=True).select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "exact")


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id and ids of every document left. Chunks are of a quarter of the size, as executors still hold what earlier stages left."""
    return encode(docs, load(), chunk_bytes=CHUNK_BYTES // 4).select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))
