"""Operator 9: line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words; lines with equal sets are one node.
Tokens are put in one order, rare ones first. Two sets with Jaccard similarity of
at least t overlap in at least ceil(t * |x|) tokens, so they share a token among
the first |x| - ceil(t * |x|) + 1 of each (prefix filter). Nodes are dealt by these
tokens and paired where the length and the positional filter allow and where 128
bits of each set do not show too many differing tokens; what passes is verified on
the whole sets. A line goes if an earlier line (by document,
then line number) has an equal set or is a verified match.

Rarity comes from a table of ``BUCKETS`` counts over token hashes (a few MB at any
input size, so it may be broadcast). Every order of the tokens gives the same
result; rare-first only keeps the join small. Where the first common token of two
lines would be a frequent one (count over ``FREQUENT``), the key is that token and a
second common one (from prefixes one token longer), which is exact by the same
argument for the tokens after the first and splits the groups of very common words.

A pair shares several keys. It is compared where a key may hold its first common tokens (the tokens before differ)
and counted only where they do, so no pair is written: a task gives the number of links of each of its sets and
whether one has an earlier first line. The rows of a key that is in many lines are compared one with all later ones
in size by marked tokens: 8,000 near-equal lines take some seconds; one key is still one task.

Tokens are 32-bit hashes inside a comparison (two words of two compared lines are
taken for one with a chance of about 1 in 10**6 a pair); node ids have 64 bits, of 64-bit hashes of the words.
Copies of a line are one node however many, and a key of one token is held by at
most ``FREQUENT`` lines.

Defined results: null and empty texts have no lines; lines without words are kept
and not counted; rows with equal id and text are one document (each row returned
with the same figures); a null id is ordered last; an empty table gives no rows;
``dedup_lines`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, cut, small_batches, table, whole_row

SIMILARITY = 0.8
BUCKETS = 1 << 21
CHUNKS = 64
FREQUENT = 4096
#: Size of the bit table of wanted nodes: 2**26 bits, 8 MB at any input size.
MARK_BITS = 26


#: Words are hashed as sum(BYTE[b] * BASE ** place) modulo 2**64, then mixed; separators count nothing.
BYTE = np.random.default_rng(9).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
BYTE[[ord(c) for c in SPACE]] = 0
BASE = np.uint64(0xD1342543DE82EF95)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes hashed at a time (the arrays stay in the processor's cache).
PIECE = 1 << 18


@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x), dtype=np.uint64)]) for x in (BASE, UNBASE))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of the bytes ``data``; ``start``: where the words begin."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + PIECE))
        end = int(start[j]) if j < len(start) else len(data)
        n = end - int(start[i])
        up, down = powers(1 << max(PIECE.bit_length(), (n - 1).bit_length()))
        at = start[i:j] - start[i]
        with np.errstate(over="ignore"):
            out[i:j] = np.add.reduceat(BYTE[data[start[i]:end]] * up[:n], at) * down[at]
        i = j
    return mixed(out)


class Lines:
    """The lines with words of a batch of texts: a 64-bit hash of each word, and whose line it is."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").lower().encode("utf-8") for t in texts]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        word = BYTE[data] != 0
        start = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])) if len(data) else np.empty(0, np.int64)
        ends = np.flatnonzero(data == 10)
        line = np.searchsorted(ends, start)
        first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.empty(0, bool)
        self.hashes = word_hashes(data, start)
        self.line = np.cumsum(first) - 1
        line = line[first]
        self.n = len(line)
        lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
        self.row = np.repeat(np.arange(len(raw)), lines)[line]
        self.number = line - (np.cumsum(lines) - lines)[self.row]

    def buckets(self) -> np.ndarray:
        """Token occurrences in each bucket."""
        return np.bincount(bucket_of(self.hashes), minlength=BUCKETS).astype(np.uint32)

    def sets(self, count: np.ndarray | None = None) -> Sets:
        """The distinct tokens of each line, rare ones first by ``count``."""
        order = self.hashes >> np.uint64(32)
        if count is not None:
            order |= rarity(count)[bucket_of(self.hashes)] << np.uint64(32)
        if self.n < 1 << 23:
            key = self.line.astype(np.uint64) << np.uint64(40) | order
            by = np.argsort(key)
            key = key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        else:
            by = np.lexsort((order, self.line))
            new = np.concatenate([[True], (order[by][1:] != order[by][:-1]) | (self.line[by][1:] != self.line[by][:-1])])
        new = np.flatnonzero(new)
        hashes = np.maximum.reduceat(self.hashes[by], new) if len(new) else self.hashes
        line = self.line[by[new]]
        size = np.bincount(line, minlength=self.n)
        seen = count[bucket_of(hashes)].astype(np.int64) if count is not None else np.zeros(len(hashes), np.int64)
        return Sets(hashes, seen, line, np.cumsum(size) - size, size)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32) & np.uint64(BUCKETS - 1)).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _rarity(of: _Same) -> np.ndarray:
    return np.minimum(np.log2(of.array.astype(np.float64) + 1) * 7.9, 255).astype(np.uint64)


class _Same:
    """An array as a key of a cache: equal only to itself."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __hash__(self) -> int:
        return id(self.array)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Same) and other.array is self.array


def rarity(count: np.ndarray) -> np.ndarray:
    """The place of each bucket in the order of the tokens, in 256 classes of the count's logarithm."""
    return _rarity(_Same(count))


class Sets(NamedTuple):
    tokens: np.ndarray      # hashes, set after set
    count: np.ndarray       # how often the token's bucket occurs in the corpus
    line: np.ndarray        # the set of each token
    start: np.ndarray       # the first token of each set
    size: np.ndarray

    def ids(self) -> np.ndarray:
        """A 64-bit id of each set (a sum over its tokens, so independent of the order)."""
        total = np.add.reduceat(self.tokens, self.start) if len(self.start) else np.empty(0, np.uint64)
        return mixed(total ^ mixed(self.size.astype(np.uint64))).view(np.int64)

    def bits(self) -> list[np.ndarray]:
        """128 bits of each set in two numbers: the parity of its tokens that fall on each place. Two sets differ
        in at least as many tokens as their bits differ in places."""
        if not len(self.start):
            return [np.empty(0, np.int64)] * 2
        place = self.tokens >> np.uint64(32) & np.uint64(127)
        one = np.uint64(1) << (place & np.uint64(63))
        return [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == half, one, np.uint64(0)), self.start).view(np.int64)
                for half in (0, 1)]

    def low(self) -> np.ndarray:
        return (self.tokens >> np.uint64(32)).astype("<u4")


def row_key(key: str, text: str):
    return F.xxhash64(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")))


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, row, n (lines with words of the text), number, node of each line with words; and from each task ``CHUNKS`` rows (number: the
    chunk) with its part of the token counts in ``counts``: one reading of the texts gives both."""
    size = BUCKETS // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "n", "number", "node", "counts"]
        total = np.zeros(BUCKETS, np.uint32)
        for b in small_batches(batches, 2):
            lines = Lines(b.column(2).to_pylist())
            total += lines.buckets()
            row = pa.array(lines.row, pa.int64())
            n = np.bincount(lines.row, minlength=b.num_rows)[lines.row]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array(n, pa.int32()), pa.array(lines.number, pa.int32()), pa.array(lines.sets().ids()),
                 pa.nulls(lines.n, pa.binary())], names=names)
        parts = [zlib.compress(total[i * size:(i + 1) * size].tobytes(), 1) for i in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()),
             pa.nulls(CHUNKS, pa.int64()), pa.array(parts, pa.binary())], names=names)

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(key, text).alias("row"), F.col(text))
    return narrow.mapInArrow(run, "doc_id long, row long, n int, number int, node long, counts binary")


def token_counts(parts: DataFrame) -> np.ndarray:
    """How often the tokens of each hash bucket occur, from the tasks' parts (number, counts)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(part), np.uint32)
                total[c] = total[c] + np.minimum(part, np.uint32(0xFFFFFFFF) - total[c]) if c in total else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())],
            names=["number", "counts"])

    size, out = BUCKETS // CHUNKS, np.zeros(BUCKETS, np.uint32)
    for r in parts.repartition(CHUNKS, "number").mapInArrow(add, "number int, counts binary").collect():
        # CHUNKS rows, 8 MB in all at any input size
        out[r["number"] * size:(r["number"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return out


def needed(size: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of a set of this size with a set at least t similar to it."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


#: A prefix key of a set. Rows travel packed: many of one part in a binary value, byte by byte of all rows, so
#: that the zeros of small numbers compress.
KEY_ROW = np.dtype([("key", "<i8"), ("node", "<i8"), ("bits", "<i8"), ("more", "<i8"),
                    ("size", "<i4"), ("at", "<i4"), ("last", "<i4"), ("prev", "<i4")])


def packed(columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """part, rows: the key rows, those of one part (chosen by key) together."""
    rows = np.empty(len(columns[0]), KEY_ROW)
    for name, x in zip(KEY_ROW.names, columns, strict=True):
        rows[name] = x
    part = (mixed(rows["key"].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[len(part) > 0], part[1:] != part[:-1], [len(part) > 0]])).tolist()
    blobs = [rows[i:j].view(np.uint8).reshape(j - i, -1).T.tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["part", "rows"])


def unpacked(blobs: list[bytes]) -> np.ndarray:
    wide = KEY_ROW.itemsize
    return np.concatenate([np.frombuffer(b, np.uint8).reshape(wide, -1).T.copy().view(KEY_ROW).ravel() for b in blobs])


def prefix_keys(docs: DataFrame, text: str, counts, t: float, frequent: int) -> DataFrame:
    """Every prefix key of every set, packed: key, node, its bits, size, the positions of the key's first and last token
    (the same for a key of one token) and prev. prev is the token before the key's last one, or before its first
    where the two are neighbours (0: none): two sets with equal prev share a token before the key's."""

    def keys_of(s: Sets) -> tuple:
        node, need = s.ids(), needed(s.size, t)
        use = np.zeros(len(node), bool)
        use[np.unique(node, return_index=True)[1]] = True         # each set once a batch
        # similar to equal sets only: no larger size is near enough and none of its own tokens can differ
        use &= (s.size > need) | (np.floor(s.size / t + 1e-9) > s.size)
        at = np.arange(len(s.tokens)) - s.start[s.line]
        inside = use[s.line] & (at < (s.size - need + 1)[s.line]) & (s.count > 1)     # a token seen once matches nothing
        low = s.low().astype(np.int64)
        one = np.flatnonzero(inside & ((s.count <= frequent) | (need[s.line] == 1)))
        # a frequent first token: with each token after it in the prefix that is one longer
        hot = np.flatnonzero(inside & (s.count > frequent))
        last = s.start[s.line[hot]] + np.minimum(s.size, s.size - need + 2)[s.line[hot]]
        n = np.maximum(last - hot - 1, 0)
        first = np.repeat(hot, n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        both = mixed(low[first].astype(np.uint64) << np.uint64(32) | low[second].astype(np.uint64)) | np.uint64(1 << 63)
        key = np.concatenate([low[one], both.view(np.int64)])
        first, second = np.concatenate([one, first]), np.concatenate([one, second])
        before = np.where(second > first + 1, second, first)
        prev = np.where(at[before] > 0, low[np.maximum(before - 1, 0)], 0).astype(np.uint32).view(np.int32)
        ln = s.line[first]
        return key, node[ln], *[x[ln] for x in s.bits()], s.size[ln], at[first], at[second], prev

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 0):
            yield packed(keys_of(Lines(b.column(0).to_pylist()).sets(counts.value)), parts)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(n, min(8 * n, 4096))
    return docs.select(text).mapInArrow(run, "part int, rows binary")


def near_rows(key: np.ndarray, size: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (left, right) of places with equal keys and sizes near enough, right - left growing by one.
    Rows are ordered by key and size."""
    left, d = np.arange(len(key)), 1
    while True:
        left = left[left + d < len(key)]
        right = left + d
        go = (key[left] == key[right]) & (size[left] >= t * size[right] - 1e-9)
        left, right = left[go], right[go]
        if not len(left):
            return
        yield left, right
        d += 1


def partnered(rows: np.ndarray, t: float) -> np.ndarray:
    """The key rows with a partner of the same key that passes the length, the positional and the bit filter and
    may have its first common tokens at this key. A set that came from several batches is there once."""
    rows = rows[np.lexsort((rows["node"], rows["size"], rows["key"]))]
    rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])]
    key, bits, more, size, at, last, prev = (rows[c].copy() for c in ("key", "bits", "more", "size", "at", "last", "prev"))
    hit, rest = np.zeros(len(key), bool), size - last + (last > at)
    for left, right in near_rows(key, size, t):
        # overlap needed: t / (1 + t) * (|a| + |b|); still possible: the key's tokens and what follows them in both
        both = size[left] + size[right]
        need = np.ceil(t / (1 + t) * both - 1e-9)
        ok = np.minimum(rest[left], rest[right]) >= need
        ok &= (prev[left] != prev[right]) | (prev[left] == 0)
        left, right, most = left[ok], right[ok], (both - 2 * need)[ok]
        differ = sum(np.bitwise_count((x[left] ^ x[right]).view(np.uint64)).astype(np.int64) for x in (bits, more))
        ok = differ <= most
        hit[left[ok]] = True
        hit[right[ok]] = True
    return rows[hit]


def shared_keys(keys: DataFrame, t: float) -> DataFrame:
    """key, node, size, at, last of the key rows with a partner. Rows are dealt by part, all of a key together."""
    names = ["key", "node", "size", "at", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(p, []).append(blob)
        while parts:
            rows = partnered(unpacked(parts.popitem()[1]), t)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].copy()) for c in names], names=names)

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "part").mapInArrow(run, "key long, node long, size int, at int, last int")


class Marks:
    """Which ids may be in a set: a bit table of fixed size (no id of the set is missed, others pass by chance)."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << (MARK_BITS - 3), np.uint8) if bits is None else bits

    @staticmethod
    def places(ids: np.ndarray):
        x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift in (64 - MARK_BITS, 20):
            yield ((x >> np.uint64(shift)) & np.uint64((1 << MARK_BITS) - 1)).astype(np.int64)

    def add(self, ids: np.ndarray) -> None:
        for p in self.places(ids):
            np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def holds(self, ids: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for p in self.places(ids):
            ok &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return ok


def marks_of(nodes: DataFrame) -> Marks:
    """The bit table of a column of ids, put together from the tasks' tables by pieces."""
    piece = (1 << (MARK_BITS - 3)) // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Marks()
        for b in batches:
            m.add(b.column(0).to_numpy())
        parts = [zlib.compress(m.bits[i * piece:(i + 1) * piece].tobytes(), 1) for i in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["number", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(part), np.uint8)
                total[c] = total[c] | part if c in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())],
                                         names=["number", "bits"])

    schema = "number int, bits binary"
    out = Marks()
    for r in nodes.mapInArrow(run, schema).repartition(CHUNKS, "number").mapInArrow(join, schema).collect():   # 8 MB in all
        out.bits[r["number"] * piece:(r["number"] + 1) * piece] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out


def node_sets(docs: DataFrame, text: str, counts, wanted: DataFrame) -> DataFrame:
    """node, tokens (32-bit hashes, rare ones first) of the wanted nodes and a few more: a bit table keeps
    most other sets from being shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(marks_of(wanted).bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(shared.value)
        for b in small_batches(batches, 0):
            s = Lines(b.column(0).to_pylist()).sets(counts.value)
            ids = s.ids()
            _, once = np.unique(ids, return_index=True)
            once = once[marks.holds(ids[once])]
            low, end = s.low(), s.start + s.size
            blobs = [low[s.start[i]:end[i]].tobytes() for i in once.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[once]), pa.array(blobs, pa.binary())], names=["node", "tokens"])

    return docs.select(text).mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


class Group(NamedTuple):
    """Rows of a task, ordered by key and size: a set under a key."""

    key: np.ndarray
    size: np.ndarray
    at: np.ndarray          # position of the key's first token
    last: np.ndarray        # and of its last one
    rank: np.ndarray        # order of the first places of the nodes
    start: np.ndarray       # the first token of each set in ``tokens``
    tokens: np.ndarray

    def flat(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places in ``tokens`` of the first ``size`` tokens of the rows."""
        return np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))

    def early(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``tokens`` before the key's last token, without its first; and how many of each row."""
        n = self.last[rows]
        place = self.flat(rows, n)
        keep = place != np.repeat(self.start[rows] + self.at[rows], n)
        return place[keep], n - (self.last[rows] > self.at[rows])

    def alike(self, left, right, common: np.ndarray, t: float) -> np.ndarray:
        """Which pairs have similarity t and truly share the key's tokens (keys are hashes)."""
        x, y = self.start[left], self.start[right]
        ok = common / (self.size[left] + self.size[right] - common) >= t - 1e-12
        ok &= (self.tokens[x + self.at[left]] == self.tokens[y + self.at[right]])
        ok &= (self.tokens[x + self.last[left]] == self.tokens[y + self.last[right]])
        # where an overlap of one token is enough, the pair is met under the one token too
        return ok & ((self.last[left] == self.at[left]) | (np.maximum(needed(self.size[left], t), needed(self.size[right], t)) > 1))


def common_tokens(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """How many tokens the i-th run of ``x`` (of nx[i] distinct ones) shares with the i-th run of ``y``."""
    pair = np.arange(len(nx), dtype=np.uint64) << np.uint64(32)
    both = np.concatenate([np.repeat(pair, nx) | x, np.repeat(pair, ny) | y])
    both.sort()
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(nx))


def links_of_small(g: Group, at: np.ndarray, t: float, links: np.ndarray, goes: np.ndarray) -> None:
    """Counts the links of the rows ``at`` (groups of few rows each), many pairs at a time."""
    for a, b in near_rows(g.key[at], g.size[at], t):
        for lo, hi in runs(g.size[at[a]] + g.size[at[b]], 2_000_000):
            left, right = at[a[lo:hi]], at[b[lo:hi]]
            common = common_tokens(g.tokens[g.flat(left, g.size[left])], g.size[left], g.tokens[g.flat(right, g.size[right])], g.size[right])
            ok = g.alike(left, right, common, t)
            left, right = left[ok], right[ok]
            if len(left):
                (x, nx), (y, ny) = g.early(left), g.early(right)
                first = common_tokens(g.tokens[x], nx, g.tokens[y], ny) == 0      # else counted under an earlier key
                left, right = left[first], right[first]
            np.add.at(links, left, 1)
            np.add.at(links, right, 1)
            goes[np.where(g.rank[left] < g.rank[right], right, left)] = True


def links_of_large(g: Group, lo: int, hi: int, t: float, links: np.ndarray, goes: np.ndarray) -> None:
    """Counts the links of one key's rows lo..hi: each row's tokens are marked and looked up for the rows after it."""
    rows = np.arange(lo, hi)
    kinds, code = np.unique(g.tokens[g.flat(rows, g.size[rows])], return_inverse=True)
    start = np.concatenate([[0], np.cumsum(g.size[rows])])
    place, n = g.early(rows)
    # one empty mark before each row's early tokens: no run is empty
    before = np.concatenate([[0], np.cumsum(n + 1)])
    early = np.full(before[-1], len(kinds))
    early[np.arange(len(place)) + np.repeat(np.arange(len(rows)) + 1, n)] = np.searchsorted(kinds, g.tokens[place])
    mark = np.zeros(len(kinds) + 1, np.int32)
    for i in range(len(rows) - 1):
        end = int(np.searchsorted(g.size[lo:hi], g.size[lo + i] / t + 1e-9, "right"))
        for a, b in runs(g.size[lo + i + 1:lo + end], 2_000_000):
            a, b = a + i + 1, b + i + 1
            mark[code[start[i]:start[i + 1]]] = 1
            common = np.add.reduceat(mark[code[start[a]:start[b]]], start[a:b] - start[a])
            mark[code[start[i]:start[i + 1]]] = 0
            ok = g.alike(lo + i, rows[a:b], common, t)
            if not ok.any():
                continue
            mark[early[before[i]:before[i + 1]]] = 1
            mark[-1] = 0
            ok &= np.add.reduceat(mark[early[before[a]:before[b]]], before[a:b] - before[a]) == 0
            mark[early[before[i]:before[i + 1]]] = 0
            later = g.rank[lo + a:lo + b] > g.rank[lo + i]
            links[lo + i] += int(ok.sum())
            links[lo + a:lo + b] += ok
            goes[lo + a:lo + b] |= ok & later
            goes[lo + i] |= bool((ok & ~later).any())


def runs(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of 0..len(weight) with a weight of some ``most`` each."""
    total = np.cumsum(weight)
    i = 0
    while i < len(weight):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


#: Rows of a key from which on they are compared one with all later ones.
LARGE = 48


def count_links(key: np.ndarray, size: np.ndarray, at: np.ndarray, last: np.ndarray, rank: np.ndarray, tokens: np.ndarray,
                t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row (a set under a key) the similar sets whose first common tokens with it are the key's, and whether
    one of them has an earlier first place. Rows are ordered by key and size; ``tokens``: set after set."""
    g = Group(key, size, at, last, rank, np.cumsum(size) - size, tokens)
    links, goes = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    n = np.diff(bounds)
    links_of_small(g, np.flatnonzero(np.repeat(n < LARGE, n)), t, links, goes)
    for i in np.flatnonzero(n >= LARGE).tolist():
        links_of_large(g, int(bounds[i]), int(bounds[i + 1]), t, links, goes)
    return links, goes


def line_links(docs: DataFrame, text: str, counts: np.ndarray, nodes: DataFrame, t: float = SIMILARITY,
               frequent: int = FREQUENT) -> DataFrame:
    """node, links (similar nodes), goes (one of them has an earlier first place) of the nodes with links. Pairs are
    verified and counted where their first common key is dealt to; none is written."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    rows = cut(shared_keys(prefix_keys(docs, text, shared, t, frequent), t), "line-keys")
    sets = node_sets(docs, text, shared, rows.select("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got)
        key, node, size, at, last, none, doc, row, number = (
            got.column(c).to_numpy() for c in ("key", "node", "size", "at", "last", "none", "doc_id", "row", "number"))
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((number, row, doc, none))] = np.arange(len(key))
        by = np.lexsort((node, size, key))
        blobs = got.column("tokens").to_pylist()
        flat = np.frombuffer(b"".join([blobs[i] for i in by.tolist()]), "<u4")
        del blobs, got
        links, goes = count_links(key[by], size[by].astype(np.int64), at[by], last[by], rank[by], flat, t)
        out = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[by][out]), pa.array(links[out]), pa.array(goes[out])], names=["node", "links", "goes"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = nodes.select("node", "first.none", F.coalesce("first.doc_id", F.lit(0)).alias("doc_id"), "first.row", "first.number")
    full = rows.join(sets.hint("merge"), "node").join(first.hint("merge"), "node").repartition(n, "key").mapInArrow(run, "node long, links long, goes boolean")
    return full.groupBy("node").agg(F.sum("links").alias("links"), F.max("goes").alias("goes"))


def judge_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", t: float = SIMILARITY, frequent: int = FREQUENT):
    """(lines, nodes): every line with its node; every node with links and whether its first line stays."""
    both = cut(line_rows(docs, key, text), "line-rows")
    lines = both.filter("counts IS NULL").drop("counts")
    counts = token_counts(both.filter("counts IS NOT NULL").select("number", "counts"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("number"))
    nodes = cut(lines.groupBy("node").agg(F.min(place).alias("first")), "line-nodes")
    links = cut(line_links(docs, text, counts, nodes, t, frequent), "line-links")
    nodes = nodes.join(links.hint("merge"), "node", "left").select(
        "node", "first", F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (~F.coalesce("goes", F.lit(False))).alias("stays"))
    return lines, cut(nodes, "line-judged")


def line_figures(docs: DataFrame, key: str = "doc_id", text: str = "text", t: float = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, row, n_lines, n_removed, links, kept_numbers of each document."""
    lines, nodes = judge_lines(docs, key, text, t, frequent)
    # rows with equal id and text count once: their lines are so many times those of one
    per = lines.groupBy("doc_id", "row").agg(F.max("n").alias("n_lines"), (F.count("*") / F.max("n")).alias("copies"))
    kept = nodes.filter("stays").groupBy(F.col("first.doc_id").alias("_d"), F.col("first.row").alias("_r")).agg(
        F.array_sort(F.collect_list("first.number")).alias("kept_numbers"))
    linked = nodes.filter("links > 0").select("node", "links")
    links = lines.join(linked.hint("merge"), "node").groupBy(F.col("doc_id").alias("_e"), F.col("row").alias("_s")).agg(
        F.sum("links").alias("links"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(key, text).alias("row"))
    none = F.expr("CAST(array() AS array<int>)")
    return (rows.join(per.select(F.col("doc_id").alias("_p"), F.col("row").alias("_q"), "n_lines", "copies").hint("merge"),
                      F.col("doc_id").eqNullSafe(F.col("_p")) & (F.col("row") == F.col("_q")), "left")
            .join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
            .join(links.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_e")) & (F.col("row") == F.col("_s")), "left")
            .select("doc_id", "row", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
                    (F.coalesce("n_lines", F.lit(0)) - F.size(F.coalesce("kept_numbers", none))).cast("long").alias("n_removed"),
                    F.coalesce(F.round(F.col("links") / F.col("copies")), F.lit(0)).cast("long").alias("links"),
                    F.coalesce("kept_numbers", none).alias("kept_numbers")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", t: float = SIMILARITY) -> DataFrame:
    """``docs`` without the removed lines (lines without words stay)."""
    f = line_figures(docs, key, text, t).select(F.col("row").alias("_row"), "kept_numbers").distinct()
    out = docs.select(whole_row(docs), F.col(text).alias("_text"), row_key(key, text).alias("_key")).join(f, F.col("_key") == F.col("_row"))
    parts = F.split(F.col("_text"), "\n")
    stays = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                     lambda p: F.array_contains("kept_numbers", p["i"]) | ~p["x"].rlike("[^\\x20\\x09-\\x0D]"))
    new = F.when(F.col("_text").isNotNull(), F.array_join(F.transform(stays, lambda p: p["x"]), "\n"))
    return out.select(*[new.alias(c) if c == text else F.col(f"_doc.`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_figures(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "links", F.to_json("kept_numbers").alias("kept_numbers"))
