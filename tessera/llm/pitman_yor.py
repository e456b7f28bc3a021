"""Operator 3: hierarchical Pitman-Yor language model, seated by Gibbs sampling.

One restaurant for every context (the token before); a customer is a token in its
context, a dish is a word. Every table of a context restaurant sends one customer to
the parent restaurant, which all contexts share and whose base is uniform over the
training vocabulary and one unknown word. With c customers and t tables of a dish,
C and T of the restaurant, discount d and strength s:

    P(w | u) = (c - d t) / (s + C) + (s + d T) / (s + C) * P(w),    P(w) alike over 1 / (V + 1)

Seating: what matters of a dish's seating is its number of tables, and a Gibbs step draws
that number anew from its exact conditional distribution given the other dishes' tables
(``table_counts``): the same as moving its customers one by one until they have forgotten
their seats, for dishes of any size. ``BURN`` sweeps precede ``SAMPLES`` samples (one sweep
apart), and the predictive probability is the mean over the samples. A sweep draws the dishes
of a restaurant in ``GROUPS`` groups, one after the other; those of a group are drawn side by
side, against the table numbers left by the step before. Discounts come from the
counts of counts, n1 / (n1 + 2 n2). Contexts are seated twice: first with the word
shares of their bucket as parent, then with the parent seated on the first result.

What is gathered covers the whole corpus and is spread over twice ``spark.sql.shuffle.partitions``
buckets of word ids (48-bit hashes). A chunk of documents (some 10 MB of text) sends each
distinct word and each distinct pair (context, word) once, with its training count; a
context belongs to the bucket of its id. Contexts with a share above 1 / (4 buckets) of all
tokens (at most four a bucket, so they may be broadcast) are dealt over all buckets by pair.
Buckets and chunks exchange arrays, never rows of tokens; what goes back to a bucket or a chunk
is written to a folder of its own in the shared folder: a lost executor costs its
tasks only. The driver holds a few numbers a bucket.

Defined results: a null text is empty and has the end token alone; a null id counts as
the text '' (crc32 0: held out); repeated rows are documents of their own; without
training documents every probability is 1 (N = V = 0); an empty table gives no rows.
The input must be a plan that returns the same rows in the same order when read again
(files do); a chunk that differs on the second reading raises.
"""

from __future__ import annotations

import io
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, table
from tessera.llm.table_counts import Stirling, draw

STRENGTH = 1.0
BURN, SAMPLES, GROUPS = 2, 2, 4
SEED = 7
CHUNK_CHARS = 10_000_000
HELD_OUT_OF = 10
#: Buckets for each shuffle partition: a task holds one bucket's pairs in memory.
BUCKETS_PER_PARTITION = 2
END = b"\n"            # no word holds a line break
ID_BITS = 48
WIDE = np.uint64(0xFFFFFFFF)


# ---- arrays on the wire -----------------------------------------------------------

def pack_ids(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pack_sorted(ids: np.ndarray) -> bytes:
    """Ascending ids as 32-bit gaps, the few wider ones apart."""
    gaps = np.diff(ids, prepend=np.uint64(0))
    wide = gaps >= WIDE
    small = np.where(wide, WIDE, gaps).astype("<u4")
    return int(wide.sum()).to_bytes(4, "little") + gaps[wide].astype("<u8").tobytes() + small.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    gaps = np.frombuffer(data, "<u4", offset=4 + 8 * n).astype(np.uint64)
    gaps[gaps == WIDE] = np.frombuffer(data, "<u8", n, 4)
    return np.cumsum(gaps, dtype=np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    """Compressed, after its size in bytes."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def expand(data: bytes, kind) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"))
    return np.frombuffer(raw, kind)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the place of each element among them."""
    bits = len(x).bit_length()
    if not len(x):
        return x, np.empty(0, np.int64)
    span = int(x.max()) - int(x.min())
    if span >> 64 - bits:
        first, place = distinct_hashes((x - x.min()).astype(np.uint64) << np.uint64(64 - span.bit_length()))
        return x[first], place
    # value and position share a number, so one plain sort does
    low = x.min()
    s = np.sort((x - low).astype(np.uint64) << np.uint64(bits) | np.arange(len(x), dtype=np.uint64))
    at, value = (s & np.uint64((1 << bits) - 1)).astype(np.int64), s >> np.uint64(bits)
    new = np.concatenate([[True], value[1:] != value[:-1]])
    place = np.empty(len(x), np.int64)
    place[at] = np.cumsum(new) - 1
    return value[new].astype(x.dtype) + low, place


def distinct_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each distinct 64-bit hash, in the hashes' order, and the place of each element among them."""
    bits = len(h).bit_length()
    s = np.sort(h >> np.uint64(bits) << np.uint64(bits) | np.arange(len(h), dtype=np.uint64))
    at, high = (s & np.uint64((1 << bits) - 1)).astype(np.int64), s >> np.uint64(bits)
    new = h[at[1:]] != h[at[:-1]]
    if (new & (high[1:] == high[:-1])).any():      # hashes that differ in the bits cut off alone
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        return first, place
    new = np.concatenate([[True], new])[:len(h)]
    place = np.empty(len(h), np.int64)
    place[at] = np.cumsum(new) - 1
    return at[new], place


def held_in(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the ascending, distinct ``ids`` are among ``some``."""
    out = np.zeros(len(ids), bool)
    if len(ids):
        at = np.minimum(np.searchsorted(ids, some), len(ids) - 1)
        out[at[ids[at] == some]] = True
    return out


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Ranges of ids, so that sorted ids are in bucket order."""
    return ((ids >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (u ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31)) ^ w) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def word_ids(words: pa.Array) -> np.ndarray:
    each = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each)) >> np.uint64(64 - ID_BITS)


END_ID = word_ids(pa.array([END]))[0]


# ---- chunks of documents -------------------------------------------------------------

class Chunk:
    """Some documents: distinct word ids, the tokens as places in them, distinct pairs."""

    def __init__(self, number: int, doc_ids: list, texts: pa.Array):
        self.number = number
        self.doc_ids = doc_ids
        self.held = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % HELD_OUT_OF == 0 for d in doc_ids], bool)
        # A-Z only, the six separators
        found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words, doc = found.flatten(), pc.list_parent_indices(found).to_numpy()
        full = pc.greater(pc.binary_length(words), 0)      # a text may begin or end with separators
        words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
        self.sizes = np.bincount(doc, minlength=len(doc_ids)) + 1
        coded = words.dictionary_encode()
        ids = np.append(word_ids(coded.dictionary), END_ID)
        self.ids, place = np.unique(ids, return_inverse=True)
        ends = np.cumsum(self.sizes) - 1
        self.token = np.full(len(words) + len(doc_ids), place[-1])
        inside = np.ones(len(self.token), bool)
        inside[ends] = False
        self.token[inside] = place[coded.indices.to_numpy()]
        self.doc = np.repeat(np.arange(len(doc_ids)), self.sizes)
        self.train = ~self.held[self.doc]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ids, np.bincount(self.token, weights=self.train, minlength=len(self.ids)).astype(np.int64)

    def pairs(self, n: int, heavy: np.ndarray):
        """(context place, word place, bucket, training count) of each distinct pair in bucket order, pair of each token."""
        end = np.searchsorted(self.ids, END_ID)
        before = np.concatenate([[end], self.token[:-1]])
        bits = len(self.ids).bit_length()
        key, pair = distinct(before << bits | self.token)
        u, w = key >> bits, key & (1 << bits) - 1
        bucket = bucket_of(self.ids, n)[u]
        if len(heavy):
            hot = held_in(self.ids, heavy)[u]
            bucket[hot] = (pair_hash(self.ids[u[hot]], self.ids[w[hot]]) % np.uint64(n)).astype(np.int64)
        # 16-bit numbers are sorted by radix
        order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        count = np.bincount(pair, weights=self.train, minlength=len(key)).astype(np.int64)
        return u[order], w[order], bucket[order], count[order], place[pair]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    part, held, size, k = TaskContext.get().partitionId(), [], 0, 0

    def chunk() -> Chunk:
        ids, texts = zip(*held, strict=True)
        return Chunk(part << 20 | k, [d for x in ids for d in x.to_pylist()], pa.concat_arrays(texts))

    for b in batches:
        first = 0
        for i, length in enumerate(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()):
            size += length + 1
            if size >= CHUNK_CHARS:
                held.append([c.slice(first, i + 1 - first) for c in b.columns[:2]])
                yield chunk()
                held, size, k, first = [], 0, k + 1, i + 1
        if first < b.num_rows:
            held.append([c.slice(first) for c in b.columns[:2]])
    if held:
        yield chunk()


def slices(bucket: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    at = np.searchsorted(bucket, np.arange(n + 1))
    return [(b, int(at[b]), int(at[b + 1])) for b in range(n) if at[b + 1] > at[b]]


def send(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for k, *values in rows:
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(tuple(values))], pa.binary())], names=["k", "v"])


def dealt(df: DataFrame, n: int):
    """Rows (k, v) as an RDD partitioned by k; its shuffle files serve every later pass."""
    return by_bucket(df.rdd.map(lambda r: (r[0], bytes(r[1]))), n)


def by_bucket(rdd, n: int, place=int):
    return rdd.partitionBy(n, place)


# ---- merging what chunks sent -----------------------------------------------------------

def merge_words(rows) -> tuple[np.ndarray, np.ndarray, list]:
    """(ids, training counts) of a bucket and what each chunk asked for: (chunk, places)."""
    got = sorted((pickle.loads(v) for _, v in rows), key=lambda x: x[0])
    if not got:
        return np.empty(0, np.uint64), np.empty(0, np.int64), []
    parts = [unpack_sorted(x[1]) for x in got]
    ids, place = distinct(np.concatenate(parts))
    count = np.bincount(place, weights=np.concatenate([expand(x[2], "<u4") for x in got]), minlength=len(ids)).astype(np.int64)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return ids, count, list(zip([x[0] for x in got], np.split(place, cuts), strict=True))


class Restaurants:
    """The pairs of a bucket: distinct (u, w) with training counts, by context."""

    def __init__(self, rows, heavy: dict[int, int]):
        got = sorted((pickle.loads(v) for _, v in rows), key=lambda x: x[0])
        us, ws, cs, sizes = [], [], [], []
        self.asked = [unpack_sorted(x[1]) for x in got]
        for (_, _, n_u, w, c), u in zip(got, self.asked, strict=True):
            us.append(np.repeat(u, expand(n_u, "<u4")))
            ws.append(unpack_ids(w))
            cs.append(expand(c, "<u4"))
            sizes.append(len(ws[-1]))
        self.chunks, self.sizes = [x[0] for x in got], sizes
        u, w = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (us, ws))
        c = np.concatenate(cs) if cs else np.empty(0, np.uint32)
        first, self.place = distinct_hashes(pair_hash(u, w))
        self.count = np.bincount(self.place, weights=c, minlength=len(first)).astype(np.int64)
        self.word = w[first]
        self.contexts, self.context = distinct(u[first])
        self.customers = np.bincount(self.context, weights=self.count, minlength=len(self.contexts))
        self.heavy = held_in(self.contexts, np.fromiter(heavy, np.uint64, len(heavy)))
        for i in np.flatnonzero(self.heavy):
            self.customers[i] = heavy[int(self.contexts[i])]
        self.many = np.flatnonzero(self.count > 1)
        self.many_words, self.many_place = distinct(self.word[self.many])

    def seat(self, parent: np.ndarray, d: float, rng, sweeps: int, samples: int, n: int) -> list[np.ndarray]:
        """Tables of every pair, for each sample. ``parent``: P(w) of ``many_words``."""
        single = np.bincount(self.context[self.count == 1], minlength=len(self.contexts)).astype(float)
        scale = np.where(self.heavy, float(n), 1.0)      # a bucket sees one n-th of a heavy context
        found = seat(rng, self.context[self.many], self.count[self.many], parent[self.many_place], single, scale, d,
                     STRENGTH, sweeps, samples)
        out = []
        for t in found:
            tables = (self.count > 0).astype(np.int64)
            tables[self.many] = t
            out.append(tables)
        return out


def seat(rng, room, c, base, tables, scale, d, s, sweeps, samples) -> list[np.ndarray]:
    """Tables per dish after ``sweeps`` sweeps and a first one, and one more for each further sample.

    Dish i has c[i] >= 2 customers in restaurant room[i] and base probability base[i];
    ``tables``: tables of the restaurants' other dishes; ``scale``: by how much the
    tables seen here are to be multiplied.
    """
    n = len(c)
    if not n:
        return [np.empty(0, np.int64)] * samples
    numbers, t = Stirling(d, int(c.max())), np.ones(n, np.int64)
    total = tables + np.bincount(room, minlength=len(tables))
    order = np.argsort(room, kind="stable")
    place = np.empty(n, np.int64)      # of a dish in its restaurant
    place[order] = np.arange(n) - np.searchsorted(room[order], room[order])
    groups = [g for g in (np.flatnonzero(place % GROUPS == i) for i in range(GROUPS)) if len(g)]
    out = []
    for sweep in range(sweeps + samples):
        for g in groups:
            r = room[g]
            new = draw(rng, numbers, c[g], base[g], s + d * np.maximum(total[r] * scale[r] - t[g], 0))
            total += np.bincount(r, weights=new - t[g], minlength=len(total))
            t[g] = new
        if sweep >= sweeps:
            out.append(t.copy())
    return out


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


# ---- the model ------------------------------------------------------------------------

def generator(*of: int):
    return np.random.default_rng([SEED, *of])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"))
    wire = "k long, v binary"

    # 1. words: ids and training counts
    def send_words(batches):
        def rows():
            for ch in chunks(batches):
                ids, count = ch.words()
                for b, i, j in slices(bucket_of(ids, n), n):
                    yield b, ch.number, pack_sorted(ids[i:j]), squeeze(count[i:j].astype("<u4"))
        return send(rows())

    words = dealt(narrow.mapInArrow(send_words, wire), n)

    def word_stats(rows):
        _, count, _ = merge_words(rows)
        yield int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum())

    stats = np.array(words.mapPartitions(word_stats).collect() or [(0, 0, 0, 0)]).sum(axis=0).tolist()
    total, vocab, d0 = stats[0], stats[1], discount(*stats[2:])
    least = total / (4 * n)

    def heavy_words(rows):
        ids, count, _ = merge_words(rows)
        hot = np.flatnonzero(count > least)
        yield from zip(ids[hot].tolist(), count[hot].tolist(), strict=True)

    heavy = dict(words.mapPartitions(heavy_words).collect()) if total else {}     # fewer than 4 n
    heavy_ids = np.array(sorted(heavy), np.uint64)

    # 2. pairs: each distinct pair of a chunk once
    def send_pairs(batches):
        def rows():
            for ch in chunks(batches):
                u, w, bucket, count, _ = ch.pairs(n, heavy_ids)
                for b, i, j in slices(bucket, n):
                    new = np.concatenate([[True], u[i + 1:j] != u[i:j - 1]])
                    runs = np.diff(np.append(np.flatnonzero(new), j - i))
                    yield (b, ch.number, pack_sorted(ch.ids[u[i:j][new]]), squeeze(runs.astype("<u4")),
                           pack_ids(ch.ids[w[i:j]]), squeeze(count[i:j].astype("<u4")))
        return send(rows())

    pairs = dealt(narrow.mapInArrow(send_pairs, wire), n)

    def bucket_number(rows) -> int:
        return rows[0][0] if rows else -1

    def tables_up(r: Restaurants, tables: list[np.ndarray], number: int):
        """Customers that the contexts of this bucket send to the parent, to the words' buckets."""
        seen = r.count > 0
        ids, place = distinct(r.word[seen])
        sums = [np.bincount(place, weights=t[seen], minlength=len(ids)) for t in tables]
        many = held_in(ids, r.many_words)
        once = int((r.count == 1).sum()), int((r.count == 2).sum())        # pairs seen once and twice, sent along once
        for b, i, j in slices(bucket_of(ids, n), n):
            yield b, pickle.dumps((number, pack_sorted(ids[i:j]), squeeze(np.stack([x[i:j] for x in sums]).astype("<u4")),
                                   squeeze(many[i:j]), once))
            once = (0, 0)

    # 3. first seating of the contexts; the parent is what the bucket's own contexts show of the words
    def first_seating(rows):
        rows = list(rows)
        r, number = Restaurants(rows, heavy), bucket_number(rows)
        words_here, place = distinct(r.word)
        share = np.bincount(place, weights=r.count, minlength=len(words_here))
        share = (share + 0.1) / (share.sum() + 0.1 * (vocab + 1))
        parent = share[np.searchsorted(words_here, r.many_words)]
        d = discount(int((r.count == 1).sum()), int((r.count == 2).sum()))
        yield from tables_up(r, r.seat(parent, d, generator(1, number + 1), 1, 1, n), number)

    up = by_bucket(pairs.mapPartitions(first_seating), n)

    # 4. the parent restaurant on the words' buckets
    def seat_parent(rows, round_: int):
        """(ids, customers and tables per sample, what each context bucket asked for)."""
        got = sorted((pickle.loads(v) for _, v in rows), key=lambda x: x[0])
        if not got:
            return np.empty(0, np.uint64), [], []
        parts = [unpack_sorted(x[1]) for x in got]
        ids, place = distinct(np.concatenate(parts))
        sums = np.concatenate([expand(x[2], "<u4").reshape(-1, len(p)) for x, p in zip(got, parts, strict=True)], axis=1)
        samples, number = [], int(bucket_of(ids[:1], n)[0])
        for s, row in enumerate(sums):
            c = np.bincount(place, weights=row, minlength=len(ids)).astype(np.int64)
            many = np.flatnonzero(c > 1)
            t = np.minimum(c, 1)
            t[many] = seat(generator(2, round_, s, number), np.zeros(len(many), np.int64), c[many],
                           np.full(len(many), 1.0 / (vocab + 1)), np.array([float((c == 1).sum())]), np.array([float(n)]),
                           d0, STRENGTH, BURN, 1)[0]
            samples.append((c, t))
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return ids, samples, [(x[0], p, expand(x[3], bool)) for x, p in zip(got, np.split(place, cuts), strict=True)]

    def totals(parts: list, samples: int) -> list[tuple[int, int]]:
        return [tuple(sum(x[s][i] for x in parts) for i in (0, 1)) for s in range(samples)]

    def answer_parent(rows):
        rows = list(rows)
        ids, samples, asked = seat_parent(rows, 1)
        if not len(ids):
            return
        c, t = samples[0]
        number = int(bucket_of(ids[:1], n)[0])
        rows_seen = [pickle.loads(v)[4] for _, v in rows]
        yield -1, pickle.dumps([(int(c.sum()), int(t.sum())), tuple(sum(x[i] for x in rows_seen) for i in (0, 1))])
        for to, place, many in asked:
            yield to, pickle.dumps((number, (c - d0 * t)[place[many]].astype("<f4").tobytes()))

    at_parents = stored(spark, by_bucket(up.mapPartitions(answer_parent), n, lambda k: k + 1), "parents")
    (customers, tables), seen = totals([pickle.loads(v) for v in driver_rows(spark, at_parents)], 2)
    d1 = discount(*seen)

    # 5. second seating: samples; upwards the parent's customers, to the chunks what they need of contexts and pairs
    def second_seating(rows):
        rows = list(rows)
        r, number = Restaurants(rows, heavy), bucket_number(rows)
        got = sorted(read_answers(at_parents, number), key=lambda x: x[0]) if rows else []
        rest = np.frombuffer(b"".join(x[1] for x in got), "<f4").astype(float)
        parent = (rest + (STRENGTH + d0 * tables) / (vocab + 1)) / (STRENGTH + customers)
        found = r.seat(parent, d1, generator(3, number + 1), BURN, SAMPLES, n)
        for b, v in tables_up(r, found, number):
            yield ("up", b), v
        if not r.chunks:
            return
        per = np.stack([np.bincount(r.context, weights=t, minlength=len(r.contexts)) for t in found]).astype("<u4")
        hot = np.flatnonzero(r.heavy)
        if len(hot):
            yield ("heavy", number), pickle.dumps([(int(r.contexts[i]), [float(t[i]) for t in per]) for i in hot])
        seated = sum(found)                             # tables of a pair, added up over the samples
        cuts = np.cumsum(r.sizes)[:-1]
        for ch, place, u in zip(r.chunks, np.split(r.place, cuts), r.asked, strict=True):
            yield ("chunk", ch), pickle.dumps((number, "pairs", squeeze(r.count[place].astype("<u4")), squeeze(seated[place].astype("<u4")),
                                               squeeze(per[:, np.searchsorted(r.contexts, u)])))

    place_of = {"up": 0, "heavy": 1, "chunk": 2}

    def spread(k) -> int:
        return (k[1] if k[0] != "chunk" else k[1] * 2654435761 >> 16) + place_of[k[0]] * 7919

    second = pairs.mapPartitions(second_seating).partitionBy(n, spread)
    heavy_tables = {u: [0.0] * SAMPLES for u in heavy}
    for _, v in second.filter(lambda x: x[0][0] == "heavy").collect() if heavy else []:      # fewer than 4 n, a few numbers each
        for u, t in pickle.loads(v):
            heavy_tables[u] = [a + b for a, b in zip(heavy_tables[u], t, strict=True)]

    def by_kind(kind: str):
        return second.filter(lambda x: x[0][0] == kind).map(lambda x: (x[0][1], x[1]))

    def last_parent(rows):
        by: dict[int, list] = {}
        for k, v in rows:                               # the buckets dealt to this task
            by.setdefault(k, []).append((k, v))
        for k, own in by.items():
            ids, samples, _ = seat_parent(own, 2)
            yield -1, pickle.dumps([(int(c.sum()), int(t.sum())) for c, t in samples])
            yield k, pickle.dumps((pack_sorted(ids), [(squeeze(c.astype("<u4")), squeeze(t.astype("<u4"))) for c, t in samples]))

    at_samples = stored(spark, by_kind("up").mapPartitions(last_parent), "samples")
    sums = totals([pickle.loads(v) for v in driver_rows(spark, at_samples)], SAMPLES)

    # 6. what the chunks need of words: training count, and customers and tables in the parent for each sample
    def answer_words(rows):
        rows = list(rows)
        if not rows:
            return
        number = bucket_number(rows)
        ids, count, asked = merge_words(rows)
        parent = np.zeros((2 * SAMPLES, len(ids)), "<u4")
        for packed, samples in read_answers(at_samples, number):
            at = np.searchsorted(ids, unpack_sorted(packed))
            for s, (c, t) in enumerate(samples):
                parent[2 * s, at], parent[2 * s + 1, at] = expand(c, "<u4"), expand(t, "<u4")
        for ch, place in asked:
            yield ("chunk", ch), pickle.dumps((number, "words", squeeze(count[place].astype("<u8")), squeeze(parent[:, place])))

    for_words = words.mapPartitions(answer_words).partitionBy(n, spread).map(lambda x: (x[0][1], x[1]))
    folders = [stored(spark, by_kind("chunk"), "for-chunks-p"), stored(spark, for_words, "for-chunks-w")]

    # 7. scores
    def score_batches(batches):
        for ch in chunks(batches):
            got = [x for f in folders for x in read_answers(f, ch.number)]
            yield score_chunk(ch, got, n, heavy, heavy_ids, heavy_tables, total, vocab, d0, d1, sums)

    out = narrow.mapInArrow(score_batches, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                           "base_score double, score double")
    return out.withColumn(key, F.col("id").cast(docs.schema[key].dataType)).select(
        key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def stored(spark: SparkSession, rdd, name: str) -> str:
    """Write rows (k, v), each k from one task, to a folder for each k; returns the folder's place."""
    folder = shared_dir(spark, f"pitman-yor-{name}")
    df = spark.createDataFrame(rdd.map(lambda x: (int(x[0]), bytearray(x[1]))), "k long, v binary")
    df.write.partitionBy("k").parquet(folder)
    return folder


def driver_rows(spark: SparkSession, folder: str) -> list[bytes]:
    """The few numbers a task that were stored for the driver (k = -1)."""
    return [bytes(r["v"]) for r in spark.read.schema("v binary, k long").parquet(folder).filter("k = -1").collect()]


def read_answers(folder: str, k: int) -> list[tuple]:
    """What was stored for ``k`` in the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    from tessera.llm.packed_tokens import file_system
    fs, base = file_system(folder)
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{base}/k={k}", allow_not_found=True)) if x.path.endswith(".parquet")]
    out = []
    for f in sorted(files):
        with fs.open_input_file(f) as h:
            out += [pickle.loads(v) for v in pq.read_table(io.BytesIO(h.read()), columns=["v"]).column(0).to_pylist()]
    return out


def score_chunk(ch: Chunk, got, n, heavy, heavy_ids, heavy_tables, total, vocab, d0, d1, sums) -> pa.RecordBatch:
    words = sorted((x for x in got if x[1] == "words"), key=lambda x: x[0])
    count = np.concatenate([expand(x[2], "<u8") for x in words]).astype(np.int64)
    seated = np.concatenate([expand(x[3], "<u4").reshape(2 * SAMPLES, -1) for x in words], axis=1).astype(float)
    u, w, bucket, _, pair = ch.pairs(n, heavy_ids)
    answers = {x[0]: x for x in got if x[1] == "pairs"}
    if len(count) != len(ch.ids) or set(answers) != set(np.unique(bucket).tolist()):
        raise RuntimeError(f"chunk {ch.number} was read differently before: the input must return equal rows in equal order")
    parent = np.stack([(seated[2 * s] - d0 * seated[2 * s + 1] + (STRENGTH + d0 * sums[s][1]) / (vocab + 1)) / (STRENGTH + sums[s][0])
                       for s in range(SAMPLES)])
    hold = STRENGTH + count[u]                          # a context has as many customers as training tokens
    back, here = np.empty((SAMPLES, len(u))), np.empty(len(u))
    for b, i, j in slices(bucket, n):
        c, t = (expand(answers[b][k], "<u4").astype(float) for k in (2, 3))
        if len(c) != j - i:
            raise RuntimeError(f"chunk {ch.number} was read differently before: the input must return equal rows in equal order")
        new = np.concatenate([[True], u[i + 1:j] != u[i:j - 1]])
        tables = expand(answers[b][4], "<u4").reshape(SAMPLES, -1)[:, np.cumsum(new) - 1]
        back[:, i:j] = (STRENGTH + d1 * tables) / hold[i:j]
        here[i:j] = (c - d1 * t / SAMPLES) / hold[i:j]
    if heavy:
        hot = np.full(len(ch.ids), -1)
        here_too = np.flatnonzero(held_in(heavy_ids, ch.ids))
        hot[np.searchsorted(ch.ids, heavy_ids[here_too])] = here_too
        shares = np.array([[(STRENGTH + d1 * y) / (STRENGTH + heavy[x]) for y in heavy_tables[x]] for x in heavy_ids.tolist()]).T
        mine = hot[u]
        back[:, mine >= 0] = shares[:, mine[mine >= 0]]
    p = here + np.mean([back[s] * parent[s][w] for s in range(SAMPLES)], axis=0)
    log = np.log10(p)[pair]
    base = np.log10((count + 0.1) / (total + 0.1 * (vocab + 1)))[ch.token]
    k = len(ch.doc_ids)
    add = lambda x: np.bincount(ch.doc, weights=x, minlength=k)
    return pa.RecordBatch.from_arrays(
        [pa.array(ch.doc_ids, pa.string()), pa.array(ch.held), pa.array(ch.sizes.astype(np.int64)),
         pa.array(add(count[ch.token] > 0).astype(np.int64)), pa.array(np.full(k, total, np.int64)), pa.array(add(base)),
         pa.array(add(log))],
        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, tokens, perplexity of the model and of the base, from ``score``'s rows."""
    n = F.sum("n_tokens")
    return scores.groupBy("held_out").agg(n.alias("tokens"), F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"),
                                          F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
