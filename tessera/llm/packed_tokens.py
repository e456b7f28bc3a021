"""Operator 4: token ids in fixed-width bit-packed shard files.

Every id takes the bits that the largest vocabulary id needs (16 for 50,257 ids).
Ids are packed in blocks of ``BLOCK`` ids that begin on byte boundaries, so a
block, a document or any id range is read by its offset and unpacked with numpy
without touching the rest.

Shard file (little endian):

    0   8 bytes   magic "TSRPACK1"
    8   uint32    bits per id
    12  uint32    ids per block
    16  uint64    number of ids
    24  uint64    number of documents
    32  packed blocks, each of ceil(ids * bits / 8) bytes
    ..  uint64[blocks + 1]     byte offset of each block
    ..  int64[documents]       document ids
    ..  uint64[documents + 1]  first id of each document in the shard
    end-24  uint64 x 3         byte offsets of the three tables

Documents are range-partitioned and sorted by id; each task writes the shards of
its range (cut at ``SHARD_IDS`` ids, between documents), so shard order is
document order and only one row per shard, its length, goes on: the running sum
of these lengths gives every shard's first global id. A shard is written under an
attempt's own name and renamed when whole, so a task that is repeated or runs
twice leaves the same file.

Defined results: null and empty texts have only the end id; repeated ids are
documents of their own, ordered by a hash of their text; an empty table writes no shard and
gives no rows; other columns are not stored. A null id is stored as the smallest
64-bit number and read back as null.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, table

MAGIC = b"TSRPACK1"
BLOCK = 4096
SHARD_IDS = 1 << 24
END_ID = 0
NULL_ID = -(1 << 63)
#: Words that one worker remembers (about 200 bytes each).
MEMO = 1_000_000

_state: dict = {}


# ---- tokenizing -----------------------------------------------------------------

class WordMemo(dict):
    """word -> ids as bytes. ``lead`` is what stands before the word in the text (a space or nothing).

    A missing word is encoded by the library; a final mark after letters is a piece
    of its own. Words that begin or end with white space (or are empty) raise: there
    the piece could reach past the word.
    """

    def __init__(self, tok, lead: str):
        super().__init__()
        self.tok, self.lead = tok, lead
        self.marks = {m: self._ids(m) for m in ".,;:!?"}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, w: str) -> bytes:
        if not w or w[0].isspace() or w[-1].isspace():
            raise LookupError(w)
        if w[-1] in self.marks and w[:-1].isalpha():
            ids = self[w[:-1]] + self.marks[w[-1]]
        else:
            ids = self._ids(self.lead + w)
        self[w] = ids
        return ids


class WordEncoder:
    """Whole texts to ids by the tokenizers library, remembering what each word became.

    Byte-level BPE never joins across the start of a space-led word or a single line
    break between two characters that are no white space, so there a text's ids are
    those of its pieces, one after the other. A text with any other spacing is
    encoded in one call. The memory is emptied when full.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.memo = memo
        self.inner, self.first = WordMemo(self.tok, " "), WordMemo(self.tok, "")
        self.line_break = self.first._ids("\n")

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if len(self.inner) + len(self.first) > self.memo:
            self.inner.clear()
            self.first.clear()
        inner, first, out = self.inner.__getitem__, self.first.__getitem__, []
        lines = text.split("\n")
        try:
            for line in lines[:-1] if len(lines) > 1 and not lines[-1] else lines:
                words = line.split(" ")
                out.append(first(words[0]) + b"".join(map(inner, words[1:])))
        except LookupError:
            return self.first._ids(text)
        if len(out) < len(lines):
            out.append(b"")
        return self.line_break.join(out)


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if _state.get("path") != path:
        _state.update(path=path, encoder=WordEncoder(path))
    return _state["encoder"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


# ---- the file format ------------------------------------------------------------

def pack_block(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` side by side, ``bits`` bits each, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype("u1").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    if bits == 8:
        return np.frombuffer(data, "u1", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


class ShardWriter:
    """Writes documents one after the other; holds one block of ids and the small tables."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.held = [], 0
        self.blocks, self.docs, self.starts = [32], [], [0]
        out.write(MAGIC + struct.pack("<IIQQ", bits, block, 0, 0))

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block * self.block
            self._put(flat[:whole])
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), self.block):
            data = pack_block(ids[i:i + self.block], self.bits)
            self.out.write(data)
            self.blocks.append(self.blocks[-1] + len(data))

    def close(self) -> int:
        if self.held:
            self._put(np.concatenate(self.rest))
        at = self.blocks[-1]
        tables = [np.array(self.blocks, "<u8"), np.array(self.docs, "<i8"), np.array(self.starts, "<u8")]
        places = []
        for t in tables:
            places.append(at)
            at += t.nbytes
            self.out.write(t.tobytes())
        self.out.write(struct.pack("<QQQ", *places))
        return self.starts[-1]


class ShardReader:
    """Random access to a shard held in a seekable file (``read_at(offset, size)``)."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        head = read_at(0, 32)
        if head[:8] != MAGIC:
            raise ValueError("not a packed token shard")
        self.bits, self.block = struct.unpack("<II", head[8:16])
        b, d, s = struct.unpack("<QQQ", read_at(size - 24, 24))
        self.offsets = np.frombuffer(read_at(b, d - b), "<u8").astype(np.int64)
        self.docs = np.frombuffer(read_at(d, s - d), "<i8")
        self.starts = np.frombuffer(read_at(s, size - 24 - s), "<u8").astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids first..last-1 of the shard; reads only the blocks that hold them."""
        if last <= first:
            return np.empty(0, np.uint32)
        b0, b1 = first // self.block, (last - 1) // self.block
        data = self.read_at(int(self.offsets[b0]), int(self.offsets[b1 + 1] - self.offsets[b0]))
        total, parts, at = int(self.starts[-1]), [], 0
        for b in range(b0, b1 + 1):
            size = int(self.offsets[b + 1] - self.offsets[b])
            parts.append(unpack_block(data[at:at + size], self.bits, min(self.block, total - b * self.block)))
            at += size
        return np.concatenate(parts)[first - b0 * self.block:last - b0 * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def file_system(uri: str):
    """(file system, path) of a URI or plain path that driver and executors share."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


# ---- the operator ---------------------------------------------------------------

SHARDS = "part long, shard long, path string, n_ids long, n_docs long"


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 end_id: int = END_ID, block: int = BLOCK, shard_ids: int = SHARD_IDS,
                 partitions: int | None = None) -> DataFrame:
    """Encode, pack and write all documents in key order; returns one row per shard with its first global id."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
                  .withColumn("h", F.xxhash64("t"))      # many rows of one id still fall into several ranges
                  .repartitionByRange(n, F.col("k").asc_nulls_first(), "h")
                  .sortWithinPartitions(F.col("k").asc_nulls_first(), "h", "t").drop("h")
                  .withColumn("p", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, out, shard, part, done = encoder(path), None, None, 0, 0, []
        end = struct.pack("<I", end_id)

        def finish():
            nonlocal out
            n_ids = writer.close()
            out.close()
            final = f"{base}/shard-{part:06d}-{shard:04d}.bin"
            fs.move(tmp, final)
            done.append((part, shard, f"{folder}/shard-{part:06d}-{shard:04d}.bin", n_ids, len(writer.docs)))
            out = None

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            part = b.column(2)[0].as_py() if b.num_rows else part
            for k, text_ in zip(keys, texts, strict=True):
                if out is None:
                    fs, base = file_system(folder)
                    fs.create_dir(base, recursive=True)
                    tmp = f"{base}/.tmp-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp, compression=None)
                    writer = ShardWriter(out, bits_for(enc.vocab), block)
                writer.add(NULL_ID if k is None else k, np.frombuffer(enc.encode(text_) + end, "<u4"))
                if writer.starts[-1] >= shard_ids:
                    finish()
                    shard += 1
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done, strict=True)], names=["part", "shard", "path", "n_ids", "n_docs"])

    shards = ranged.mapInArrow(run, SHARDS)
    shards.write.mode("overwrite").parquet(f"{folder}/manifest")
    in_order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard of up to shard_ids ids: a small table at any size
    return (spark.read.schema(SHARDS).parquet(f"{folder}/manifest")
            .withColumn("first_id", F.coalesce(F.sum("n_ids").over(in_order), F.lit(0)).cast("long")))


def read_shards(shards: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 for each document."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    r = ShardReader(lambda at, size, f=f: f.read_at(size, at), f.size())
                    rows = []
                    for i in range(len(r.docs)):
                        ids = r.document(i)
                        rows.append((None if r.docs[i] == NULL_ID else int(r.docs[i]), first + int(r.starts[i]), len(ids),
                                     zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "first_id").repartition(
        int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, folder: str | None = None, **params) -> DataFrame:
    """Write ``docs`` to packed shards below the shared folder and return what the files hold."""
    return read_shards(write_shards(docs, folder or shared_dir(docs.sparkSession, "packed"), **params))


def op4_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
