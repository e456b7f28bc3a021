"""Operator 7: benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a text with up to k = floor(rate * m)
edits. Cut into k + 1 pieces, at least one piece then occurs unchanged: all pieces
of all items are looked for in one pass over the text (Aho-Corasick), every hit
fixes where the whole item would lie, and that stretch, k characters wider on both
sides, is checked with Myers' bit-parallel distance. Texts and items are compared
in lower case with every run of white space as one space.

The items are the stated query set. They go to the tasks in blocks of bounded
size (``BLOCK_CHARS``) and every block is compared with all documents, in one
narrow pass: documents are never shuffled and only matches leave the tasks.

Defined results: null and empty texts match nothing; null items and items under
``min_chars`` characters (they would match by chance) are left out; repeated items
and repeated documents give a row each; without items or documents there are no
rows; ``remove_contaminated`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bitvector import best_occurrence, match_masks
from tessera.llm.common import table

RATE = 0.08
MIN_CHARS = 25
#: Characters of items in one block: with its automaton at most some 200 MB in a task.
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in k + 1 parts of nearly equal length."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    """One block of items, ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items, where = [], {}
        for item_id, text in items:
            k = int(rate * len(text))
            at = len(self.items)
            self.items.append((item_id, len(text), k, match_masks(text)))
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of the best occurrence of each item found."""
        t = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(t):
            for at, offset in places:
                starts.setdefault(at, set()).add(end + 1 - size - offset)
        out = []
        for at, found in starts.items():
            item_id, m, k, masks = self.items[at]
            best = None
            for lo, hi in stretches(sorted(found), m, k):
                lo = max(0, lo)
                d, end = best_occurrence(masks, m, t[lo:hi])
                if d <= k and (best is None or d < best[0]):
                    best = (d, lo + end)
            if best:
                out.append((item_id, *best))
        return sorted(out)


def stretches(starts: list[int], m: int, k: int) -> list[tuple[int, int]]:
    """The parts of the text to check, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s in starts:
        lo, hi = s - k, s + m + k
        if out and lo <= out[-1][1] - m:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def item_blocks(items: DataFrame, key: str, text: str, min_chars: int,
                block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of bounded size; one block at a time is held by the driver."""
    block, size = [], 0
    for item_id, t in items.select(key, text).toLocalIterator():
        t = normal(t or "")
        if len(t) < min_chars:
            continue
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, t))
        size += len(t)
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: key, item_id, distance, end_char."""
    spark = docs.sparkSession
    narrow = docs.select(docs[key].cast("long"), docs[text])
    schema = f"`{key}` long, item_id long, distance long, end_char long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items.select(items[item_key].cast("long").alias(item_key), item_text), item_key, item_text,
                             min_chars, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = Matcher(shared.value, rate).find
            for b in batches:
                rows = [(k, *hit) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t
                        for hit in find(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)],
                    names=[key, "item_id", "distance", "end_char"])

        out = out.unionAll(narrow.mapInArrow(run, schema))
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                        item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS,
                        block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item; all columns, no shuffle (one pass for each block of items)."""
    spark, out, at = docs.sparkSession, docs, docs.columns.index(text)
    for block in item_blocks(items.select(items[item_key].cast("long").alias(item_key), item_text), item_key, item_text,
                             min_chars, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = Matcher(shared.value, rate).find
            for b in batches:
                yield b.filter(pa.array([not (t and find(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
