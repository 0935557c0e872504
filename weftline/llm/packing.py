"""Best-fit packing of token pieces into sequences, by exact-complement hashing.

Texts are tokenised once and cut into pieces. What has to be planned is then only how many
pieces of each length there are, at most ``capacity`` numbers. Hash tables by sum hold the pairs of
lengths and the triples (a length and a pair sum). For a gap that is left open they give one to
three lengths that fill it exactly; as many copies of the combination are consumed as the counts
allow. Lengths for which no combination fills the gap go through best fit. The plan is a
short list of patterns with multiplicities; it and the tables (about capacity ** 2 / 4 pairs and
as many triples of a length and a sum) are bounded by the capacity and not by the rows.

Pieces find their places without a join on rows: a piece's rank among those of its
length (from counts per partition) selects the pattern, the sequence and the offset.

Cases: null and empty texts are one piece with the end token alone; texts longer than the
capacity are cut into pieces of exactly the capacity, the first one shorter; added tokens of the
JSON file beside the rank file have their own ids; repeated rows are packed each; equal lengths are
interchangeable; null doc_ids stay null; other columns, whatever their names, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import modest_batches
from weftline.llm.textkit import chunked
from weftline.scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, object] = {}


def encoder(ranks_path: str, pattern: str):
    """Byte-level BPE encoder of a rank file; kept for the life of the worker."""
    if ranks_path not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path]


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Ids of the strings that the JSON file beside the rank file takes out of the text before its merges."""
    path = Path(ranks_path).with_suffix(".json")
    tokens = json.loads(path.read_text(encoding="utf-8"))["added_tokens"] if path.exists() else []
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} does not match plainly")
    return {t["content"]: t["id"] for t in tokens}


def with_added(encode, tokens: dict[str, int]):
    """``encode`` for the text between added tokens, with the ids of these."""
    if not tokens:
        return encode
    cut = re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")")

    def run(text: str) -> list[int]:
        if not cut.search(text):
            return encode(text)
        out: list[int] = []
        for k, part in enumerate(cut.split(text)):
            out += [tokens[part]] if k % 2 else encode(part)
        return out

    return run


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document with the checksum of their ids."""

    tokens = added_tokens(ranks_path)

    def run(batches):
        encode = with_added(encoder(ranks_path, pattern).encode_ordinary, tokens)
        for batch, data, offsets in chunked(batches):
            raw, ids = data.tobytes(), batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for k, doc in enumerate(ids):
                got = encode(raw[offsets[k] : offsets[k + 1]].decode())
                got.append(end_id)
                view, n = np.array(got, "<u4").tobytes(), len(got)
                first = (n - 1) % capacity + 1
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    out.append((doc, piece, start, stop - start, zlib.crc32(view[4 * start : 4 * stop])))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Sums:
    """Combinations of the available lengths by their sum: single lengths, pairs, and triples as a length and a pair.

    Entries are in order of falling longest length, as long lengths are the hardest to place. Counts
    only fall, so entries with a length that has run out are passed for good.
    """

    def __init__(self, counts: np.ndarray):
        self.left, cap = counts, len(counts) - 1
        there = counts > 0
        self.pairs: dict[int, list[int]] = {}  # sum -> longer lengths, longest last
        for total in range(2, cap + 1):
            b = np.arange((total + 1) // 2, total)
            if len(found := b[there[b] & there[total - b]]):
                self.pairs[total] = found.tolist()
        self.triples: dict[int, list[int]] = {}  # sum -> lengths whose rest is a pair sum, longest last
        paired = np.zeros(cap + 1, bool)
        paired[list(self.pairs)] = True
        for total in range(3, cap + 1):
            a = np.arange(1, total - 1)
            if len(found := a[there[a] & paired[total - a]]):
                self.triples[total] = found.tolist()

    def copies(self, parts: tuple[int, ...]) -> int:
        """How often the combination can be had."""
        return min(int(self.left[n]) // parts.count(n) for n in parts)

    def pair(self, gap: int, head: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths that add up to the gap, beside those of ``head``."""
        row = self.pairs.get(gap, [])
        while row and not self.copies((row[-1], gap - row[-1])):
            row.pop()
        for b in reversed(row):
            if self.copies((*head, b, gap - b)):
                return b, gap - b
        return None

    def fill(self, gap: int, head: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that add up to the gap, if any are left beside those of ``head``."""
        if not gap:
            return ()
        if self.copies((*head, gap)):
            return (gap,)
        if two := self.pair(gap, head):
            return two
        row = self.triples.get(gap, [])
        while row and not self.left[row[-1]]:
            row.pop()
        for a in reversed(row):
            if self.copies((*head, a)) and (two := self.pair(gap - a, (*head, a))):
                return a, *two
        return None

    def take(self, parts: tuple[int, ...]) -> int:
        """Consumes as many copies as there are."""
        m = self.copies(parts)
        for n in parts:
            self.left[n] -= m
        return m


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, descending) and how many sequences use each.

    The longest length that is left opens a sequence and the tables of sums fill the gap exactly.
    Sequences that no combination completes are filled by best fit: the longest length that
    still fits, until none does.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = max(c, 0)
    sums = Sums(left)
    out: list[tuple[tuple[int, ...], int]] = []
    for first in range(capacity, 0, -1):
        while left[first] > 0:
            parts = (first,)
            if (fill := sums.fill(capacity - first, parts)) is not None:
                parts += fill
            else:  # best fit
                gap = capacity - first
                while gap:
                    fits = np.flatnonzero(left[: gap + 1])[::-1]
                    n = next((n for n in fits.tolist() if left[n] > parts.count(n)), 0)
                    if not n:
                        break
                    parts += (n,)
                    gap -= n
            out.append((tuple(sorted(parts, reverse=True)), sums.take(parts)))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, sequences, offset), by rank."""
    table: dict[int, list] = {}
    used: Counter = Counter()
    base = 0
    for parts, m in patterns:
        offset = 0
        for n in parts:
            table.setdefault(n, []).append((used[n], base, m, offset))
            used[n] += m
            offset += n
        base += m
    return {n: np.array(rows, np.int64) for n, rows in table.items()}


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces with the sequence and offset that each is placed at."""
    spark = docs.sparkSession
    modest_batches(spark)
    scratch = Scratch(spark, "packing")

    def ranked(batches):
        """Rank of each piece among those of its length in its block."""
        seen: Counter = Counter()
        for batch in batches:
            n = np.asarray(batch.column("length"))
            order = np.argsort(n, kind="stable")
            values, first, count = np.unique(n[order], return_index=True, return_counts=True)
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(first, count) + np.repeat([seen[int(v)] for v in values], count)
            for v, c in zip(values, count, strict=True):
                seen[int(v)] += int(c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "rank"])

    made = scratch.table(pieces(docs, ranks_path, pattern, capacity, end_id).withColumn("block", F.spark_partition_id()).mapInArrow(ranked, PIECES + ", block int, rank long"))
    per_block = made.groupBy("length", "block").agg(F.count("*").alias("n"))
    # at most capacity lengths; the counts of blocks stay on the executors
    totals = {r.length: r.n for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(slots(plan(totals, capacity)))
    from pyspark.sql import Window

    before = per_block.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    placed = made.join(before.select("length", "block", F.coalesce("before", F.lit(0)).alias("before")), ["length", "block"])

    def place(batches):
        table = sent.value
        for batch in batches:
            n, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for v in np.unique(n):
                rows, at = table[int(v)], np.flatnonzero(n == v)
                slot = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                sequence[at] = slot[:, 1] + rank[at] - slot[:, 0]
                offset[at] = slot[:, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ready = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ready.mapInArrow(place, PIECES + ", sequence_id long, offset long")
