"""Substring deduplication with a count-min prefilter.

A window is ``size`` consecutive words of one document. Documents are dealt into blocks by a
hash of their id, about ``block_bytes`` of text each.

1. Each block adds its distinct windows to a count-min sketch (``depth`` rows). Its partial
   sketch is sparse: for each shard of a row, the touched cells and whether the block alone
   counts two documents there. Shards merge the partial sketches of all blocks exactly and
   tell each block which of its cells reach two documents. Estimates never fall short, so no
   repeated window is lost.
2. Each block looks up its windows: only those estimated repeated in every row go on, once for
   each block, with a 128-bit hash and the block's smallest document id. An exact group
   by hash tells each block for which of them some other block has a smaller id.
3. Each block marks the words under windows that start in a smaller document, and cuts them.

All exchanges are by block or shard and hold at most one entry for each window and block, so
a passage that a third of all documents share meets one entry from each block in its shard and no
more. Shards and blocks are sized from the input; nothing goes through the driver.

Cases: null texts have no words; texts of fewer than ``size`` words lose none; a window that
repeats only within one document removes nothing; rows that share a doc_id count as one document,
so neither removes from the other; rows with a null doc_id come back unchanged and remove
nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blobs import expand, pack_bits, pack_sorted, squeeze, unpack_bits, unpack_sorted
from weftline.llm.textkit import U, Words, mix, text_bytes, window_hash, window_starts
from weftline.scratch import plan_bytes

BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


class Block:
    """Windows of the documents of one block, and its distinct ones in hash order."""

    def __init__(self, table: pa.Table, size: int):
        text = table.column("text").combine_chunks()
        self.text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        self.data, self.offsets = text_bytes(self.text)
        self.words = Words(self.data, self.offsets)
        known = np.asarray(table.column("doc_id").is_valid())
        self.ids = np.asarray(table.column("doc_id").fill_null(np.iinfo(np.int64).max))
        self.known = known
        self.starts = window_starts(self.words.first, size)
        owner = self.words.owner()[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        keep = known[owner]
        self.starts, owner = self.starts[keep], owner[keep]
        self.doc = self.ids[owner]
        if not len(self.starts):
            self.hash = self.extra = np.zeros(0, U)
            self.order, self.group, self.least, self.repeated = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            return
        h = self.words.hashes()
        first, second = (window_hash(h, size, base)[self.starts] for base in BASES)
        self.order = np.argsort(first, kind="stable")
        sorted_hash, doc, extra = first[self.order], self.doc[self.order], second[self.order]
        new = np.flatnonzero(np.concatenate([[True], (sorted_hash[1:] != sorted_hash[:-1]) | (extra[1:] != extra[:-1])]))
        self.hash = sorted_hash[new]
        self.group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(sorted_hash))))
        self.least = np.minimum.reduceat(doc, new)
        self.repeated = np.maximum.reduceat(doc, new) > self.least
        self.extra = extra[new]


def row_cells(hashes: np.ndarray, row: int, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and cell of each window in a row of the sketch."""
    h = mix(hashes + U(0x632BE59BD9B4E019) * U(row + 1))
    return ((h >> U(32)) % U(shards)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)


def touched(block: Block, row: int, shards: int, bits: int):
    """Distinct (shard, cell) keys of a block in order, and the key's position for each window."""
    shard, cell = row_cells(block.hash, row, shards, bits)
    return np.unique(shard << bits | cell, return_inverse=True)


def substring_dedup(docs: DataFrame, size: int = 50, depth: int = 2, bits: int = 24, block_bytes: int = 8 << 20, shard_windows: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` has the words that stay, joined by one space."""
    return _run(docs, size, depth, bits, block_bytes, shard_windows, digest=False)


def substring_digest(docs: DataFrame, size: int = 50, depth: int = 2, bits: int = 24, block_bytes: int = 8 << 20, shard_windows: int = 2 << 20) -> DataFrame:
    """As ``substring_dedup``, with the SHA-256 of the kept text in its place."""
    return _run(docs, size, depth, bits, block_bytes, shard_windows, digest=True)


def _run(docs: DataFrame, size: int, depth: int, bits: int, block_bytes: int, shard_windows: int, digest: bool) -> DataFrame:
    about = 2 * plan_bytes(docs)  # Parquet about halves a text
    n_blocks, shards = max(8, about // block_bytes), max(4, about // 6 // shard_windows)
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))

    def sketch(table: pa.Table) -> pa.Table:
        block, number = Block(table, size), table.column("block")[0].as_py()
        rows = []
        for row in range(depth):
            keys, at = touched(block, row, shards, bits)
            count = np.minimum(np.bincount(at, weights=np.where(block.repeated, 2, 1), minlength=len(keys)), 2)
            cut = np.searchsorted(keys >> bits, np.arange(shards + 1))
            for s in range(shards):
                part = slice(cut[s], cut[s + 1])
                if cut[s + 1] > cut[s]:
                    rows.append((row * shards + s, number, pack_sorted(keys[part] & ((1 << bits) - 1)), pack_bits(count[part] == 2)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["shard", "block", "cells", "twice"])

    partial = blocks.groupBy("block").applyInArrow(sketch, "shard int, block int, cells binary, twice binary")

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits, np.uint8)
        cells, twice = table.column("cells").to_pylist(), table.column("twice").to_pylist()
        for c, t in zip(cells, twice, strict=True):
            at = unpack_sorted(c)
            total[at] = np.minimum(total[at] + 1 + unpack_bits(t), 2)
        return pa.table([table.column("block"), pa.array([0] * len(cells), pa.int32()), table.column("shard"), pa.array([pack_bits(total[unpack_sorted(c)] >= 2) for c in cells], pa.binary())], ["block", "kind", "shard", "flags"])

    marks = "block int, kind int, shard int, flags binary"
    estimated = partial.groupBy("shard").applyInArrow(merge, marks)

    def maybe_repeated(block: Block, flags: pd.DataFrame) -> np.ndarray:
        """Of the block's distinct windows, those whose estimate reaches two in every row."""
        out = np.ones(len(block.hash), bool)
        mine = flags[flags.kind == 0].sort_values("shard")
        for row in range(depth):
            part = mine[(mine.shard >= row * shards) & (mine.shard < (row + 1) * shards)]
            _, at = touched(block, row, shards, bits)
            ok = np.concatenate([np.zeros(0, bool), *map(unpack_bits, part["flags"])])
            out &= ok[at] if len(at) else out
        return out

    def windows(table: pa.Table, flags: pa.Table) -> pa.Table:
        block = Block(table, size) if table.num_rows else None
        rows = []
        if block is not None and len(block.hash):
            at = np.flatnonzero(maybe_repeated(block, flags.to_pandas()))
            h, extra, least = block.hash[at], block.extra[at], block.least[at]
            shard = ((h >> U(20)) % U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            number = table.column("block")[0].as_py()
            for s in range(shards):
                part = order[cut[s] : cut[s + 1]]
                if len(part):
                    rows.append((s, number, h[part].tobytes(), extra[part].tobytes(), squeeze(least[part].view(np.uint8).reshape(-1, 8).T.tobytes())))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["shard", "block", "h", "extra", "least"])

    listed = blocks.groupBy("block").cogroup(estimated.groupBy("block")).applyInArrow(windows, "shard int, block int, h binary, extra binary, least binary")

    def exact(table: pa.Table) -> pa.Table:
        h, extra = (np.frombuffer(b"".join(table.column(c).to_pylist()), U) for c in ("h", "extra"))
        least = np.concatenate([np.frombuffer(expand(b), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for b in table.column("least").to_pylist()])
        sizes = [len(b) // 8 for b in table.column("h").to_pylist()]
        order = np.lexsort((extra, h))
        new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (extra[order][1:] != extra[order][:-1])]))
        best = np.empty(len(h), np.int64)
        best[order] = np.repeat(np.minimum.reduceat(least[order], new), np.diff(np.append(new, len(h))))
        lower, cut = best < least, np.cumsum([0, *sizes])
        return pa.table([table.column("block"), pa.array([1] * len(sizes), pa.int32()), table.column("shard"), pa.array([pack_bits(lower[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["block", "kind", "shard", "flags"])

    decided = listed.groupBy("shard").applyInArrow(exact, marks)

    def cut_words(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
        block, told = Block(table, size), flags.to_pandas()
        gone = np.zeros(len(block.words.starts) + 1, np.int32)
        if len(block.hash):
            at = np.flatnonzero(maybe_repeated(block, told))
            shard = ((block.hash[at] >> U(20)) % U(shards)).astype(np.int64)
            lower = np.zeros(len(block.hash), bool)
            lower[at[np.argsort(shard, kind="stable")]] = np.concatenate([np.zeros(0, bool), *map(unpack_bits, told[told.kind == 1].sort_values("shard")["flags"])])
            doc = block.doc[block.order]
            hit = block.starts[block.order[lower[block.group] | (block.least[block.group] < doc)]]
            np.add.at(gone, hit, 1)
            np.subtract.at(gone, hit + size, 1)
        covered = np.cumsum(gone[:-1]) > 0
        first, raw = block.words.first, block.data.tobytes()
        removed = np.concatenate([[0], np.cumsum(covered)])[first]
        n_removed = np.diff(removed)
        kept = []
        for i in range(table.num_rows):
            parts = raw[block.offsets[i] : block.offsets[i + 1]].split()
            if n_removed[i]:
                parts = [parts[k] for k in np.flatnonzero(~covered[first[i] : first[i + 1]])]
            joined = b" ".join(parts)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return pa.table([table.column("doc_id"), pa.array(block.words.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    told = estimated.unionByName(decided)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut_words, "doc_id long, n_words long, n_removed long, kept string")
