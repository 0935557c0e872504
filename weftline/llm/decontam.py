"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact check.

Each benchmark item of n words is compared with the windows of n words of every document. A
window's weighted set holds its five-word shingles with their counts; a 128-bit SimHash is taken
of it. The bits are cut into ``BLOCKS`` blocks: two fingerprints within the radius differ in at most
radius // BLOCKS bits of one block at least, so probing the table of each block with all
values that near finds every item within the radius, and about 8 % of unrelated ones. Candidates
are then confirmed by the exact weighted Jaccard similarity.

Fingerprints are only taken of windows that can reach the threshold at all: such a window holds
at least ``threshold`` of an item's number of shingles from the shingles of items of that length,
which is counted for all windows by prefix sums and loses none.

Documents are read whole, in one pass and without a shuffle. The benchmark is sent in slices
of at most ``slice_bytes`` of text, so a larger benchmark means more passes and not a larger
broadcast. A worker builds the index of a slice once and keeps it for its next tasks.

Cases: texts are compared by lower-cased ASCII letters and digits, other letters unchanged; items
of fewer than five words are one shingle; a document shorter than an item is one window; null
or wordless items and documents match nothing; repeated items and repeated rows each match; of
equally similar windows the first counts; null ids are kept in the result; an empty table on either side
gives no matches; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import modest_batches
from weftline.llm.textkit import LOWER, NON_WORD, U, Words, chunked, mix, window_hash

RESULT = "doc_id long, item_id long, start_word long, n_words int, similarity double, hamming int"
BITS, BLOCKS = 128, 8
WIDTH = BITS // BLOCKS
#: Slices' indexes of this worker: the latest one.
_indexes: dict[str, "Index"] = {}


def near_values(distance: int) -> np.ndarray:
    """What to flip in a block's value to reach all values within a distance."""
    values = np.arange(1 << WIDTH, dtype=np.uint16)
    return values[np.bitwise_count(values) <= distance]


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a window's shingles, each occurrence counting once."""
    values, weights = np.unique(shingles, return_counts=True)
    words = np.stack([mix(values ^ U(0x8CB92BA72F3D8DD7)), mix(values + U(0xAAF66A5BF6A4B1E3))], 1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(values), BITS // 8), axis=1)
    return int.from_bytes(np.packbits(weights @ (bits.astype(np.int64) * 2 - 1) > 0).tobytes(), "big")


def block_values(code: int) -> np.ndarray:
    """The blocks of a fingerprint."""
    return np.frombuffer(code.to_bytes(BITS // 8, "big"), ">u2").astype(np.uint16)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each as sorted values and their counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(1, int(a[1].sum() + b[1].sum()) - common)


class Blocks:
    """Multi-index of some fingerprints: for each block, the items by the block's value."""

    def __init__(self, codes: list[int], flips: np.ndarray):
        self.flips, self.codes, self.near = flips, codes, np.zeros(1 << WIDTH, bool)
        self.near[flips] = True
        values = np.array([block_values(c) for c in codes])
        self.order = [np.argsort(values[:, k], kind="stable") for k in range(BLOCKS)]
        self.values = [values[order, k] for k, order in enumerate(self.order)]

    def candidates(self, code: int) -> np.ndarray:
        """Items of which some block is as near as the probes reach."""
        found = np.zeros(len(self.codes), bool)
        for value, mine, order in zip(block_values(code), self.values, self.order, strict=True):
            if len(mine) <= len(self.flips):  # fewer entries than probes: each entry asks whether a probe meets it
                found[order[self.near[mine ^ value]]] = True
            else:
                probes = self.flips ^ value
                low, high = np.searchsorted(mine, probes, "left"), np.searchsorted(mine, probes, "right")
                for a, b in zip(low[low < high], high[low < high], strict=True):
                    found[order[a:b]] = True
        return np.flatnonzero(found)


class Index:
    """Items of one benchmark slice by number of words, with their block tables."""

    def __init__(self, items: list[tuple], size: int, radius: int):
        self.size, self.radius = size, radius
        self.by_length: dict[int, list[int]] = defaultdict(list)
        self.ids, self.sets, prints = [], [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h = Words(LOWER[raw], np.array([0, len(raw)]), NON_WORD).hashes()
            if not len(h):
                continue
            shingles = window_hash(h, min(size, len(h)), 0x9FB21C651E98DF25)
            self.by_length[len(h)].append(len(self.ids))
            self.ids.append(item_id)
            self.sets.append(np.unique(shingles, return_counts=True))
            prints.append(fingerprint(shingles))
        flips = near_values(radius // BLOCKS)
        self.blocks = {n: Blocks([prints[k] for k in at], flips) for n, at in self.by_length.items()}
        # of each shingle size: the benchmark's shingles, and which item lengths hold each (their numbers, span by span)
        self.known: dict[int, tuple] = {}
        for s in sorted({min(n, size) for n in self.by_length}):
            lengths = np.array(sorted(n for n in self.by_length if min(n, size) == s))
            each = [np.unique(np.concatenate([self.sets[at][0] for at in self.by_length[int(n)]])) for n in lengths]
            flat = np.concatenate(each)
            order = np.argsort(flat, kind="stable")
            known, start = np.unique(flat[order], return_index=True)
            table = np.zeros(1 << 20, bool)
            table[(known >> U(44)).astype(np.int64)] = True
            self.known[s] = known, np.append(start, len(flat)), np.repeat(np.arange(len(lengths)), [len(e) for e in each])[order].astype(np.int32), lengths, table

    def near(self, n: int, code: int) -> list[tuple[int, int]]:
        """(item, distance) of the items of n words within the radius."""
        blocks = self.blocks[n]
        found = ((int(k), (blocks.codes[k] ^ code).bit_count()) for k in blocks.candidates(code))
        return [(self.by_length[n][k], d) for k, d in found if d <= self.radius]


def index_of(name: str, items: list[tuple], size: int, radius: int) -> Index:
    """The index of a slice, built once in a worker."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(items, size, radius)
    return _indexes[name]


def _known(values: np.ndarray, known: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is among the known ones; a bit table answers for nearly all."""
    out = table[(values >> U(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = known[np.minimum(np.searchsorted(known, values[at]), len(known) - 1)] == values[at]
    return out


def matches(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple]:
    """(text, item, first word, words, similarity, distance) of the best window of each text and item."""
    words = Words(LOWER[data], offsets, NON_WORD)
    h, first = words.hashes(), words.first
    best: dict[tuple[int, int], tuple] = {}
    for size, (known, spans, holders, lengths, table) in index.known.items():
        hashes = window_hash(h, size, 0x9FB21C651E98DF25)
        hit = _known(hashes, known, table)
        total = np.concatenate([[0], np.cumsum(hit)])
        needs = np.maximum(1, np.ceil(threshold * (lengths - size + 1) - 1e-9).astype(np.int64))
        stop = np.maximum(first[1:] - size + 1, first[:-1])
        stop, start = np.minimum(stop, len(hashes)), np.minimum(first[:-1], len(hashes))
        for doc in np.flatnonzero(total[stop] - total[start] >= needs.min()):
            a, b = int(start[doc]), int(stop[doc])
            at = np.flatnonzero(hit[a:b])
            shingle = np.searchsorted(known, hashes[a:b][at])
            many = spans[shingle + 1] - spans[shingle]  # the lengths that hold each of the document's known shingles
            which = holders[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(spans[shingle], many)]
            places = np.repeat(at, many)
            order = np.argsort(which, kind="stable")
            which, places = which[order], places[order]
            counts = np.bincount(which, minlength=len(lengths))
            ends = np.cumsum(counts)
            for k in np.flatnonzero(counts >= needs):
                n = int(lengths[k])
                wide = min(n - size + 1, b - a)
                mine = places[ends[k] - counts[k] : ends[k]]
                # windows with enough of them start from ``wide`` before the last of so many to the first of them
                starts = np.arange(b - a - wide + 1)
                held = np.searchsorted(mine, starts + wide, "left") - np.searchsorted(mine, starts, "left")
                for s in np.flatnonzero(held >= needs[k]):
                    window = hashes[a + s : a + s + wide]
                    if near := index.near(n, fingerprint(window)):
                        weighted = np.unique(window, return_counts=True)
                    for item, distance in near:
                        similarity = weighted_jaccard(weighted, index.sets[item])
                        key = (int(doc), item)
                        if similarity >= threshold and (key not in best or similarity > best[key][2]):
                            best[key] = (int(s), wide + size - 1, similarity, distance)
    return [(doc, item, *row) for (doc, item), row in best.items()]


def _slices(benchmark: DataFrame, slice_bytes: int):
    """The benchmark's items, at most about ``slice_bytes`` of text at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // slice_bytes)
    for k in range(count):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 31, slice_bytes: int = 16 << 20) -> DataFrame:
    """The best window of every document for every benchmark item that it holds."""
    spark, out = docs.sparkSession, None
    modest_batches(spark)
    for items in _slices(benchmark, slice_bytes):
        sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            index = index_of(name, sent.value, size, radius)
            for batch, data, offsets in chunked(batches):
                rows = [(batch.column("doc_id")[doc].as_py(), index.ids[item], *rest) for doc, item, *rest in matches(index, data, offsets, threshold)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 31, slice_bytes: int = 16 << 20) -> DataFrame:
    """The documents that hold no benchmark item, columns unchanged, without a shuffle."""
    modest_batches(docs.sparkSession)
    for items in _slices(benchmark, slice_bytes):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            index = index_of(name, sent.value, size, radius)
            for batch, data, offsets in chunked(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(index, data, offsets, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
