"""Line deduplication by pairwise alignment.

Documents that overlap are found by hashes of their lines and of shortest runs of successive lines
(often one line) with ``block_chars`` bytes. Documents that share a line or run held by at most
``rare`` different texts are all paired with each other, and each pair is aligned by patience diff
on line hashes: lines that are unique in both and in the same order (longest increasing
subsequence) anchor the alignment, which then grows over equal neighbours and recurses between
anchors. Runs of aligned lines with at least ``block_chars`` bytes, or that make up the whole
later document, are deleted from the later document (the larger doc_id).

The exact way for what more than ``rare`` texts hold, where pairs would grow with the square: a
shortest run is a block of ``block_chars`` bytes by itself, so the later document's run is aligned
with that of its first holder, and deleted, by the hash of the run alone. Texts that are equal line by line
are one text here: the first document has it, later ones lose all lines. With these three no
aligned block of any two documents is missed. Decisions are made on the input, not on what
other deletions leave.

Cases: a null text stays null and an empty one empty, neither has lines to delete; texts of one
line are deleted only as whole copies or by a long line; blank lines neither make pairs nor count
as bytes, but belong to the line sequence of whole copies; texts of any length are read whole; rows
that share a doc_id are never paired with each other, each loses only what its own text shares with
smaller doc_ids, and equal ones are cut equally; null doc_ids are left alone; other columns pass
through, but for those named like the two counts, which are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import free_name, modest_batches
from weftline.llm.textkit import BASE, U, chunked, give_back, mix, span_hash, sums
from weftline.scratch import Scratch


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes (without blanks) of each line, and the texts' spans in them."""
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    solid = sums((data > 32).astype(np.float64), np.append(starts, len(data)))
    h = mix(span_hash(data, starts, ends, 0x5851F42D4C957F2D) + (ends - starts).astype(U) * BASE)
    return h, solid.astype(np.int64), np.concatenate([[0], np.cumsum(per_text)])


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        d = bisect_left(tails, v)
        if d == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[d], at[d] = v, k
        back.append(at[d - 1] if d else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {v: k for k, v in enumerate(a[a0:a1], a0) if in_a[v] == 1 and in_b.get(v) == 1}
        both = [(place[v], k) for k, v in enumerate(b[b0:b1], b0) if v in place]
        anchors = [both[k] for k in increasing([x for x, _ in both])]
        last = (a0, b0)
        for x, y in anchors:
            todo.append((last[0], x, last[1], y))
            out.append((x, y))
            last = (x + 1, y + 1)
        if anchors:
            todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def deletable(earlier: list[int], later: list[int], size: list[int], block_chars: int) -> list[int]:
    """Lines of the later document under aligned blocks that are long enough."""
    pairs = patience(earlier, later)
    if len(pairs) == len(later):
        return list(range(len(later)))
    out: list[int] = []
    k = 0
    while k < len(pairs):
        e = k + 1
        while e < len(pairs) and pairs[e][0] == pairs[e - 1][0] + 1 and pairs[e][1] == pairs[e - 1][1] + 1:
            e += 1
        block = [y for _, y in pairs[k:e]]
        if sum(size[y] for y in block) >= block_chars:
            out += block
        k = e
    return out


def shortest_runs(h: np.ndarray, size: np.ndarray, block_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the shortest runs of lines with at least block_chars bytes, from each
    line on and back from each line. They cover every line of any longer run, and depend on it alone."""
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    need, n = max(block_chars, 1), len(size)
    ends = np.searchsorted(total, total[:-1] + need, "left")
    starts = np.searchsorted(total, total[1:] - need, "right") - 1
    on, back = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    starts, ends = np.concatenate([on, starts[back]]), np.concatenate([ends[on], back + 1])
    return starts, ends, mix(span_hash(h, starts, ends, 0xA24BAED4963EE407) + (ends - starts).astype(U) * BASE)


def aligned_lines(batches, block_chars: int):
    """(id, part, line) of the lines that a pair's alignment deletes."""
    for batch in batches:
        ids, parts, out = [], [], []
        for k in range(batch.num_rows):
            early, h, size = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("earlier", U), ("h", U), ("size", "<u4")))
            gone = deletable(early.tolist(), h.tolist(), size.tolist(), block_chars)
            if gone:
                out.append(np.array(gone, np.int32))
                ids.append(np.full(len(gone), batch.column("id")[k].as_py()))
                parts.append(np.full(len(gone), batch.column("part")[k].as_py()))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (ids, parts, out)], ["id", "part", "line"])
    give_back()


def run_lines(batches, block_chars: int):
    """(id, part, line) of the lines under the runs that were asked for."""
    for batch in batches:
        ids, parts, out = [], [], []
        for k in range(batch.num_rows):
            h, size = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("h", U), ("size", "<u4")))
            starts, ends, keys = shortest_runs(h, size, block_chars)
            hit = np.isin(keys.view(np.int64), np.asarray(batch.column("asked")[k].values))
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, starts[hit], 1)
            np.subtract.at(cover, ends[hit], 1)
            gone = np.flatnonzero(np.cumsum(cover[:-1])).astype(np.int32)
            out.append(gone)
            ids.append(np.full(len(gone), batch.column("id")[k].as_py()))
            parts.append(np.full(len(gone), batch.column("part")[k].as_py()))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (ids, parts, out)], ["id", "part", "line"])
    give_back()


def deleted_lines(docs: DataFrame, rare: int = 64, block_chars: int = 50) -> DataFrame:
    """(id, part, lines): sorted positions of the lines to delete, for rows that have any; ``part`` is the
    hash of the row's text, and null ``lines`` stand for all of them."""
    modest_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "linedup")

    def cut(batches):
        for batch, data, offsets in chunked(batches):
            h, size, first = line_hashes(data, offsets)
            whole = [mix(span_hash(h, first[:-1], first[1:], base) + np.diff(first).astype(U)).view(np.int64) for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]
            spans, small = list(zip(first, first[1:], strict=False)), size.astype("<u4")
            yield pa.record_batch([batch.column("id"), batch.column("part"), *map(pa.array, whole), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([small[a:b].tobytes() for a, b in spans], pa.binary())], ["id", "part", "w1", "w2", "h", "size"])

    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("part"), "text").where("id IS NOT NULL AND text <> ''")
    lined = scratch.table(source.mapInArrow(cut, "id long, part long, w1 long, w2 long, h binary, size binary"))
    # one row for each different text, that of its first document
    texts = scratch.table(lined.groupBy("w1", "w2").agg(F.min(F.struct("id", "part", "h", "size")).alias("t")).select("w1", "w2", "t.*"))
    copies = lined.select("id", "part", "w1", "w2").join(texts.select("w1", "w2", F.col("id").alias("first")), ["w1", "w2"]).where("first < id").select("id", "part").distinct()

    def keys(batches):
        """Distinct keys of each text: kind 0 lines, 1 shortest runs that reach block_chars."""
        for batch in batches:
            ids, parts, kinds, out = [], [], [], []
            for k in range(batch.num_rows):
                h, size = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("h", U), ("size", "<u4")))
                for kind, got in ((0, np.unique(h[size > 0])), (1, np.unique(shortest_runs(h, size, block_chars)[2]))):
                    out.append(got)
                    ids.append(np.full(len(got), batch.column("id")[k].as_py()))
                    parts.append(np.full(len(got), batch.column("part")[k].as_py()))
                    kinds.append(np.full(len(got), kind, np.int8))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (kinds, ids, parts))], ["key", "kind", "id", "part"])
        give_back()

    keyed = texts.mapInArrow(keys, "key long, kind byte, id long, part long")
    marks = [F.bit_xor(F.xxhash64("id", "part", F.lit(salt))).alias(f"mark{salt}") for salt in (1, 2)]
    shared = scratch.table(keyed.groupBy("key", "kind").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"), *marks).where("owner < last"))
    # keys that the same texts hold give the same pairs: one of them will do
    chosen = shared.where(F.col("n") <= rare).groupBy("n", "owner", "last", "mark1", "mark2").agg(F.min(F.struct("key", "kind")).alias("k")).select("k.key", "k.kind", F.lit(None).cast("long").alias("owner"))
    common = shared.where((F.col("n") > rare) & (F.col("kind") == 1)).select("key", "kind", "owner")
    held = scratch.table(keyed.join(chosen.unionByName(common).hint("shuffle_hash"), ["key", "kind"]))
    one, two = (held.where("owner IS NULL").select("key", "kind", F.col("id").alias(f"{x}id"), F.col("part").alias(f"{x}part")) for x in ("e", ""))
    pairs = scratch.table(one.join(two, ["key", "kind"]).where("eid < id").select("eid", "epart", "id", "part").distinct())
    early = texts.select(F.col("id").alias("eid"), F.col("part").alias("epart"), F.col("h").alias("earlier"))
    ready = pairs.join(early, ["eid", "epart"]).select("id", "part", "earlier").join(texts.select("id", "part", "h", "size"), ["id", "part"])
    result = "id long, part long, line int"
    by_pairs = ready.select("id", "part", "earlier", "h", "size").mapInArrow(lambda batches: aligned_lines(batches, block_chars), result)
    # a text has at most two shortest runs for each of its lines, and so has the list
    asked = held.where("owner < id").groupBy("id", "part").agg(F.collect_set("key").alias("asked"))
    by_runs = asked.join(texts, ["id", "part"]).select("id", "part", "h", "size", "asked").mapInArrow(lambda batches: run_lines(batches, block_chars), result)
    # sets of positions: never more than the document has lines
    lines = by_pairs.unionByName(by_runs).groupBy("id", "part").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    out = scratch.table(lines.unionByName(copies.select("id", "part", F.lit(None).cast("array<int>").alias("lines"))))
    scratch.drop(lined, texts, shared, held, pairs)
    return out


def line_dedup(docs: DataFrame, rare: int = 64, block_chars: int = 50, counts: tuple[str, str] = ("n_lines", "n_removed_lines")) -> DataFrame:
    """The documents with their columns, ``text`` without the deleted lines, plus the two ``counts``."""
    id_name, part_name, gone_name, cut_name = (free_name(docs, x) for x in ("id", "part", "gone", "cut"))
    gone = deleted_lines(docs, rare, block_chars).select(F.col("id").alias(id_name), F.col("part").alias(part_name), F.col("lines").alias(gone_name), F.lit(True).alias(cut_name))
    keyed = docs.withColumns({id_name: F.col("doc_id").cast("long"), part_name: F.xxhash64("text")})
    both = keyed.join(gone.hint("shuffle_hash"), [id_name, part_name], "left")
    lines, removed, cut = F.split("text", "\n", -1), F.col(gone_name), F.col(cut_name).isNotNull()
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    # the outer lambda's variable holds the lines, which are then not split anew for each position
    rest = F.transform(F.array(F.struct(lines.alias("of"), stay.alias("at"))), lambda x: F.array_join(F.transform(x["at"], lambda i: F.get(x["of"], i)), "\n"))[0]
    text = F.when(~cut | F.col("text").isNull(), F.col("text")).when(removed.isNull() | (F.size(removed) >= F.size(lines)), F.lit("")).otherwise(rest)
    n_lines = F.when(F.col("text").isNull() | (F.col("text") == ""), F.lit(0)).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int")
    n_removed = F.when(~cut, 0).when(removed.isNull(), n_lines).otherwise(F.size(removed))
    old = {c.lower() for c in counts}
    return both.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in old], n_lines.alias(counts[0]), n_removed.alias(counts[1]))
