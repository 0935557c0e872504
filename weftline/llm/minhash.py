"""Near-duplicate detection by minhash with tensored banding, confirmed on full sets.

A document's set holds its distinct word shingles. Two small collections of keys are made from
its minhashes: ``rows_a`` minhashes for each key of the first, ``rows_b`` for each of the second.
Every pair of a first and a second key is a table key, so the number of tables is the product of
the collections while the minhashes computed only grow with their sum. The collections are
sized so that a pair at the threshold misses all tables with a probability of ``miss`` at most.

1. Documents with equal sets (128-bit sums over the set) become one class, with a number.
2. Classes that share a table key form a bucket, and a bucket's first class is confirmed against all
   others of the bucket on full sets: as many rows as classes, however large the bucket. This is done
   first for a few of the tables, the diagonal of the product, which groups nearly all close
   copies; of the other tables only the buckets with classes of several groups are looked at.
3. Classes that met the same first class are settled if they are all in one group of confirmed links
   by now. The others are joined to clusters and compared block by block: a task holds two
   blocks at most and gives the links of a spanning forest of what it confirmed, never all
   pairs. So every pair of a bucket is confirmed or refused on full sets, or needless
   because its classes are linked already.
4. Components of the confirmed links are joined back to all documents.

Cases: null and empty texts have an empty set and stand alone; with fewer words than a shingle
the whole sequence is the one shingle; rows that share a doc_id are vertices of their own unless
their texts are equal, and are linked only by their sets; rows with a null doc_id stand alone with a
null component and are kept; other columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import free_name, modest_batches
from weftline.llm.textkit import LOWER, U, Words, chunked, give_back, minima, mix, sums, window_hash, window_starts
from weftline.operators.components import component_edges
from weftline.scratch import Scratch

#: Bits of a shingle's hash, and so the texts of a chunk that one sort key can tell apart.
HASH_BITS = 52
#: Members and shingles, about, of a block of a cluster, and members that one task compares with a star's centre.
MEMBERS = 1024
SHINGLES = 500_000
STAR = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and the texts' spans in them."""
    words = Words(LOWER[data], offsets)
    h, counts = words.hashes(), words.counts
    at = window_starts(words.first, size)
    owner = words.owner()
    values, owners = window_hash(h, size, 0x9FB21C651E98DF25)[at] if len(at) else np.zeros(0, U), owner[at] if len(at) else np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        short = np.zeros(len(few), U)
        for k in range(size - 1):
            has = counts[few] > k
            short[has] = mix(short[has] * U(0xD6E8FEB86659FD93) + h[words.first[few[has]] + k] + U(1))
        values, owners = np.concatenate([values, short]), np.concatenate([owners, few])
    key = np.sort(owners.astype(U) << U(HASH_BITS) | values >> U(64 - HASH_BITS))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(len(offsets), dtype=np.int64).astype(U) << U(HASH_BITS))
    return key & U((1 << HASH_BITS) - 1), first


class Tables:
    """How many keys each collection has, and the minhashes that they are made of."""

    def __init__(self, threshold: float, rows_a: int = 2, rows_b: int = 2, miss: float = 3e-4, seed: int = 23):
        need = lambda r: max(1, math.ceil(math.log(miss / 2) / math.log(1 - threshold**r)))
        self.rows_a, self.rows_b = rows_a, rows_b
        self.a, self.b = need(rows_a), need(rows_b)
        draw = np.random.default_rng(seed)
        n = self.a * rows_a + self.b * rows_b
        self.flip, self.times = (draw.integers(0, 1 << 64, n, dtype=U) for _ in range(2))
        self.times |= U(1)

    def sketches(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Minhashes (upper 32 bits) of each set, one row for each."""
        mixed = mix(values)
        out = np.empty((len(first) - 1, len(self.flip)), np.uint32)
        for k, (flip, times) in enumerate(zip(self.flip, self.times, strict=True)):
            out[:, k] = minima((mixed ^ flip) * times, first, U(0)) >> U(32)
        return out

    def keys(self, sketch: np.ndarray) -> np.ndarray:
        """Table keys, one row for each sketch and a * b columns."""
        s = sketch.astype(U)

        def collection(part: np.ndarray, count: int, rows: int, salt: int) -> np.ndarray:
            out = np.zeros((len(part), count), U) + np.arange(count, dtype=np.int64).astype(U) * U(salt)
            for r in range(rows):
                out = mix(out ^ part[:, r::rows]) + U(0x9E3779B97F4A7C15)
            return out

        cut = self.a * self.rows_a
        one, two = collection(s[:, :cut], self.a, self.rows_a, 0xC2B2AE3D27D4EB4F), collection(s[:, cut:], self.b, self.rows_b, 0x165667B19E3779F9)
        return mix(one[:, :, None] * U(0x27D4EB2F165667C5) + two[:, None, :]).reshape(len(s), -1)


def alike(common: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, from the sizes of the intersections and of the sets."""
    common = np.rint(common).astype(np.int64)
    return 100 * common >= percent * (one + two - common)


def confirmed(values: list[np.ndarray], percent: int, wide: int = 2048) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union: a square of booleans."""
    sizes = np.array([len(v) for v in values])
    n = len(values)
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(flat)))
    shared = np.repeat(count > 1, count)
    column, row = np.repeat(np.cumsum(count > 1) - 1, count)[shared], owner[shared]
    width, common = int((count > 1).sum()), np.zeros((n, n), np.float32)
    for a in range(0, width, wide):  # exact: counts stay below 2**24 in a chunk
        part = slice(*np.searchsorted(column, (a, a + wide)))
        dense = np.zeros((n, min(wide, width - a)), np.float32)
        dense[row[part], column[part] - a] = 1
        common += dense @ dense.T
    out = np.empty((n, n), bool)
    for a in range(0, n, 256):
        out[a : a + 256] = alike(common[a : a + 256], sizes[a : a + 256, None], sizes[None, :], percent)
    return out


def spanning(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's connected group; every row of the square is read once."""
    lead = np.full(len(linked), -1)
    for k in range(len(linked)):
        if lead[k] < 0:
            lead[k], edge = k, np.array([k])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(0) & (lead < 0))
                lead[edge] = k
    return lead


def stars(rows: tuple[np.ndarray, ...], data: np.ndarray, first: np.ndarray, centre: tuple | None, percent: int):
    """Members that are alike to the centre of their star. ``rows``: star, part, whether it is the centre, member.

    Gives the positions found and the last centre, as a star may go on in the next batch.
    """
    star, part, is_centre, _ = rows
    cut = np.flatnonzero((np.diff(star, prepend=star[0] - 1) != 0) | (np.diff(part, prepend=part[0] - 1) != 0))
    found = []
    for a, b in zip(cut, np.append(cut[1:], len(star)), strict=True):
        if is_centre[a]:
            centre = (star[a], part[a], data[first[a] : first[a + 1]].copy())
            a += 1
        if a == b or centre is None or centre[:2] != (star[b - 1], part[b - 1]):
            continue
        values, against = data[first[a] : first[b]], centre[2]
        hit = against[np.minimum(np.searchsorted(against, values), len(against) - 1)] == values
        common = sums(hit.astype(np.float64), first[a : b + 1] - first[a])
        found.append(a + np.flatnonzero(alike(common, len(against), np.diff(first[a : b + 1]), percent)))
    return np.concatenate([np.zeros(0, np.int64), *found]), centre


def set_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and spans of a binary column of 64-bit sets, without a copy."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data.view(U), (at - at[0]) // 8


class _Finder:
    """Tables of one call."""

    def __init__(self, docs: DataFrame, size: int, percent: int, members: int):
        modest_batches(docs.sparkSession)
        self.scratch, self.tables = Scratch(docs.sparkSession, "minhash"), Tables(percent / 100)
        self.size, self.percent, self.members = size, percent, members
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")

    def sketched(self) -> DataFrame:
        """Set size, 128-bit sum and minhashes of every row."""
        tables, size = self.tables, self.size

        def sketch(batches):
            for batch, data, offsets in chunked(batches):
                values, first = shingle_sets(data, offsets, size)
                total = [np.add.reduceat(np.append(mix(values ^ U(salt)), U(0)), first[:-1]) for salt in (0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35)]
                n = np.diff(first)
                rows = tables.sketches(values, first)
                yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(n.astype(np.int64)), *(pa.array(np.where(n > 0, t, U(0)).view(np.int64)) for t in total), pa.array([r.tobytes() if k else b"" for r, k in zip(rows, n, strict=True)], pa.binary())], ["doc_id", "part", "n", "s1", "s2", "sketch"])

        return self.scratch.table(self.texts.mapInArrow(sketch, "doc_id long, part long, n long, s1 long, s2 long, sketch binary"))

    def bucketed(self, classes: DataFrame, diagonal: bool = False) -> DataFrame:
        """Distinct (rep, cid) of buckets with classes (cid, grp, sketch) of two groups or more: ``rep`` is a
        bucket's first class, ``cid`` another."""
        tables, wide = self.tables, max(self.tables.a, self.tables.b)
        some = [i % tables.a * tables.b + i % tables.b for i in range(wide)] if diagonal else slice(None)

        def keys(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    rows = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(part.num_rows, -1)
                    found = tables.keys(rows)[:, some]
                    yield pa.record_batch([pa.array(found.ravel().view(np.int64)), *(pa.array(np.repeat(np.asarray(part.column(c)), found.shape[1])) for c in ("cid", "grp"))], ["key", "cid", "grp"])
            give_back()

        keyed = classes.select("cid", "grp", "sketch").mapInArrow(keys, "key long, cid long, grp long")
        buckets = keyed.groupBy("key").agg(F.min("cid").alias("rep"), F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("key", "rep")
        buckets = self.scratch.table(buckets)
        out = self.scratch.table(keyed.join(buckets.hint("shuffle_hash"), "key").where("cid <> rep").select("rep", "cid").distinct())
        self.scratch.drop(buckets)
        return out

    def sets(self, wanted: DataFrame, rows: DataFrame) -> DataFrame:
        """(cid, set) of classes (cid, first_id, first_part)."""
        texts, size = self.texts, self.size
        if not rows.groupBy("doc_id", "part").count().where("count > 1").isEmpty():
            texts = texts.groupBy("doc_id", "part").agg(F.min("text").alias("text"))

        def shingled(batches):
            for batch, data, offsets in chunked(batches):
                values, first = shingle_sets(data, offsets, size)
                blob = pa.py_buffer(values.tobytes())
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((8 * first).astype(np.int64).tobytes()), blob]).cast(pa.binary())
                yield pa.record_batch([batch.column("cid"), sets], ["cid", "set"])

        joined = texts.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("first_id")) & (F.col("part") == F.col("first_part")))
        return self.scratch.table(joined.select("cid", "text").mapInArrow(shingled, "cid long, set binary"))

    def confirm_stars(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(src, dst) of pairs (rep, cid) that are alike: the centre's set goes to each task of its star once."""
        percent = self.percent
        width = pairs.groupBy("rep").agg(F.ceil(F.count("*") / STAR).cast("int").alias("width"))
        member = pairs.join(width, "rep").select("rep", F.pmod(F.xxhash64("cid"), "width").cast("int").alias("task"), F.lit(False).alias("centre"), "cid")
        centre = width.select("rep", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("task"), F.lit(True).alias("centre"), F.col("rep").alias("cid"))
        work = member.unionByName(centre).join(sets, "cid").select("rep", "task", "centre", "cid", "set")

        def compare(batches):
            last = None
            for batch in batches:
                if batch.num_rows:
                    rows = tuple(np.asarray(batch.column(c)) if c != "centre" else batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "task", "centre", "cid"))
                    at, last = stars(rows, *set_column(batch.column("set")), last, percent)
                    yield pa.record_batch([pa.array(rows[0][at]), pa.array(rows[3][at])], ["src", "dst"])
            give_back()

        dealt = work.repartition("rep", "task").sortWithinPartitions("rep", "task", F.desc("centre"))
        return self.scratch.table(dealt.mapInArrow(compare, "src long, dst long"))

    def confirm_blocks(self, edges: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
        """(src, dst) that span the alike pairs of the clusters that ``edges`` (rep, cid) form; ``sizes`` (cid, n)."""
        percent = self.percent
        clusters = component_edges(edges, "rep", "cid")
        clusters = self.scratch.table(clusters.union(clusters.select(F.col("comp").alias("id"), "comp").distinct()))
        member = clusters.join(sizes.withColumnRenamed("cid", "id"), "id")
        need = F.ceil(F.greatest(F.count("*") / self.members, F.sum("n") / SHINGLES)).cast("int")
        own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
        dealt = member.join(member.groupBy("comp").agg(need.alias("blocks")), "comp").select("id", "comp", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("own <> other OR blocks = 1")
        work = dealt.select("comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("id").alias("cid")).join(sets, "cid")

        def compare(batches):
            """Runs of rows of one task: members of one or two blocks."""
            rows: list[tuple] = []
            now = None

            def settle():
                rows.sort(key=lambda r: r[0])
                ids, lead = np.array([r[0] for r in rows], np.int64), spanning(confirmed([r[1] for r in rows], percent))
                other = np.flatnonzero(lead != np.arange(len(lead)))
                return pa.record_batch([pa.array(ids[lead[other]]), pa.array(ids[other])], ["src", "dst"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                (data, first), ids = set_column(batch.column("set")), batch.column("cid").to_pylist()
                for k, task in enumerate(zip(*(batch.column(c).to_pylist() for c in ("comp", "x", "y")), strict=True)):
                    if task != now:
                        if rows:
                            yield settle()
                        now, rows[:] = task, []
                    rows.append((ids[k], data[first[k] : first[k + 1]].copy()))
            if rows:
                yield settle()
            give_back()

        found = work.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y").select("comp", "x", "y", "cid", "set")
        return self.scratch.table(found.mapInArrow(compare, "src long, dst long"))


def labelled(docs: DataFrame, size: int = 5, percent: int = 80, members: int = MEMBERS, stars: bool = True) -> DataFrame:
    """(doc_id, part, n_shingles, component_id, component_part) of every row: ``part`` is the hash of its
    text, the component's pair is that of its first row by (doc_id, part)."""
    finder = _Finder(docs, size, percent, members)
    scratch, rows = finder.scratch, finder.sketched()
    linkable = rows.where("n > 0 AND doc_id IS NOT NULL")
    least = linkable.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "part")).alias("first"), F.min("sketch").alias("sketch"))
    classes = scratch.table(least.select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n", F.col("first.doc_id").alias("first_id"), F.col("first.part").alias("first_part"), "sketch"))
    sizes, names = classes.select("cid", "n"), classes.select("cid", "first_id", "first_part")
    grouped, made, sets, links = classes.select("cid", F.col("cid").alias("grp"), "sketch"), [], None, None
    for diagonal in (True, False) if stars else (False,):
        pairs = finder.bucketed(grouped, diagonal)
        wanted = pairs.select("cid").union(pairs.select("rep")).distinct().join(names, "cid")
        made.append(finder.sets(wanted if sets is None else wanted.join(sets.select("cid"), "cid", "left_anti"), rows))
        sets = made[0] if sets is None else sets.unionByName(made[1])
        if not stars:
            open_pairs = pairs
            break
        sized = pairs.join(sizes, "cid").join(sizes.select(F.col("cid").alias("rep"), F.col("n").alias("rep_n")), "rep")
        found = finder.confirm_stars(sized.where(f"100 * least(n, rep_n) >= {percent} * greatest(n, rep_n)").select("rep", "cid"), sets)
        links = found if links is None else links.unionByName(found)
        groups = scratch.table(component_edges(links)).select(F.col("id").alias("cid"), "comp")
        grouped = scratch.table(classes.join(groups, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("grp"), "sketch"))
        # a first class has met all others of its buckets; those are settled if they are in one group
        mixed = pairs.join(grouped.select("cid", "grp"), "cid").groupBy("rep").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a < b").select("rep")
        open_pairs = pairs.join(mixed, "rep")
    open_pairs = scratch.table(open_pairs)
    if not open_pairs.isEmpty():
        found = finder.confirm_blocks(open_pairs, sizes, sets)
        links = found if links is None else links.unionByName(found)
    scratch.drop(*made)
    if links is not None:
        comps = scratch.table(component_edges(links))
        comps = comps.union(comps.select(F.col("comp").alias("id"), "comp").distinct())
        firsts = classes.join(comps, F.col("cid") == F.col("id")).groupBy("comp").agg(F.min(F.struct("first_id", "first_part")).alias("lead"))
        named = classes.join(comps.join(firsts, "comp").select("id", "lead"), F.col("cid") == F.col("id"), "left")
        named = scratch.table(named.select("s1", "s2", "n", F.coalesce("lead.first_id", "first_id").alias("component_id"), F.coalesce("lead.first_part", "first_part").alias("component_part")))
    else:
        named = classes.select("s1", "s2", "n", F.col("first_id").alias("component_id"), F.col("first_part").alias("component_part"))
    together = linkable.join(named, ["s1", "s2", "n"]).select("doc_id", "part", F.col("n").alias("n_shingles"), "component_id", "component_part")
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "part", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("part").alias("component_part"))
    return together.unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, members: int = MEMBERS, stars: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    out = labelled(docs, size, percent, members, stars).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, columns unchanged, without all rows of a group of near-duplicates but its first.

    Rows are told apart by doc_id and text, so rows that share a doc_id only go if their own text is
    a near copy; of rows that agree in both one stays. Rows with a null doc_id and empty texts stay.
    """
    id_name, part_name = free_name(docs, "id"), free_name(docs, "part")
    found = labelled(docs, size, percent).where("doc_id IS NOT NULL AND n_shingles > 0")
    gone = found.where("doc_id <> component_id OR part <> component_part").select(F.col("doc_id").alias(id_name), F.col("part").alias(part_name)).distinct()
    repeated = found.where("doc_id = component_id AND part = component_part").groupBy("doc_id", "part").count().where("count > 1").select(F.col("doc_id").alias(id_name), F.col("part").alias(part_name))
    keyed = docs.withColumns({id_name: F.col("doc_id").cast("long"), part_name: F.xxhash64("text")})
    kept = keyed.join(gone.hint("shuffle_hash"), [id_name, part_name], "left_anti")
    if not repeated.isEmpty():
        again = kept.join(repeated, [id_name, part_name], "left_semi").dropDuplicates([id_name, part_name])
        kept = kept.join(repeated, [id_name, part_name], "left_anti").unionByName(again)
    return kept.select(*docs.columns)
