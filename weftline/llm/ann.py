"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector less the corpus mean is padded with zeros to ``expand`` times its length, rotated by a fixed random
rotation and kept as its signs, one packed bit per dimension, with three scalars: its distance to the
mean, its inner product with the mean, and the inner product of the rotated unit vector with its
own code. From these the inner product with a query is estimated without bias, and a bound on the
estimate's error holds with a probability set by ``epsilon``. Only vectors whose upper bound
reaches the query's running k-th best are compared exactly.

The index, codes and scalars beside the vectors, is written once in the shared folder; every block
of queries scans it. Its fit (mean and start thresholds) uses a bounded sample of vectors; every
vector is indexed. Queries go in blocks of bounded size against all rows; each task keeps its
own k best of a query, and those are merged.

Cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part; fewer than k candidates give all of them; ties go to the smaller id. Rows that
share an id are all candidates, also of the query of that id but for those with its own vector, and the
query is the least of their vectors. Empty tables give an empty result. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import bounded_sample, rows_of
from weftline.scratch import Scratch

#: Vectors that the mean and the start thresholds are taken from.
FIT_ROWS = 4096
#: Queries that a task holds at a time.
QUERY_BLOCK = 4096
RESULT = "query_id long, rank int, vec_id long, score double"


def rotation(dim: int, expand: int = 4, seed: int = 5) -> np.ndarray:
    """The rows of a random rotation of expand * dim dimensions that unpadded components meet."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((expand * dim, expand * dim)))
    return (q * np.sign(np.diag(r)))[:dim]  # expand * dim is a multiple of eight: see nearest


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, each summed in component order in double precision."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i].astype(np.float64) * b[:, i].astype(np.float64)
    return out


def dots_at(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Inner products of a[i] and b[j], gathered a bounded number at a time."""
    return np.concatenate([np.zeros(0), *(dots(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step))])


def start_limits(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, rows: int = 512) -> np.ndarray:
    """A score that k of these vectors reach for each query (-inf if there are fewer): nothing below
    it can be among the k best of all."""
    out = np.full(len(q), -np.inf)
    size = np.linalg.norm(vectors, axis=1).max(initial=0)
    for a in range(0, len(q), rows):
        s = q[a : a + rows] @ vectors.T
        s[q_ids[a : a + rows, None] == ids[None, :]] = -np.inf
        if s.shape[1] >= k:
            out[a : a + rows] = np.partition(s, -k, axis=1)[:, -k] - 1e-9 * size * np.linalg.norm(q[a : a + rows], axis=1)
    return out


class Codes:
    """Packed signs and correction scalars of some vectors."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, own: np.ndarray, with_mean: np.ndarray):
        self.bits, self.norm, self.own, self.with_mean, self.dim = bits, norm, own, with_mean, 8 * bits.shape[1]

    @classmethod
    def of(cls, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> Codes:
        o = (vectors - mean) @ turn
        norm = np.linalg.norm(o, axis=1)
        unit = o / np.maximum(norm, 1e-30)[:, None]
        own = np.maximum(np.abs(unit).sum(1) / np.sqrt(turn.shape[1]), 1e-6)  # <code, unit vector>
        return cls(np.packbits(unit > 0, axis=1), norm, own, vectors @ mean)

    def signs(self, at: slice) -> np.ndarray:
        return (np.unpackbits(self.bits[at], axis=1, count=self.dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.dim))

    def upper(self, at: slice, unit_q: np.ndarray, norm_q: np.ndarray, base_q: np.ndarray, epsilon: float) -> np.ndarray:
        """Upper bounds of the inner products, one row for each query."""
        estimate = unit_q @ self.signs(at).T / self.own[at].astype(np.float32)
        error = (epsilon * np.sqrt(np.maximum(1 - self.own[at] ** 2, 0)) / (self.own[at] * np.sqrt(max(self.dim - 1, 1)))).astype(np.float32)
        best = np.minimum(estimate + error + np.float32(1e-4), 1 + np.float32(1e-4))
        return best * norm_q[:, None] * self.norm[at].astype(np.float32) + self.with_mean[at].astype(np.float32) + base_q[:, None]


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (highest score, then smallest id) of each query."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    start = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def search_block(ids: np.ndarray, vectors: np.ndarray, codes: Codes, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int, epsilon: float, rows: int = 2048, queries: int = 512):
    """k best of these vectors for each query: yields (query positions, vector ids, scores)."""
    for a in range(0, len(q), queries):
        qs, qi = q[a : a + queries], q_ids[a : a + queries]
        turned = (qs - mean) @ turn
        norm = np.linalg.norm(turned, axis=1)
        unit = (turned / np.maximum(norm, 1e-30)[:, None]).astype(np.float32)
        base = ((qs - mean) @ mean).astype(np.float32)
        limit = floor[a : a + queries].copy()
        kept_q, kept_i, kept_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(ids), rows):
            at = slice(b, b + rows)
            hit_q, hit_v = np.nonzero(codes.upper(at, unit, norm.astype(np.float32), base, epsilon) >= (limit - 1e-5 * np.abs(limit) - 1e-5)[:, None])
            own = np.flatnonzero(ids[at][hit_v] == qi[hit_q])
            other = np.ones(len(hit_q), bool)
            other[own] = (vectors[at][hit_v[own]] != qs[hit_q[own]]).any(1)
            hit_q, hit_v = hit_q[other], hit_v[other]
            s = dots_at(qs, hit_q, vectors[at], hit_v)
            enough = s >= limit[hit_q]
            kept_q, kept_i, kept_s = np.append(kept_q, hit_q[enough]), np.append(kept_i, ids[at][hit_v[enough]]), np.append(kept_s, s[enough])
            best = best_of(kept_q, kept_i, kept_s, k)
            kept_q, kept_i, kept_s = kept_q[best], kept_i[best], kept_s[best]
            count = np.bincount(kept_q, minlength=len(qs))
            full = np.flatnonzero(count >= k)
            last = np.cumsum(count) - 1
            limit[full] = np.maximum(limit[full], kept_s[last[full]])
        yield kept_q + a, kept_i, kept_s


def collected(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded number of rows, by id."""
    t = rows.select("vec_id", "v").toArrow().combine_chunks()
    ids = t["vec_id"].to_numpy()
    v = t["v"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(ids), dim) if len(ids) else np.zeros((0, dim))
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def indexed(rows: DataFrame, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """The rows (vec_id, v) with their codes and scalars. Dimensions are a multiple of eight."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("v").flatten().cast(pa.float64())).reshape(batch.num_rows, -1)
                codes = Codes.of(x, mean, turn)
                bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.bits.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(codes.bits))]).cast(pa.binary())
                yield pa.record_batch([*batch.columns, bits, *map(pa.array, (codes.norm, codes.own, codes.with_mean))], [*batch.schema.names, "bits", "norm", "own", "with_mean"])

    schema = T.StructType([*rows.schema.fields, T.StructField("bits", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in ("norm", "own", "with_mean"))])
    return rows.mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries, k: int = 20, epsilon: float = 3.5, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, query_block: int = QUERY_BLOCK, expand: int = 4) -> DataFrame:
    """The k nearest rows of each query row; ``queries`` is a condition on ``id_col``."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    empty = spark.createDataFrame([], RESULT)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return empty
    dim = sizes[0].d
    rows = rows.where(F.size("v") == dim)
    sample = rows_of(rows, bounded_sample(rows.select("vec_id").distinct(), "vec_id", fit_rows), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    fit_ids, fit_v = collected(sample, dim)
    mean, turn = fit_v.mean(0), rotation(dim, expand * 8 // math.gcd(expand * dim, 8))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = asked.count()
    if not n_queries:
        return empty
    scratch, found = Scratch(spark, "ann"), None
    index = scratch.table(indexed(rows, mean, turn))
    blocks = -(-n_queries // query_block)
    for block in range(blocks):
        # hash buckets of about query_block queries: bounded whatever the number of queries
        q_ids, q = collected(asked.where(F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(blocks)) == block), dim)
        if not len(q_ids):
            continue
        floor = start_limits(q_ids, q, fit_ids, fit_v, k)
        sent = spark.sparkContext.broadcast((q_ids, q.astype(np.float32) if np.array_equal(q, q.astype(np.float32)) else q, floor, mean, turn))

        def run(batches, sent=sent):
            q_ids, q, floor, mean, turn = sent.value
            q = q.astype(np.float64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.asarray(batch.column("vec_id"))
                flat = batch.column("v").flatten()
                x = np.asarray(flat.cast(pa.float64())).reshape(len(ids), -1)
                bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
                codes = Codes(bits, *(np.asarray(batch.column(c)) for c in ("norm", "own", "with_mean")))
                for at, vec, s in search_block(ids, x, codes, q_ids, q, floor, mean, turn, k, epsilon):
                    yield pa.record_batch([pa.array(q_ids[at]), pa.array(vec), pa.array(s)], ["query_id", "vec_id", "score"])

        part = index.mapInArrow(run, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]))
        part = scratch.table(part)
        found = part if found is None else found.unionByName(part)

    def top(batches):
        held: list[pa.RecordBatch] = []

        def cut(tables):
            t = pa.Table.from_batches(tables)
            best = best_of(np.asarray(t["query_id"]), np.asarray(t["vec_id"]), np.asarray(t["score"]), k)
            return t.take(pa.array(best)).combine_chunks()

        for batch in batches:
            held.append(batch)
            if len(held) >= 16:
                held = cut(held).to_batches()
        if held and (t := cut(held)).num_rows:
            q = np.asarray(t["query_id"])
            start = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) + 1
            yield from pa.table([t["query_id"], pa.array(rank, pa.int32()), t["vec_id"], t["score"]], ["query_id", "rank", "vec_id", "score"]).to_batches()

    return found.repartition("query_id").mapInArrow(top, RESULT) if found is not None else empty
