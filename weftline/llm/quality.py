"""Quality by Bradley-Terry pairwise ranking.

Each text has bounded style features. From all labelled documents, preference pairs (a better
and a worse one) are drawn, each document in one at least, and a linear score is learned by
logistic loss on the difference of their features. A quantile of the learned scores is then
made the threshold: the score that is returned is a logistic curve of the raw score that passes
``threshold`` exactly at that quantile.

Labelled documents are dealt out by a hash of the id to blocks of about ``BLOCK`` rows, in which the
pairs are drawn; of a class so rare that blocks would lack it, rows are partners in several. Means,
gradients and the quantile are taken over all blocks, by the executors if there are more than
``LOCAL_ROWS`` rows, and merged in the order of the blocks: the weights depend neither on the partitioning
nor on where they are computed.

Cases: null and empty texts have all features zero and get the score of that point; texts are
read whole, in one pass, without a shuffle; labels that are null are not learned from; without
a good and a bad label every score is ``threshold``. Texts that tie at the quantile get the threshold and
pass; a document with several labels takes part once for each, and repeated rows are scored each;
an empty table gives an empty result. Columns other than id and text, whatever their names,
are not read; of kept ones, that named like the score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fold, modest_batches
from weftline.llm.textkit import LOWER, NON_WORD, U, Words, per_chunk, sums, window_hash, window_starts
from weftline.scratch import Scratch

#: Labelled documents, about, among which pairs are drawn.
BLOCK = 4096
#: Rows of the rarer class that a block has, about, if there are as many.
RARER = 64
#: Labelled documents, at most, whose features the driver takes.
LOCAL_ROWS = 12000

_UPPER, _LOWERCASE, _DIGIT, _PUNCT = (np.zeros(256, np.float64) for _ in range(4))
_UPPER[65:91], _LOWERCASE[97:123], _DIGIT[48:58] = 1, 1, 1
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_PLAIN = np.zeros(256, np.float64)
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = 1
WIDTH = 26


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and share of the most common one, of each of n texts."""
    total = np.bincount(owner, minlength=n).astype(float)
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, o[at], np.diff(np.append(at, len(o))))
    return _share(np.bincount(o[at], minlength=n), total), _share(top, total)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` style features for each text."""
    n = len(offsets) - 1
    chars = np.diff(offsets).astype(float)
    words = Words(data, offsets)
    bare = Words(LOWER[data], offsets, NON_WORD)
    count, owner = words.counts.astype(float), words.owner()
    upper, lower, digit, punct, plain = (sums(t[data], offsets) for t in (_UPPER, _LOWERCASE, _DIGIT, _PUNCT, _PLAIN))
    last, begin = data[words.ends - 1], data[words.starts]
    odd_end = (_PUNCT[last] > 0) & (_PLAIN[last] == 0)
    alone = _PUNCT[begin] * (words.ends - words.starts == 1)
    h = bare.hashes()
    bare_owner = bare.owner()
    kinds, top = _repeats(bare_owner, h, n)
    at = window_starts(words.first, 3)
    trigrams, _ = _repeats(owner[at], window_hash(words.hashes(), 3, 0x2545F4914F6CDD1D)[at] if len(at) else np.zeros(0, U), n)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (bare_owner[1:] == bare_owner[:-1])
    is_line = np.zeros(256, bool)
    is_line[10] = True
    lines = Words(data, offsets, is_line)
    line_kinds, line_top = _repeats(lines.owner(), lines.hashes(), n)
    line_count = lines.counts.astype(float)
    shout = _share(upper, upper + lower)
    base = [
        _share(odd_end_sum := sums(odd_end.astype(float), words.first), count), _share(sums(alone, words.first), count), shout, _share(digit, chars), _share(punct - plain, chars), _share(plain, chars),
        kinds, top, trigrams, _share(sums(same, bare.first), bare.counts), line_kinds, line_top, np.log1p(count) / 10, np.log1p(line_count) / 6, _share(chars, count) / 20,
    ]
    base += [(odd_end_sum > 2).astype(float), (base[0] > 0.2).astype(float), (base[1] > 0.05).astype(float), (shout > 0.3).astype(float), (top > 0.2).astype(float), (base[9] > 0.1).astype(float), (trigrams < 0.5).astype(float), ((line_kinds < 0.7) & (line_count > 4)).astype(float), (line_top > 0.3) * (line_count > 3).astype(float), base[4] ** 0.5, (1 - trigrams) ** 2]
    out = np.stack(base, 1)
    out[count == 0] = 0
    return out


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def weighed(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z @ w, summed column by column: a row's value is the same whatever rows are beside it."""
    out = np.zeros(len(z))
    for j in range(len(w)):
        out += z[:, j] * w[j]
    return out


def styles(rows: DataFrame, *kept: str) -> DataFrame:
    """The kept columns and, as ``x``, the bytes of each text's features."""
    modest_batches(rows.sparkSession)
    kept_rows = rows.select(*kept, "text")

    def pack(batch, data, offsets):
        x = features(data, offsets)
        at = np.arange(len(x) + 1, dtype=np.int32) * (8 * WIDTH)
        return pa.record_batch([*(batch.column(c) for c in kept), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x.tobytes())])], [*kept, "x"])

    return kept_rows.mapInArrow(per_chunk(pack), kept_rows.select(*kept).schema.add("x", "binary"))


def _block(table: pa.Table) -> tuple[int, bytes, bytes, bytes]:
    """Number, labels, owned rows and features of a block, in an order that its rows alone decide."""
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(-1, WIDTH)
    doc, label, own = (table.column(c).to_numpy() for c in ("doc_id", "label", "own"))
    order = np.lexsort([*x.T, label, doc])
    return table.column("block")[0].as_py(), label[order].astype(np.int64).tobytes(), own[order].astype(bool).tobytes(), x[order].tobytes()


def _arrays(row: tuple[int, bytes, bytes, bytes]) -> tuple:
    return row[0], np.frombuffer(row[1], np.int64), np.frombuffer(row[2], bool), np.frombuffer(row[3], np.float64).reshape(-1, WIDTH)


def _blocks(rows: DataFrame, good: int, bad: int) -> list | RDD:
    """All rows in blocks: a list if they are few. A row is owned by one block; others use it as a partner."""
    count = math.ceil((good + bad) / BLOCK)
    copies = min(count, math.ceil(RARER * count / min(good, bad)))
    rarer = (F.col("label") > 0) == F.lit(good < bad)
    step = F.explode(F.sequence(F.lit(0), F.when(rarer, copies - 1).otherwise(0)))
    dealt = rows.select("*", step.alias("step")).select("doc_id", "label", "x", ((F.pmod(F.xxhash64("doc_id"), F.lit(count)) + F.col("step")) % count).cast("int").alias("block"), (F.col("step") == 0).alias("own"))
    if good + bad <= LOCAL_ROWS:
        table = dealt.toArrow()
        return [_arrays(_block(table.filter(pc.equal(table.column("block"), b)))) for b in sorted(set(table.column("block").to_pylist()))]

    def pack(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([v], t) for v, t in zip(_block(table), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["block", "label", "own", "x"])

    # a task has about one block, also where the session deals by a key to more partitions
    packed = dealt.repartition(count, "block").groupBy("block").applyInArrow(pack, "block int, label binary, own binary, x binary").coalesce(count)
    return packed.rdd.map(lambda r: _arrays((r[0], bytes(r[1]), bytes(r[2]), bytes(r[3]))))


def _each(parts: list | RDD, f: Callable) -> list:
    """f of every part, in the order of the numbers that parts begin with."""
    got = [(p[0], f(p)) for p in parts] if isinstance(parts, list) else parts.map(lambda p: (p[0], f(p))).collect()
    return [v for _, v in sorted(got, key=itemgetter(0))]


def _moments(values: np.ndarray) -> tuple:
    """Count, mean and sum of squared differences from it."""
    if not len(values):
        return 0, 0.0, 0.0
    mean = values.mean(0)
    return len(values), mean, ((values - mean) ** 2).sum(0)


def _merged(moments: list[tuple]) -> tuple:
    """Mean and standard deviation of all values."""
    n, mean, squares = 0, 0.0, 0.0
    for k, other, more in moments:
        if k:
            apart = other - mean
            squares = squares + more + apart**2 * (n * k / (n + k))
            mean, n = mean + apart * (k / (n + k)), n + k
    return mean, np.sqrt(squares / n)


def _paired(part: tuple, mean: np.ndarray, scale: np.ndarray, pairs_per_row: int) -> tuple:
    """The block with standard features and its pairs: ``pairs_per_row`` for a row, and one for each row that none has drawn."""
    number, y, own, x = part
    draw = np.random.default_rng(11)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        up = down = np.zeros(0, np.int64)
    else:
        up, down = draw.choice(good, pairs_per_row * len(y)), draw.choice(bad, pairs_per_row * len(y))
        left, right = np.setdiff1d(good, up), np.setdiff1d(bad, down)
        up, down = np.concatenate([up, left, draw.choice(good, len(right))]), np.concatenate([down, draw.choice(bad, len(left)), right])
    return number, y, own, standard(x, mean, scale), up.astype(np.int32), down.astype(np.int32)


def _pull(part: tuple, w: np.ndarray) -> tuple[np.ndarray, int]:
    """Gradient of the block's log(1 + exp(-difference of a pair's scores)), downwards, and its number of pairs."""
    _, _, _, z, up, down = part
    s = weighed(z, w)
    p = 1 / (1 + np.exp(np.clip(s[up] - s[down], -35, 35)))
    return (np.bincount(up, p, len(z)) - np.bincount(down, p, len(z))) @ z, len(up)


def _counted(part: tuple, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different raw scores of the block's own rows, with the good and the bad rows of each."""
    _, y, own, z, _, _ = part
    raw, at = np.unique(weighed(z[own], w), return_inverse=True)
    return raw, np.bincount(at, y[own] > 0, len(raw)).astype(np.int64), np.bincount(at, y[own] <= 0, len(raw)).astype(np.int64)


def _ranked(parts: list | RDD, w: np.ndarray, rows: DataFrame) -> list | RDD:
    """The different raw scores in ascending order, with their good and bad rows, in numbered runs that are not empty."""
    if isinstance(parts, list):
        raw, good, bad = (np.concatenate(v) for v in zip(*_each(parts, partial(_counted, w=w)), strict=True))
        raw, at = np.unique(raw, return_inverse=True)
        return [(0, raw, np.bincount(at, good).astype(np.int64), np.bincount(at, bad).astype(np.int64))]
    one = parts.flatMap(lambda p: zip(*(v.tolist() for v in _counted(p, w)), strict=True))
    counts = rows.sparkSession.createDataFrame(one, "raw double, good long, bad long", verifySchema=False).groupBy("raw").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))

    def run(number: int, scores: Iterator) -> Iterator[tuple]:
        got = list(scores)
        if got:
            yield (number, *(np.array(v) for v in zip(*got, strict=True)))

    return counts.repartitionByRange(parts.getNumPartitions(), "raw").sortWithinPartitions("raw").rdd.mapPartitionsWithIndex(run)


def _cut(runs: list | RDD, reject_share: float | None) -> float:
    """The raw score between the rows that are rejected and the others.

    ``reject_share`` of the rows, or the share with the fewest errors: of several, the middle one.
    """
    sizes = _each(runs, lambda p: (p[0], int(p[2].sum()), int(p[3].sum())))
    n_good, n_bad = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
    n, before, g, b = n_good + n_bad, {}, 0, 0
    for number, more_good, more_bad in sizes:
        before[number] = g, b
        g, b = g + more_good, b + more_bad

    def below(p: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Good and bad rows below each score of the run."""
        return before[p[0]][0] + np.cumsum(p[2]) - p[2], before[p[0]][1] + np.cumsum(p[3]) - p[3]

    def errors(p: tuple) -> np.ndarray:
        good, bad = below(p)
        return good + n_bad - bad

    if reject_share is None:
        least = [*_each(runs, lambda p: (int((e := errors(p)).min()), int((e == e.min()).sum()), p[0])), (n_good, 1, None)]  # the last: all are rejected
        fewest = min(v for v, _, _ in least)
        at = sum(c for v, c, _ in least if v == fewest) // 2
        for v, c, number in least:
            if v == fewest:
                if at < c:
                    break
                at -= c
        k = n if number is None else next(v for v in _each(runs, lambda p: int(sum(below(p))[np.flatnonzero(errors(p) == fewest)[at]]) if p[0] == number else None) if v is not None)
    else:
        k = round(reject_share * n)
    ranks = max(0, k - 1), min(k, n - 1)

    def held(p: tuple) -> list[float]:
        """Scores of those of the two rows that are in this run."""
        upto = np.cumsum(p[2] + p[3]) + sum(before[p[0]])
        return [float(p[1][np.searchsorted(upto, r, "right")]) for r in ranks if sum(before[p[0]]) <= r < upto[-1]]

    return sum(v for found in _each(runs, held) for v in found) / 2


def learn(rows: DataFrame, pairs_per_row: int = 8, epochs: int = 300, rate: float = 0.5, l2: float = 1e-4, threshold: float = 0.7, reject_share: float | None = None) -> dict:
    """Weights, and the line that maps raw scores so that the chosen quantile gets ``threshold``, from the ``styles`` of all labelled rows.

    The quantile is ``reject_share`` of the labelled scores; by default the share that
    gives the fewest errors on them.
    """
    scratch, held = Scratch(rows.sparkSession, "quality"), []

    def keep(parts: list | RDD) -> list | RDD:
        if not isinstance(parts, list):
            held.append(parts.persist(StorageLevel.MEMORY_AND_DISK))
        return parts

    table = scratch.table(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "x"))
    try:
        good, bad = table.select(F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") <= 0, 1))).first()
        if not good or not bad:
            return {"w": np.zeros(WIDTH), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "cut": 0.0, "slope": 0.0, "threshold": threshold}
        parts = keep(_blocks(table, good, bad))
        mean, scale = _merged(_each(parts, lambda p: _moments(p[3][p[2]])))
        scale = np.maximum(scale, 1e-3)
        pair = partial(_paired, mean=mean, scale=scale, pairs_per_row=pairs_per_row)
        parts = keep([pair(p) for p in parts] if isinstance(parts, list) else parts.map(pair))
        w, speed = np.zeros(WIDTH), np.zeros(WIDTH)
        for _ in range(epochs):  # gradient descent with momentum over the pairs of all blocks
            pulls = _each(parts, partial(_pull, w=w))
            speed = 0.9 * speed + rate * (sum(v for v, _ in pulls) / max(1, sum(m for _, m in pulls)) - l2 * w) * 0.3
            w = w + speed
        _, spread = _merged(_each(parts, lambda p: _moments(weighed(p[3][p[2]], w))))
        cut = _cut(keep(_ranked(parts, w, table)), reject_share)
        return {"w": w, "mean": mean, "scale": scale, "cut": cut, "slope": float(4 / max(spread, 1e-9)), "threshold": threshold}
    finally:
        for parts in held:
            parts.unpersist()
        scratch.drop(table)


def train(rows: DataFrame, **more) -> dict:
    """``learn`` from texts with their ids and labels."""
    return learn(styles(rows, "doc_id", "label"), **more)


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), name: str = "quality_score") -> DataFrame:
    """The kept columns and, as ``name``, the score of every document."""
    keep = tuple(c for c in keep if c.lower() != name.lower())
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, "text"]))
    kept = docs.select(*columns)

    def run(batches):
        m = sent.value
        shift = np.log(m["threshold"] / (1 - m["threshold"]))

        def one(batch, data, offsets):
            raw = weighed(standard(features(data, offsets), m["mean"], m["scale"]), m["w"])
            s = 1 / (1 + np.exp(-np.clip((raw - m["cut"]) * m["slope"] + shift, -35, 35)))
            s = np.where(raw == m["cut"], m["threshold"], s)
            return pa.record_batch([*(batch.column(c) for c in keep), pa.array(s)], [*keep, name])

        yield from per_chunk(one)(batches)

    schema = kept.select(*keep).schema.add(name, "double")
    return kept.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **more) -> dict:
    """Learn from all labelled documents outside the held-out fold."""
    known = F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)
    ids = labels.where(F.col("quality").isNotNull() & known).select("doc_id", F.col("quality").cast("int").alias("label"))
    return learn(styles(docs.where(known), "doc_id").join(ids, "doc_id"), threshold=threshold, **more)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score and class of every document."""
    out = score(docs, fit(docs, labels, threshold))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
