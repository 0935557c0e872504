"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs that skip one
word, in ``2**bits`` buckets. Per-coordinate learning rates and the L1 term leave few
non-zero weights, so the model that goes to the executors has at most ``2**bits`` entries
however large the corpus is.

Cases: null or empty texts have only the bias; texts of any length are scored whole, in one
pass, without a shuffle; repeated labels of a document count repeatedly and labels that are
null are not learned from; without any label the score is 0.5. Repeated rows are scored each and, if
labelled, learned from each; equal scores get equal classes; an empty table gives an empty result.
Columns other than the id and the text, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, fold, modest_batches, rows_of
from weftline.llm.textkit import LOWER, NON_WORD, U, Words, mix, per_chunk, sums

#: Most labelled documents that are learned from.
TRAIN_ROWS = 10000


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indices of each text, with the texts' spans in them."""
    words = Words(LOWER[data], offsets, NON_WORD)
    h, owner = words.hashes(), words.owner()
    parts, owners = [h], [owner]
    for gap, salt in ((1, 0x1D8E4E27C47D124F), (2, 0x62A9D9ED799705F5)):
        same = owner[gap:] == owner[:-gap] if len(h) > gap else np.zeros(0, bool)
        pair = mix(h[:-gap] * U(salt) + h[gap:]) if len(h) > gap else np.zeros(0, U)
        parts.append(pair[same])
        owners.append(owner[gap:][same] if len(h) > gap else owner[:0])
    at = (np.concatenate(parts) >> U(64 - bits)).astype(np.int64)
    # one sort of a combined integer key; owners are below 2**32 in a chunk
    key = np.unique(np.concatenate(owners) << bits | at)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(offsets)))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, 1 << self.bits)  # the bias
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def best_cut(raw: np.ndarray, label: np.ndarray) -> float:
    """The raw score at which calling higher ones toxic makes the fewest errors (0 if one class is missing)."""
    if len(np.unique(label)) < 2:
        return 0.0
    order = np.argsort(raw, kind="stable")
    below = np.concatenate([[0], np.cumsum(label[order])])
    errors = below + ((label == 0).sum() - (np.arange(len(raw) + 1) - below))
    least = np.flatnonzero(errors == errors.min())
    k = int(least[len(least) // 2])
    padded = np.concatenate([[raw.min() - 1], raw[order], [raw.max() + 1]])
    return float(padded[k] + padded[k + 1]) / 2


def train(rows: DataFrame, bits: int = 20, epochs: int = 4, **ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights (indices, values) and bias from bounded ``rows`` (doc_id, text, label).

    Every fifth row is not learned from; the bias is shifted so that the score 0.5 falls where
    those rows are told apart best.
    """

    def pack(batch, data, offsets):
        at, first = features(data, offsets, bits)
        return pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.float64()), pa.array([at[a:b].astype("<u4").tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], ["doc_id", "label", "at"])

    got = rows.select("doc_id", "text", "label").mapInArrow(per_chunk(pack), "doc_id long, label double, at binary").toArrow()
    ids, labels, packed = got["doc_id"].to_numpy(), got["label"].to_numpy(), got["at"]
    order = np.lexsort((labels, ids, mix(ids.astype(np.int64).view(U) + U(1))))
    model = Ftrl(bits, **ftrl)
    examples = [(np.frombuffer(packed[int(k)].as_buffer(), "<u4"), labels[k]) for k in order]  # views of the Arrow table
    held = examples[::5]
    for _ in range(epochs):
        for k, (at, y) in enumerate(examples):
            if k % 5:
                model.learn(at, y)
    w = model.weights(np.arange((1 << bits) + 1))
    cut = best_cut(np.array([w[at].sum() + w[-1] for at, _ in held]), np.array([y for _, y in held]))
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1]) - cut


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = 20) -> DataFrame:
    """(doc_id, score) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32), model[2]))

    def run(batches):
        at, w, bias = sent.value
        dense = np.zeros(1 << bits)
        dense[at] = w

        def one(batch, data, offsets):
            found, first = features(data, offsets, bits)
            s = 1 / (1 + np.exp(-np.clip(sums(dense[found], first) + bias, -35, 35)))
            return pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(s)], ["doc_id", "score"])

        yield from per_chunk(one)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, bits: int = 20, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """Score every document; learns from labelled documents outside the held-out fold."""
    modest_batches(docs.sparkSession)
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", F.col("toxic").cast("double").alias("label"))
    model = train(rows_of(docs.select("doc_id", "text"), bounded_sample(ids, "doc_id", train_rows)), bits)
    out = score(docs, model, bits)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
