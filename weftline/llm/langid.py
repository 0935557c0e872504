"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for each
piece; the likelihood of a word is the sum over all of its segmentations into pieces, taken
by the forward algorithm, and that of a text is the product over its words. The
probabilities are learned by expectation-maximisation: the backward pass gives the expected
count of each piece.

A word is a maximal run of letters (lower-cased), read with the vocabulary's mark for a word start
before it; the mark is a piece too. A character that is no piece counts as one piece of
its own kind. All words of a chunk advance together, position by position, scaled so that no
word is too long; each distinct word of ordinary length is scored once and remembered in a bounded
cache that lives as long as the Python worker. Training is on all words of its bounded sample of
rows: expected counts are summed on the executors, and only counts of pieces reach the driver.

Cases: null texts and texts without a letter are ``und`` with score 0; texts and words of any length
are read whole, in one pass, without a shuffle; ties go to the alphabetically first language; null
languages are not learned from; without any language every text is ``und``; repeated rows are learned
from and scored each; an empty table gives an empty result; other columns, whatever their
names, are ignored. Only the text decides.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, fold, modest_batches, rows_of
from weftline.llm.textkit import U, per_chunk
from weftline.scratch import Scratch

#: Most documents that are learned from.
TRAIN_ROWS = 12000
MARK = "▁"
#: Words remembered by a worker, and the longest ones that are.
CACHE, CACHED_LETTERS = 400_000, 40
#: Characters of the words that advance together.
BATCH = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")
_caches: dict[str, "WordScores"] = {}
_STEP = U(0xD6E8FEB86659FD93)


def vocabulary(path: str) -> dict[str, int]:
    """Letter pieces of a sentencepiece model and its mark of a word start, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (piece == MARK or piece.lstrip(MARK).isalpha()):
            found.setdefault(piece, len(found))
    return found


class Pieces:
    """The vocabulary as a trie: for each length, the hashes of all prefixes of pieces, with the pieces' ids."""

    def __init__(self, pieces: dict[str, int]):
        self.count, levels = len(pieces), {}
        for piece, at in pieces.items():
            h = 0
            for k, c in enumerate(piece, 1):
                h = (h * int(_STEP) + ord(c)) % (1 << 64)
                level = levels.setdefault(k, {})
                level[h] = at if k == len(piece) else level.get(h, -1)
        self.longest = max(levels, default=1)
        self.levels = [(np.array(sorted(level), U), np.array([level[h] for h in sorted(level)], np.int64)) for _, level in sorted(levels.items())]


class Lattice:
    """All pieces in some words: edges between positions. Each word has its own positions, one more than characters."""

    def __init__(self, words: list[str], pieces: Pieces):
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))  # the words still open at a step come first
        self.order, self.longest = np.array(order, np.int64), pieces.longest
        self.length = np.array([len(words[k]) + 1 for k in order], np.int64)
        code = np.frombuffer("".join(MARK + words[k] for k in order).encode("utf-32-le"), "<u4").astype(U)
        stop = np.cumsum(self.length)
        word = np.repeat(np.arange(len(order)), self.length)
        room = stop[word] - np.arange(len(code))  # characters from here to the word's end
        self.first = stop - self.length + np.arange(len(order))  # one position more for each word before
        at, h = np.arange(len(code)), np.zeros(len(code), U)
        begin, size, piece = [], [], []
        for k, (known, ids) in enumerate(pieces.levels, 1):
            fits = room[at] >= k
            at, h = at[fits], h[fits]
            h = h * _STEP + code[at + k - 1]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[place] == h
            found = np.where(hit, ids[place], -1)
            if k == 1:
                found[found < 0] = pieces.count  # a character of no piece
            use = found >= 0
            begin.append(at[use])
            size.append(np.full(int(use.sum()), k))
            piece.append(found[use])
            at, h = at[hit], h[hit]
        begin, size, self.piece = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begin, size, piece))
        if not len(pieces.levels):
            begin, size, self.piece = np.arange(len(code)), np.ones(len(code), np.int64), np.zeros(len(code), np.int64)
        self.word = word[begin]
        self.begin, self.n = begin + self.word, len(code) + len(order)
        self.end = self.begin + size
        self.last = self.first + self.length

    def _swept(self, source: np.ndarray, target: np.ndarray, start: np.ndarray, sign: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all paths from ``start``, by position, and the logarithms they are divided by."""
        step = sign * (target - start[self.word])
        order = np.argsort(step * self.n + target)
        source, target, step, weight = source[order], target[order], step[order], weight[order]
        most = int(self.length.max(initial=0))
        cut, live = np.searchsorted(step, np.arange(most + 2)), np.searchsorted(-self.length, -np.arange(most + 1), "right")
        value, scale = np.zeros((self.n, weight.shape[1])), np.zeros((self.n, weight.shape[1]))
        value[start] = 1.0
        for j in range(1, most + 1):
            part = slice(cut[j], cut[j + 1])
            to = target[part]
            new = np.flatnonzero(np.diff(to, prepend=-1))
            value[to[new]] = np.add.reduceat(value[source[part]] * weight[part], new)
            if j % 8 == 0:  # the positions that later ones still look back to
                back = (start[: live[j]] + sign * j)[:, None] - sign * np.arange(min(self.longest, j) + 1)[None, :]
                high = np.maximum(value[back].max(1), 1e-300)
                value[back] /= high[:, None]
                scale[back] += np.log(high)[:, None]
                ahead = np.minimum(j + 1 + np.arange(8)[None, :], self.length[: live[j], None])
                scale[start[: live[j], None] + sign * ahead] = scale[back[:, :1]]
        return value, scale

    def forward(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._swept(self.begin, self.end, self.first, 1, weight)

    def backward(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._swept(self.end, self.begin, self.last, -1, weight)

    def log_likelihood(self, table: np.ndarray) -> np.ndarray:
        """Of each word, by column of ``table`` (a row for each piece, and one for other characters)."""
        value, scale = self.forward(table[self.piece])
        out = np.empty((len(self.order), table.shape[1]))
        out[self.order] = np.log(np.maximum(value[self.last], 1e-300)) + scale[self.last]
        return out

    def expected(self, table: np.ndarray, column: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Posterior counts of the pieces (rows) by column; each word has its column and counts ``times``."""
        mine = column[self.order][self.word]
        weight = table[self.piece, mine][:, None]
        (a, a_log), (b, b_log) = self.forward(weight), self.backward(weight)
        log = lambda x: np.log(np.maximum(x, 1e-300))
        whole = log(a[self.last, 0]) + a_log[self.last, 0]
        edge = log(a[self.begin, 0]) + a_log[self.begin, 0] + log(weight[:, 0]) + log(b[self.end, 0]) + b_log[self.end, 0] - whole[self.word]
        share = np.where((a[self.begin, 0] > 0) & (b[self.end, 0] > 0), np.exp(np.minimum(edge, 0)), 0) * times[self.order][self.word]
        return np.bincount(self.piece * table.shape[1] + mine, weights=share, minlength=table.size).reshape(table.shape)


def batches_of(words: list[str], most: int = BATCH):
    """Positions of words in groups of about equally long ones and a bounded number of characters."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    group: list[int] = []
    size = 0
    for k in order:
        group.append(k)
        size += len(words[k]) + 2
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def log_likelihoods(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """One row for each word, one column for each language."""
    out = np.empty((len(words), table.shape[1]))
    for group in batches_of(words):
        out[group] = Lattice([words[k] for k in group], pieces).log_likelihood(table)
    return out


def train(rows: DataFrame, vocabulary_path: str, rounds: int = 2, smooth: float = 0.1) -> dict:
    """Piece probabilities of each language from bounded ``rows`` (text, lang), by expectation-maximisation over all words."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "langid")

    def count(batches):
        seen: Counter = Counter()

        def told():
            return pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.update((lang, w) for w in _LETTERS.findall((text or "").lower()))
                if len(seen) > 100_000:
                    yield told()
                    seen.clear()
        yield told()

    words = scratch.table(rows.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    pieces = vocabulary(vocabulary_path)
    table = np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1))
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast(table)

        def expect(batches, sent=sent):
            now, trie, at = sent.value, Pieces(vocabulary(vocabulary_path)), {lang: k for k, lang in enumerate(langs)}
            total = np.zeros(now.shape)
            for batch in batches:
                found = batch.column("word").to_pylist()
                column, times = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64), np.asarray(batch.column("n")).astype(float)
                for group in batches_of(found):
                    total += Lattice([found[k] for k in group], trie).expected(now, column[group], times[group])
            piece, lang = np.nonzero(total)
            yield pa.record_batch([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "v"])

        got = words.mapInArrow(expect, "piece long, lang long, v double").groupBy("piece", "lang").agg(F.sum("v").alias("v")).toArrow()
        soft = np.full(table.shape, smooth)
        soft[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["v"].to_numpy()
        table = soft / soft.sum(0)
    scratch.drop(words)
    return {"langs": langs, "table": table}


class WordScores:
    """Log likelihoods of words: a row of ``table`` for each word remembered."""

    def __init__(self, model: dict, pieces: Pieces):
        self.model, self.pieces = model, pieces
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(model["langs"])))

    def rows(self, words: list[str]) -> np.ndarray:
        """The words' likelihoods in order."""
        at = list(map(self.row.get, words))
        new = list({w for w, k in zip(words, at, strict=True) if k is None})
        extra, have, far = np.zeros((0, self.table.shape[1])), len(self.row), {}
        if new:
            new.sort(key=len)
            short = bisect_right(new, CACHED_LETTERS, key=len)
            if have + short > CACHE:
                self.row.clear()
                new = sorted(set(words), key=len)
                short, have = bisect_right(new, CACHED_LETTERS, key=len), 0
            if have + short > len(self.table):
                self.table = np.vstack([self.table[:have], np.zeros((max(have + short, 2 * len(self.table)) - have, self.table.shape[1]))])
            scores = log_likelihoods(new, self.pieces, self.model["table"])
            self.table[have : have + short], extra = scores[:short], scores[short:]
            self.row.update(zip(new[:short], range(have, have + short), strict=True))
            far = {w: k for k, w in enumerate(new[short:])}
            at = list(map(self.row.get, words))
        if not far:
            return self.table[np.array(at, np.int64)]
        out = self.table[np.array([-1 if k is None else k for k in at], np.int64)]
        beyond = [i for i, k in enumerate(at) if k is None]
        out[beyond] = extra[[far[words[i]] for i in beyond]]
        return out


def identify(docs: DataFrame, model: dict, vocabulary_path: str) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior, tempered by length."""
    sent, mine = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        if mine not in _caches:
            _caches.clear()
            _caches[mine] = WordScores(sent.value, Pieces(vocabulary(vocabulary_path)))
        scores, langs = _caches[mine], sent.value["langs"]
        names = np.array([*langs, "und"], dtype=object)

        def one(batch, data, offsets):
            raw = data.tobytes()
            found = [_LETTERS.findall(raw[a:b].decode().lower()) for a, b in zip(offsets, offsets[1:], strict=False)]
            counts = np.array([len(f) for f in found])
            if not langs or not counts.any():
                return pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(["und"] * len(counts), pa.string()), pa.array(np.zeros(len(counts)))], ["doc_id", "lang_pred", "score"])
            total = np.zeros((counts.sum() + 1, len(langs)))
            np.cumsum(scores.rows([w for f in found for w in f]), axis=0, out=total[1:])
            edge = np.concatenate([[0], np.cumsum(counts)])
            sums = total[edge[1:]] - total[edge[:-1]]
            e = np.exp((sums - sums.max(1, keepdims=True)) / np.sqrt(np.maximum(counts, 1))[:, None])
            some = counts > 0
            pred = np.where(some, sums.argmax(1), len(langs))
            return pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(names[pred], pa.string()), pa.array(np.where(some, e.max(1) / e.sum(1), 0.0))], ["doc_id", "lang_pred", "score"])

        yield from per_chunk(one)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language(docs: DataFrame, vocabulary_path: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    modest_batches(docs.sparkSession)
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id")
    rows = rows_of(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"), bounded_sample(ids, "doc_id", train_rows).distinct())
    out = identify(docs, train(rows, vocabulary_path), vocabulary_path)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
