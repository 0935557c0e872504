"""Operators against brute force, and the defined cases: nulls, empty, long, ties, clashes."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import ann, decontam, langid, licenses, linedup, minhash, packing, quality, substring, toxicity
from weftline.llm.textkit import Words, text_bytes, window_starts

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Extra columns with the names that operators use inside.
CLASH = dict.fromkeys("block key kind h id lines score n cid comp blocks set gone owner size label rank sketch held_out order".split(), 7)
SYLLABLES = "ba ko ri tu mel sor vin dap eck lum".split()


def make(spark, rows, schema="doc_id long, text string"):
    """Documents with every clashing column."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items() if k not in df.columns])


def prose(draw, n, kinds=400):
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(1 + draw.randrange(kinds) % 3)) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, nulls, blanks and one long text."""
    draw = random.Random(seed)
    texts = [prose(draw, draw.randint(3, 160)) for _ in range(n)]
    passage = prose(draw, 70)
    for k in range(0, n, 7):
        texts[k] += "\n" + passage + "\n" + prose(draw, 9)
    for k in range(3, n, 11):
        words = texts[k - 1].split(" ")
        words[draw.randrange(len(words))] = "changed"
        texts[k] = " ".join(words)
    texts[5] = texts[6] = texts[20]
    texts += [None, "", "   \n\t ", "one", "two words", "one", prose(draw, 6000), "é ü ß ñ " * 40]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def ascii_words(text):
    return (text or "").encode().split()


def test_words_follow_the_pattern():
    texts = ["", " a  b\x0bc\u00a0d\n", "x", "\t\t", "\u00e9\u2028f g"]
    words = Words(*text_bytes(pa.array(texts)))
    got = [[words.word(i) for i in range(a, b)] for a, b in itertools.pairwise(words.first)]
    assert got == [ascii_words(t) for t in texts]
    assert window_starts(words.first, 2).tolist() == [0, 1, 4]


# packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything(seed):
    draw = random.Random(seed)
    counts = Counter(draw.choice([draw.randint(1, 64), draw.randint(1, 20), 64, 33]) for _ in range(500))
    plan = packing.plan(dict(counts), 64)
    used = Counter()
    for parts, m in plan:
        assert sum(parts) <= 64 and m > 0
        for p in parts:
            used[p] += m
    assert used == counts
    bound = max(-(-sum(n * c for n, c in counts.items()) // 64), sum(c for n, c in counts.items() if n > 32))
    assert sum(m for _, m in plan) <= 1.03 * bound + 1


def test_plan_finds_exact_triples():
    assert sum(m for _, m in packing.plan({50: 4, 25: 4, 15: 4, 10: 4}, 100)) == 4
    assert packing.plan({}, 10) == []


@pytest.mark.parametrize("seed", range(4))
def test_sums_find_a_filling_whenever_there_is_one(seed):
    """Against all combinations of one to three of the lengths left, while counts fall."""
    draw = random.Random(seed)
    left = np.zeros(41, np.int64)
    for n in draw.sample(range(1, 40), 9):
        left[n] = draw.randint(1, 3)
    sums = packing.Sums(left)
    for first in sorted(np.flatnonzero(left).tolist(), reverse=True):
        while left[first]:
            items = [n for n in np.flatnonzero(left).tolist() for _ in range(int(left[n]) - (n == first))]
            possible = first == 40 or any(sum(c) == 40 - first for k in (1, 2, 3) for c in itertools.combinations(items, k))
            fill = sums.fill(40 - first, (first,))
            assert (fill is not None) == possible
            assert fill is None or sum(fill) == 40 - first and not Counter((first, *fill)) - Counter(dict(enumerate(left.tolist())))
            assert sums.take((first, *(fill or ()))) > 0


def test_plan_of_one_length():
    assert packing.plan({10: 3}, 10) == [((10,), 3)]


def check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_round_trip(spark):
    rows = [*corpus(2), (900, "<|endoftext|> don't  x\n\n y'll 12345 你好")]
    got = packing.pack(make(spark, rows).repartition(5), RANKS, PATTERN, 256).collect()
    used = check_packing(rows, got, 256)
    assert used <= 1.03 * -(-sum(r.length for r in got) // 256) + 1


def test_added_tokens_have_the_ids_of_the_json_file():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.with_added(packing.encoder(RANKS, PATTERN).encode_ordinary, packing.added_tokens(RANKS))
    end = "<|endoftext|>"
    assert encode(f"a{end}b") == [64, 50256, 65]
    for text in ("", end, end * 3, f" {end}  x ", f"a b\n{end}\n\ndon't", f"<|{end}|>", "<|endoftext", "é" + end):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_op1_gives_added_tokens_their_ids(spark, tmp_path):
    from weftline.llm import registry

    spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = registry.op1_best_fit_packing(spark, str(tmp_path)).collect()
    assert (r.length, r.ids_crc32) == (4, zlib.crc32(np.array([64, 50256, 65, 0], "<u4").tobytes()))


def test_pack_empty_and_repeated(spark):
    assert packing.pack(make(spark, []), RANKS, PATTERN).collect() == []
    got = packing.pack(make(spark, [(1, "a b"), (1, "a b"), (1, None)]), RANKS, PATTERN, 4).collect()
    assert len(got) == 3


# nearest neighbours


def brute_nearest(rows, asked, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]

    def dot(x, y):  # plain double sums in order; sum() compensates
        total = 0.0
        for a, b in zip(x, y, strict=True):
            total += float(a) * float(b)
        return total

    out = []
    for q in sorted({i for i, _ in good if asked(i)}):
        mine = min(v for i, v in good if i == q)
        s = sorted((-dot(mine, v), i) for i, v in good if i != q or v != mine)[:k]
        out += [(q, r + 1, i, -d) for r, (d, i) in enumerate(s)]
    return out


def test_nearest_equals_brute_force(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(4)
    v = draw.standard_normal((400, 8)).astype(np.float32)
    v[50:150] = v[50]  # a common vector
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0] * 3), (403, [None] + [1.0] * 7), (404, [float("nan")] * 8), (405, [float("inf")] * 8), (None, [1.0] * 8), (406, [])]
    rows += [(40, [float(x) for x in v[7] * 3]), rows[40], (61, rows[3][1]), (61, rows[5][1])]  # ids that repeat
    df = make(spark, rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5, query_block=8, fit_rows=64).collect())
    assert got == brute_nearest(rows, lambda i: i % 20 == 0, 5)


def test_nearest_small_and_empty(spark):
    df = make(spark, [(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(df, "vec_id = 0").collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(df.limit(0), "vec_id = 0").collect() == []
    assert ann.nearest(df, "vec_id = 9").collect() == []


def test_error_bound_holds():
    draw = np.random.default_rng(0)
    x, q = draw.standard_normal((3000, 64)), draw.standard_normal((20, 64))
    mean, turn = x.mean(0), ann.rotation(64)
    c = ann.Codes.of(x, mean, turn)
    turned = (q - mean) @ turn
    norm = np.linalg.norm(turned, axis=1)
    upper = c.upper(slice(0, 3000), (turned / norm[:, None]).astype(np.float32), norm.astype(np.float32), ((q - mean) @ mean).astype(np.float32), 3.5)
    assert (upper >= q @ x.T - 1e-3).mean() > 0.9995
    assert (upper - q @ x.T).mean() < 40  # and it says something


# decontamination


def brute_leaks(rows, items, threshold=0.8):
    import re

    norm = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = {}
    for doc, text in rows:
        w = norm(text)
        for item, t in items:
            u = norm(t)
            if not u or not w:
                continue
            n, size = len(u), min(5, len(u))
            want = grams(u, size)
            for s in range(max(1, len(w) - n + 1)):
                have = grams(w[s : s + n], size)
                j = sum((want & have).values()) / max(1, sum((want | have).values()))
                if j >= threshold and j > out.get((doc, item), (0,))[0]:
                    out[doc, item] = (j, s)
    return out


def test_contaminated_equals_brute_force(spark):
    draw = random.Random(8)
    items = [(k, prose(draw, draw.randint(6, 40))) for k in range(12)] + [(20, None), (21, "..."), (22, "Solo word"), (23, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    rows = corpus(3, 40)
    for k in range(10):
        words = items[k][1].split()
        if k % 3 == 0 and len(words) > 30:
            words[-1] = "other"
        rows.append((500 + k, prose(draw, 20) + "\n" + " ".join(words).upper() + ". " + prose(draw, 11)))
    rows += [(600, "Solo, word!"), (601, "alpha beta gamma delta epsilon zeta eta theta iota"), (602, items[0][1]), (603, None)]
    bench = make(spark, items, "item_id long, text string")
    got = decontam.contaminated(make(spark, rows).repartition(3), bench, slice_bytes=700)
    found = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got.collect()}
    want = brute_leaks(rows, items)
    assert {k for k, (j, _) in want.items() if j > 0.85} <= set(found) <= set(want)
    assert all(found[k] == want[k] for k in found)
    clean = decontam.without_contaminated(make(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in found}
    assert clean.columns == make(spark, rows).columns
    assert decontam.contaminated(make(spark, rows), bench.limit(0)).collect() == []


@pytest.mark.parametrize("n", [200, 3000])  # fewer and more items than there are probes
def test_multi_index_finds_all_within_radius(n):
    draw = random.Random(2)
    items = [(k, prose(draw, 25)) for k in range(n)]
    blocks = decontam.Index(items, 5, 31).blocks[25]
    for _ in range(60):
        code = blocks.codes[draw.randrange(n)]
        for bit in draw.sample(range(128), draw.randint(0, 40)):
            code ^= 1 << bit
        near = {k for k, p in enumerate(blocks.codes) if (p ^ code).bit_count() <= 31}
        by_blocks = {k for k, p in enumerate(blocks.codes) if any(((p ^ code) >> 16 * b & 0xFFFF).bit_count() <= 3 for b in range(8))}
        assert near <= set(blocks.candidates(code).tolist()) == by_blocks
    share = [len(blocks.candidates(draw.getrandbits(128))) / n for _ in range(60)]
    assert sum(share) / 60 < 0.12


def test_fingerprints_find_windows_from_the_threshold_up():
    """Of windows whose similarity is 0.8 to 0.85 at least 98 % are within the radius."""
    draw, near, all_of = random.Random(9), 0, 0
    for k in range(1500):
        words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        index = decontam.Index([(0, " ".join(words))], 5, 31)
        other = words[:]
        other[draw.choice([0, 1, 2, 3, 4, 55, 56, 57, 58, 59])] = "odd"
        other[draw.randrange(5, 55) if k % 2 else 0] = "even"
        h = decontam.Words(np.frombuffer(" ".join(other).encode(), np.uint8), np.array([0, len(" ".join(other))]), decontam.NON_WORD).hashes()
        shingles = decontam.window_hash(h, 5, 0x9FB21C651E98DF25)
        j = decontam.weighted_jaccard(np.unique(shingles, return_counts=True), index.sets[0])
        if 0.8 <= j <= 0.85:
            all_of += 1
            near += bool(index.near(60, decontam.fingerprint(shingles)))
    assert all_of > 300 and near >= 0.98 * all_of


# classifiers


def labelled(seed, n, bad):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        y = draw.random() < 0.4
        rows.append((k, bad(draw) if y else prose(draw, draw.randint(20, 90))))
        labels.append((k, int(y)))
    return rows, labels


def test_toxicity_learns_and_scores_all(spark):
    rows, labels = labelled(5, 500, lambda d: prose(d, 20) + f" you {d.choice(['vile', 'rotten'])} thing " + prose(d, 20))
    extra = [(900, None), (901, ""), (902, prose(random.Random(1), 4000))]
    marks = make(spark, [*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(make(spark, rows + extra), marks, bits=16).collect()}
    assert len(got) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and np.mean([r.predicted == y for r, y in held]) > 0.93
    assert got[900].score == got[901].score


def test_toxicity_without_labels(spark):
    out = toxicity.toxicity(make(spark, [(1, "x")]), make(spark, [], "doc_id long, toxic int"), bits=10).collect()
    assert [(r.score, r.predicted) for r in out] == [(0.5, 1)]
    assert toxicity.toxicity(make(spark, []), make(spark, [(1, 1)], "doc_id long, toxic int"), bits=10).collect() == []


def plain_ftrl(texts, labels, epochs=4, alpha=2.0, beta=1.0, l1=8.0, l2=0.1):
    """FTRL-proximal over words, pairs and pairs that skip a word, by name and without hashing; weight of a feature."""
    z, n = Counter(), Counter()

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for k, (text, y) in enumerate(zip(texts, labels, strict=True)):
            if k % 5 == 0:
                continue
            found = plain_features(text)
            w = {f: weight(f) for f in found}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in found:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return weight


def plain_features(text):
    w = re.findall("[a-z0-9\\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {"bias", *w, *((1, a, b) for a, b in zip(w, w[1:], strict=False)), *((2, a, b) for a, b in zip(w, w[2:], strict=False))}


def test_toxicity_equals_plain_ftrl(spark):
    def shuffled(x):  # splitmix64, the order that examples are learned in
        x = (x + 1) % (1 << 64)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x ^= x >> shift
            x = x * times % (1 << 64)
        return x

    draw = random.Random(71)
    rows = [(k, " ".join(draw.choice(["vile", "awful", "Hateful"] if k % 3 == 0 and draw.random() < 0.3 else ["calm", "tree", "river", "é", "walk"]) for _ in range(12))) for k in range(300)]
    labels = [(k, int(k % 3 == 0)) for k in range(300)]
    order = sorted(range(300), key=shuffled)
    weight = plain_ftrl([rows[k][1] for k in order], [labels[k][1] for k in order])
    raw = {k: sum(weight(f) for f in plain_features(t)) for k, t in rows}
    held = sorted((raw[k], labels[k][1]) for k in order[::5])
    errors = [sum(y for _, y in held[:m]) + sum(1 - y for _, y in held[m:]) for m in range(len(held) + 1)]
    least = [m for m, e in enumerate(errors) if e == min(errors)]
    m, edges = least[len(least) // 2], [held[0][0] - 1, *(r for r, _ in held), held[-1][0] + 1]
    cut = (edges[m] + edges[m + 1]) / 2
    model = toxicity.train(make(spark, [(k, t, float(labels[k][1])) for k, t in rows], "doc_id long, text string, label double"))
    texts = [*rows, (900, None), (901, ""), (902, "vile hateful " * 30_000), (5, rows[5][1])]
    got = [(r.doc_id, r.score) for r in toxicity.score(make(spark, texts), model).collect()]
    want = [(k, 1 / (1 + math.exp(-max(-35, min(35, sum(weight(f) for f in plain_features(t)) - cut))))) for k, t in texts]
    assert len(got) == len(want) and all(a == b and abs(x - y) < 1e-4 for (a, x), (b, y) in zip(sorted(got), sorted(want), strict=True))
    assert len({round(x, 6) for _, x in want}) > 20


def test_quality_learns_bradley_terry_weights(spark):
    """The pairs' logistic loss by plain loops over the same features, and scores by their quantile."""
    rows, labels = [], []
    draw = random.Random(72)
    for k in range(60):
        text = prose(draw, draw.randint(8, 40)) + (" ##!! @@ $$ junk" * draw.randint(1, 3) if k % 4 == 0 else ".")
        rows.append((k, text, int(k % 4 != 0)))
    model = quality.train(make(spark, rows, "doc_id long, text string, label int"), epochs=5)
    x = np.array([quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t, _ in rows])
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), -8, 8)
    rng = np.random.default_rng(11)
    good, bad = [k for k, r in enumerate(rows) if r[2]], [k for k, r in enumerate(rows) if not r[2]]
    pairs = list(zip(rng.choice(good, 480), rng.choice(bad, 480), strict=True))
    w, speed = [0.0] * quality.WIDTH, [0.0] * quality.WIDTH
    for _ in range(5):
        p = [1 / (1 + math.exp(sum((z[a][i] - z[b][i]) * w[i] for i in range(quality.WIDTH)))) for a, b in pairs]
        speed = [0.9 * speed[i] + 0.15 * (sum(q * (z[a][i] - z[b][i]) for q, (a, b) in zip(p, pairs, strict=True)) / 480 - 1e-4 * w[i]) for i in range(quality.WIDTH)]
        w = [v + s for v, s in zip(w, speed, strict=True)]
    assert np.allclose(model["w"], w, atol=1e-9)
    texts = [*[r[:2] for r in rows], (3, rows[3][1]), (900, None), (901, ""), (902, "many words here. " * 30_000)]
    got = sorted((r.doc_id, r.quality_score) for r in quality.score(make(spark, texts), model).collect())
    raw = {k: float(z[k] @ np.array(w)) for k in range(60)}
    assert len(got) == 64 and all((s >= 0.7) == (raw[k] >= model["cut"]) for k, s in got if k < 60)
    assert quality.score(make(spark, []), model).collect() == []
    named = quality.score(spark.createDataFrame([(1, "a b", 5.0)], "doc_id long, text string, Quality_Score double"), model, ("doc_id", "Quality_Score"))
    assert named.columns == ["doc_id", "quality_score"] and named.count() == 1


def test_quality_learns_from_all_labelled_rows(spark):
    """More labelled documents than the driver takes: means, weights and threshold are those of all of them, by plain loops."""
    draw = random.Random(73)
    words = [(prose(draw, 6), k % 5) for k in range(50)]
    rows = [(k, f"{t} {'## ' * (kind == 0)}{k % 13}" + "!" * (k % 7 == 0), int(kind != 0)) for k in range(17_500) for t, kind in [words[draw.randrange(50)]]]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(known) > quality.LOCAL_ROWS
    marks = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = quality.fit(make(spark, [r[:2] for r in rows]).repartition(3), marks, epochs=2)
    x = quality.features(*text_bytes(pa.array([t for _, t, _ in known])))
    assert np.allclose(model["mean"], x.mean(0), atol=1e-12) and np.allclose(model["scale"], np.maximum(x.std(0), 1e-3), atol=1e-12)
    raw, y = quality.weighed(quality.standard(x, model["mean"], model["scale"]), model["w"]), np.array([r[2] for r in known])
    wrong = [int((y[raw >= c] == 0).sum() + (y[raw < c] == 1).sum()) for c in [*np.unique(raw), np.inf]]
    assert (y[raw >= model["cut"]] == 0).sum() + (y[raw < model["cut"]] == 1).sum() == min(wrong)


def test_quality_blocks_have_every_row_and_both_classes(spark, monkeypatch):
    """Small blocks with three bad rows: all rows are owned once and paired, on the driver as on the executors."""
    from pyspark.sql import functions as F

    draw = random.Random(74)
    rows = [(k, prose(draw, draw.randint(5, 20)) + " ##!! junk" * (k in (7, 301, 302)), int(k not in (7, 301, 302))) for k in range(400)]
    monkeypatch.setattr(quality, "BLOCK", 90)
    df = make(spark, rows, "doc_id long, text string, label int")
    parts = quality._blocks(quality.styles(df, "doc_id", "label"), 397, 3)
    mean, scale = np.zeros(quality.WIDTH), np.ones(quality.WIDTH)
    paired = [quality._paired(p, mean, scale, 1) for p in parts]
    assert len(parts) == 5 and sum(p[2].sum() for p in parts) == 400 and all((p[1] == 0).sum() == 3 for p in parts)
    assert all(set(p[4]) | set(p[5]) == set(range(len(p[1]))) and (p[1][p[4]] > 0).all() and (p[1][p[5]] == 0).all() for p in paired)
    models = [quality.train(df, epochs=3, reject_share=share) for share in (None, 0.1)]
    w, speed = np.zeros(quality.WIDTH), np.zeros(quality.WIDTH)
    eight = [quality._paired(p, models[0]["mean"], models[0]["scale"], 8) for p in parts]
    for _ in range(3):
        d = np.concatenate([z[up] - z[down] for _, _, _, z, up, down in eight])
        speed = 0.9 * speed + 0.15 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-4 * w)
        w = w + speed
    assert np.allclose(models[0]["w"], w, atol=1e-9)
    monkeypatch.setattr(quality, "LOCAL_ROWS", 0)
    for one, share, pieces in zip(models, (None, 0.1), (2, 5), strict=True):
        other = quality.train(df.repartition(pieces, F.col("text")), epochs=3, reject_share=share)
        assert all(np.array_equal(one[k], other[k]) for k in one)


def test_quality_ranks_junk_below(spark):
    junk = [lambda d: "word!! " * d.randint(9, 60), lambda d: " ".join(w + d.choice(["###", "$$$"]) for w in prose(d, 40).split()), lambda d: " | ".join(prose(d, 40).split())]
    rows, labels = labelled(6, 400, lambda d: d.choice(junk)(d))
    marks = make(spark, [(k, 1 - y) for k, y in labels] + [(2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(make(spark, [*rows, (800, None), (801, ""), (802, "a")]), marks).collect()}
    held = [(got[d], 1 - y) for d, y in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([r.predicted == y for r, y in held]) > 0.97 and all(r.held_out for r, _ in held)
    assert got[800].score == got[801].score and all(0 <= r.score <= 1 for r in got.values())
    flat = quality.quality(make(spark, rows[:3]), marks.where("quality = 1")).collect()
    assert {(r.score, r.predicted) for r in flat} == {(0.7, 1)}


def segmentations(text, pieces):
    """Every way to cut a text into pieces; a character of no piece (number ``len(pieces)``) is one by itself."""
    if not text:
        yield []
    for j in range(1, len(text) + 1):
        p = pieces.get(text[:j], len(pieces) if j == 1 else None)
        if p is not None:
            for rest in segmentations(text[j:], pieces):
                yield [p, *rest]


def brute_likelihood(word, pieces, column):
    return sum(math.prod(column[p] for p in cut) for cut in segmentations(langid.MARK + word, pieces))


def slow_log_likelihood(word, pieces, column):
    """By the recurrence over ends, in logarithms."""
    text = langid.MARK + word
    log = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        terms = [log[i] + math.log(column[p]) for i in range(max(0, j - 40), j) if (p := pieces.get(text[i:j], len(pieces) if j == i + 1 else None)) is not None]
        top = max(terms, default=-math.inf)
        log[j] = top + math.log(sum(math.exp(t - top) for t in terms)) if terms else top
    return log[-1]


PIECES = {p: k for k, p in enumerate([langid.MARK, *(langid.MARK + a for a in ("a", "ab", "abc")), "a", "b", "c", "bc", "cab", "abab"])}


def test_likelihood_sums_all_segmentations():
    table = np.random.default_rng(1).random((len(PIECES) + 1, 3)) / 20
    words = ["a", "abcab", "cabab", "zab", "ababababab", "é", "zz"]
    got = langid.log_likelihoods(words, langid.Pieces(PIECES), table)
    for k, w in enumerate(words):
        assert np.allclose(got[k], [math.log(brute_likelihood(w, PIECES, table[:, c])) for c in range(3)])
    assert len(list(segmentations(langid.MARK + "ab", PIECES))) == 3


@pytest.mark.parametrize("letters", ["z", "ab", "abcz", "abab"])
def test_likelihood_of_words_of_any_length(letters):
    """Tiny probabilities, 1 to 200 letters and one of 20,000: neither underflow nor two ways that disagree."""
    table = np.column_stack([np.full(len(PIECES) + 1, 1e-9), np.full(len(PIECES) + 1, 2e-9), np.geomspace(1e-12, 1e-3, len(PIECES) + 1)])
    words = [(letters * 200)[:n] for n in range(1, 201)] + [(letters * 20_000)[:20_000]]
    together = langid.log_likelihoods(words, langid.Pieces(PIECES), table)
    for k in [*range(0, 200, 13), 35, 36, 39, 40, 199, 200]:
        want = [slow_log_likelihood(words[k], PIECES, table[:, c]) for c in range(3)]
        assert np.allclose(together[k], want, rtol=1e-9) and np.allclose(langid.log_likelihoods([words[k]], langid.Pieces(PIECES), table), want, rtol=1e-9)


def brute_expected(words, pieces, column):
    out = np.zeros(len(pieces) + 1)
    for word, n in words:
        whole = brute_likelihood(word, pieces, column)
        for cut in segmentations(langid.MARK + word, pieces):
            for p in cut:
                out[p] += n * math.prod(column[q] for q in cut) / whole
    return out


def test_expected_counts_equal_brute_force():
    draw = np.random.default_rng(2)
    table = draw.random((len(PIECES) + 1, 2))
    words = [("abcab", 2, 0), ("z", 1, 0), ("ababab", 3, 1), ("cab", 5, 1), ("a", 1, 1)]
    lattice = langid.Lattice([w for w, _, _ in words], langid.Pieces(PIECES))
    got = lattice.expected(table, np.array([c for _, _, c in words]), np.array([n for _, n, _ in words], float))
    for c in range(2):
        assert np.allclose(got[:, c], brute_expected([(w, n) for w, n, k in words if k == c], PIECES, table[:, c]))
    long = "z" * 64  # a word of unknown letters at 1e-9 does not vanish
    got = langid.Lattice([long], langid.Pieces(PIECES)).expected(np.full((len(PIECES) + 1, 1), 1e-9), np.zeros(1, int), np.ones(1))
    assert abs(got[len(PIECES), 0] - 64) < 1e-6 and abs(got[0, 0] - 1) < 1e-6


def test_long_words_are_scored_beside_the_cache():
    table = np.random.default_rng(5).random((len(PIECES) + 1, 2)) / 9
    model, pieces = {"langs": ["x", "y"], "table": table}, langid.Pieces(PIECES)
    scores, words = langid.WordScores(model, pieces), ["ab", "abc" * 30, "a", "abc" * 30, "z" * 41, "ab"]
    for _ in range(2):
        assert np.allclose(scores.rows(words), langid.log_likelihoods(words, pieces, table))
    assert set(scores.row) == {"ab", "a"} and len(scores.rows(["c" * 50])) == 1


def test_language_equals_brute_force(spark):
    """The whole query by enumeration of segmentations on a small corpus."""
    vocab = public_tokenizers.path("piece_bpe_32k.model")
    pieces = langid.vocabulary(vocab)
    assert langid.MARK in pieces
    draw = random.Random(7)
    rows = [(k, " ".join(draw.choice(["der", "und", "ach", "x"] if k % 2 else ["que", "les", "et", "x"]) for _ in range(4)) + draw.choice(["", " 12", "!"]), "de" if k % 2 else "fr") for k in range(24)]
    rows += [(100, None, "de"), (101, "", "fr"), (102, "7 !", None), (103, "Und", None), (104, "der", "fr"), (104, "der", "fr")]
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    words_of = lambda t: langid._LETTERS.findall((t or "").lower())
    columns = {}
    for lang in ("de", "fr"):
        counts = Counter(w for d, t, x in rows if x == lang and fold(d) != 2 for w in words_of(t))
        p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        for _ in range(2):
            p = brute_expected(counts.items(), pieces, p) + 0.1
            p /= p.sum()
        columns[lang] = p
    got = sorted(langid.language(make(spark, rows, "doc_id long, text string, lang string"), vocab).collect(), key=lambda r: r.doc_id)
    for r, (d, text, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        found = words_of(text)
        sums = {x: sum(math.log(brute_likelihood(w, pieces, c)) for w in found) / math.sqrt(max(1, len(found))) for x, c in columns.items()}
        e = {x: math.exp(v - max(sums.values())) for x, v in sums.items()}
        assert (r.doc_id, r.held_out, r.lang_pred) == (d, fold(d) == 2, max(sorted(e), key=e.get) if found else "und")
        assert abs(r.score - (max(e.values()) / sum(e.values()) if found else 0)) < 1e-9
    assert langid.language(make(spark, [], "doc_id long, text string, lang string"), vocab).collect() == []


def test_language(spark):
    draw = random.Random(3)
    kinds = {"xa": "ber ung lich schen der und".split(), "xb": "tion eau que les ment une".split()}
    rows = []
    for k in range(300):
        lang = draw.choice(list(kinds))
        rows.append((k, " ".join("".join(draw.choices(kinds[lang], k=draw.randint(1, 3))) for _ in range(30)), lang))
    rows += [(900, None, "xa"), (901, "123 ... !", "xb"), (902, rows[0][1].upper() * 50, None)]
    vocab = public_tokenizers.path("piece_bpe_32k.model")
    df = make(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language(df, vocab).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows[:300]) and got[902].lang_pred == rows[0][2]
    assert (got[900].lang_pred, got[901].lang_pred) == ("und", "und") and all(0 <= r.score <= 1 for r in got.values())
    none = langid.language(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"), vocab).collect()
    assert {r.lang_pred for r in none} == {"und"}


# line dedup


def test_increasing_and_patience():
    assert [[5, 1, 2, 9, 3][k] for k in linedup.increasing([5, 1, 2, 9, 3])] == [1, 2, 3]
    a, b = [1, 2, 3, 9, 4, 5], [7, 2, 3, 4, 5, 8]
    assert linedup.patience(a, b) == [(1, 1), (2, 2), (4, 3), (5, 4)]
    assert linedup.patience([], [1]) == [] and linedup.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]


def solid(line):
    return sum(c > 32 for c in line.encode())


def plain_patience(x, y):
    """Aligned positions of two lists of lines, from the definition: recursion on anchors, an increasing subsequence
    by dynamic programming (of equally long ones the one that ends, and goes on backwards, with the least positions)."""
    out = []
    while x and y and x[0][1] == y[0][1]:
        out.append((x[0][0], y[0][0]))
        x, y = x[1:], y[1:]
    tail = []
    while x and y and x[-1][1] == y[-1][1]:
        tail.append((x[-1][0], y[-1][0]))
        x, y = x[:-1], y[:-1]
    if x and y:
        here = {}
        for i, (_, line) in enumerate(x):
            if [z for _, z in x].count(line) == 1 and [z for _, z in y].count(line) == 1:
                here[line] = i
        both = [(here[line], j) for j, (_, line) in enumerate(y) if line in here]
        length, back = [], []
        for k, (i, _) in enumerate(both):
            before = [m for m in range(k) if both[m][0] < i]
            best = max((length[m] for m in before), default=0)
            length.append(best + 1)
            back.append(min((m for m in before if length[m] == best), key=lambda m: both[m][0], default=None))
        if both:
            k = min((k for k in range(len(both)) if length[k] == max(length)), key=lambda k: both[k][0])
            chain = []
            while k is not None:
                chain.append(both[k])
                k = back[k]
            i0 = j0 = 0
            for i, j in reversed(chain):
                out += plain_patience(x[i0:i], y[j0:j]) + [(x[i][0], y[j][0])]
                i0, j0 = i + 1, j + 1
            out += plain_patience(x[i0:], y[j0:])
    return sorted(out + tail)


def runs_of(lines, block_chars):
    """Shortest runs (start, stop) of lines with enough bytes: none that a shorter one with the same start or the same end is in."""
    out = set()
    for a in range(len(lines)):
        for b in range(a + 1, len(lines) + 1):
            size = [solid(x) for x in lines[a:b]]
            if sum(size) >= block_chars and (sum(size[:-1]) < block_chars or sum(size[1:]) < block_chars):
                out.add((a, b))
    return out


def brute_lines(rows, rare=64, block_chars=50):
    """Deleted positions of each document (with unique ids), by the definition and without any code of the operator."""
    docs = {doc: text.split("\n") for doc, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0])}
    first, out = {}, {}
    for doc, lines in docs.items():
        if first.setdefault(tuple(lines), doc) != doc:
            out[doc] = set(range(len(lines)))
    texts = {doc: docs[doc] for doc in first.values()}
    holders = {}
    for doc, lines in texts.items():
        for key in {("line", x) for x in lines if solid(x)} | {("run", *lines[a:b]) for a, b in runs_of(lines, block_chars)}:
            holders.setdefault(key, []).append(doc)
    for key, docs_of in holders.items():
        if len(docs_of) > rare and key[0] == "run":
            for doc in docs_of[1:]:
                for a, b in runs_of(texts[doc], block_chars):
                    if texts[doc][a:b] == list(key[1:]):
                        out.setdefault(doc, set()).update(range(a, b))
    for e, d in {p for docs_of in holders.values() if len(docs_of) <= rare for p in itertools.combinations(docs_of, 2)}:
        pairs = plain_patience(list(enumerate(texts[e])), list(enumerate(texts[d])))
        if len(pairs) == len(texts[d]):
            out.setdefault(d, set()).update(range(len(texts[d])))
        block = []
        for k, (x, y) in enumerate(pairs):
            block = [*block, y] if k and pairs[k - 1] == (x - 1, y - 1) else [y]
            if sum(solid(texts[d][i]) for i in block) >= block_chars:
                out.setdefault(d, set()).update(block)
    return {d: sorted(v) for d, v in out.items() if v}


def cut_lines(docs, rows, **options):
    """Deleted positions of each document, as the operator has them."""
    texts = {d: t for d, t in rows if t}
    return {r.id: list(range(len(texts[r.id].split("\n")))) if r.lines is None else list(r.lines) for r in linedup.deleted_lines(docs, **options).collect()}


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(12)
    shared = [[prose(draw, 12) for _ in range(draw.randint(2, 5))] for _ in range(6)]
    rows = []
    for k in range(80):
        lines = [prose(draw, draw.randint(1, 14)) for _ in range(draw.randint(1, 6))] + ["All rights reserved."] * draw.randint(0, 1)
        if draw.random() < 0.5:
            lines[draw.randrange(len(lines)) :] = draw.choice(shared) + ["", prose(draw, 5)]
        rows.append((k, "\n".join(lines)))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, None), (103, ""), (104, "\n\n"), (105, "one line"), (106, "one line"), (None, rows[4][1])]
    docs = make(spark, rows).repartition(4)
    got = cut_lines(docs, rows, rare=3)
    want = brute_lines(rows, rare=3)
    assert got == want and 100 in want and 106 in want
    out = linedup.line_dedup(docs, rare=3)
    assert out.columns == [*docs.columns, "n_lines", "n_removed_lines"]
    for r in out.collect():
        if r.doc_id is None:
            assert r.text == rows[4][1]
            continue
        text, gone = dict(rows)[r.doc_id], set(want.get(r.doc_id, ()))
        keep = text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert r.text == keep and r.n_removed_lines == len(gone) and r.n_lines == (len(text.split("\n")) if text else 0)
    assert linedup.line_dedup(make(spark, [])).collect() == []


def test_long_line_in_many_documents_is_deleted(spark):
    draw = random.Random(40)
    line, short = "a long passage on one line that very many documents hold in common", ["the first half of a passage, too short", "and the second half of that passage"]
    rows = [(k, "\n".join([prose(draw, 9), line, prose(draw, 9)])) for k in range(70)]
    rows += [(100 + k, "\n".join([prose(draw, 5), short[0], "", short[1], prose(draw, 5)])) for k in range(70)]
    assert cut_lines(make(spark, rows), rows) == brute_lines(rows) == {k: [1] for k in range(1, 70)} | {k: [1, 2, 3] for k in range(101, 170)}


@pytest.mark.parametrize("rare", [1, 3, 64])
def test_line_dedup_with_common_lines(spark, rare):
    draw = random.Random(41)
    common = [prose(draw, 13) for _ in range(5)] + ["share this page", "all rights reserved", ""]
    rows = [(k, "\n".join(draw.choice(common) if draw.random() < 0.7 else prose(draw, 9) for _ in range(draw.randint(1, 7)))) for k in range(120)]
    long, odd = prose(draw, 15), [prose(draw, 16), prose(draw, 17)]
    rows += [(200, "\n".join([prose(draw, 3), long, prose(draw, 3), long, prose(draw, 3)])), (201, prose(draw, 4) + "\n" + long), (202, long + "\n" + prose(draw, 4))]
    rows += [(210, "\n".join(odd)), (211, "\n".join([*odd[::-1], "end"])), (212, "\n".join([prose(draw, 2), *odd[::-1], "end"]))]
    rows += [(220, "\n".join(["x y", "short one", "z w"] * 2)), (221, "head\nshort one\ntail"), (222, "short one")]
    docs = make(spark, rows).repartition(3)
    got = cut_lines(docs, rows, rare=rare)
    assert got == brute_lines(rows, rare) and got[202] == [0] and (rare < 64 or got[222] == [0])


@pytest.mark.parametrize("holders", [64, 65])
def test_line_dedup_has_no_cliff_at_rare(spark, holders):
    draw = random.Random(43)
    line = "a passage of well over fifty bytes, which every one of these documents holds"
    rows = [(k, "\n".join([prose(draw, 9), line, prose(draw, 9)])) for k in range(holders)]
    assert cut_lines(make(spark, rows), rows, rare=64) == {k: [1] for k in range(1, holders)}


def test_line_dedup_pairs_with_every_earlier_holder(spark):
    a, b, c = (x * 3 for x in ("first shared passage ", "second shared passage ", "own words only "))
    two, three = (2, f"{a}\nx\n{b}"), (3, f"y\n{a}\nz\n{b}")
    alone = cut_lines(make(spark, [two, three]), [two, three])
    crossed = (1, f"{b}\n{c}\n{a}")
    assert alone == {3: [1, 3]} and cut_lines(make(spark, rows := [crossed, two, three]), rows)[3] == [1, 3]


def test_line_dedup_of_rows_that_share_an_id(spark):
    shared, own = "a line that two documents have in common, of over fifty bytes", "a sentence that no other document holds, whatever its number"
    rows = [(1, f"{shared}\nend"), (2, f"{shared}\nx"), (2, f"{own}\ny"), (2, f"{own}\ny")]
    out = sorted((r.doc_id, r.text, r.n_removed_lines) for r in linedup.line_dedup(make(spark, rows)).collect())
    assert out == sorted([(1, rows[0][1], 0), (2, "x", 1), (2, rows[2][1], 0), (2, rows[2][1], 0)])


def test_line_dedup_replaces_columns_named_like_its_counts(spark):
    df = spark.createDataFrame([(1, "x\ny", 5, 6, "a")], "doc_id long, text string, n_lines int, N_Removed_Lines int, weftline_id_0 string")
    out = linedup.line_dedup(df)
    assert out.columns == ["doc_id", "text", "weftline_id_0", "n_lines", "n_removed_lines"] and tuple(out.first()) == (1, "x\ny", "a", 2, 0)


def test_line_dedup_of_very_long_texts(spark):
    draw = random.Random(44)
    lines = [prose(draw, 9) for _ in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:9_000], "between", *lines[9_000:]])), (3, "word " * 300_000)]
    got = cut_lines(make(spark, rows), rows)
    assert got == {2: [*range(9_000), *range(9_001, 20_001)]}


# licenses


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    rows = [
        (1, "Released under the MIT License."), (2, "intro\nCopyright 2020 Me\n" + "Licensed under the Apache License,\tversion 2.0\nmore " * 1),
        (3, "Copyright (c) 2001 Some One\n" + mit.lower()), (4, "text\n\n" + mit.replace("Software", "Work", 1) + "\n\nmore text here"), (5, None), (6, ""),
        (7, "released under a license"), (8, "Released under the MIT License. Then other words follow it."), (9, prose(random.Random(1), 3000)), (None, "Licensed under CC BY-NC 4.0."),
    ]
    got = {(r.doc_id, r.license): (r.dice, r.unit) for r in licenses.scan(make(spark, rows)).collect()}
    want = {}
    for doc, text in rows:
        for kind, unit in licenses.units(text or ""):
            for name, texts in licenses.TEMPLATES.items():
                for t in texts:
                    d = licenses.dice(licenses.bigrams(unit), licenses.bigrams(t))
                    if d >= 0.9 and d > want.get((doc, name), (0,))[0]:
                        want[doc, name] = (d, kind)
    assert got == want
    assert {k[0] for k in got} == {1, 3, 4, 8, None} | ({2} if (2, "Apache-2.0") in got else set()) and got[8, "MIT"] == (1.0, "sentence")


def test_license_inside_a_longer_text(spark):
    draw = random.Random(50)
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][1]
    cut = [mit.replace(mark, "\n\n" + mark) for mark in ("The above copyright",)][0].replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    rows = [
        (1, prose(draw, 60) + "\n\n" + cut + "\n\n" + prose(draw, 60)), (2, prose(draw, 80) + " " + mit + " " + prose(draw, 80)),
        (3, "# " + apache.replace(". ", ".\n# ") + "\nimport os\n" + prose(draw, 70)), (4, "Copyright (c) 2001 Some One. " + mit), (5, prose(draw, 300)),
    ]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(make(spark, rows)).collect()}
    assert {(1, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (4, "MIT")} <= set(got) and min(got.values()) > 0.99 and 5 not in {d for d, _ in got}


def test_whole_license_files(spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause"]
    rows = [(k, "Some words first.\n\n" + licenses.TEMPLATES[name][-1] + "\n\nand after") for k, name in enumerate(names)]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(make(spark, rows)).collect()}
    assert all(got.get((k, name), 0) > 0.99 for k, name in enumerate(names))


def test_best_window_equals_brute_force():
    draw = random.Random(51)
    for _ in range(60):
        template, words = draw.choices("abc", k=draw.randint(3, 9)), draw.choices("abcd", k=draw.randint(3, 30))
        table, text = licenses.Templates({"x": [" ".join(template)]}), " ".join(words)
        spans = [licenses.dice(licenses.bigrams(" ".join(words[i:j])), licenses.bigrams(" ".join(template))) for i, j in itertools.combinations(range(len(words) + 1), 2)]
        got = max((d for _, d, _ in table.windows(text, 0.6)), default=0)
        assert abs(got - (max(spans) if max(spans) >= 0.6 else 0)) < 1e-12


# substring dedup


def brute_substring(rows, size):
    least = {}
    for doc, text in rows:
        w = ascii_words(text)
        if doc is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                least[k] = min(least.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = ascii_words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if doc is not None and least[tuple(w[i : i + size])] < doc:
                gone |= set(range(i, i + size))
        out.append((doc is not None, doc or 0, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize(("size", "bits"), [(50, 24), (5, 12), (2, 6)])
def test_substring_equals_brute_force(spark, size, bits):
    rows = corpus(4)
    rows += [(None, rows[5][1]), (None, None), (rows[0][0], rows[20][1] or "x")]
    docs = make(spark, rows).repartition(3)
    got = substring.substring_dedup(docs, size, bits=bits, block_bytes=400, shard_windows=500).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == brute_substring(rows, size)


def test_substring_digest_and_empty(spark):
    import hashlib

    assert substring.substring_digest(make(spark, [])).collect() == []
    (r,) = substring.substring_digest(make(spark, [(1, " a\n b ")])).collect()
    assert (r.n_words, r.n_removed, r.kept) == (2, 0, hashlib.sha256(b"a b").hexdigest())


# minhash


def brute_near(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.decode()) for x in ascii_words(text)]
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), root(d), root(d) == d) for d in sorted(sets)]


@pytest.mark.parametrize(("size", "percent", "members"), [(3, 85, 256), (5, 80, 4)])
def test_near_duplicates_equal_brute_force(spark, size, percent, members):
    draw = random.Random(21)
    rows = corpus(7)
    base = prose(draw, 200).split()
    for k in range(30):  # a group of near copies that is cut into blocks of members
        w = list(base)
        for _ in range(draw.randint(0, 8)):
            w[draw.randrange(len(w))] = draw.choice(SYLLABLES)
        rows.append((1000 + k, " ".join(w)))
    got = minhash.near_duplicates(make(spark, rows).repartition(3), size, percent, members)
    assert sorted(tuple(r) for r in got.collect()) == brute_near(rows, size, percent)


def test_near_duplicates_cases(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, "A  b\tC d"), (3, None), (4, ""), (5, "a"), (6, "a"), (7, "a b"), (5, "a")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make(spark, rows), 3, 85).collect()}
    assert got == {(None, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True)}
    assert minhash.near_duplicates(make(spark, []), 3, 85).collect() == []


@pytest.mark.parametrize("stars", [True, False])
def test_near_duplicates_settle_in_stars_or_blocks(spark, stars):
    """A chain in which only neighbours are alike, beside copies of one text with a word changed."""
    draw = random.Random(61)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(50)]
    base = [f"b{k}" for k in range(90)]
    for k in range(100, 160):
        text = base[:]
        text[draw.randrange(90)] = f"odd{k}"
        rows.append((k, " ".join(text)))
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make(spark, rows).repartition(3), 3, 85, members=16, stars=stars).collect()}
    assert sorted(got.values()) == sorted(brute_near(rows, 3, 85))


def test_near_duplicates_ship_a_linear_number_of_sets(spark, monkeypatch):
    """5,000 different near copies: rows that meet in comparisons stay a small multiple of the members."""
    draw = random.Random(62)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(5_000):
        text = base[:]
        text[draw.randrange(150)] = f"odd{k}"
        rows.append((k, " ".join(text)))
    made, plain = [], minhash._Finder.confirm_blocks
    monkeypatch.setattr(minhash._Finder, "confirm_blocks", lambda self, left, *rest: made.append(left.count()) or plain(self, left, *rest))
    stars = minhash._Finder.confirm_stars
    monkeypatch.setattr(minhash._Finder, "confirm_stars", lambda self, pairs, sets: made.append(pairs.count()) or stars(self, pairs, sets))
    out = minhash.near_duplicates(make(spark, rows).repartition(8), 5, 80)
    assert {r.component_id for r in out.select("component_id").distinct().collect()} == {0} and sum(made) <= 30 * len(rows)


def test_first_of_group_acts_on_rows(spark):
    one, other = prose(random.Random(63), 40), prose(random.Random(64), 40)
    near = one.rsplit(" ", 1)[0] + " changed"
    rows = [(1, one, 1), (2, one, 2), (2, other, 3), (2, other, 3), (3, near, 4), (None, one, 5), (4, None, 6), (5, "", 7), (5, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, weftline_part_0 int")
    got = [tuple(r) for r in minhash.first_of_group(df).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], *rows[5:]], key=str)


def test_tables_meet_their_miss_rate():
    for percent in (80, 85):
        t = minhash.Tables(percent / 100)
        j = percent / 100
        miss = 1 - (1 - (1 - j**t.rows_a) ** t.a) * (1 - (1 - j**t.rows_b) ** t.b)
        assert miss <= 3e-4
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 52, 4000, dtype=np.uint64)
    a, b = pool[:900], pool[100:1000]  # similarity 0.8
    s = minhash.Tables(0.8).sketches(np.concatenate([a, b]), np.array([0, 900, 1800]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.2


def test_links_of_a_block_equal_brute_force():
    from weftline.llm import minhash

    draw = np.random.default_rng(4)
    base = [np.unique(draw.integers(0, 400, 120)).astype(np.uint64) for _ in range(12)]
    sets = []
    for _ in range(300):
        s = set(base[draw.integers(12)].tolist())
        for _ in range(draw.integers(0, 14)):
            s ^= {int(draw.integers(0, 400))}
        sets.append(np.array(sorted(s), np.uint64))
    sets += [np.zeros(0, np.uint64), np.arange(5, dtype=np.uint64) + np.uint64(1 << 50)]
    linked = minhash.confirmed(sets, 85)
    plain = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert i == j or linked[i, j] == (100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])), (i, j)
    lead = list(range(len(sets)))
    for _ in range(len(sets)):
        for i in range(len(sets)):
            lead[i] = min(lead[j] for j in range(len(sets)) if linked[i, j] or i == j)
    assert minhash.spanning(linked).tolist() == lead and len(set(lead)) < 200
