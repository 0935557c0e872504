"""The stages of the corpus pipeline in turn, against brute force on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import brute_leaks, brute_lines, brute_near, check_packing, prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(31)
    items = [(k, prose(draw, 30)) for k in range(6)]
    rows, labels = [], []
    for k in range(260):
        text = "\n".join(prose(draw, draw.randint(10, 60)) for _ in range(draw.randint(1, 5)))
        bad = k % 5 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split())
        labels.append((k, int(not bad), 0))
        rows.append((k, text))
    for k in range(40, 52):
        rows[k] = (k, rows[k][1] if k % 5 == 0 else rows[k][1] + "\n" + items[k % 6][1])
    rows += [(300 + k, rows[k][1]) for k in range(1, 30, 3)]
    for k in range(61, 99, 4):
        words = rows[k][1].split(" ")
        words[len(words) // 2] = "odd"
        rows.append((400 + k, " ".join(words)))
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows, items


def test_stages(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_filter", "line_dedup", "near_dedup", "decontaminate", "pack"]
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    good = stages["quality_filter"](spark, docs, d)
    kept = pairs(good)
    assert good.columns == names and sorted(kept) == sorted((k, t) for k, t in rows if "###" not in t)

    lined = stages["line_dedup"](spark, good, d)
    gone = brute_lines(kept)
    want = []
    for k, t in kept:
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ()))
        if not (k in gone and not rest.strip()):
            want.append((k, rest))
    assert lined.columns == names and sorted(pairs(lined)) == sorted(want) and len(want) < len(kept)

    single = stages["near_dedup"](spark, lined, d)
    left = {k for k, _, _, keep in brute_near(want, 5, 80) if keep}
    assert single.columns == names and sorted(pairs(single)) == sorted((k, t) for k, t in want if k in left)

    clean = stages["decontaminate"](spark, single, d)
    leaks = {k for k, _ in brute_leaks(pairs(single), items)}
    assert leaks and sorted(pairs(clean)) == sorted((k, t) for k, t in pairs(single) if k not in leaks)

    packed = stages["pack"](spark, clean, d).collect()
    check_packing(pairs(clean), packed, 2048)
    whole = corpus_pipeline.run(spark, d).collect()
    assert sorted(r[:5] for r in map(tuple, whole)) == sorted(r[:5] for r in map(tuple, packed))


def test_stages_with_odd_rows(spark, folder):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing names and an empty table in every stage."""
    d, rows, items = folder
    draw = random.Random(32)
    long = "\n".join(prose(draw, 12) for _ in range(8_000))
    one, near, other = rows[1][1], rows[1][1].rsplit(" ", 1)[0] + " changed", prose(draw, 60)
    odd = [(1, one), (2, one), (2, other), (3, None), (4, ""), (None, one), (None, None), (5, long), (6, long + "\nend"), (7, near), (7, near), (8, "word"), (9, items[0][1]), (10, items[0][1])]
    clash = dict.fromkeys("quality_score n_removed_lines n_lines _dropped part id lines component_id weftline_id_0 weftline_score_0 weftline_removed_0".split(), 7)
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *clash.values()) for k, t in odd], schema)
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name, stage in stages.items():
        out, none = stage(spark, docs, d), stage(spark, docs.limit(0), d)
        assert none.collect() == []
        if name != "pack":
            assert out.columns == none.columns == docs.columns and {r.quality_score for r in out.collect()} <= {7}
    cut = pairs(stages["line_dedup"](spark, docs, d))
    assert (2, other) in cut and (5, long) in cut and (3, None) in cut and (None, one) in cut and not any(k == 10 for k, _ in cut) and (2, one) not in cut
    single = pairs(stages["near_dedup"](spark, docs, d))
    assert single == sorted([(1, one), (2, other), (3, None), (4, ""), (None, one), (None, None), (5, long), (8, "word"), (9, items[0][1])], key=str)
    clean = pairs(stages["decontaminate"](spark, docs, d))
    assert clean == sorted(((k, t) for k, t in odd if k not in (9, 10)), key=str)
    assert len([r for r in stages["pack"](spark, docs, d).collect() if r.piece == 0]) == len(odd)
