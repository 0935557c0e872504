"""The writer of compressed graphs: the same codes as the scalar encoder, and pieces joined at any bit."""

import random

import numpy as np
import pytest

from weftline.plans import registry
from weftline.plans.graph import Graph
from weftline.sinks import compressed
from weftline.sources import bitio, bvgraph


def lists(draw, n):
    """Adjacency with copied lists, intervals, hubs and vertices without edges."""
    out = []
    for v in range(n):
        kind, row = draw.random(), set()
        if kind < 0.4 and out and out[-1]:
            row |= set(draw.sample(out[-1], draw.randint(1, len(out[-1]))))
        if kind < 0.7:
            row |= {draw.randrange(n) for _ in range(draw.randint(0, 6))}
        if kind > 0.85:
            start = draw.randrange(n)
            row |= set(range(start, min(n, start + draw.randint(3, 9))))
        out.append(sorted(row))
    if n > 12:
        out[9], out[10] = list(range(0, n, 2)), list(range(n))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_codes_are_those_of_the_scalar_encoder(seed):
    draw = random.Random(seed)
    n, size, most, least, k = draw.randint(1, 150), draw.randint(0, 9), draw.randint(0, 4), draw.randint(0, 6), draw.randint(1, 6)
    rows, recent, depth, parts = lists(draw, n), {}, {}, []
    for x, row in enumerate(rows):
        bits, r = bvgraph.encode_vertex(x, row, recent, depth, size, most, least, k)
        recent[x], depth[x] = row, depth[x - r] + 1 if r else 0
        recent.pop(x - size, None)
        parts.append(bits)
    raw, lengths = bvgraph.encode_vertices(0, np.array([len(r) for r in rows]), np.array(sum(rows, []), np.int64), size, most, least, k)
    assert lengths.tolist() == [len(p) for p in parts]
    assert raw == bitio.bytes_of("".join(parts))


def test_repeated_successors_are_refused():
    with pytest.raises(ValueError, match="twice"):
        bvgraph.encode_vertices(0, np.array([2]), np.array([5, 5]))


def test_pieces_join_at_any_bit(tmp_path):
    draw = random.Random(2)
    sizes = [draw.choice([0, 1, 2, 3, 7, 8, 9, 30]) for _ in range(300)]
    texts = ["".join(draw.choice("01") for _ in range(n)) for n in sizes]
    path = tmp_path / "x"
    path.write_bytes(bytes(-(-sum(sizes) // 8)))
    ends, at = {}, 0
    with open(path, "r+b", buffering=0) as f:
        for s in texts:
            for byte, value in compressed.place(f.fileno(), bitio.bytes_of(s), len(s), at):
                ends[byte] = ends.get(byte, 0) | value
            at += len(s)
    raw = bytearray(path.read_bytes())
    for byte, value in ends.items():
        assert raw[byte] == 0
        raw[byte] = value
    assert bytes(raw) == bitio.bytes_of("".join(texts))


@pytest.mark.parametrize(("slice_edges", "span"), [(1, 1 << 20), (50, 7), (1 << 18, 1 << 20)])
def test_files_of_many_pieces(spark, tmp_path, monkeypatch, slice_edges, span):
    monkeypatch.setattr(compressed, "SPAN", span)
    draw = random.Random(slice_edges)
    rows = [[], [], *lists(draw, 120), *[[]] * 30, [3, 4], *[[]] * 9]
    flat = [(s, d, draw.choice([0, 1, 77, 2**31 + 5])) for s, row in enumerate(rows) for d in row]
    links = spark.createDataFrame(draw.sample(flat, len(flat)), "src long, dst long, weight long")
    assert compressed.write_compressed(links, len(rows), f"{tmp_path}/g", 3, f"{tmp_path}/w", slice_edges=slice_edges) == len(flat)
    got = Graph.open(spark, f"{tmp_path}/w", "wg404")
    assert sorted(tuple(r) for r in got.edges.select("edge_idx", "src", "dst", "weight").collect()) == [(k, *e) for k, e in enumerate(flat)]
    assert [r.offset for r in got.offset_rows().orderBy("v").collect()] == [0, *np.cumsum([len(r) for r in rows]).tolist()]
    codes = bvgraph.Codes(bvgraph.read_properties(f"{tmp_path}/g"))
    # .offsets says what a pass over the graph itself finds, and the pieces are gone
    for i in (0, 1):
        a, b = (np.concatenate([p[i] for p in f(f"{tmp_path}/g", codes)]).tolist() for f in (bvgraph._indexed_pass, bvgraph._scalar_pass))
        assert a == b
    assert not list(tmp_path.glob("*pieces*"))
    with pytest.raises(ValueError, match="below"):
        compressed.write_compressed(links, 100, f"{tmp_path}/h")


def test_graph_without_edges(spark, tmp_path):
    for n in (0, 5):
        compressed.write_compressed(spark.createDataFrame([], "src long, dst long"), n, f"{tmp_path}/e{n}")
        g = Graph.open(spark, f"{tmp_path}/e{n}")
        assert g.edges.count() == 0 and [r.offset for r in g.offset_rows().collect()] == [0] * (n + 1)


def test_no_edge_passes_the_driver(spark, monkeypatch):
    """Rows that are streamed to the driver were most of what these queries sent there."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows are streamed to the driver"))
    assert registry.compressed(spark, "/root/testdata/sf0.001", "wg404").num_edges == 4292
