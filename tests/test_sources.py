"""Codes, compressed graphs, the data source, sinks and asynchronous reads."""

import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.plans.graph import Graph
from weftline.sinks import binary, text
from weftline.sources import bitio, bvgraph, sequence
from weftline.sources.properties import parse_properties


@given(st.lists(st.integers(0, 1 << 40), max_size=20), st.integers(1, 6))
def test_codes_round_trip(values, k):
    for write, read in ((bitio.write_gamma, bitio.read_gamma), (bitio.write_delta, bitio.read_delta), (lambda n: bitio.write_zeta(n, k), lambda s, at: bitio.read_zeta(s, at, k))):
        s = "".join(map(write, values))
        raw, at = bitio.bits_of(bitio.bytes_of(s)), 0
        for v in values:
            got, at = read(raw, at)
            assert got == v
        assert at == len(s)


def test_codes_by_hand():
    assert [bitio.write_gamma(n) for n in range(5)] == ["1", "010", "011", "00100", "00101"]
    assert [bitio.write_zeta(n, 3) for n in (0, 1, 2, 6)] == ["100", "1010", "1011", "1111"]
    assert [bitio.write_unary(n) for n in (0, 3)] == ["1", "0001"]
    assert [bitio.from_nat(bitio.to_nat(n)) for n in range(-5, 6)] == list(range(-5, 6))


def adjacency(draw, n):
    out = []
    for v in range(n):
        kind = draw.random()
        row = set()
        if kind < 0.3 and out and out[-1]:
            row |= set(draw.sample(out[-1], draw.randint(1, len(out[-1]))))
        if kind < 0.7:
            row |= {draw.randrange(n) for _ in range(draw.randint(0, 6))}
        if kind > 0.8:
            start = draw.randrange(n)
            row |= set(range(start, min(n, start + draw.randint(3, 9))))
        out.append(sorted(row))
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(0, 7), st.integers(0, 4))
def test_graph_round_trip(tmp_path_factory, seed, n, window, interval):
    rows = adjacency(random.Random(seed), n)
    base = str(tmp_path_factory.mktemp("g") / "g")
    bvgraph.encode(base, n, rows, window, 3, interval)
    index = bvgraph.index_files(base)
    assert np.fromfile(index["csx"], "<u8").tolist() == np.cumsum([0, *map(len, rows)]).tolist()
    for first in {0, n // 2, n - 1}:
        degree, flat = bvgraph.Reader(base, index).successors(first, n)
        assert degree.tolist() == [len(r) for r in rows[first:]] and flat.tolist() == sum(rows[first:], [])


def test_offsets_bootstrap_and_side_folder(tmp_path):
    rows = adjacency(random.Random(1), 40)
    bvgraph.encode(str(tmp_path / "g"), 40, rows)
    before = (tmp_path / "g.offsets").read_bytes()
    os.remove(tmp_path / "g.offsets")
    index = bvgraph.index_files(str(tmp_path / "g"), str(tmp_path / "side"))
    assert (tmp_path / "side" / "g.offsets").read_bytes() == before
    assert index["csx"].startswith(str(tmp_path / "side"))


def test_properties():
    got = parse_properties("#c\n nodes = 5\narcs:14\n\n! x\nempty=\n")
    assert got == {"nodes": "5", "arcs": "14", "empty": ""}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    draw = random.Random(11)
    rows = adjacency(draw, 120)
    folder = tmp_path_factory.mktemp("graphs")
    bvgraph.encode(str(folder / "g"), 120, rows)
    weights = [[draw.choice([0, 1, 77, 2**31 + 5, 2**32 - 1]) for _ in r] for r in rows]
    bvgraph.encode_labels(str(folder / "w"), str(folder / "g"), weights)
    bvgraph.encode_labels(str(folder / "f"), str(folder / "g"), weights, 32)
    flat = [(s, d, w) for s, (r, ws) in enumerate(zip(rows, weights, strict=True)) for d, w in zip(r, ws, strict=True)]
    return str(folder), flat


def collect(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_scan_any_block_size(spark, files, block):
    folder, flat = files
    g = Graph.open(spark, f"{folder}/g", "wg400")
    g.block_edges = block if block > 1 else 3
    want = [(k, s, d) for k, (s, d, _) in enumerate(flat)]
    assert collect(g.edges, "edge_idx", "src", "dst") == want
    assert (g.num_vertices, g.num_edges, g.path) == (120, len(flat), f"{folder}/g")


def test_weights_and_types(spark, files):
    folder, flat = files
    for name in ("w", "f"):
        g = Graph.open(spark, f"{folder}/{name}", "wg404")
        assert collect(g.edges, "edge_idx", "src", "dst", "weight") == [(k, *e) for k, e in enumerate(flat)]
    bare = Graph.open(spark, f"{folder}/w", "wg404", withWeights="false")
    assert bare.edges.columns == ["src", "edge_idx", "dst"]
    assert Graph.open(spark, f"{folder}/g", "wg800").edges.count() == len(flat)
    with pytest.raises(FileNotFoundError):
        Graph.open(spark, f"{folder}/none", "wg400")
    with pytest.raises(ValueError):
        Graph.open(spark, f"{folder}/g", "wg401")


def test_filters_reach_the_source(spark, files):
    folder, flat = files
    g = Graph.open(spark, f"{folder}/g", "wg400", blockEdges=16)
    want = [(k, s, d) for k, (s, d, _) in enumerate(flat)]
    few = g.edges.where("src >= 30 AND src < 34")
    assert collect(few, "edge_idx", "src", "dst") == [r for r in want if 30 <= r[1] < 34]
    assert collect(g.edges.where("edge_idx > 10 AND edge_idx <= 20 AND dst % 2 = 0"), "edge_idx", "src", "dst") == [r for r in want if 10 < r[0] <= 20 and r[2] % 2 == 0]
    assert collect(g.edges.where("src IN (3, 90)"), "edge_idx", "src", "dst") == [r for r in want if r[1] in (3, 90)]
    assert collect(g.edges.where("src = 500"), "src") == []
    narrow = spark.read.format("csx").options(path=f"{folder}/g", blockEdges=4).load()
    assert narrow.where("edge_idx < 8").rdd.getNumPartitions() == 2


def test_async_read(spark, files):
    folder, flat = files
    g = Graph.open(spark, f"{folder}/g", "wg400")
    g.block_edges, g.max_blocks_in_flight = 50, 2
    got = []
    request = g.read_async(lambda batch, _: got.extend((r.block, r.edge_idx, r.dst) for r in batch.collect()), 2, 1, 100, 3)
    lo, hi = g.edge_range(2, 1, 100, 3)
    request.wait(120)
    assert request.status == 1 and request.edges_read == hi - lo and request.total_blocks == -(-(hi - lo) // 50)
    assert sorted(got) == [((k - lo) // 50, k, flat[k][1]) for k in range(lo, hi)]
    assert g.read_async(lambda *_: None, 120 - 1, 10**6).wait(10).status == 1


def test_async_failure(spark, files):
    g = Graph.open(spark, f"{files[0]}/g", "wg400")

    def fails(batch, _):
        raise KeyError("mine")

    request = g.read_async(fails)
    began = time.time()
    while request.status == 0 and time.time() - began < 60:
        time.sleep(0.1)
    assert request.status == -1
    with pytest.raises(RuntimeError):
        request.wait(5)
    request.release()


def test_binary_sinks(spark, files, tmp_path):
    folder, flat = files
    g = Graph.open(spark, f"{folder}/w", "wg404")
    off = np.cumsum(np.bincount([s for s, _, _ in flat], minlength=120)).tolist()
    dst, n = [d for _, d, _ in flat], len(flat)
    binary.write_csx(g.edges, g.offset_rows(), 120, n, str(tmp_path / "a.bin"))
    raw = (tmp_path / "a.bin").read_bytes()
    assert np.frombuffer(raw[: 8 * 123], "<u8").tolist() == [120, n, 0, *off] and np.frombuffer(raw[8 * 123 :], "<u4").tolist() == dst
    binary.write_g3(g.edges, g.offset_rows(), 120, n, str(tmp_path / "a.g3_bin"))
    raw = (tmp_path / "a.sg").read_bytes()
    assert np.frombuffer(raw[: 8 * 129], "<u8").tolist() == [3, 1, 120, n, 4, 8, 0, 0, 0, *off] and np.frombuffer(raw[8 * 129 :], "<u4").tolist() == dst
    binary.write_weighted(g.edges, n, str(tmp_path / "a.w"))
    assert np.fromfile(tmp_path / "a.w", "<u4").reshape(-1, 2).tolist() == [[d, w] for _, d, w in flat]
    with pytest.raises(ValueError):
        binary.write_csx(g.edges, g.offset_rows(), (1 << 32) + 1, n, str(tmp_path / "b"))
    wide = spark.createDataFrame([(0, 0, 1 << 33)], "src long, edge_idx long, dst long")
    with pytest.raises(Exception, match="4 bytes"):
        binary.write_csx(wide, spark.createDataFrame([(0, 0), (1, 1)], "v long, offset long"), 1, 1, str(tmp_path / "c"))


def test_text_sinks(spark, files, tmp_path):
    folder, flat = files
    g = Graph.open(spark, f"{folder}/g", "wg400")
    text.write_lines(text.el_lines(g.edges), str(tmp_path / "el"), 3)
    lines = [x for p in sorted((tmp_path / "el").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [f"{s} {d}" for s, d, _ in flat]
    adj = sorted((r.pos, r.line) for r in text.adj_lines(g.edges, g.offset_rows(), 120, len(flat)).collect())
    assert [x for _, x in adj][:3] == ["AdjacencyGraph", "120", str(len(flat))] and len(adj) == 3 + 120 + len(flat)


def test_sequence_scan(spark, tmp_path):
    path, n = str(tmp_path / "s"), 300_000
    sequence.write_sequence(spark, path, n, 1 << 15)
    for method in sequence.METHODS:
        got = sequence.bandwidth(spark, path, 1 << 17, method, 3, rounds=1)
        assert got["right"] and got["min"] <= got["avg"] <= got["max"]


def test_text_edge_lists(spark, tmp_path):
    from weftline.sources.coo import read_edge_list, read_matrix_market

    (tmp_path / "e.el").write_text("# made by hand\n0 1\n\n0 2\n1\t2\n3 3\n")
    assert collect(read_edge_list(spark, str(tmp_path / "e.el")), "row", "src", "dst") == [(0, 0, 1), (1, 0, 2), (2, 1, 2), (3, 3, 3)]
    assert collect(read_edge_list(spark, str(tmp_path / "e.el"), start_row=1, end_row=3), "row", "src", "dst") == [(1, 0, 2), (2, 1, 2)]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n4 4 3\n1 2 7\n4 4 9\n2 1 1\n")
    edges, vertices, entries = read_matrix_market(spark, str(tmp_path / "m.mtx"), 0, 2)
    assert (vertices, entries) == (4, 3) and collect(edges, "row", "src", "dst", "weight") == [(0, 0, 1, 7), (1, 3, 3, 9)]
    many = "\n".join(f"{k} {k + 1}" for k in range(5000))
    (tmp_path / "big.el").write_text(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert collect(read_edge_list(spark, str(tmp_path / "big.el")), "row", "src") == [(k, k) for k in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_short_writes_are_continued(tmp_path, monkeypatch):
    import os

    from weftline.sinks import binary

    real = os.pwrite
    monkeypatch.setattr(os, "pwrite", lambda f, data, at: real(f, bytes(data)[:3], at))
    path = tmp_path / "x"
    path.write_bytes(b"\0" * 20)
    with open(path, "r+b") as f:
        binary.put(f.fileno(), b"0123456789", 5)
    assert path.read_bytes() == b"\0" * 5 + b"0123456789" + b"\0" * 5


@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 1 << 40)), min_size=1, max_size=120), st.integers(1, 6), st.integers(0, 9))
def test_codes_side_by_side(values, k, shift):
    from weftline.sources import bitvec

    for kind, write in (("GAMMA", bitio.write_gamma), ("DELTA", bitio.write_delta), ("ZETA", lambda n: bitio.write_zeta(n, k)), ("UNARY", lambda n: bitio.write_unary(n % 300))):
        want = [v % 300 if kind == "UNARY" else v for v in values]
        codes = ["0" * shift, *map(write, values)]
        bits = bitvec.Bits(bitio.bytes_of("".join(codes)))
        starts = np.cumsum([len(c) for c in codes])
        got, behind = bits.reader(kind, k)(starts[:-1])
        assert got.tolist() == want and behind.tolist() == starts[1:].tolist()
        counts = np.array([len(values) - i for i in range(len(values))])
        for few in (1, 32):
            got, behind = bitvec.runs(bits.reader(kind, k), starts[:-1], counts, few)
            assert got.tolist() == [v for i in range(len(want)) for v in want[i:]] and set(behind.tolist()) == {int(starts[-1])}


def test_codes_of_a_file_in_pieces(tmp_path):
    from weftline.sources import bitvec

    draw = random.Random(3)
    values = [draw.choice([0, 5, draw.randrange(1 << 33)]) for _ in range(700)]
    (tmp_path / "x").write_bytes(bitio.bytes_of("".join(map(bitio.write_gamma, values))))
    for size in (1, 13, 1 << 16):
        assert np.concatenate(list(bitvec.values_of_file(str(tmp_path / "x"), 700, "GAMMA", size=size))).tolist() == values
    with pytest.raises(ValueError, match="early"):
        list(bitvec.values_of_file(str(tmp_path / "x"), 800, "GAMMA"))


def test_index_is_the_same_with_and_without_offsets(tmp_path, monkeypatch):
    rows = adjacency(random.Random(5), 500)
    rows[7] = list(range(0, 500, 3))
    bvgraph.encode(str(tmp_path / "g"), 500, rows)
    codes = bvgraph.Codes(bvgraph.read_properties(str(tmp_path / "g")))
    fast = list(bvgraph._indexed_pass(str(tmp_path / "g"), codes))
    slow = list(bvgraph._scalar_pass(str(tmp_path / "g"), codes, size=64, rows=50))
    for i in (0, 1):
        assert np.concatenate([p[i] for p in fast]).tolist() == np.concatenate([p[i] for p in slow]).tolist()
    monkeypatch.setattr(os, "access", lambda *_: False)
    with pytest.raises(PermissionError, match="sideDir"):
        bvgraph.index_files(str(tmp_path / "g"))


def test_cold_scans_and_sweep(spark, tmp_path):
    path, n = str(tmp_path / "s.bin"), 300_001
    sequence.write_sequence(spark, path, n, 1 << 16)
    got = sequence.sweep(spark, path, [1 << 20, 4096 * 5], [3], ("mmap", "read"), 1)
    assert [(r["block_bytes"], r["method"]) for r in got] == [(b, m) for b in (1 << 20, 20480) for m in ("mmap", "read")]
    assert all(r["right"] and 0 < r["min"] <= r["max"] for r in got)
    try:
        os.close(os.open(path, os.O_RDONLY | os.O_DIRECT))
    except OSError:
        pytest.skip("the file system has no direct reads")
    assert sequence.bandwidth(spark, path, 1 << 16, sequence.DIRECT, 2, 1)["right"]
    with pytest.raises(ValueError, match="multiples"):
        sequence.scan_blocks(spark, path, 1000, sequence.DIRECT)


def test_other_graph_classes_are_refused(spark, tmp_path):
    (tmp_path / "e.graph").write_bytes(b"")
    (tmp_path / "e.properties").write_text("graphclass=it.unimi.dsi.webgraph.EFGraph\nnodes=1\narcs=0\n")
    with pytest.raises(ValueError, match="EFGraph"):
        Graph.open(spark, str(tmp_path / "e"), "wg400")


def test_progress_and_release_of_reads(spark, files):
    folder, flat = files
    with Graph.open(spark, f"{folder}/g", "wg400") as g:
        g.block_edges = 64
        request = g.read_async(lambda batch, i: None, 0, 0, -1, -1)
        request.wait(120)
        told = request.progress
        assert (told["status"], told["edges_read"], told["total_edges"], told["total_blocks"]) == (1, len(flat), len(flat), -(-len(flat) // 64))
        assert told["edges_per_s"] > 0
    assert not g._requests


@pytest.mark.parametrize("seed", range(4))
def test_ranges_of_long_reference_chains_and_hubs(tmp_path, seed):
    draw = random.Random(seed)
    n, base = 400, str(tmp_path / "g")
    rows = adjacency(draw, n)
    rows[200] = sorted(draw.sample(range(n), 300))
    rows[201], rows[202] = rows[200][::2], list(range(n))
    bvgraph.encode(base, n, rows, draw.randint(1, 9), 10**6, draw.randint(0, 6), draw.randint(1, 6))
    reader = bvgraph.Reader(base, bvgraph.index_files(base))
    for _ in range(20):
        a = draw.randrange(n)
        b = draw.randint(a + 1, n)
        degree, flat = reader.successors(a, b)
        assert degree.tolist() == [len(r) for r in rows[a:b]] and flat.tolist() == sum(rows[a:b], [])
