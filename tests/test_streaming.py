"""Micro-batches of many blocks: few batches, no more tasks than blocks may be in flight, and the same rows."""

import random

import pytest

from weftline.plans import registry
from weftline.plans.graph import Graph
from weftline.sources import bvgraph
from weftline.sources.datasource import CsxStream


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    draw, base = random.Random(4), str(tmp_path_factory.mktemp("stream") / "g")
    rows = [sorted(draw.sample(range(90), draw.randint(0, 20))) for _ in range(90)]
    bvgraph.encode(base, 90, rows)
    return base, [(s, d) for s, row in enumerate(rows) for d in row]


def test_batches_of_many_blocks(spark, graph):
    base, flat = graph
    g, got = Graph.open(spark, base), []
    g.block_edges, g.max_blocks_in_flight = 4, 3
    request = g.read_async(lambda batch, _: got.append([(r.block, r.edge_idx, r.src, r.dst) for r in batch.collect()]), 3, 1, -1, -1, batch_edges=200).wait(120)
    lo, hi = g.edge_range(3, 1)
    assert sorted(sum(got, [])) == [((k - lo) // 4, k, *flat[k]) for k in range(lo, hi)]
    assert len(got) == -(-(hi - lo) // 200) and request.edges_read == hi - lo and request.total_blocks == -(-(hi - lo) // 4)


@pytest.mark.parametrize(("flight", "batch"), [(3, 0), (3, 200), (1, 50), (5, 3), (0, 0)])
def test_tasks_are_the_blocks_in_flight(graph, flight, batch):
    base, flat = graph
    stream = CsxStream({"path": base, "blockEdges": 4, "maxBlocksInFlight": flight, "batchEdges": batch})
    at, seen, batches = stream.initialOffset(), [], 0
    while at["edge"] < len(flat):
        to = stream.latestOffset()
        parts = stream.partitions(at, to)
        assert not flight or len(parts) <= flight
        assert batch or all(p.hi - p.lo <= 4 for p in parts)
        seen += [r for p in parts for b in stream.read(p) for r in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True)]
        assert not flight or max(b.num_rows for p in parts for b in stream.read(p)) <= 4
        at, batches = to, batches + 1
    assert seen == flat
    assert batches == (-(-len(flat) // max(4 * flight, batch // 4 * 4)) if flight else 1)


def test_tables_do_not_grow_with_blocks(spark, monkeypatch):
    """One table for each batch and one scan of all; there was a table and a branch of a union for each three blocks."""
    made = []
    monkeypatch.setattr(registry, "BLOCK", 8)
    table = registry.Scratch.table
    monkeypatch.setattr(registry.Scratch, "table", lambda self, df: made.append(1) or table(self, df))
    got = registry.stream_in_degree(spark, "/root/testdata/sf0.001")
    assert got.agg({"in_degree": "sum"}).first()[0] == 4292
    assert len(made) == 1 and "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stream_without_edges(spark, monkeypatch):
    empty = lambda spark, d, *a: Graph.from_edges(spark.createDataFrame([], "src long, dst long"), 3)
    monkeypatch.setattr(registry, "part_graph", empty)
    assert sorted(tuple(r) for r in registry.stream_in_degree(spark, "").collect()) == [(0, 0), (1, 0), (2, 0)]
