"""Operators on hand-made and random graphs."""

import random

import pytest

from weftline.functions.unsigned import adaptive_block_edges, block_count
from weftline.operators import blocks, layout
from weftline.operators.components import component_edges, components
from weftline.operators.requests import RejectedRequest, edge_range, normalise
from weftline.plans.graph import Graph

TINY = [(0, 1), (0, 2), (1, 2), (3, 3)]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def tiny(spark):
    return Graph.from_edges(spark.createDataFrame(TINY, "src long, dst long"), 6)


def test_tiny_layout(tiny):
    assert rows(tiny.offset_rows(), "v", "offset") == list(enumerate([0, 2, 3, 3, 4, 4, 4]))
    assert rows(tiny.degrees, "v", "degree") == list(enumerate([2, 1, 0, 1, 0, 0]))
    assert rows(tiny.edges, "src", "edge_idx", "dst") == [(0, 0, 1), (0, 1, 2), (1, 2, 2), (3, 3, 3)]
    assert rows(layout.degrees_of(tiny.offset_rows()), "v", "degree") == list(enumerate([2, 1, 0, 1, 0, 0]))


def test_tiny_analytics(tiny):
    assert rows(tiny.in_degree_distribution(), "degree", "cnt") == [(0, 3), (1, 2), (2, 1)]
    assert rows(tiny.components(), "id", "comp") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5)]
    assert int(tiny.validation_sum().first()[0]) == 34
    assert rows(tiny.block_summary(2), "block", "n") == [(0, 2), (1, 2)]
    assert rows(tiny.block_summary(3), "block", "n") == [(0, 3), (1, 1)]


@pytest.mark.parametrize(
    ("request_", "want"),
    [((0, 0, -1, -1), (0, 4)), ((0, 1, 3, 0), (1, 3)), ((0, 5, -1, -1), (2, 4)), ((0, 0, 0, 9), (0, 2)), ((2, 0, 2, 0), (3, 3)), ((4, 0, 6, 0), (4, 4))],
)
def test_requests(tiny, request_, want):
    assert tiny.edge_range(*request_) == want
    assert len(tiny.subgraph(*request_).collect()) == want[1] - want[0]


@pytest.mark.parametrize("request_", [(6, 0, -1, -1), (3, 1, 2, 0), (1, 2, 1, 1)])
def test_rejected(tiny, request_):
    with pytest.raises(RejectedRequest):
        tiny.edge_range(*request_)


def test_normalise_agrees_with_single_requests(spark, tiny):
    draw = random.Random(3)
    asked = [(k, draw.randint(0, 7), draw.randint(0, 4), draw.randint(-1, 7), draw.randint(-1, 4)) for k in range(60)]
    got = {r.id: r for r in normalise(spark.createDataFrame(asked, "id int, sv long, se long, ev long, ee long"), tiny.offset_rows(), 6).collect()}
    offsets = [0, 2, 3, 3, 4, 4, 4]
    for k, sv, se, ev, ee in asked:
        try:
            end = None if ev < 0 else ev
            want = edge_range(lambda v: offsets[min(v, 6)], 6, sv, se, end, (1 << 62) if ee < 0 and end is not None else max(ee, 0))
            assert (got[k].lo, got[k].hi) == want, asked[k]
            assert got[k].status == ("ok" if want[0] < want[1] else "empty")
        except RejectedRequest:
            assert got[k].status == "rejected", asked[k]


def test_offsets_slice(tiny):
    assert rows(tiny.offsets(2, 4), "v", "offset") == [(2, 3), (3, 3), (4, 4)]
    assert tiny.offsets(5, -1).count() == 2
    for bad in ((7, 7), (0, 7), (3, 2)):
        with pytest.raises(RejectedRequest):
            tiny.offsets(*bad)


def test_hub_split_and_block_independence(spark):
    """A star: with tiny chunks every window is cut, and the order must not change."""
    edges = sorted({(0, d) for d in range(200)} | {(random.Random(5).randint(0, 199), d % 200) for d in range(100)})
    df = spark.createDataFrame(edges, "src long, dst long")
    vertices = spark.range(200).selectExpr("id AS v")
    got = layout.indexed(df, vertices, bits=3)
    assert rows(got, "edge_idx", "src", "dst") == [(k, s, d) for k, (s, d) in enumerate(edges)]
    from weftline.operators.checksum import validation_sum

    want, prev = 0, None
    for s, d in edges:
        want += 1 + ((prev[1] + 1) if prev and prev[0] == s else s + 1) * (d + 1)
        prev = (s, d)
    for bits in (2, 5, 20):
        assert int(validation_sum(got, bits).first()[0]) == want
    offsets = layout.offsets(layout.out_degree(df, vertices))
    for size in (1, 7, 64, len(edges), len(edges) + 1):
        cut = rows(blocks.bounds(got, offsets, size), "block", "start_vertex", "start_edge", "end_vertex", "end_edge")
        assert len(cut) == block_count(len(edges), size)
        assert sum(r[1] for r in rows(blocks.summary(got, size), "block", "n")) == len(edges)
        assert rows(blocks.progress(got, size), "block", "edges_read")[-1][1] == len(edges)


def test_components_random(spark):
    draw = random.Random(9)
    for n, m in ((60, 40), (200, 150), (30, 0)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(0, 12)] * (m > 0)
        parent = list(range(n))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame(edges, "src long, dst long")
        assert rows(components(spark.range(n).selectExpr("id AS v"), df), "id", "comp") == [(k, root(k)) for k in range(n)]
        starred = component_edges(df, local_edges=0)
        assert rows(starred, "id", "comp") == [(k, root(k)) for k in range(n) if root(k) != k]
    loops = spark.createDataFrame([(1, 1), (None, 2), (5, 4), (4, 5)], "src long, dst long")
    assert rows(component_edges(loops), "id", "comp") == [(5, 4)]


def test_block_sizes(tiny):
    assert adaptive_block_edges(4) == 64 << 20
    assert adaptive_block_edges(1 << 20) == 1 << 17
    assert adaptive_block_edges(2000) == 1024
    with pytest.raises(ValueError):
        tiny.block_edges = 1 << 29
    assert tiny.total_callbacks(0, 4) == 1
    assert tiny.uses_own_buffers and not tiny.uses_user_arrays
    with pytest.raises(NotImplementedError):
        tiny.vertex_weights()


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"), 1)
    assert rows(g.offset_rows(), "v", "offset") == [(0, 0), (1, 0)]
    assert g.edges.count() == 0 and g.num_edges == 0
    assert int(g.validation_sum().first()[0]) == 0
    assert rows(g.components(), "id", "comp") == [(0, 0)]
