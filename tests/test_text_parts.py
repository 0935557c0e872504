"""Text graphs in several part files: places go on from part to part, and no task has all of the lines."""

import pytest

from weftline.plans import registry
from weftline.sinks import text
from weftline.sources import coo


def test_parts_are_read_in_the_order_of_their_names(spark, tmp_path):
    # the largest file first is the order that splits are dealt in, and not that of the names
    sizes, k = [3, 700, 1, 5000, 40, 0, 900], 0
    for i, n in enumerate(sizes):
        (tmp_path / f"part-{i:05d}").write_text("# of its own\n\n" + "".join(f"{j} {j + 1}\n" for j in range(k, k + n)))
        k += n
    for split in ("128m", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = sorted((r.row, r.src) for r in coo.read_edge_list(spark, str(tmp_path)).collect())
            some = sorted((r.row, r.src) for r in coo.read_edge_list(spark, str(tmp_path), start_row=2, end_row=705).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == [(j, j) for j in range(k)]
        assert some == [(j, j) for j in range(2, 705)]


def test_matrix_market_in_parts(spark, tmp_path):
    (tmp_path / "part-00000").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n9 9 900\n")
    (tmp_path / "part-00001").write_text("1 2 7\n")
    (tmp_path / "part-00002").write_text("".join(f"{k % 9 + 1} 3 {k}\n" for k in range(1, 900)))
    edges, vertices, entries = coo.read_matrix_market(spark, str(tmp_path))
    assert (vertices, entries) == (9, 900)
    assert sorted((r.row, r.src, r.weight) for r in edges.collect()) == [(0, 0, 7), *[(k, k % 9, k) for k in range(1, 900)]]


@pytest.mark.parametrize("name", ["coo_text_scan", "matrix_market_scan"])
def test_no_task_sorts_all_lines(spark, name, monkeypatch):
    dealt, write = [], text.write_lines

    def seen(lines, path, partitions=None):
        dealt.append(partitions)
        write(lines, path, partitions)

    monkeypatch.setattr(text, "write_lines", seen)
    registry.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert dealt == [None]
