"""The checksum tree, and how much it and the fingerprint read and shuffle."""

import re

import evenkeel as ek
from conftest import SF_TINY, as_set
from workload.fixtures import table

SCHEMA = "k int, a string, b double"


def shuffled(df) -> dict[str, int]:
    """Records written by each shuffle of an executed frame, by its partitioning."""
    found = {}

    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if "QueryStage" in name:
            return visit(node.plan())
        if name == "Exchange":
            found[node.simpleString(100)] = node.metrics().get("shuffleRecordsWritten").get().value()
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return found


def test_equal_sides_shuffle_only_the_tree(spark):
    orders = table(spark, SF_TINY, "orders_src")
    same = orders.orderBy("o_orderdate")
    assert ek.checksum_ranges(orders, same, ["o_orderkey"]).count() == 0
    rows = ek.checksum_rows(orders, same, ["o_orderkey"], depth=1)
    written = shuffled(rows)
    assert rows.count() == 0 and sum(written.values()) <= 16 * 20


def test_one_difference_is_found_in_its_range(rows):
    data = [(i, f"v{i}", i / 2) for i in range(500)] + [(None, None, None), (None, None, None), (7, "again", -0.0)]
    src = rows(SCHEMA, *data)
    tgt = rows(SCHEMA, *[(k, "new" if k == 33 else a, b) for k, a, b in reversed(data) if k != 44], (None, None, None))
    nodes = ek.checksum_ranges(src, tgt, ["k"], depth=2)
    by_level = {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}
    assert by_level[0] == 1 and by_level[1] <= 3 and by_level[2] == 3
    top = nodes.where("level = 0").first()
    assert (top.range, top.src_rows, top.tgt_rows) == ("", 503, 503) and top.src_checksum != top.tgt_checksum
    found = as_set(ek.checksum_rows(src, tgt, ["k"], depth=2), "k", "side", "copies")
    assert found == {(33, "source", 1), (33, "target", 1), (44, "source", 1), (None, "target", 1)}


def test_trees_of_empty_sides_and_stored_trees(spark, rows, tmp_path):
    some, none = rows(SCHEMA, (1, "x", 1.0)), rows(SCHEMA)
    assert ek.checksum_ranges(none, none, ["k"]).count() == 0
    assert {(r.src_rows, r.tgt_rows) for r in ek.checksum_ranges(some, none, ["k"]).collect()} == {(1, 0)}
    assert as_set(ek.checksum_rows(none, some, ["k"]), "k", "side") == {(1, "target")}
    ek.checksum_tree(some, ["k"]).write.parquet(f"{tmp_path}/tree")
    stored = spark.read.parquet(f"{tmp_path}/tree")
    assert ek.compare_trees(stored, ek.checksum_tree(some, ["k"])).count() == 0
    assert ek.compare_trees(stored, ek.checksum_tree(rows(SCHEMA, (1, "y", 1.0)), ["k"])).count() == 4


def test_fingerprint_reads_each_side_once(spark):
    src, tgt = table(spark, SF_TINY, "part"), table(spark, SF_TINY, "part").where("p_size > 3")
    text = ek.fingerprint(src, tgt, ["p_partkey"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", text)) == 2
    assert len(re.findall("Exchange hashpartitioning", text)) == 1


def test_fingerprint_of_odd_sides(rows):
    src = rows("k int, a string, b string", (1, None, " "), (None, None, None), (1, None, " "))
    value = {r.kpi: (r.src_value, r.tgt_value) for r in ek.fingerprint(src, rows("k int, a string, b string"), ["k"]).collect()}
    assert value == {"row_count": (3, 0), "column_count": (3, 3), "null_columns": (3, 0), "null_rows": (1, 0), "empty_columns": (1, 0),
                     "duplicate_rows": (1, 0), "duplicate_keys": (1, 0), "checksum": (2, 0)}
    narrow = ek.fingerprint(src, src, ["k"], ["null_rows", "row_count"]).collect()
    assert [(r.kpi, r.src_value) for r in narrow] == [("null_rows", 1), ("row_count", 3)]
