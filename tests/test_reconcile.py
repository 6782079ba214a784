"""Reconciliation on small frames: NULLs, repeated keys, type differences, empty sides, metamorphic rules."""

import random

import pytest
from pyspark.sql import functions as F

import evenkeel as ek
from conftest import SF_TINY, as_set
from evenkeel.operators.reconcile import Pair
from workload.fixtures import table

SCHEMA = "k int, a string, b int"


def test_null_keys_and_null_values_are_equal(rows):
    src = rows(SCHEMA, (None, "x", None), (1, None, 1))
    tgt = rows(SCHEMA, (None, "x", None), (1, "y", 1))
    out = ek.reconcile(Pair(src, tgt, ["k"]))
    assert as_set(out, "k", "status", "matched", "eq_a", "eq_b") == {
        (None, "both", True, True, True), (1, "both", False, False, True)}


def test_null_key_is_not_the_default_key(rows):
    src, tgt = rows(SCHEMA, (None, "x", 1)), rows(SCHEMA, (0, "x", 1))
    out = ek.counts(ek.reconcile(Pair(src, tgt, ["k"]))).first()
    assert (out.common, out.only_source, out.only_target) == (0, 1, 1)


def test_repeated_keys_pair_in_value_order(rows):
    src = rows(SCHEMA, (1, "a", 1), (1, "c", 3), (2, "z", 0))
    tgt = rows(SCHEMA, (1, "c", 3), (1, "b", 2), (1, "d", 4), (2, "z", 0))
    pair = Pair(src, tgt, ["k"])
    got = as_set(ek.reconcile(pair), "k", "occurrence", "status", "src_a", "tgt_a", "matched")
    assert got == {(1, 1, "both", "a", "b", False), (1, 2, "both", "c", "c", True),
                   (1, 3, "target_only", None, "d", False), (2, 1, "both", "z", "z", True)}
    assert as_set(ek.only_target(pair), "k", "occurrence", "a") == {(1, 3, "d")}
    assert ek.only_target(pair).columns == ["k", "occurrence", "a", "b"]
    assert ek.only_source(pair).count() == 0
    c = ek.counts(ek.reconcile(pair)).first()
    assert (c.src_distinct, c.src_duplicate, c.tgt_distinct, c.tgt_duplicate) == (2, 1, 2, 2)


def test_empty_sides(rows):
    some, none = rows(SCHEMA, (1, "a", 1)), rows(SCHEMA)
    for src, tgt, want in ((none, none, (0, 0, 0, "Passed")), (some, none, (0, 1, 0, "Failed")), (none, some, (0, 0, 1, "Failed"))):
        v = ek.test_content(Pair(src, tgt, ["k"])).first()
        assert (v.matched, v.only_source, v.only_target, v.result) == want
    assert ek.test_count(none, none).first().result == "Passed"


def test_types_differ(rows):
    src = rows("k string, v string", ("1", "10"), ("2", "x"), ("3", None))
    tgt = rows("k int, v int", (1, 10), (2, None), (3, None))
    out = as_set(ek.reconcile(Pair(src, tgt, ["k"])), "k", "status", "eq_v")
    assert out == {("1", "both", True), ("2", "both", False), ("3", "both", True)}


def test_keys_meet_in_the_targets_type(rows):
    """'01' is 1; text that is no number is a key of its own, not the NULL key."""
    src = rows("k string, v int", ("01", 1), ("x", 2), (None, 3), ("1", 4), ("2", 5))
    tgt = rows("k int, v int", (1, 1), (None, 3), (2, 5), (1, 4), (7, 7))
    out = as_set(ek.reconcile(Pair(src, tgt, ["k"])), "k", "occurrence", "status", "matched")
    assert out == {("01", 1, "both", True), ("1", 2, "both", True), ("x", 1, "source_only", False), (None, 1, "both", True),
                   ("2", 1, "both", True), ("7", 1, "target_only", False)}
    assert as_set(ek.only_target(Pair(src, tgt, ["k"])), "k", "v") == {("7", 7)}


def test_keys_with_names_of_the_result(rows):
    schema = "status string, matched int, occurrence int, v int"
    src, tgt = rows(schema, ("a", 1, 1, 5), ("b", 1, 1, 6)), rows(schema, ("a", 1, 1, 5), ("b", 1, 1, 7))
    pair = Pair(src, tgt, ["status", "matched", "occurrence"])
    out = ek.reconcile(pair)
    assert out.columns[:6] == ["key_status", "key_matched", "key_occurrence", "occurrence", "status", "matched"]
    assert as_set(out, "key_status", "status", "matched") == {("a", "both", True), ("b", "both", False)}
    assert as_set(ek.column_details(out, pair.keys), "key_columns") == {("status=b, matched= 1, occurrence= 1",)}
    assert as_set(ek.sample_keys(ek.mismatched_rows(pair), pair.keys)) == {("status=b, matched= 1, occurrence= 1",)}


def test_details_of_many_equal_cells(rows):
    """Copies of one differing cell count once, however many tasks hold them."""
    src, tgt = rows("k int, a int", *[(1, 5)] * 300, (2, 1)), rows("k int, a int", *[(1, 6)] * 300, (2, 2))
    found = ek.column_details(ek.reconcile(Pair(src, tgt, ["k"])), ["k"], 1)
    assert as_set(found) == {("a", "k=1", "5", "6")} and found.count() == 1


def test_types_differ_with_repeated_keys(rows):
    src = rows("k int, v string", (1, "10"), (1, "9"))
    tgt = rows("k int, v int", (1, 9), (1, 10))
    assert as_set(ek.reconcile(Pair(src, tgt, ["k"])), "src_v", "tgt_v", "matched") == {("9", 9, True), ("10", 10, True)}


def test_column_mapping_and_case(rows):
    src, tgt = rows("ID int, Name string, extra int", (1, "x", 5)), rows("id int, full_name string", (1, "x"))
    pair = Pair(src, tgt, ["ID"], {"Name": "full_name"})
    assert as_set(ek.reconcile(pair), "ID", "src_Name", "tgt_Name", "matched") == {(1, "x", "x", True)}
    v = ek.test_content(pair).first()
    assert (v.compared_columns, v.src_only_columns, v.tgt_only_columns) == (2, 1, 0)


def test_missing_key_raises(rows):
    with pytest.raises(ValueError, match="nope"):
        ek.reconcile(Pair(rows(SCHEMA, (1, "a", 1)), rows(SCHEMA, (1, "a", 1)), ["nope"]))
    with pytest.raises(ValueError, match="to compare.*a"):
        ek.reconcile(Pair(rows(SCHEMA, (1, "a", 1)), rows(SCHEMA, (1, "a", 1)), ["k"], {"a": "zip"}))


def test_key_names_match_without_case(rows):
    src, tgt = rows("Id int, V int", (1, 1), (2, 2)), rows("ID int, v int", (1, 1), (2, 3))
    assert as_set(ek.reconcile(Pair(src, tgt, ["id"])), "id", "matched") == {(1, True), (2, False)}


def test_tolerance(rows):
    src, tgt = rows("k int, v double", (1, 1.0), (2, 100.0), (3, None)), rows("k int, v double", (1, 1.05), (2, 101.0), (3, 1.0))
    near = lambda **kw: as_set(ek.reconcile(Pair(src, tgt, ["k"], **kw)), "k", "matched")
    assert near() == {(1, False), (2, False), (3, False)}
    assert near(abs_tol=0.1) == {(1, True), (2, False), (3, False)}
    assert near(rel_tol=0.02) == {(1, False), (2, True), (3, False)}


def test_details_are_limited_per_column(rows):
    src = rows(SCHEMA, *[(i, "s", i) for i in range(30)])
    tgt = rows(SCHEMA, *[(i, "t", i if i % 2 else -1) for i in range(30)])
    pair = Pair(src, tgt, ["k"])
    found = ek.column_details(ek.reconcile(pair), ["k"], 4)
    assert {r["column"]: r["count"] for r in found.groupBy("column").count().collect()} == {"a": 4, "b": 4}
    assert ek.column_details(ek.reconcile(pair), ["k"], None).count() == 45


def test_key_text_of_composite_keys(rows):
    from evenkeel.functions import key_text

    df = rows("a int, b string", (1, "x"), (None, "y"))
    assert {r[0] for r in df.select(key_text(["a", "b"])).collect()} == {"a=1, b= x", "a=NULL, b= y"}


@pytest.mark.parametrize("name", ["orders_tgt", "orders_dup", "events_tgt"])
def test_a_set_equals_itself(spark, name):
    df = table(spark, SF_TINY, name)
    key = [df.columns[0]]
    assert ek.test_content(Pair(df, df, key)).first().result == "Passed"
    assert ek.hash_diff(df, df).count() == 0
    assert ek.symmetric_diff(df, df).count() == 0


def test_sides_mirror_and_counts_add_up(spark):
    src, tgt = table(spark, SF_TINY, "orders_src"), table(spark, SF_TINY, "orders_dup")
    one, other = Pair(src, tgt, ["o_orderkey"]), Pair(tgt, src, ["o_orderkey"])
    assert sorted(map(str, ek.only_source(one).collect())) == sorted(map(str, ek.only_target(other).collect()))
    c = ek.counts(ek.reconcile(one)).first()
    assert c.matched + c.mismatched == c.common
    assert c.common + c.only_source == c.src_rows == src.count()
    assert c.common + c.only_target == c.tgt_rows == tgt.count()
    assert ek.mismatched_rows(one).count() == c.mismatched and ek.matched_rows(one).count() == c.matched
    assert ek.only_source(one).count() == c.only_source and ek.only_target(one).count() == c.only_target


def brute_force(src, tgt):
    """Pair copies of a key in value order, NULLs first."""
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in r[1:])
    by = lambda side: {k: sorted((r for r in side if r[0] == k), key=order) for k in {r[0] for r in side}}
    s, t, out = by(src), by(tgt), []
    for k in set(s) | set(t):
        a, b = s.get(k, []), t.get(k, [])
        for i in range(max(len(a), len(b))):
            left, right = (a[i] if i < len(a) else None), (b[i] if i < len(b) else None)
            out.append((k, i + 1, left[1:] if left else None, right[1:] if right else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 3])
def test_against_brute_force(rows, chunk_rows):
    rng = random.Random(7)
    pick = lambda n: [(0 if rng.random() < 0.4 else rng.randint(1, 9), rng.choice([None, 1, 2]), rng.choice([None, 5, 6]))
                      for _ in range(n)]
    src, tgt = pick(120), pick(100)
    schema = "k int, a int, b int"
    out = ek.reconcile(Pair(rows(schema, *src), rows(schema, *tgt), ["k"], chunk_rows=chunk_rows)).collect()
    got = sorted(((r.k, r.occurrence, (r.src_a, r.src_b) if r.status != "target_only" else None,
                   (r.tgt_a, r.tgt_b) if r.status != "source_only" else None) for r in out), key=str)
    assert got == brute_force(src, tgt)


def test_persisted_rows_give_all_reports(spark):
    """The rows can be stored once and reported many times."""
    from evenkeel.frames import durable

    pair = Pair(table(spark, SF_TINY, "orders_src"), table(spark, SF_TINY, "orders_tgt"), ["o_orderkey"])
    stored = durable(ek.reconcile(pair))
    fresh = ek.reconcile(pair)
    assert ek.counts(stored).collect() == ek.counts(fresh).collect()
    assert as_set(ek.column_summary(stored)) == as_set(ek.column_summary(fresh))


def test_content_report_agrees_with_the_parts(spark):
    pair = Pair(table(spark, SF_TINY, "orders_src"), table(spark, SF_TINY, "orders_dup"), ["o_orderkey"])
    report = ek.content_report(pair, 3)
    assert report.verdict.collect() == ek.test_content(pair).collect()
    rows = ek.reconcile(pair)
    assert as_set(report.columns) == as_set(ek.column_summary(rows))
    assert as_set(report.cells) == as_set(ek.column_details(rows, ["o_orderkey"], 3))
    assert as_set(report.mismatched_keys) == as_set(ek.sample_keys(ek.mismatched_rows(pair), ["o_orderkey"], 3))
    assert report.differences.where("matched").count() == 0
    same = ek.content_report(Pair(pair.source, pair.source, ["o_orderkey"]))
    assert same.verdict.first().result == "Passed" and same.columns.count() == same.only_source_keys.count() == 0


def test_summary_can_show_all_columns(rows):
    src, tgt = rows(SCHEMA, (1, "a", 1)), rows(SCHEMA, (1, "b", 1))
    full = ek.column_summary(ek.reconcile(Pair(src, tgt, ["k"])), only_differing=False)
    assert as_set(full) == {("a", 1, 0, 1), ("b", 1, 1, 0)}
    assert full.where(F.col("rows_mismatched") > 0).count() == 1


def test_wide_tables_plan_quickly(spark):
    """A filter over all columns must not become a constraint that is rewritten for every alias."""
    wide = spark.range(50).select("id", *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(80)])
    pair = Pair(wide, wide.withColumn("c7", F.when(F.col("id") < 5, -1).otherwise(F.col("c7"))), ["id"])
    bad = ek.mismatched_rows(pair)
    renamed = bad.select("id", *[F.col(f"src_c{i}").alias(f"x{i}") for i in range(80)])
    assert renamed.where("x0 >= 0").count() == 5
    assert as_set(ek.column_details(ek.reconcile(pair), ["id"], 2), "column", "key_columns") == {("c7", "id=0"), ("c7", "id=1")}
