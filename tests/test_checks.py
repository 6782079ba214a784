"""Verdict quirks, mappings, schemas, history, suites and reports on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import evenkeel as ek
from conftest import as_set
from evenkeel.operators.mapping import DERIVED, HARDCODED, MappingRow as R, SOURCE_TO_STAGE
from evenkeel.plans.suite import clock_text, selected


# Verdicts
def test_duplicates_on_the_source_alone_pass(rows):
    src, tgt = rows("k int", (1,), (1,), (2,)), rows("k int", (1,), (2,))
    assert ek.test_duplicate(src, tgt, ["k"]).first().result == "Passed"
    assert ek.test_duplicate(tgt, src, ["k"]).first().result == "Failed"
    assert ek.fingerprint(src, tgt, ["k"], ["duplicate_keys"]).first().result == "Failed"


def test_each_side_counts_its_own_repeated_rows(rows):
    src, tgt = rows("a int", (1,), (1,), (1,)), rows("a int", (1,), (2,), (3,))
    kpi = ek.fingerprint(src, tgt, ["a"], ["duplicate_rows"]).first()
    assert (kpi.src_value, kpi.tgt_value, kpi.result) == (2, 0, "Failed")


def test_null_columns_compare_how_many_not_which(rows):
    src, tgt = rows("a int, b int", (None, 1)), rows("a int, b int", (1, None))
    assert ek.fingerprint(src, tgt, ["a"], ["null_columns"]).first().result == "Passed"
    v = ek.test_null(src, tgt).first()
    assert (v.result, v.mismatched, v.src_null_columns, v.tgt_null_columns) == ("Failed", 2, 1, 1)


def test_null_test_with_more_columns_on_one_side(rows):
    src, tgt = rows("a int, b int", (None, None)), rows("x int", (None,))
    v = ek.test_null(src, tgt).first()
    assert (v.result, v.matched, v.mismatched, v.src_null_columns, v.tgt_null_columns) == ("Passed", 1, 0, 2, 1)


def test_row_hash_nulls(rows):
    df = rows("a string, b string", (None, "x"), ("x", None), ("a|b", "c"), ("a", "b|c"))
    skip, mark = (df.select(ek.row_hash(df, nulls=n)).distinct().count() for n in ("skip", "mark"))
    assert (skip, mark) == (2, 4)


def test_fingerprint_of_equal_sets_passes(rows):
    df = rows("k int, v string", (1, "a"), (2, "b"))
    v = ek.test_fingerprint(df, df, ["k"]).first()
    assert (v.result, v.kpis, v.kpis_passed) == ("Passed", 8, 8)
    empty = rows("k int, v string")
    assert ek.test_fingerprint(empty, empty, ["k"]).first().result == "Passed"


def test_all_null_rows_and_blanks(rows):
    df = rows("k int, v string", (None, None), (1, "  "))
    out = {r.kpi: (r.src_value, r.result) for r in ek.fingerprint(df, df, ["k"]).collect()}
    assert out["null_rows"] == (1, "Failed") and out["empty_columns"] == (1, "Failed")
    assert ek.null_rows(df).count() == 1


def test_symmetric_difference_counts_copies(rows):
    a, b = rows("v int", (1,), (1,), (1,), (2,), (None,)), rows("v int", (1,), (3,), (None,))
    assert as_set(ek.symmetric_diff(a, b)) == {(1, "source", 2), (2, "source", 1), (3, "target", 1)}


def test_columns_may_carry_the_names_of_measures(rows):
    df = rows("n int, rows int, src_rows int, side string", (1, 1, 1, "x"), (1, 1, 1, "x"))
    assert ek.dup_keys(df, ["n", "rows"]).count() == 1
    assert ek.test_content(ek.Pair(df, df, ["n", "rows"])).first().result == "Passed"
    assert ek.occurrence(df, ["n"], chunk_rows=1).count() == 2


# Mappings
def test_source_to_stage_neither_trims_nor_casts_nor_filters(rows):
    df = rows("a string", (" 1 ",), (None,))
    row = [R("a", "a", filter_nulls=True, source_type="string", target_type="int")]
    assert as_set(ek.apply_mapping(df, row, SOURCE_TO_STAGE, trim=True)) == {(" 1 ",), (None,)}
    assert as_set(ek.apply_mapping(df, row, trim=True)) == {(1,)}


def test_try_cast_and_strict_cast(rows):
    df = rows("a string", ("x",))
    row = [R("a", "a", source_type="string", target_type="integer")]
    assert as_set(ek.apply_mapping(df, row, cast="try")) == {(None,)}
    with pytest.raises(Exception):
        ek.apply_mapping(df, row).collect()


def test_lookups_join_once_each_in_order(rows):
    src, lk = rows("k int, j int", (1, 2)), rows("id int, a string, b string", (1, "a1", "b1"), (2, "a2", "b2"))
    mapped = ek.apply_mapping(src, [
        R("x", "k", DERIVED, lookup_table="lk", lookup_key="id", lookup_return="a"),
        R("y", "j", DERIVED, lookup_table="lk", lookup_key="id", lookup_return="lk.b"),
        R("z", "k", DERIVED, lookup_table="lk", lookup_key="id", lookup_return="concat(a, b)"),
    ], lookups={"lk": lk})
    assert as_set(mapped) == {("a1", "b2", "a1b1")}
    assert mapped._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_hardcoded_null_takes_the_declared_type(rows):
    out = ek.apply_mapping(rows("a int", (1,)), [R("n", kind=HARDCODED, expression="NULL", target_type="integer")])
    assert out.schema["n"].dataType.simpleString() == "int" and as_set(out) == {(None,)}


def test_one_column_may_be_excluded(rows):
    assert ek.like_select(rows("b int, a int, c int", (1, 2, 3)), "c").columns == ["a", "b"]
    assert ek.apply_mapping(rows("a int, b int", (1, 2)), [R("a", "a"), R("b", "b")], exclude="b").columns == ["a"]


def test_unknown_hop_raises(rows):
    with pytest.raises(ValueError, match="hop"):
        ek.apply_mapping(rows("a int", (1,)), [], "sideways")


# Schemas and nested data
def test_declared_schema_of_every_layer(rows):
    sheet = rows("tabletype string, columnname string, datatype string, length string, scale string",
                 ("source", "A", "NUMBER", "22.0", "2.0"), ("stage", "B", "STRING", None, None), ("target", "C", "VARCHAR", "8", ""))
    got = {layer: as_set(ek.declared_schema(sheet, layer)) for layer in ("source", "stage", "target")}
    assert got == {"source": {("a", "number(22,2)")}, "stage": {("b", "string")}, "target": {("c", "varchar")}}


def test_schema_statuses(rows):
    a, b = rows("K int, v string, only_a int", (1, "x", 1)), rows("k int, V int, only_b int", (1, 1, 1))
    out = as_set(ek.schema_compare(ek.schema_rows(a), ek.schema_rows(b)), "columnname", "status")
    assert out == {("k", "match"), ("v", "type mismatch"), ("only_a", "only source"), ("only_b", "only target")}
    assert ek.test_schema(a, a).first().reason == "Schema matched"


def test_flatten_deep(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('A', named_struct('B', 2), 'L', array(named_struct('x', 1), named_struct('x', 2))) AS s")
    flat = ek.flatten(df)
    assert flat.columns == ["id", "s_a_b", "s_l_x"] and as_set(flat) == {(1, 2, 1), (1, 2, 2)}
    assert ek.flatten(df, explode=False).columns == ["id", "s_a_b", "s_l"]


# Rules and history
def day(text):
    return dt.date.fromisoformat(text)


def test_kpi_rule_without_rows_fails(rows):
    out = ek.kpi_rules(rows("v int", (1,)), [ek.KpiRule("none", "avg(v)", 1, "v > 5"), ek.KpiRule("one", "sum(v)", 1)])
    assert as_set(out, "rule", "result") == {("none", "Failed"), ("one", "Passed")}


def test_null_foreign_keys_are_no_orphans(rows):
    child, parent = rows("f int", (None,), (1,), (9,), (9,)), rows("k int", (1,), (None,))
    out = ek.ref_integrity(child, [ek.Reference("r", "f", parent, "k")]).first()
    assert (out.orphan_rows, out.orphan_keys) == (2, 1)


def test_aggregates_pair_null_groups_and_tolerate(rows):
    a, b = rows("g string, v double", (None, 1.0), ("x", 2.0)), rows("g string, v double", (None, 1.0), ("x", 2.4), ("y", 1.0))
    status = lambda tol: as_set(ek.agg_compare(a, b, ["g"], {"t": "sum(v)"}, tol), "g", "status")
    assert status(0) == {(None, "match"), ("x", "mismatch"), ("y", "only target")}
    assert status(0.5) == {(None, "match"), ("x", "match"), ("y", "only target")}


def test_required_values(rows):
    assert as_set(ek.required_values(rows("b string", ("x",)), "b", ["x", "y"])) == {("y",)}


def test_scd2_rules(rows):
    df = rows("k int, f date, t date, c string",
              (1, day("2020-01-01"), day("2020-12-31"), "N"), (1, day("2021-01-01"), day("9999-12-31"), "Y"),
              (2, day("2020-01-01"), day("9999-12-31"), "N"), (3, day("2021-02-01"), day("2021-01-01"), "Y"))
    out = {r.rule: r.violations for r in ek.scd2_check(df, ["k"], "f", "t", "c").collect()}
    assert out == {"one_current": 1, "start_before_end": 1, "open_if_current": 2}


def test_date_chain_labels(rows):
    df = rows("k int, f date, t date", (1, day("2020-01-01"), day("2020-01-31")), (1, day("2020-02-01"), day("2020-02-10")),
              (1, day("2020-02-12"), day("2020-03-01")), (1, day("2020-03-01"), day("9999-12-31")))
    assert as_set(ek.date_chain(df, ["k"], "f", "t"), "next_start", "fault") == {(day("2020-02-12"), "gap"), (day("2020-03-01"), "overlap")}


def test_incremental_mark_may_be_a_value(rows):
    df = rows("k int, ts int", (1, 1), (2, 5), (3, 9))
    assert as_set(ek.changed_since(df, "ts", F.lit(4)), "k") == as_set(ek.changed_since(df, "ts", 4), "k") == {(2,), (3,)}
    marks = rows("done int", (1,), (5,))
    assert as_set(ek.changed_since(df, "ts", marks), "k") == {(3,)}


# Suites and reports
def test_selection_and_errors(spark, rows):
    df = rows("k int, v int", (1, 1))
    cases = [ek.Case("A", "k", df, df), ek.Case("B", "k", df, df, execute="N"), ek.Case("C", "k", df, df.where("1/v > 0").withColumn(
        "v", F.expr("v / 0")))]
    assert [c.name for c in selected(cases)] == ["A", "C"] and [c.name for c in selected(cases, ["b"])] == ["B"]
    out = {r.testcase_name: (r.test_result, r.reason) for r in ek.run_suite(spark, cases, "null").collect()}
    assert out["A"] == ("Passed", "Nulls are matching for each column")
    assert out["C"][0] == "Errored" and "Execution Error" in out["C"][1]
    for kind in ("count", "duplicate", "content", "schema", "fingerprint"):
        assert ek.run_suite(spark, cases, kind, ["A"]).first().test_result == "Passed"
    totals = ek.suite_totals(ek.run_suite(spark, cases, "null")).first()
    assert tuple(totals) == (2, 1, 0, 1)


def test_clock_text_and_buckets(rows):
    assert clock_text(3725.9) == "1:02:05"
    hist = rows("testcase_name string, runtime string", ("a", "0:00:44"), ("a", "0:00:45"), ("b", "0:02:00"), ("c", "1:00:00"), ("d", ""), ("e", None))
    assert as_set(ek.runtime_members(hist), "bucket", "testcase_name") == {("0s-45s", "a"), ("45s-2m", "a"), ("2m-5m", "b"), ("5m+", "c")}


def test_trend_keeps_the_latest(rows):
    hist = rows("run_created_time string, test_result string, db_stored_time string",
                *[(f"r{i:02d}", "Passed" if i % 2 else "Failed", f"t{i:02d}") for i in range(50)])
    out = ek.trend(hist).collect()
    assert len(out) == 40 and out[0].run_created_time == "r49" and out[0].pass_rate == 1.0


def test_profile_covers_every_column(rows):
    df = rows("n int, s string", (1, "ab1"), (2, "ab1"), (None, None))
    out = {(r["column"], r["metric"]): r["value"] for r in ek.profile(df).collect()}
    assert out["n", "count"] == "2.0" and out["n", "nulls"] == "1.0" and out["s", "top_1"] == "ab1 (2)"
    assert out["s", "pattern_1"] == "AA9 (2)" and out["s", "distinct"] == "1"


def test_bulk_queries(spark, rows):
    out = ek.adhoc_bulk(spark, ["SELECT v FROM t", "SELECT count(*) AS n FROM t"], {"t": rows("v int", *[(i,) for i in range(9)])})
    assert as_set(out, "query_no", "row_no", "row_json") == {(1, 1, '{"v":0}'), (1, 2, '{"v":1}'), (1, 3, '{"v":2}'), (2, 1, '{"n":9}')}


def test_layer_report(rows):
    raw, stage = rows("a int", (1,), (2,)), rows("b int", (1,), (3,))
    out = ek.layer_report([ek.LayerHop("one", raw, stage, [R("b", "a")]), ek.LayerHop("two", stage, stage, [R("b", "b")])])
    assert as_set(out, "hop", "missing_in_target", "not_in_source", "result") == {("one", 1, 1, "Failed"), ("two", 0, 0, "Passed")}
