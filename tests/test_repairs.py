"""Answers that were once wrong."""

import pytest
from conftest import as_set

import evenkeel as ek
from evenkeel.operators.mapping import MappingRow, repeated_lookup_keys
from evenkeel.plans.adhoc import _has_order
from evenkeel.plans.results import runtime_members, runtime_seconds
from evenkeel.sources import HISTORY, append_history, read_table
from evenkeel.sources.readers import query_text
from pyspark.sql import functions as F


def test_kpi_filter_holds_for_the_whole_aggregate(rows):
    df = rows("kind string, value double", ("click", 10.0), ("click", 20.0), ("view", 100.0))
    rule = ek.KpiRule("mean", "sum(value) / count(*)", 15, "kind = 'click'")
    assert as_set(ek.kpi_rules(df, [rule, ek.KpiRule("all", "count(*)", 3)]), "rule", "actual", "result") == {
        ("mean", 15.0, "Passed"), ("all", 3.0, "Passed")}


def test_adhoc_keeps_the_order_of_the_query(spark, rows):
    df = rows("id int, bal int", (0, 5), (1, 9), (2, 7), (3, 8))
    sql = "SELECT id FROM t ORDER BY bal DESC -- best first"
    assert [r.id for r in ek.adhoc_sql(spark, sql, {"t": df}).collect()] == [1, 3, 2]
    bulk = ek.adhoc_bulk(spark, [sql, "SELECT id FROM t"], {"t": df}).collect()
    assert [r.row_json for r in sorted(bulk, key=lambda r: (r.query_no, r.row_no))] == [
        f'{{"id":{i}}}' for i in (1, 3, 2, 0, 1, 2)]
    with pytest.raises(ValueError):
        ek.adhoc_bulk(spark, [sql], {"t": df}, limit=None)
    assert not _has_order("SELECT rank() OVER (ORDER BY x) FROM (SELECT * FROM t ORDER BY y) -- order by z")


def test_first_incremental_load_takes_every_row(rows):
    df, none = rows("id int, ts int", (1, 5), (2, None)), rows("ts int")
    assert ek.changed_since(df, "ts", none).count() == 2 == ek.changed_since(df, "ts", None).count()
    assert as_set(ek.changed_since(df, "ts", 4), "id") == {(1,)}


def test_open_end_before_another_version_overlaps(rows):
    df = rows("k int, a string, b string", (1, "2024-01-01", None), (1, "2024-02-01", "2024-02-05"), (1, "2024-02-06", None))
    df = df.select("k", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    for hot in (1, 100):
        assert [r.fault for r in ek.date_chain(df, ["k"], "a", "b", chunk_rows=hot).collect()] == ["overlap"]


def test_sets_are_compared_in_the_type_of_the_column(rows):
    df = rows("v decimal(9,2)", *[(__import__("decimal").Decimal(x),) for x in ("1.00", "2.00")])
    assert as_set(ek.required_values(df, "v", ["1", "2.0", "3"])) == {("3",)}
    assert ek.required_values(rows("v string", ("1.0",)), "v", ["1"]).count() == 1


def test_aggregates_of_dates_and_text(rows):
    a, b = rows("g int, t string", (1, "x"), (2, "y")), rows("g int, t string", (1, "x"), (2, "z"))
    out = ek.agg_compare(a, b, ["g"], {"last": "max(t)"})
    assert as_set(out, "g", "diff_last", "status") == {(1, None, "match"), (2, None, "mismatch")}


def test_long_runtimes(rows):
    df = rows("runtime string, testcase_name string", ("1 day, 2:00:00", "a"), ("0:00:01.5", "b"), ("soon", "c"))
    assert as_set(df.select(runtime_seconds(F.col("runtime")))) == {(93600,), (1,), (None,)}
    assert as_set(runtime_members(df), "testcase_name", "bucket") == {("a", "5m+"), ("b", "0s-45s"), ("c", "unknown")}


def test_comments_in_query_files(tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("SELECT 1 -- one\n  AS a\n;")
    assert query_text(str(path)) == "SELECT 1 -- one\nAS a"


def test_negative_zero_survives_a_hot_group(rows):
    df = rows("k int, v double, w float", (1, -0.0, 0.0), (1, 0.0, -0.0), (1, None, 1.5), (1, -0.0, -0.0), (2, float("nan"), 2.0))
    read = lambda hot: sorted(str(tuple(r)[:3]) for r in ek.occurrence(df, ["k"], chunk_rows=hot).collect())
    assert read(1) == read(10**6)
    assert ek.occurrence(df, ["k"], chunk_rows=1).schema == ek.occurrence(df, ["k"]).schema


def test_fingerprint_keys_of_other_types(rows):
    src, tgt = rows("k int, v string", (1, "a"), (None, "b"), (None, "b")), rows("k bigint, v string", (1, "a"), (None, "b"))
    out = {r.kpi: (r.src_value, r.tgt_value) for r in ek.fingerprint(src, tgt, ["k"]).collect()}
    assert out["duplicate_keys"] == out["duplicate_rows"] == (1, 0) and out["checksum"] == (0, 0)


def test_suite_run_has_an_identity_and_details(spark, rows, tmp_path):
    src, tgt = rows("id int, v int", (1, 1), (2, 2), (3, 3)), rows("ident int, v int", (1, 1), (2, 9), (4, 4))
    cases = [ek.Case("a", "id", src, tgt, columns={"id": "ident", "v": "v"}, limit=1), ek.Case("b", "none", src, tgt)]
    for kind, result in (("content", "Failed"), ("duplicate", "Passed"), ("fingerprint", "Failed")):
        done = ek.run_suite(spark, cases, kind)
        assert as_set(done, "testcase_name", "test_result") == {("a", result), ("b", "Errored")}
        append_history(done, str(tmp_path / "history"))
    history = read_table(spark, HISTORY, str(tmp_path / "history"))
    assert history.where("run_created_time IS NULL OR db_stored_time IS NULL").isEmpty()
    assert as_set(ek.trend(history), "total", "failed", "passed") == {(2, 1, 0), (2, 0, 1)} and ek.trend(history).count() == 3
    found = ek.suite_details(spark, cases)
    assert as_set(found.where("testcase_name = 'a'"), "kind", "key_columns", "source_value", "target_value") == {
        ("cell", "id=2", "2", "9"), ("mismatched", "id=2", None, None), ("only_source", "id=3", None, None), ("only_target", "id=4", None, None)}
    assert as_set(found.where("testcase_name = 'b'"), "kind") == {("errored",)}
    with pytest.raises(ValueError):
        append_history(done.drop("test_result"), str(tmp_path / "other"))


def test_lookup_keys_that_repeat(rows):
    lookup = rows("code int, name string", (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"))
    mapped = [MappingRow("n", "c", "derived", lookup_table="l", lookup_key="code", lookup_return="name"), MappingRow("c", "c")]
    assert as_set(repeated_lookup_keys(mapped, {"l": lookup})) == {("l", "code", "1", 2)}
    assert repeated_lookup_keys(mapped[1:], {}) is None
