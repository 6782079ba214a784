"""Physical plans: what is read, what is shuffled, how joins run."""

import re

import evenkeel as ek
from conftest import SF_TINY
from evenkeel.operators.reconcile import Pair
from workload.fixtures import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> int:
    return len(re.findall(r"FileScan parquet", plan(df)))


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def part(spark):
    return table(spark, SF_TINY, "part")


def test_null_test_scans_each_side_once(spark):
    src, tgt = part(spark), part(spark).where("p_size > 3")
    assert scans(ek.test_null(src, tgt)) == 2


def test_scan_rules_share_one_scan(spark):
    rules = [ek.Rule("Length", "p_name", "Between", "1-99"), ek.Rule("Regexp", "p_brand", "", "^B"),
             ek.Rule("NotBeNull", "p_size"), ek.Rule("Null", "p_type"), ek.Rule("Sum", "p_size", "Between", "0-1"),
             ek.Rule("ColumnCount", "Table", "", "6")]
    assert scans(ek.run_quality(part(spark), rules)) == 1
    assert scans(ek.run_quality(part(spark), rules + [ek.Rule("Unique", "p_name")])) == 2


def jobs_of(spark, build):
    """The frame that ``build`` gives, and the jobs that ran meanwhile."""
    name = f"built-{id(build)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        return build(), list(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_reconcile_reads_what_it_compares(spark):
    pair = Pair(table(spark, SF_TINY, "orders_src"), table(spark, SF_TINY, "orders"), ["o_orderkey"], ["o_custkey"])
    rows = ek.reconcile(pair)
    assert "CartesianProduct" not in plan(rows) and "NestedLoop" not in plan(rows)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(rows))
    assert read and all("o_orderpriority" not in r and "o_totalprice" not in r for r in read)
    # The sides meet in an aggregate by key; what is numbered passes the repeated keys first.
    assert "FullOuter" not in plan(rows) and "LeftSemi" in plan(rows)


def test_no_job_while_building(spark):
    src, tgt, events = (table(spark, SF_TINY, n) for n in ("orders_src", "orders_dup", "events"))
    pair = Pair(src, tgt, ["o_orderkey"])
    for build in (lambda: ek.reconcile(pair), lambda: ek.common_rows(pair), lambda: ek.only_target(pair), lambda: ek.test_content(pair),
                  lambda: ek.column_details(ek.reconcile(pair), ["o_orderkey"]), lambda: ek.sequence(events, ["event_type"], ["event_id"]),
                  lambda: ek.ranked(events, ["event_type"], ["value"]), lambda: ek.profile_numeric(events, ["value"], exact=True),
                  lambda: ek.date_chain(src.select("o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderdate")):
        assert jobs_of(spark, build)[1] == []
    assert len(jobs_of(spark, lambda: ek.counts(ek.reconcile(pair)).first())[1]) > 0


def test_key_filters_reach_both_scans(spark):
    src, tgt = table(spark, SF_TINY, "orders_src"), table(spark, SF_TINY, "orders").where("o_custkey > 0")
    pair = Pair(src, tgt, ["o_orderkey"], ["o_custkey"])
    text = plan(ek.common_rows(pair).where("o_orderkey = 5"))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    assert sum("EqualTo(o_orderkey,5)" in p and "GreaterThan(o_custkey,0)" in p for p in pushed) >= 1
    assert sum("EqualTo(o_orderkey,5)" in p and "GreaterThan(o_custkey,0)" not in p for p in pushed) >= 1
    assert ek.common_rows(pair).where("o_orderkey = 5").count() == 1


def test_differing_cells_are_limited_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, False, 2, 3, False)], "k int, occurrence long, matched boolean, src_a int, tgt_a int, eq_a boolean")
    text = plan(ek.column_details(rows, ["k"], 5))
    below = text[text.rindex("WindowGroupLimit"):]
    assert "Exchange" not in below and "dense_rank" in text


def test_null_safe_keys_stay_equi_joins(spark, rows):
    a, b = rows("k int, v int", (None, 1), (1, 2)), rows("k int, v int", (None, 1), (1, 2))
    text = plan(ek.reconcile(Pair(a, b, ["k"])))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_no_cross_join_in_verdicts(spark):
    src, tgt = table(spark, SF_TINY, "orders_src"), table(spark, SF_TINY, "orders_tgt")
    for df in (ek.test_count(src, tgt), ek.test_null(src, tgt), ek.test_duplicate(src, tgt, ["o_orderkey"]),
               ek.test_fingerprint(src, tgt, ["o_orderkey"]), ek.run_quality(src, [ek.Rule("NotBeNull", "o_orderstatus")])):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_fingerprint_plans_only_what_the_kpis_need(spark):
    src, tgt = part(spark), part(spark).where("p_size > 3")
    assert "md5" not in plan(ek.fingerprint(src, tgt, ["p_partkey"], ["row_count", "null_columns"]))
    narrow = plan(ek.fingerprint(src, tgt, ["p_partkey"], ["row_count"]))
    assert "p_name" not in "".join(re.findall(r"ReadSchema: struct<([^>]*)>", narrow))


def test_limits_per_group_apply_before_the_shuffle(spark):
    df = part(spark)
    for frame in (ek.profile_topk(df, ["p_name", "p_brand"]), ek.dup_value_lists(df.select("p_name", "p_brand")),
                  ek.quality_samples(df, [ek.Rule("Regexp", "p_brand", "", "x")])):
        assert "WindowGroupLimit" in plan(frame)


def test_filters_reach_the_scan(spark):
    spec = ek.SourceSpec("local", "parquet", path=f"{SF_TINY}/orders.parquet", where="WHERE o_orderstatus = 'F'",
                         exclude="o_orderdate,o_orderpriority,o_totalprice")
    text = plan(ek.read_source(spark, spec))
    assert "EqualTo(o_orderstatus,F)" in text
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string"]


def test_null_filters_of_a_mapping_reach_the_scan(spark):
    rows = [ek.MappingRow("id", "o_orderkey", filter_nulls=True)]
    text = plan(ek.apply_mapping(table(spark, SF_TINY, "orders"), rows, where="o_custkey > 5"))
    assert "IsNotNull(o_orderkey)" in text and "GreaterThan(o_custkey,5)" in text


def test_no_python_in_any_plan(spark):
    from workload import QUERIES

    for name in ("test_content", "dq_suite", "profile_numeric", "date_chain_hot", "row_sequence_hot", "map_layer_hop"):
        text = plan(QUERIES[name](spark, SF_TINY))
        assert "Python" not in text and "Pandas" not in text, name


def test_rules_on_values_share_one_scan(spark):
    df = part(spark)
    unique = [ek.Rule("Unique", c) for c in ("p_name", "p_brand", "p_type")] + [ek.Rule("DistinctSet", "p_size", "", "[1,2]")]
    assert scans(ek.run_quality(df, unique)) == 1 == scans(ek.quality_samples(df, [*unique, ek.Rule("Regexp", "p_brand", "", "x")]))
    assert exchanges(ek.run_quality(df, unique)) == 1


def test_reference_check_reads_the_child_once(spark):
    li, orders, parts = table(spark, SF_TINY, "li_orphan"), table(spark, SF_TINY, "orders"), part(spark)
    text = plan(ek.ref_integrity(li, [
        ek.Reference("order", "l_orderkey", orders, "o_orderkey"), ek.Reference("part", "l_partkey", parts, "p_partkey"),
        ek.Reference("again", "l_orderkey", orders, "o_custkey")]))
    assert len(re.findall(r"FileScan parquet.*l_orderkey", text)) == 1
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_high_water_mark_reaches_the_scan(spark):
    changed = ek.changed_since(table(spark, SF_TINY, "events"), "ts", table(spark, SF_TINY, "events_loaded"))
    assert "GreaterThan(ts,ScalarSubquery" in plan(changed)


def test_many_aggregates_plan_quickly(spark):
    aggs = {f"a{i}": f"sum(p_size + {i})" for i in range(30)}
    out = ek.agg_compare(part(spark), part(spark), ["p_brand"], aggs).where("status <> 'match'")
    assert out.select("p_brand", *[f"diff_a{i}" for i in range(30)]).where("diff_a3 > 0").count() == 0
