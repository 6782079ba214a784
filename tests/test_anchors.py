"""Known numbers of the fixture pairs at sf0.01."""

import evenkeel as ek
from conftest import SF_SMALL
from evenkeel.operators.reconcile import Pair
from pyspark.sql import functions as F
from workload.fixtures import table


def test_orders_pair(spark):
    src, tgt = (table(spark, SF_SMALL, n) for n in ("orders_src", "orders_tgt"))
    rows = ek.reconcile(Pair(src, tgt, ["o_orderkey"]))
    c = ek.counts(rows).first()
    assert (c.src_rows, c.tgt_rows, c.common, c.only_source, c.only_target, c.mismatched) == (
        15000, 14923, 14851, 149, 72, 1311)
    bad = {r["column"]: r["rows_mismatched"] for r in ek.column_summary(rows).collect()}
    assert bad == {"o_orderstatus": 356, "o_totalprice": 401, "o_orderpriority": 592}
    nulls = {r["column"]: r["nulls"] for r in ek.null_counts(tgt).collect()}
    assert (nulls["o_orderstatus"], nulls["o_orderpriority"]) == (281, 345)
    sides = {r.side: r["count"] for r in ek.data_check(src, tgt).groupBy("side").count().collect()}
    assert sides == {"source": 1460, "target": 1383}
    differing = ek.agg_compare(src, tgt, ["o_orderdate"], {"total": "sum(o_totalprice)"}).where("status <> 'match'")
    assert differing.count() == 554


def test_repeated_keys(spark):
    src, dup, line = (table(spark, SF_SMALL, n) for n in ("orders_src", "orders_dup", "lineitem"))
    c = ek.counts(ek.reconcile(Pair(src, dup, ["o_orderkey"]))).first()
    assert (c.common, c.only_source, c.only_target, c.tgt_rows, c.tgt_distinct) == (14851, 149, 226, 15077, 14923)
    kpi = ek.fingerprint(src, dup, ["o_orderkey"], ["duplicate_rows"]).first()
    assert (kpi.src_value, kpi.tgt_value) == (0, 154)
    assert ek.dup_keys(line, ["l_orderkey", "l_linenumber"]).count() == 11785


def test_history_and_quality(spark):
    scd = table(spark, SF_SMALL, "cust_scd2")
    assert ek.scd2_current_faults(scd, ["c_custkey"], "is_current").count() == 7
    assert ek.date_chain(scd, ["c_custkey"], "eff_from", "eff_to").count() == 6
    li = table(spark, SF_SMALL, "li_orphan")
    orphans = ek.ref_integrity(li, [ek.Reference("order", "l_orderkey", table(spark, SF_SMALL, "orders"), "o_orderkey")])
    assert orphans.first().orphan_rows == 201
    customer, part = table(spark, SF_SMALL, "customer"), table(spark, SF_SMALL, "part")
    rules = [ek.Rule("Length", "c_mktsegment", "Equal", "9"), ek.Rule("Length", "c_mktsegment", "Between", "8-9")]
    assert [r.unexpected_count for r in ek.run_quality(customer, rules).orderBy("rule_no").collect()] == [600, 298]
    rules = [ek.Rule("Unique", "p_name"), ek.Rule("Regexp", "p_brand", "", "^Brand#[0-9]$"),
             ek.Rule("Regexplist", "p_brand", "", ["^Brand#[0-9]$", "^Brand#1[0-9]$"])]
    assert [r.unexpected_count for r in ek.run_quality(part, rules).orderBy("rule_no").collect()] == [2000, 1261, 461]
    money = customer.select(F.col("c_acctbal").cast("decimal(18,2)").alias("m"))
    total = money.agg(F.sum(F.when(F.col("m") < 0, F.col("m"))).alias("neg"), F.sum(F.when(F.col("m") >= 0, F.col("m"))).alias("pos")).first()
    assert (str(total.neg), str(total.pos)) == ("-61692.67", "6805281.63")
