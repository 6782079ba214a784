"""Work that has to grow no faster than the rows: hot keys, searches among bounds, profiles."""

import re

import evenkeel as ek
from conftest import SF_TINY, as_set
from evenkeel.operators.ordinal import occurrence
from evenkeel.operators.reconcile import Pair
from workload.fixtures import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_hot_key_are_not_shuffled_by_key(rows):
    """a small list picks them, so the join by key never has them in one task; hot, repeated, single and null keys all pair up."""
    src = [(None, 1), (None, 2), (0, None), *[(0, i % 7) for i in range(60)], (1, 1), (1, 1), (2, 5), (3, 3)]
    tgt = [(None, 2), *[(0, i % 5) for i in range(70)], (1, 1), (2, 6), (4, 4), (4, 4)]
    pair = lambda n: Pair(rows("k int, v int", *src), rows("k int, v int", *tgt), ["k"], chunk_rows=n)
    hot = ek.reconcile(pair(16))
    assert sorted(map(repr, hot.collect())) == sorted(map(repr, ek.reconcile(pair(1 << 20)).collect()))
    assert {c: n for c, n in ek.counts(hot).first().asDict().items() if c in ("src_rows", "tgt_rows", "common")} == {
        "src_rows": 67, "tgt_rows": 75, "common": 64}
    text = plan(ek.reconcile(pair(16)))
    assert re.search(r"BroadcastHashJoin.*LeftAnti", text) and re.search(r"BroadcastHashJoin.*LeftSemi", text)
    # Numbered copies are dealt out before they are sorted: no partial aggregate of pairs below that exchange.
    assert "REPARTITION_BY_COL" in text


def test_bounds_are_searched_once_a_row(rows):
    """no filter repeats the search, no row carries the bounds, and the search takes as many steps as there are bounds."""
    df = rows("k string, v int", *[("a", i) for i in range(50)], ("b", 1))
    text = plan(occurrence(df, ["k"], ["v"], chunk_rows=8))
    assert not re.search(r"Filter .*lambda", text) and "AS __bounds" not in text and ".steps" in text
    assert as_set(occurrence(df, ["k"], ["v"], chunk_rows=8)) == {("a", i, i + 1) for i in range(50)} | {("b", 1, 1)}


def test_ranked_rows_are_spread_between_the_two_counts(rows):
    """the input lies together by the partition; counting it whole there would hold all its rows twice in one task."""
    df = rows("k int, v int, no int", (1, 1, 1), (1, 1, 1), (1, 2, 3), (1, 2, 9), (None, 5, 1), (None, None, 1), (None, 5, 2)).repartition(3, "k")
    for function, wrong in (("rank", {(1, 2, 9, 3, 1), (None, 5, 1, 2, 1)}), ("dense_rank", {(1, 2, 9, 2, 1), (1, 2, 3, 2, 1), (None, 5, 1, 2, 1)})):
        found = ek.rank_check(df, ["k"], ["v"], "no", function)
        assert as_set(found) == wrong
        assert re.search(r"hashpartitioning\((_groupingexpression|__row|struct|named_struct)", plan(found))


def test_profile_makes_texts_once(spark):
    """the measures of a state read texts, numbers and patterns that were made once a row."""
    data = table(spark, SF_TINY, "lineitem")
    aggregate = "\n".join(line for line in plan(ek.profile_state(data)).splitlines() if "Aggregate" in line)
    assert "cast(" not in aggregate and "regexp_replace" not in aggregate
    found = {(r.column, r.metric): r.value for r in ek.profile(data).where("metric IN ('count', 'min', 'max', 'pattern_1')").collect()}
    low, high, n = data.selectExpr("min(l_quantity)", "max(l_quantity)", "count(*)").first()
    assert (found["l_quantity", "min"], found["l_quantity", "max"]) == (str(float(low)), str(float(high)))
    assert found["l_linestatus", "pattern_1"] == f"A ({n})"
