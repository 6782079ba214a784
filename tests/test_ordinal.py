"""Positions in groups: the distributed numbers equal the window's."""

import random

import pytest
from pyspark.sql import Window, functions as F

import evenkeel as ek
from conftest import SF_TINY, as_set
from evenkeel.operators import ordinal
from workload.fixtures import table


def skewed(rows, n=600, seed=3):
    """One key holds a third of the rows, one row of it is copied many times, one key is NULL."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        if i % 3 == 0:
            data.append((0, "copy" if rng.random() < 0.6 else f"v{rng.randint(0, 80)}"))
        else:
            data.append((rng.choice([None, *range(1, 40)]), rng.choice([None, "a", "b", f"v{i}"])))
    return rows("k int, v string", *data)


def test_hot_occurrence_equals_window(rows):
    df = skewed(rows)
    hot = ordinal.occurrence(df, ["k"], chunk_rows=5)
    plain = ordinal.occurrence(df, ["k"], chunk_rows=10**6)
    assert sorted(map(str, hot.collect())) == sorted(map(str, plain.collect()))


def test_blocks_of_copies(rows, monkeypatch):
    monkeypatch.setattr(ordinal, "_EXPAND", 7)
    df = rows("k int, v string", *[(1, "same")] * 50, (1, "zz"), (2, "x"))
    out = ordinal.occurrence(df, ["k"], chunk_rows=1)
    assert sorted(r.occurrence for r in out.where("k = 1").collect()) == list(range(1, 52))
    assert as_set(out.where("occurrence = 51")) == {(1, "zz", 51)}


def test_rows_that_are_all_key(rows):
    df = rows("k int", (1,), (1,), (1,), (2,))
    for hot in (1, 100):
        assert sorted(map(tuple, ordinal.occurrence(df, ["k"], chunk_rows=hot).collect())) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_one_sequence_over_a_whole_table(rows):
    df = rows("v int", *[(i % 17,) for i in range(100)])
    out = ordinal.occurrence(df, [], chunk_rows=5).orderBy("occurrence").collect()
    assert [r.occurrence for r in out] == list(range(1, 101)) and [r.v for r in out] == sorted(i % 17 for i in range(100))


def test_hot_positions_equal_rank_functions(rows):
    df = skewed(rows)
    w = Window.partitionBy("k").orderBy("v")
    want = df.select("k", "v", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d")).distinct()
    got = ek.ranked(df, ["k"], ["v"], chunk_rows=5)
    assert as_set(got, "k", "v", "rank", "dense_rank") == as_set(want)


@pytest.mark.parametrize("function,stored", [("rank", "rank_no"), ("dense_rank", "dense_no")])
def test_hot_rank_check(spark, function, stored):
    df = table(spark, SF_TINY, "line_ranks")
    run = lambda hot: as_set(ek.rank_check(df, ["l_orderkey"], ["l_linenumber"], stored, function, chunk_rows=hot))
    assert run(2) == run(10**6) != set()


def test_row_number_ties_accept_any_numbering(rows):
    good = rows("p int, o int, n int", (1, 5, 2), (1, 5, 1), (1, 6, 3))
    bad = rows("p int, o int, n int", (1, 5, 1), (1, 5, 1), (1, 6, 3))
    assert ek.rank_check(good, ["p"], ["o"], "n").count() == 0
    assert ek.rank_check(bad, ["p"], ["o"], "n").count() == 1


def test_hot_date_chain_equals_window(rows):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 2, None]), f"2020-01-{d:02d}", f"2020-01-{min(28, d + rng.randint(0, 3)):02d}")
            for d in range(1, 28) for _ in range(3)]
    df = rows("k int, s string, e string", *data).select("k", F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    run = lambda hot: sorted(map(str, ek.date_chain(df, ["k"], "s", "e", chunk_rows=hot).collect()))
    assert run(4) == run(10**6)


@pytest.mark.parametrize("chunk_rows", [10, 10**6])
def test_exact_quantiles(rows, chunk_rows):
    from evenkeel.operators.profile import quantiles

    rng = random.Random(9)
    data = [(rng.randint(0, 20) if i % 5 else None, i) for i in range(200)]
    got = {(r["column"], r["metric"]): r["value"] for r in quantiles(rows("a int, b int", *data), ["a", "b"], (0, 0.25, 0.5, 1), chunk_rows).collect()}
    for name, values in (("a", sorted(v for v, _ in data if v is not None)), ("b", list(range(200)))):
        for p in (0, 0.25, 0.5, 1):
            assert got[name, f"q{p * 100:g}"] == values[max(int(-(-p * len(values) // 1)), 1) - 1]
    assert quantiles(rows("a int"), ["a"]).count() == 0
