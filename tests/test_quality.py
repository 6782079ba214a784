"""Rule decoding and rule semantics on small frames."""

import json
from decimal import Decimal

import pytest

import evenkeel as ek
from conftest import as_set
from evenkeel.functions.parsing import as_list, as_range, names, predicate
from evenkeel.operators.quality import Rule


def verdicts(df, *rules):
    return [(r.result, r.unexpected_count, r.element_count) for r in ek.run_quality(df, rules).orderBy("rule_no").collect()]


def test_list_cells():
    assert as_list("['M','F']") == ["M", "F"]
    assert as_list('["M", "F"]') == ["M", "F"]
    assert as_list(["a", 1]) == ["a", "1"]
    assert as_list("'x'") == ["x"]
    assert as_list(r"['^\d{4}-\d{2}$','^\d{4}/\d{2}$']", raw=True) == [r"^\d{4}-\d{2}$", r"^\d{4}/\d{2}$"]


def test_word_boundaries_survive(rows):
    df = rows("s string", ("a cat",), ("concat",))
    assert verdicts(df, Rule("Regexplist", "s", "", r"['\bcat\b', 'dog']")) == [("Failed", 1, 2)]


def test_range_cells():
    assert as_range("10-23") == (Decimal(10), Decimal(23))
    assert as_range("-5.5 - -1") == (Decimal("-5.5"), Decimal(-1))
    with pytest.raises(ValueError):
        as_range("ten")


def test_filter_and_name_cells():
    assert predicate("") is None and predicate("  ") is None and predicate(None) is None
    assert predicate("where a = 1;") == "a = 1"
    assert predicate("a=1") == "a=1" and predicate("wherever = 1") == "wherever = 1"
    assert names(" a , b,,") == ["a", "b"]


def test_nulls_only_fail_not_null(rows):
    df = rows("s string, n int", (None, None), ("abc", 1))
    assert verdicts(df, Rule("Length", "s", "Equal", "3"), Rule("Length", "s", "Between", "1-2"), Rule("Regexp", "s", "", "^b"),
                    Rule("NotBeNull", "s"), Rule("Null", "s")) == [
        ("Passed", 0, 2), ("Failed", 1, 2), ("Failed", 1, 2), ("Failed", 1, 2), ("Failed", 1, 2)]


def test_regex_is_a_search_and_quotes_are_dropped(rows):
    df = rows("s string", ("2024-01-02",), ("x2024-01-02",), ("2024/01/02",))
    assert verdicts(df, Rule("Regexp", "s", "", r"'\d{4}-\d{2}-\d{2}'"), Rule("Regexp", "s", "", r"'^\d{4}-\d{2}-\d{2}$'"),
                    Rule("Regexplist", "s", "", r"['^\d{4}-\d{2}-\d{2}$','^\d{4}/\d{2}/\d{2}$']")) == [
        ("Failed", 1, 3), ("Failed", 2, 3), ("Failed", 1, 3)]


def test_unique_counts_every_copy_and_skips_nulls(rows):
    df = rows("s string", (None,), (None,), ("a",), ("a",), ("b",))
    assert verdicts(df, Rule("Unique", "s")) == [("Failed", 2, 5)]
    assert verdicts(rows("s string", (None,), (None,), ("a",)), Rule("Unique", "s")) == [("Passed", 0, 3)]


def test_distinct_set(rows):
    df = rows("g string", ("M",), ("F",), (None,))
    assert verdicts(df, Rule("DistinctSet", "g", "", "['F','M']"))[0][0] == "Passed"
    bad = ek.run_quality(df, [Rule("DistinctSet", "g", "", '["M","X","Y"]')]).first()
    assert (bad.result, bad.unexpected_count, bad.observed) == ("Failed", 1, "1 unexpected, 2 missing")
    assert as_set(ek.distinct_set_values(df, "g", ["M", "X"])) == {("M", 1, "matched"), ("F", 1, "unexpected"), ("X", 0, "missing")}


def test_sum_bounds_are_inclusive(rows):
    df = rows("v int", (-4,), (1,))
    assert [v[0] for v in verdicts(df, Rule("Sum", "v", "Between", "-3-0"), Rule("Sum", "v", "Between", "-2-0"))] == ["Passed", "Failed"]
    assert verdicts(rows("v int"), Rule("Sum", "v", "Between", "0-1"))[0][0] == "Failed"


def test_table_rules(rows):
    df = rows("a int, b int", (1, 2))
    assert [v[0] for v in verdicts(df, Rule("ColumnCount", "Table", "", "2"), Rule("ColumnOrder", "Table", "", "['a','b']"),
                                   Rule("ColumnOrder", "Table", "", "['b','a','c']"))] == ["Passed", "Passed", "Failed"]
    observed = ek.run_quality(df, [Rule("ColumnOrder", "Table", "", "['b','a','c']")]).first().observed
    assert observed == "1:b<>a,2:a<>b,3:c<>-"


def test_unknown_rule_raises(rows):
    with pytest.raises(ValueError, match="Shape"):
        ek.run_quality(rows("a int", (1,)), [Rule("Shape", "a")])


def test_rules_from_a_file(spark, rows, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([
        {"DQ Check": "NotBeNull", "Column": "a", "Check Type": "Not Required", "Value": ""},
        {"DQ Check": "DistinctSet", "Column": "b", "Check Type": "Not Required", "Value": "['x','y']"},
    ], indent=2))
    df = rows("a int, b string", (1, "x"), (2, "y"))
    out = ek.run_quality(df, ek.load_rules(spark, str(path)))
    assert ek.suite_roll_up(out).first() == (2, 2, 0)


def test_samples_are_counted_and_limited(rows):
    df = rows("s string", *[(f"v{i % 30:02d}",) for i in range(90)])
    out = ek.quality_samples(df, [Rule("Regexp", "s", "", "^v00$"), Rule("Unique", "s")], k=5)
    assert as_set(out.where("rule_no = 1"), "value", "rows", "sample_no") == {(f"v{i:02d}", 3, i) for i in range(1, 6)}
    assert out.where("rule_no = 2").count() == 5
    assert ek.quality_samples(df, [Rule("ColumnCount", "Table", "", "1")]).count() == 0
