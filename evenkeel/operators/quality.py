"""Declarative data quality rules compiled into aggregates."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..frames import passed, stack_rows
from ..functions.parsing import as_list, as_range, as_scalar
from ..functions.values import col


@dataclass(frozen=True)
class Rule:
    """One row of a rule list."""

    check: str
    column: str = ""
    check_type: str = ""
    value: object = ""

    @property
    def name(self) -> str:
        return self.check.strip().lower()


# The field names of a rule list.
_FIELDS = ("DQ Check", "Column", "Check Type", "Value")


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from a JSON array; rule lists are configuration, a handful of rows."""
    rows = spark.read.option("multiLine", True).json(path).collect()
    return rules_of(r.asDict() for r in rows)


def rules_of(rows: Iterable[dict]) -> list[Rule]:
    return [Rule(*[row.get(f) if row.get(f) is not None else "" for f in _FIELDS]) for row in rows]


def _violation(rule: Rule) -> Column | None:
    """The condition of an unexpected value, for rules that judge one row at a time. NULL passes all but NotBeNull."""
    c, kind = col(rule.column), rule.check_type.strip().lower()
    text = c.cast("string")
    if rule.name == "length" and kind == "between":
        lo, hi = as_range(rule.value)
        return ~F.length(text).between(int(lo), int(hi))
    if rule.name == "length":
        return F.length(text) != int(as_scalar(rule.value))
    if rule.name == "null":
        return c.isNotNull()
    if rule.name == "notbenull":
        return c.isNull()
    if rule.name == "regexp":
        return ~text.rlike(as_scalar(rule.value))
    if rule.name == "regexplist":
        return ~reduce(lambda a, b: a | b, [text.rlike(p) for p in as_list(rule.value, raw=True)])
    return None


# The checks that look at the whole column or table.
_COLUMN_CHECKS = {"unique", "distinctset"}

_REASONS = {
    "length": "values do not have the expected length",
    "null": "values are not null",
    "notbenull": "values are null",
    "regexp": "values do not match the pattern",
    "regexplist": "values match none of the patterns",
    "unique": "values are not unique",
}


def _expected(rule: Rule) -> Column:
    value = rule.value
    return F.lit(json.dumps(value) if isinstance(value, (list, tuple)) else str(value))


def _verdict(no: int, rule: Rule, elements: Column, unexpected: Column, observed: Column, ok: Column, bad: Column):
    return {
        "rule_no": F.lit(no), "check": F.lit(rule.check), "column": F.lit(rule.column),
        "check_type": F.lit(rule.check_type), "expected": _expected(rule), "element_count": elements,
        "unexpected_count": unexpected, "observed": observed, "result": passed(ok),
        "reason": F.when(ok, "Matched").otherwise(bad),
    }


def _order_mismatches(found: list[str], wanted: list[str]) -> list[str]:
    width = max(len(found), len(wanted))
    pad = lambda names: names + [None] * (width - len(names))
    return [f"{i + 1}:{w or '-'}<>{f or '-'}" for i, (w, f) in enumerate(zip(pad(wanted), pad(found))) if w != f]


def run_quality(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One verdict row per rule.

    All rules that judge single rows, sums or the table's shape share one aggregate over one scan.
    All unique and distinct-set rules share one more scan and one counted shuffle of (rule, value).
    """
    rules = list(rules)
    shared, later = [F.count(F.lit(1)).alias("__rows")], []
    verdicts: list[dict] = []
    nothing = F.lit(None).cast("string")
    rows = F.col("__rows")
    for no, rule in enumerate(rules, start=1):
        bad = _violation(rule)
        if bad is not None:
            shared.append(F.count_if(bad).alias(f"__r{no}"))
            n = F.col(f"__r{no}")
            text = F.concat(n.cast("string"), F.lit(" " + _REASONS[rule.name]))
            verdicts.append(_verdict(no, rule, rows, n, nothing, n == 0, text))
        elif rule.name == "sum":
            lo, hi = as_range(rule.value)
            shared.append(F.sum(col(rule.column)).alias(f"__r{no}"))
            total = F.col(f"__r{no}")
            ok = F.coalesce(total.between(F.lit(lo), F.lit(hi)), F.lit(False))
            verdicts.append(_verdict(no, rule, rows, F.lit(None).cast("bigint"), total.cast("string"), ok,
                                     F.lit("The sum is outside the range")))
        elif rule.name == "columncount":
            want, have = int(as_scalar(rule.value)), len(df.columns)
            verdicts.append(_verdict(no, rule, rows, F.lit(None).cast("bigint"), F.lit(str(have)), F.lit(have == want),
                                     F.lit("The column count differs")))
        elif rule.name == "columnorder":
            wrong = _order_mismatches(df.columns, as_list(rule.value))
            verdicts.append(_verdict(no, rule, rows, F.lit(len(wrong)).cast("bigint"), F.lit(",".join(wrong)),
                                     F.lit(not wrong), F.lit("The column order differs")))
        elif rule.name in _COLUMN_CHECKS:
            later.append((no, rule))
        else:
            raise ValueError(f"unknown check: {rule.check!r}")
    frames = [stack_rows(df.agg(*shared), verdicts)] if verdicts else []
    return reduce(DataFrame.unionByName, frames + ([_column_rules(df, later)] if later else []))


def _comparable(value: Column, kind: T.DataType) -> Column:
    """Text that is equal where the values are: -0.0 is 0.0."""
    return (value + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else value).cast("string")


def _wanted(df: DataFrame, rule: Rule) -> tuple[Column, Column]:
    """The values of a set in the column's type, as comparable text, so 1 is 1.00 of a decimal; and how many cannot become one."""
    kind = df.select(col(rule.column)).schema[0].dataType
    typed = [_comparable(F.lit(w).try_cast(kind), kind) for w in sorted(set(as_list(rule.value)))]
    all_of = F.array(*typed) if typed else F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(all_of)), F.size(F.filter(all_of, lambda w: w.isNull()))


def _values(df: DataFrame, rules: Iterable[tuple[int, Rule]]) -> list[Column]:
    """(rule_no, value) structs of a row, one for each rule."""
    kind = lambda rule: df.select(col(rule.column)).schema[0].dataType
    return [F.struct(F.lit(no).alias("rule_no"), _comparable(col(r.column), kind(r)).alias("value")) for no, r in rules]


def _column_rules(df: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Verdicts of the rules that look at a column's values: every value is counted once per rule, then all rules share one aggregate."""
    counted = df.select(F.inline(F.array(*_values(df, rules)))).groupBy("rule_no", "value").agg(F.count(F.lit(1)).alias("n"))
    zero, present = F.lit(0).cast("bigint"), F.col("value").isNotNull()
    measures, verdicts = [], []
    for no, rule in rules:
        own = F.col("rule_no") == no
        elements, bad, lost = F.col(f"e{no}"), F.col(f"u{no}"), F.col(f"m{no}")
        measures.append(F.coalesce(F.sum(F.when(own, F.col("n"))), zero).alias(f"e{no}"))
        if rule.name == "unique":
            repeated = F.sum(F.when(own & present & (F.col("n") > 1), F.col("n")))
            measures.append(F.coalesce(repeated, zero).alias(f"u{no}"))
            text = F.concat(bad.cast("string"), F.lit(" " + _REASONS["unique"]))
            verdicts.append(_verdict(no, rule, elements, bad, F.lit(None).cast("string"), bad == 0, text))
            continue
        real, unreal = _wanted(df, rule)
        known = F.array_contains(real, F.col("value"))
        measures.append(F.count_if(own & present & ~known).alias(f"u{no}"))
        measures.append(((F.size(real) + unreal).cast("bigint") - F.count_if(own & present & known)).alias(f"m{no}"))
        observed = F.concat(bad.cast("string"), F.lit(" unexpected, "), lost.cast("string"), F.lit(" missing"))
        verdicts.append(_verdict(no, rule, elements, bad, observed, (bad == 0) & (lost == 0), F.lit("The distinct values differ from the set")))
    return stack_rows(counted.agg(*measures), verdicts)


def distinct_set_values(df: DataFrame, column: str, expected) -> DataFrame:
    """Every distinct or expected value with ``matched``, ``unexpected`` or ``missing`` and its row count.

    Expected values are compared in the column's type, as the verdict compares them; one that cannot become it is missing, as it was given.
    """
    kind = df.select(col(column)).schema[0].dataType
    wanted = sorted(set(as_list(expected)))
    want = df.sparkSession.createDataFrame([(w,) for w in wanted], "given string")
    typed = _comparable(F.col("given").try_cast(kind), kind)
    found = df.where(col(column).isNotNull()).groupBy(_comparable(col(column), kind).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    both = found.select("value", F.lit(False).alias("odd"), "rows", F.lit(False).alias("want")).union(
        want.select(F.coalesce(typed, "given"), typed.isNull(), F.lit(0).cast("bigint"), F.lit(True)))
    out = both.groupBy("value", "odd").agg(F.sum("rows").alias("rows"), F.bool_or("want").alias("want"))
    status = F.when(F.col("rows") == 0, "missing").when(F.col("want"), "matched").otherwise("unexpected")
    return out.select("value", "rows", status.alias("status"))


def quality_samples(df: DataFrame, rules: Iterable[Rule], k: int = 20) -> DataFrame:
    """The first ``k`` distinct unexpected values per rule, with their rows, all from one scan.

    Values are counted before the shuffle and the limit is applied on both sides of it.
    """
    cells, unique = [], []
    for no, rule in enumerate(rules, start=1):
        bad = _violation(rule)
        if bad is not None:
            cells.append(F.when(bad, F.struct(F.lit(no).alias("rule_no"), col(rule.column).cast("string").alias("value"))))
        elif rule.name in _COLUMN_CHECKS:
            (cell,) = _values(df, [(no, rule)])
            known = F.lit(False) if rule.name == "unique" else F.array_contains(_wanted(df, rule)[0], cell["value"])
            cells.append(F.when(cell["value"].isNotNull() & ~known, cell))
            unique += [no] if rule.name == "unique" else []
    if not cells:
        return df.sparkSession.createDataFrame([], "rule_no int, value string, rows bigint, sample_no int")
    hits = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("rule_no", "value").agg(F.count(F.lit(1)).alias("rows"))
    hits = hits.where(~F.col("rule_no").isin(unique) | (F.col("rows") > 1)) if unique else hits
    w = Window.partitionBy("rule_no").orderBy("value")
    return hits.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= k)


def rules_failed_first(verdicts: DataFrame) -> DataFrame:
    """Rule verdicts with the failed ones before the passed ones, by rule number."""
    return verdicts.orderBy(F.when(F.col("result") == "Passed", 1).otherwise(0), "rule_no")


def suite_roll_up(verdicts: DataFrame) -> DataFrame:
    """Total, passed and failed rules."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "Passed").alias("passed"),
        F.count_if(F.col("result") == "Failed").alias("failed"),
    )
