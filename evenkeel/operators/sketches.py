"""Profiles as states that merge: one scan of the data gives one small row per column, and rows of parts, loads or runs add up.

A state holds exact sums (rows, NULLs, blanks, lengths, extremes, total and squared deviations) and three kinds of sketches: quantiles
(KLL), distinct values (HyperLogLog) and frequent values and patterns. Its size depends on the sketches' parameters only, never on the
rows, so states can be stored with every load and compared later without reading the data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..frames import stack_rows
from ..functions.values import col, text_mask

#: Size of the quantile sketch (rank error about 1.7 percent at 200), binary logarithm of the registers of the distinct sketch (standard
#: error about 1.6 percent at 12), items that the frequency sketches track (with fewer different values the counts are exact).
KLL_SIZE, HLL_BITS, ITEMS = 200, 12, 1000
QUANTILES = (0.25, 0.5, 0.75)
#: Ranks at which two distributions are compared.
GRID = tuple(k / 200 for k in range(1, 200))


def profile_state(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One state row per column, and per group of ``by`` (a load, a day, a partition), from one scan and one aggregate.

    NaN counts as a value but is left out of sums and quantiles. Columns of types without an order or a text form are profiled by their JSON.
    """
    columns = [c for c in (columns or df.columns) if c not in by]
    kinds = {f.name: f.dataType for f in df.schema}

    def plain(c: str) -> Column:
        nested = isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        return (F.when(col(c).isNotNull(), F.to_json(F.struct(col(c)))) if nested else col(c)).alias(f"v{columns.index(c)}")

    number = lambda c: isinstance(kinds[c], T.NumericType)
    cells = df.select(*[col(g) for g in by], *[plain(c) for c in columns])
    # Texts, numbers and patterns are made once a row; every measure would make its own.
    made = []
    for i, c in enumerate(columns):
        v, double = F.col(f"v{i}"), F.col(f"v{i}").cast("double")
        made.append(v.cast("string").alias(f"t{i}"))
        if number(c):
            made.append(F.when(~F.isnan(double), double).alias(f"x{i}"))
        if isinstance(kinds[c], T.StringType):
            made.append(text_mask(v).alias(f"p{i}"))
    cells = cells.select("*", *made)
    parts, rows = [F.count(F.lit(1)).alias("__rows")], []
    for i, c in enumerate(columns):
        v, text, is_text = F.col(f"v{i}"), F.col(f"t{i}"), isinstance(kinds[c], T.StringType)
        x = F.col(f"x{i}") if number(c) else F.lit(None).cast("double")
        pattern = F.col(f"p{i}") if is_text else F.lit(None).cast("string")
        measures = {
            "count": F.count(v), "blanks": F.count_if(F.trim(text) == "") if is_text else F.lit(0).cast("long"),
            "min_length": F.min(F.length(text)), "max_length": F.max(F.length(text)), "low": F.min(text), "high": F.max(text),
            "numbers": F.count(x), "min": F.min(x), "max": F.max(x), "total": F.sum(x), "squares": F.var_pop(x) * F.count(x),
            "quantiles": F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)), "distinct": F.hll_sketch_agg(text, F.lit(HLL_BITS)),
            "frequent": _top(text), "patterns": _top(pattern),
        }
        parts += [m.alias(f"{name}{i}") for name, m in measures.items()]
        kind = "number" if number(c) else "text" if is_text else "other"
        rows.append(
            {g: col(g) for g in by} | {"column": F.lit(c), "kind": F.lit(kind), "rows": F.col("__rows")}
            | {name: F.col(f"{name}{i}") for name in measures}
        )
    totals = cells.groupBy(*[col(g) for g in by]).agg(*parts) if by else cells.agg(*parts)
    return stack_rows(totals, rows)


def _top(value: Column) -> Column:
    # NULL is no value; it is counted apart.
    return F.call_function("approx_top_k_accumulate", value, F.lit(ITEMS))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of parts added up, one row per column (and group of ``by``); sums are exact, sketches keep their error bounds."""
    whole = F.sum("total")
    apart = F.sum(F.when(F.col("numbers") > 0, F.col("squares") + F.col("total") * F.col("total") / F.col("numbers")))
    squares = F.when(F.sum("numbers") > 0, F.greatest(apart - whole * whole / F.sum("numbers"), F.lit(0.0)))
    return states.groupBy(*[col(g) for g in by], "column", "kind").agg(
        *[F.sum(c).alias(c) for c in ("rows", "count", "blanks")],
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("numbers").alias("numbers"), F.min("min").alias("min"), F.max("max").alias("max"),
        whole.alias("total"), squares.alias("squares"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
        *[F.call_function("approx_top_k_combine", F.col(c), F.lit(ITEMS)).alias(c) for c in ("frequent", "patterns")],
    )


def describe(states: DataFrame, topk: int = 10) -> DataFrame:
    """The measures of states as (column, metric, value) text rows; a metric that a column's kind does not have is left out."""
    has = F.col("numbers") > 0
    text = F.col("kind") == "text"
    entry = lambda metric, value, when=None: F.struct(
        F.lit(metric).alias("metric"), (value if when is None else F.when(when, value)).cast("string").alias("value"))
    number = lambda value: F.when(F.col("kind") == "number", value.cast("double").cast("string")).otherwise(value.cast("string"))
    plain = F.array(
        entry("count", number(F.col("count"))), entry("nulls", number(F.col("rows") - F.col("count"))),
        entry("distinct", F.hll_sketch_estimate("distinct")), entry("blanks", F.col("blanks"), text),
        entry("min_length", F.col("min_length"), text), entry("max_length", F.col("max_length"), text),
        entry("min", F.when(has, F.col("min").cast("string")).otherwise(F.col("low"))),
        entry("max", F.when(has, F.col("max").cast("string")).otherwise(F.col("high"))),
        entry("mean", F.col("total") / F.col("numbers"), has),
        entry("sd", F.sqrt(F.col("squares") / (F.col("numbers") - 1)), F.col("numbers") > 1),
        *[entry(f"q{q * 100:g}", F.kll_sketch_get_quantile_double("quantiles", F.lit(q)), has) for q in QUANTILES],
    )

    def listed(state: str, label: str) -> Column:
        found = F.filter(F.call_function("approx_top_k_estimate", F.col(state), F.lit(topk)), lambda t: t["item"].isNotNull())
        return F.transform(F.when(text, found).otherwise(F.slice(found, 1, 0)), lambda t, i: F.struct(
            F.concat(F.lit(f"{label}_"), (i + 1).cast("string")).alias("metric"),
            F.concat(t["item"], F.lit(" ("), t["count"].cast("string"), F.lit(")")).alias("value")))

    listing = F.concat(plain, listed("frequent", "top"), listed("patterns", "pattern"))
    return states.select("column", F.inline(listing)).where(F.col("value").isNotNull())


def profile_drift(before: DataFrame, after: DataFrame, limit: float = 0.1) -> DataFrame:
    """How the columns of two runs differ, from their states alone.

    ``distance`` is the largest difference of the two distributions of a numeric column (0 to 1), taken at the ranks of ``GRID`` of
    either side, so it is too low by at most a step of the grid and the sketches' rank errors. A column has drifted if the distance or
    the shift of its share of NULLs is over ``limit``, or if only one side has it (or has it with another kind).
    """
    side = lambda states, p: merge_states(states).select(
        F.col("column"), *[F.col(c).alias(f"{p}_{c}") for c in ("kind", "rows", "count", "numbers", "total", "quantiles")])
    both = side(before, "b").join(side(after, "a"), "column", "full")
    share = lambda p: F.when(F.col(f"{p}_rows") > 0, 1 - F.col(f"{p}_count") / F.col(f"{p}_rows")).otherwise(F.lit(0.0))
    grid = F.array(*[F.lit(q) for q in GRID])
    both = both.select("*", *[
        F.when(F.col(f"{p}_numbers") > 0, F.kll_sketch_get_quantile_double(f"{p}_quantiles", grid)).alias(f"{p}_grid") for p in "ba"])
    # The share of a side at or below x is the share of its grid there; the largest gap lies at a grid value of one side.
    upto = lambda p, x: F.size(F.filter(F.col(f"{p}_grid"), lambda q: q <= x)) / float(len(GRID))
    gaps = F.transform(F.concat("b_grid", "a_grid"), lambda x: F.abs(upto("b", x) - upto("a", x)))
    both = both.withColumn("distance", F.array_max(gaps))
    known = F.col("a_kind").eqNullSafe(F.col("b_kind"))
    shift = F.when(known, F.abs(share("a") - share("b")))
    return both.select(
        "column", F.col("b_rows").alias("rows_before"), F.col("a_rows").alias("rows_after"),
        F.when(F.col("b_rows").isNotNull(), share("b")).alias("nulls_before"),
        F.when(F.col("a_rows").isNotNull(), share("a")).alias("nulls_after"),
        (F.col("b_total") / F.col("b_numbers")).alias("mean_before"), (F.col("a_total") / F.col("a_numbers")).alias("mean_after"),
        "distance", (~known | (F.coalesce("distance", F.lit(0.0)) > limit) | (F.coalesce(shift, F.lit(0.0)) > limit)).alias("drifted"),
    )
