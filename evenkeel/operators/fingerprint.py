"""Null, blank, duplicate and checksum measures of a data set, and their two-sided comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..frames import passed, side_by_side, stack_rows
from ..functions.values import col
from .keys import key_counts


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, nulls: str = "skip") -> Column:
    """md5 over the columns as text joined by a bar.

    ``nulls='skip'`` leaves NULLs out, so ``(NULL, 'a')`` equals ``('a', NULL)``; ``'mark'`` writes ``\\N`` for a
    NULL and escapes bars, so different rows always give different text.
    """
    cells = []
    for name in columns or df.columns:
        text = col(name).cast("string")
        if nulls == "mark":
            text = F.coalesce(F.regexp_replace(text, r"([\\|])", r"\\$1"), F.lit("\\N"))
        cells.append(text)
    return F.md5(F.concat_ws("|", *cells))


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def null_counts(df: DataFrame) -> DataFrame:
    """(position, column, nulls) for every column, from one aggregate."""
    totals = df.agg(*[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return stack_rows(totals, [
        {"position": F.lit(i), "column": F.lit(c), "nulls": F.col(f"c{i}")} for i, c in enumerate(df.columns)
    ])


def empty_counts(df: DataFrame) -> DataFrame:
    """(position, column, blanks): values that are empty after trimming; only text can be."""
    text = set(_text_columns(df))
    blank = lambda c: F.count_if(F.trim(col(c)) == "") if c in text else F.lit(0).cast("bigint")
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[blank(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return stack_rows(totals, [
        {"position": F.lit(i), "column": F.lit(c), "blanks": F.col(f"c{i}")} for i, c in enumerate(df.columns)
    ])


def all_null(df: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNull() for c in df.columns])


def null_rows(df: DataFrame) -> DataFrame:
    """Rows in which every column is NULL."""
    return df.where(all_null(df))


def null_compare(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Null counts of both sides per column position, one scan per side."""
    s = null_counts(src).select("position", F.col("column").alias("src_column"), F.col("nulls").alias("src_nulls"))
    t = null_counts(tgt).select("position", F.col("column").alias("tgt_column"), F.col("nulls").alias("tgt_nulls"))
    both = s.unionByName(t, allowMissingColumns=True)
    return both.groupBy("position").agg(*[F.max(c).alias(c) for c in both.columns[1:]])


def measures(df: DataFrame) -> DataFrame:
    """One row: rows, columns, columns with NULLs, all-NULL rows, columns with blanks (and both name lists)."""
    names, text = df.columns, _text_columns(df)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(all_null(df)).alias("null_rows"),
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count_if(F.trim(col(c)) == "").alias(f"e{i}") for i, c in enumerate(text)],
    )
    listed = lambda cols, p: (
        F.concat_ws(",", *[F.when(F.col(f"{p}{i}") > 0, F.lit(c)) for i, c in enumerate(cols)]) if cols else F.lit("")
    )
    counted = lambda cols, p: sum((F.when(F.col(f"{p}{i}") > 0, 1).otherwise(0) for i in range(len(cols))), F.lit(0))
    return totals.select(
        "rows", F.lit(len(names)).cast("bigint").alias("columns"), "null_rows",
        counted(names, "n").cast("bigint").alias("null_cols"), listed(names, "n").alias("null_col_names"),
        counted(text, "e").cast("bigint").alias("empty_cols"), listed(text, "e").alias("empty_col_names"),
    )


def hash_counts(src: DataFrame, tgt: DataFrame, nulls: str = "skip") -> DataFrame:
    """One row per row hash with its copies on each side; only the 32-character hashes are shuffled."""
    hashed = lambda df: df.select(row_hash(df, nulls=nulls).alias("row_hash"))
    return key_counts(hashed(src), hashed(tgt), ["row_hash"])


def hash_shape(counts: DataFrame) -> DataFrame:
    """Distinct hashes only on one side, and surplus copies on each side."""
    s, t = F.col("src_rows"), F.col("tgt_rows")
    zero = F.lit(0).cast("bigint")
    surplus = lambda c: F.coalesce(F.sum(F.greatest(c - 1, zero)), zero)
    return counts.agg(
        F.count_if((s > 0) & (t == 0)).alias("only_source"), F.count_if((t > 0) & (s == 0)).alias("only_target"),
        surplus(s).alias("src_dup"), surplus(t).alias("tgt_dup"),
    )


def _marks(df: DataFrame, keys: Sequence[str], nulls: str, hashes: bool, cells: bool) -> DataFrame:
    """What the KPIs count, from one scan: of every row its mark with the row's hash, its key, and one mark for each NULL and blank cell.

    ``kind`` is ``row``, ``key``, ``none`` for a row of NULLs, ``n<i>`` for a NULL in column i, or ``e<i>`` for a blank in text column i.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    empty = [F.lit(None).cast(df.select(col(k)).schema[0].dataType) for k in keys]
    mark = lambda kind, digest=None, cells=empty: F.struct(
        F.lit(kind).alias("kind"), (F.lit(None) if digest is None else digest).cast("string").alias("row_hash"),
        *[c.alias(n) for n, c in zip(names, cells)])
    marks = [mark("row", row_hash(df, nulls=nulls) if hashes else None)]
    if keys:
        marks.append(mark("key", None, [col(k) for k in keys]))
    if cells:
        marks += [F.when(col(c).isNull(), mark(f"n{i}")) for i, c in enumerate(df.columns)]
        marks += [F.when(F.trim(col(c)) == "", mark(f"e{i}")) for i, c in enumerate(_text_columns(df))]
        marks.append(F.when(all_null(df), mark("none")))
    return df.select(F.inline(F.array_compact(F.array(*marks))))


def _mark_shape(counts: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """The measures of both sides from counted marks, surplus copies of hashes and keys, and distinct hashes on one side only."""
    s, t = F.col("src_rows"), F.col("tgt_rows")
    row, key = F.col("kind") == "row", F.col("kind") == "key"
    zero = F.lit(0).cast("bigint")
    total = lambda kind, c: F.coalesce(F.sum(F.when(kind, c)), zero)
    surplus = lambda kind, c: F.coalesce(F.sum(F.when(kind & (c > 1), c - 1)), zero)
    kinds = lambda p, n, c: sum((F.least(total(F.col("kind") == f"{p}{i}", c), F.lit(1)) for i in range(n)), zero)
    sides = [x for p, c, df in (("src", s, src), ("tgt", t, tgt)) for x in (
        total(row, c).alias(f"{p}_rows"), F.lit(len(df.columns)).cast("bigint").alias(f"{p}_columns"),
        total(F.col("kind") == "none", c).alias(f"{p}_null_rows"), kinds("n", len(df.columns), c).alias(f"{p}_null_cols"),
        kinds("e", len(_text_columns(df)), c).alias(f"{p}_empty_cols"),
    )]
    return counts.agg(
        *sides,
        F.count_if(row & (s > 0) & (t == 0)).alias("hash_only_source"),
        F.count_if(row & (t > 0) & (s == 0)).alias("hash_only_target"),
        surplus(row, s).alias("hash_src_dup"), surplus(row, t).alias("hash_tgt_dup"),
        surplus(key, s).alias("key_src_dup"), surplus(key, t).alias("key_tgt_dup"),
    )


def hash_diff(src: DataFrame, tgt: DataFrame, nulls: str = "skip") -> DataFrame:
    """Distinct row hashes on one side only: (row_hash, side)."""
    found = hash_counts(src, tgt, nulls).where((F.col("src_rows") == 0) | (F.col("tgt_rows") == 0))
    return found.select("row_hash", F.when(F.col("tgt_rows") == 0, "source").otherwise("target").alias("side"))


KPIS = ("row_count", "column_count", "null_columns", "null_rows", "empty_columns", "duplicate_rows",
        "duplicate_keys", "checksum")


def fingerprint(
    src: DataFrame, tgt: DataFrame, keys: Sequence[str], kpis: Sequence[str] = KPIS, nulls: str = "skip"
) -> DataFrame:
    """One row per KPI: ``kpi, src_rows, tgt_rows, src_value, tgt_value, result, reason``.

    One scan of each side gives everything: hashes, keys, NULL and blank cells become marks, which are counted in the map tasks
    and meet in one shuffle. The marks a selection of KPIs does not need are not planned.
    """
    hashes, by_key = bool({"duplicate_rows", "checksum"} & set(kpis)), "duplicate_keys" in kpis
    cells = bool({"null_columns", "null_rows", "empty_columns"} & set(kpis))
    marks = [_marks(df, keys if by_key else (), nulls, hashes, cells) for df in (src, tgt)]
    row = _mark_shape(key_counts(*marks, marks[0].columns), src, tgt)

    def kpi(name, s, t, ok, good, bad):
        s, t = F.col(s) if isinstance(s, str) else s, F.col(t) if isinstance(t, str) else t
        return {
            "kpi": F.lit(name), "src_rows": F.col("src_rows"), "tgt_rows": F.col("tgt_rows"),
            "src_value": s, "tgt_value": t, "result": passed(ok(s, t)), "reason": F.when(ok(s, t), good).otherwise(bad),
        }

    equal, none = lambda s, t: s == t, lambda s, t: (s == 0) & (t == 0)
    rows = {
        "row_count": lambda: kpi("row_count", "src_rows", "tgt_rows", equal,
                                 "Row counts match", "Row counts differ"),
        "column_count": lambda: kpi("column_count", "src_columns", "tgt_columns", equal,
                                    "Column counts match", "Column counts differ"),
        "null_columns": lambda: kpi("null_columns", "src_null_cols", "tgt_null_cols", equal,
                                    "Equally many columns hold nulls", "The number of columns with nulls differs"),
        "null_rows": lambda: kpi("null_rows", "src_null_rows", "tgt_null_rows", none,
                                 "No row is entirely null", "Some rows are entirely null"),
        "empty_columns": lambda: kpi("empty_columns", "src_empty_cols", "tgt_empty_cols", none,
                                     "No column has blank values", "Some columns have blank values"),
        "duplicate_rows": lambda: kpi("duplicate_rows", "hash_src_dup", "hash_tgt_dup", none,
                                      "No row is repeated", "Some rows are repeated"),
        "duplicate_keys": lambda: kpi("duplicate_keys", "key_src_dup", "key_tgt_dup", none,
                                      "No key is repeated", "Some keys are repeated"),
        "checksum": lambda: kpi("checksum", "hash_only_source", "hash_only_target", none,
                                "All row checksums match", "Some row checksums have no match"),
    }
    return stack_rows(row, [rows[name]() for name in kpis])


def _cells(df: DataFrame) -> DataFrame:
    """One row per cell as text: (position, column, value)."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), col(c).cast("string").alias("value"))
        for i, c in enumerate(df.columns)
    ])))


def value_counts(df: DataFrame) -> DataFrame:
    """(position, column, value, rows) for every distinct cell value; counted before the shuffle, so hot values are cheap."""
    return _cells(df).groupBy("position", "column", "value").agg(F.count(F.lit(1)).alias("rows"))


def dup_columns(df: DataFrame) -> DataFrame:
    """Per column: rows, distinct values (NULL counts as one) and whether any value repeats."""
    per = value_counts(df).groupBy("position", "column").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct_values")
    )
    return per.withColumn("has_duplicates", F.col("distinct_values") < F.col("rows"))


def dup_values(df: DataFrame) -> DataFrame:
    """Every value that occurs more than once in its column: (position, column, value, rows)."""
    return value_counts(df).where("rows > 1")


def dup_value_lists(df: DataFrame, limit: int = 50) -> DataFrame:
    """Per column the first ``limit`` repeated values, sorted and joined by a bar."""
    w = Window.partitionBy("position", "column").orderBy("value")
    first = (
        dup_values(df).where(F.col("value").isNotNull())
        .withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit)
    )
    return first.groupBy("position", "column").agg(
        F.concat_ws("|", F.sort_array(F.collect_list("value"))).alias("duplicate_values")
    )


def symmetric_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference in both directions: surplus copies on either side, with the side they are on.

    Both directions come from one counted shuffle; a row with many surplus copies is one output row with ``copies``.
    """
    counts = key_counts(a, b, a.columns, b.columns, ("__ns", "__nt"))
    s, t = F.col("__ns"), F.col("__nt")
    return counts.where(s != t).select(
        *[col(c) for c in a.columns], F.when(s > t, "source").otherwise("target").alias("side"),
        F.abs(s - t).alias("copies"),
    )


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either side that the other side lacks, with the side they are on."""
    counts = key_counts(a, b, a.columns, b.columns, ("__ns", "__nt"))
    return counts.where((F.col("__ns") == 0) | (F.col("__nt") == 0)).select(
        *[col(c) for c in a.columns], F.when(F.col("__nt") == 0, "source").otherwise("target").alias("side")
    )
