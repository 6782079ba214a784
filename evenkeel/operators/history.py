"""Checks of history tables: incremental loads, versioned rows, date chains, stored ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..frames import stack_rows
from ..functions.values import col
from .ordinal import CHUNK_ROWS, followed, occurrence, positions
from .reconcile import Pair, counts, reconcile


def changed_since(df: DataFrame, ts: str, mark) -> DataFrame:
    """Rows newer than a high-water mark: a value, a column expression, or a frame whose first column's maximum is the mark.

    A NULL mark (nothing loaded yet) means every row, also those without a timestamp. A frame's mark reaches the scan as a
    pushed filter; the branch of the first load hangs on at most one row and goes at run time once there is a mark.
    """
    if isinstance(mark, DataFrame):
        top = mark.agg(F.max(mark.columns[0]).alias("__mark"))
        unloaded = top.where(F.col("__mark").isNull())
        newer = df.where(col(ts) > top.scalar())
        return newer.union(df.join(F.broadcast(unloaded), F.lit(True), "left_semi"))
    mark = mark if isinstance(mark, Column) else F.lit(mark)
    return df.where(mark.isNull() | (col(ts) > mark))


def incremental_check(src: DataFrame, tgt: DataFrame, keys: Sequence[str], ts: str, mark) -> DataFrame:
    """Reconciliation counts of only those rows that changed after the mark, on both sides."""
    return counts(reconcile(Pair(changed_since(src, ts, mark), changed_since(tgt, ts, mark), keys)))


def scd2_check(
    df: DataFrame, keys: Sequence[str], start: str, end: str, current: str,
    open_end: str = "9999-12-31", current_value: str = "Y",
) -> DataFrame:
    """Violations per rule of a versioned history: ``rule, violations``.

    ``one_current``: keys without exactly one current row; ``start_before_end``: rows that end before they
    start; ``open_if_current``: rows whose current flag and open end disagree. One counted shuffle by key.
    """
    is_current = col(current) == current_value
    is_open = F.coalesce(col(end) == F.lit(open_end).cast("date"), F.lit(True))
    per_key = df.groupBy(*[col(k) for k in keys]).agg(
        F.count_if(is_current).alias("current_rows"),
        F.count_if(col(start) > col(end)).alias("reversed_rows"),
        F.count_if(~is_current.eqNullSafe(is_open)).alias("flag_rows"),
    )
    zero = F.lit(0).cast("bigint")
    totals = per_key.agg(
        F.count_if(F.col("current_rows") != 1).alias("a"),
        F.coalesce(F.sum("reversed_rows"), zero).alias("b"), F.coalesce(F.sum("flag_rows"), zero).alias("c"),
    )
    return stack_rows(totals, [
        {"rule": F.lit("one_current"), "violations": F.col("a")},
        {"rule": F.lit("start_before_end"), "violations": F.col("b")},
        {"rule": F.lit("open_if_current"), "violations": F.col("c")},
    ])


def scd2_current_faults(df: DataFrame, keys: Sequence[str], current: str, current_value: str = "Y") -> DataFrame:
    """The keys that do not have exactly one current row."""
    per_key = df.groupBy(*[col(k) for k in keys]).agg(F.count_if(col(current) == current_value).alias("current_rows"))
    return per_key.where("current_rows <> 1")


def date_chain(
    df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Versions whose next version does not start on the day after they end, labelled ``gap`` or ``overlap``.

    Order within a key: start, end, then ``order``. Keys of many versions are cut into chunks, each of which ends with the start of the
    next one's first version. A next version without a start is no fault.
    """
    by = list(dict.fromkeys([start, end, *order]))
    linked = followed(df, keys, by, start, chunk_rows).withColumnRenamed("__next", "next_start").where("next_start IS NOT NULL")
    expected = F.date_add(col(end), 1)
    # An open end (NULL or the last day a date can hold) has no day after it: anything that follows overlaps.
    label = F.when(col(end).isNull(), "overlap").when(F.col("next_start") > expected, "gap").when(F.col("next_start") < expected, "overlap")
    return linked.withColumn("fault", label).where(F.col("fault").isNotNull()).select(
        *[col(k) for k in keys], col(start), col(end), "next_start", "fault"
    )


def rank_check(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], stored: str,
    function: str = "row_number", first: int = 1, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows whose stored ``row_number``, ``rank`` or ``dense_rank`` differs from the recomputed one.

    Returned as distinct (partition, order, stored, expected) with their number of rows.
    """
    by = [*partition, *order]
    needed = df.select(*[col(c) for c in dict.fromkeys([*by, stored])])
    # Ties of a row number are ordered by the stored value, so any consistent numbering of equal rows is accepted.
    sort_by = [*order, stored] if function == "row_number" else order
    placed = positions(needed, partition, sort_by, chunk_rows)
    expected = (F.col("__steps") if function == "dense_rank" else F.col("__before")) + F.lit(first).cast("bigint")
    if function == "row_number":
        out = placed
    else:
        # Grouped as one value: rows that lie together by a part of it are counted where they are and then spread, so no task holds
        # the rows before and after counting, and a hot partition is not one task.
        whole = F.struct(*[col(c) for c in needed.columns]).alias("__row")
        counted = needed.groupBy(whole).agg(F.count(F.lit(1)).alias("__n")).select("__row.*", "__n")
        slim = placed.select(*[col(c).alias(f"__o{i}") for i, c in enumerate(by)], "__before", "__steps")
        out = counted.join(slim, [col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(by)])
    fine = col(stored).cast("bigint").eqNullSafe(expected)
    if function == "row_number":
        # Copies of one (order, stored) row cannot share a number: one of them may be right, the rest are not.
        fine = fine & (F.col("__n") == 1)
    return out.where(~fine).select(
        *[col(c) for c in by], col(stored), expected.alias("expected"), F.col("__n").alias("rows")
    )


def sequence(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str = "row_id", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """A sequence 1, 2, 3… per partition (one input file, say), exact however large a partition is."""
    return occurrence(df, partition, order, name, chunk_rows)


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distinct (partition, order) with row count, ``rank`` and ``dense_rank``."""
    placed = positions(df, partition, order, chunk_rows)
    return placed.select(
        *[col(c) for c in [*partition, *order]], F.col("__n").alias("rows"),
        (F.col("__before") + 1).alias("rank"), (F.col("__steps") + 1).alias("dense_rank"),
    )
