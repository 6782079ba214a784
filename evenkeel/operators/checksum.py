"""Two data sets compared by a tree of checksums: only ranges of keys that differ are looked at row by row.

A key's md5 puts its rows into one of 16^depth ranges, named by the first ``depth`` hex digits. A range's checksum is the sum of its
rows' 128-bit hashes in four parts of 32 bits, so it does not depend on the order of rows. Ranges are summed again over
shorter prefixes up to the whole table. What is shuffled is one row per range and task, however large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import col
from .fingerprint import row_hash
from .keys import key_counts

DEPTH = 3
_PARTS = 4


def key_range(df: DataFrame, keys: Sequence[str], depth: int = DEPTH) -> Column:
    """The range of a row's key; NULLs are told apart from text."""
    return F.substring(row_hash(df, keys, "mark"), 1, depth)


def checksum_tree(df: DataFrame, keys: Sequence[str], depth: int = DEPTH, nulls: str = "mark") -> DataFrame:
    """(range, rows, part0…part3): the lowest level of a side's tree, at most 16^depth rows. It can be stored and compared later."""
    hashed = df.select(key_range(df, keys, depth).alias("range"), row_hash(df, nulls=nulls).alias("__hash"))
    part = lambda i: F.conv(F.substring("__hash", 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)")
    sums = [F.sum(part(i)).alias(f"part{i}") for i in range(_PARTS)]
    return _wrapped(hashed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), *sums))


def _wrapped(df: DataFrame) -> DataFrame:
    return df.withColumns({f"part{i}": (F.col(f"part{i}") % (1 << 32)).cast("bigint") for i in range(_PARTS)})


def compare_trees(src: DataFrame, tgt: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The nodes in which two trees differ: ``level, range, src_rows, tgt_rows, src_checksum, tgt_checksum``; level 0 is the table.

    A range that one side has no rows in counts 0 rows there and has the checksum 0.
    """
    side = lambda df, own, other: df.select(
        "range", F.col("rows").alias(f"{own}_rows"), *[F.col(f"part{i}").alias(f"{own}{i}") for i in range(_PARTS)],
        F.lit(0).cast("bigint").alias(f"{other}_rows"), *[F.lit(0).cast("bigint").alias(f"{other}{i}") for i in range(_PARTS)],
    )
    both = side(src, "src", "tgt").unionByName(side(tgt, "tgt", "src"))
    leaves = both.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    measures = [c for c in both.columns if c != "range"]
    nodes = leaves.groupBy("level", F.expr("substring(range, 1, level)").alias("range")).agg(*[F.sum(c).alias(c) for c in measures])
    nodes = nodes.withColumns({c: F.col(c) % (1 << 32) for c in measures if not c.endswith("rows")})
    text = lambda p: F.concat(*[F.lpad(F.lower(F.hex(f"{p}{i}")), 8, "0") for i in range(_PARTS)])
    nodes = nodes.select("level", "range", "src_rows", "tgt_rows", text("src").alias("src_checksum"), text("tgt").alias("tgt_checksum"))
    return nodes.where((F.col("src_rows") != F.col("tgt_rows")) | (F.col("src_checksum") != F.col("tgt_checksum")))


def checksum_ranges(src: DataFrame, tgt: DataFrame, keys: Sequence[str], depth: int = DEPTH, nulls: str = "mark") -> DataFrame:
    """The nodes of the checksum tree in which source and target differ; no rows if the sides hold the same rows."""
    return compare_trees(checksum_tree(src, keys, depth, nulls), checksum_tree(tgt, keys, depth, nulls), depth)


def checksum_rows(src: DataFrame, tgt: DataFrame, keys: Sequence[str], depth: int = DEPTH, nulls: str = "mark") -> DataFrame:
    """Rows that one side has more often: keys, ``row_hash``, ``side`` and ``copies``.

    Only rows of ranges that differ are shuffled. The ranges are at most 16^depth short texts, so they are broadcast.
    """
    ranges = checksum_ranges(src, tgt, keys, depth, nulls).where(F.col("level") == depth).select(F.col("range").alias("__range"))

    def within(df: DataFrame) -> DataFrame:
        rows = df.select(*[col(k).alias(k) for k in keys], row_hash(df, nulls=nulls).alias("row_hash"), key_range(df, keys, depth).alias("__range"))
        return rows.join(F.broadcast(ranges), "__range", "left_semi").drop("__range")

    counts = key_counts(within(src), within(tgt), [*keys, "row_hash"])
    s, t = F.col("src_rows"), F.col("tgt_rows")
    return counts.where(s != t).select(
        *[col(k) for k in keys], "row_hash", F.when(s > t, "source").otherwise("target").alias("side"), F.abs(s - t).alias("copies"))
