"""Business rule checks: aggregates, required values, balances, references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..frames import passed, stack_rows
from ..functions.parsing import as_list, predicate
from ..functions.values import col


def agg_compare(
    src: DataFrame, tgt: DataFrame, group: Sequence[str], aggregates: Mapping[str, str], tolerance: float = 0
) -> DataFrame:
    """Aggregates per group on both sides: ``src_x, tgt_x, diff_x`` and ``status``.

    ``aggregates`` maps a name to a SQL aggregate such as ``sum(amount)``. Each side is aggregated on its own,
    then the small results meet in one more aggregate, which also pairs NULL groups.
    """
    names = list(aggregates)
    groups = [col(g) for g in group]
    side = lambda df: df.groupBy(*groups).agg(*[F.expr(sql).alias(n) for n, sql in aggregates.items()])
    tag = lambda df, p: side(df).select(*groups, *[col(n).alias(f"{p}_{n}") for n in names], F.lit(True).alias(f"in_{p}"))
    both = tag(src, "src").unionByName(tag(tgt, "tgt"), allowMissingColumns=True)
    merged = both.groupBy(*groups).agg(*[F.max(col(c)).alias(c) for c in both.columns if c not in group])
    number = {n: all(isinstance(merged.schema[f"{p}_{n}"].dataType, T.NumericType) for p in ("src", "tgt")) for n in names}
    # Dates and text have no difference; they are equal or not.
    diff = {n: col(f"src_{n}") - col(f"tgt_{n}") if number[n] else F.lit(None).cast("double") for n in names}
    close = reduce(lambda a, b: a & b, [
        col(f"src_{n}").eqNullSafe(col(f"tgt_{n}")) | F.coalesce(F.abs(diff[n]) <= tolerance, F.lit(False))
        for n in names
    ])
    status = (
        F.when(F.col("in_tgt").isNull(), "only source").when(F.col("in_src").isNull(), "only target")
        .when(close, "match").otherwise("mismatch")
    )
    shown = [x for n in names for x in (col(f"src_{n}"), col(f"tgt_{n}"), diff[n].alias(f"diff_{n}"))]
    return merged.select(*groups, *shown, status.alias("status"))


@dataclass(frozen=True)
class KpiRule:
    """An aggregate over the rows of a filter that must equal a value within a tolerance."""

    name: str
    aggregate: str
    expected: float
    where: str | None = None
    tolerance: float = 0


def kpi_rules(df: DataFrame, rules: Sequence[KpiRule]) -> DataFrame:
    """``rule, expected, actual, result`` for every rule; rules of one filter share one aggregate over the rows it keeps.

    The filter holds for the whole expression, so ``sum(a) / count(*)`` divides by the rows of the filter.
    """
    by_filter: dict[str | None, list[KpiRule]] = {}
    for r in rules:
        by_filter.setdefault(predicate(r.where) or None, []).append(r)
    parts = []
    for where, own in by_filter.items():
        rows = df.where(F.expr(where)) if where else df
        totals = rows.agg(*[F.expr(r.aggregate).cast("double").alias(f"r{i}") for i, r in enumerate(own)])
        ok = [F.coalesce(F.abs(F.col(f"r{i}") - r.expected) <= r.tolerance, F.lit(False)) for i, r in enumerate(own)]
        parts.append(stack_rows(totals, [
            {"rule": F.lit(r.name), "expected": F.lit(float(r.expected)), "actual": F.col(f"r{i}"), "result": passed(ok[i])}
            for i, r in enumerate(own)
        ]))
    return reduce(DataFrame.unionByName, parts)


def required_values(df: DataFrame, column: str, values) -> DataFrame:
    """The required values that do not occur in the column; they are compared in the column's type, so 1 is found as 1.00."""
    kind = df.select(col(column)).schema[0].dataType
    wanted = df.sparkSession.createDataFrame([(v,) for v in as_list(values)], "value string").withColumn("__v", F.col("value").try_cast(kind))
    typed = F.array_compact(F.array(*[F.lit(v).try_cast(kind) for v in as_list(values)]))
    present = df.select(col(column).alias("__v")).where(F.array_contains(typed, F.col("__v"))).distinct()
    return wanted.join(present, "__v", "left_anti").select("value")


def balance_check(df: DataFrame, group: Sequence[str], amount: str, side: Column, tolerance: float = 0) -> DataFrame:
    """Debits against credits per group; ``side`` gives ``D`` or ``C`` per row, amounts count by size."""
    size = F.abs(col(amount))
    out = df.groupBy(*[col(g) for g in group]).agg(
        F.sum(F.when(side == "D", size).otherwise(F.lit(0))).alias("debits"),
        F.sum(F.when(side == "C", size).otherwise(F.lit(0))).alias("credits"),
    )
    out = out.withColumn("difference", F.col("debits") - F.col("credits"))
    return out.withColumn("balanced", F.abs(F.col("difference")) <= tolerance)


@dataclass(frozen=True)
class Reference:
    """A foreign key of the child and the parent column it must be found in."""

    name: str
    column: str
    parent: DataFrame
    parent_column: str


def _common_type(spark, a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two columns are compared, as Spark widens them."""
    return spark.range(0).select(F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b))).schema[0].dataType


def ref_integrity(child: DataFrame, references: Sequence[Reference]) -> DataFrame:
    """Orphans per relation: ``relation, orphan_rows, orphan_keys``. A NULL foreign key is not an orphan.

    One scan of the child gives (relation, key) for all relations, counted before they meet the parents' keys in one shuffle, so a hot
    foreign key is one row there. Keys are compared in the type that both columns widen to.
    """
    spark = child.sparkSession
    text, keys, parents = {}, [], []
    for i, ref in enumerate(references):
        kind = _common_type(spark, child.select(col(ref.column)).schema[0].dataType, ref.parent.select(col(ref.parent_column)).schema[0].dataType)
        text[i] = lambda name, kind=kind: col(name).cast(kind).cast("string")
        keys.append(F.when(col(ref.column).isNotNull(), F.struct(F.lit(i).alias("no"), text[i](ref.column).alias("key"))))
        parents.append(ref.parent.select(F.lit(i).alias("no"), text[i](ref.parent_column).alias("key")))
    zero = F.lit(0).cast("bigint")
    found = child.select(F.inline(F.array_compact(F.array(*keys)))).select("no", "key", F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("known"))
    known = reduce(DataFrame.union, parents).select("no", "key", zero, F.lit(True))
    met = found.union(known).groupBy("no", "key").agg(F.sum("n").alias("n"), F.bool_or("known").alias("known"))
    lost = lambda i: (F.col("no") == i) & (F.col("n") > 0) & ~F.col("known")
    totals = met.agg(*[x for i in text for x in (
        F.coalesce(F.sum(F.when(lost(i), F.col("n"))), zero).alias(f"r{i}"), F.count_if(lost(i)).alias(f"k{i}"))])
    return stack_rows(totals, [
        {"relation": F.lit(ref.name), "orphan_rows": F.col(f"r{i}"), "orphan_keys": F.col(f"k{i}")} for i, ref in enumerate(references)
    ])


def orphan_keys(child: DataFrame, ref: Reference) -> DataFrame:
    """Every orphan key of one relation with its rows."""
    keys = child.where(col(ref.column).isNotNull()).groupBy(col(ref.column).alias("key")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return keys.join(ref.parent.select(col(ref.parent_column).alias("key")), "key", "left_anti")
