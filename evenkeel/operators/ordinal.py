"""Positions inside groups that stay exact and spread out when one group is huge, in one plan that runs no job while it is built.

1. Equal rows are counted first, so copies of one row shrink before they travel; copies beyond ``_EXPAND`` become further blocks.
2. A hash picks about one of ``chunk_rows`` rows. The picked rows, sorted, are bounds that cut all groups into chunks: a scalar
   subquery of the plan, the same whenever it is computed again. Fewer rows than that give no bound, so a group is one chunk.
3. Every chunk is one window partition. Where a group goes on over a bound, each of its chunks starts with a row that carries what the
   chunks before it hold. Only groups at a bound need such a row, at most one for each bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.values import col, let

#: Rows of a chunk, on average, and how many chunks there are at most; of larger tables not every picked row becomes a bound.
CHUNK_ROWS, MOST_CHUNKS = 1 << 20, 4096
#: Copies of one row that are written back by one task.
_EXPAND = 100_000
_STEPS = [1 << k for k in range(16, -1, -1)]
_EARLIER = (Window.unboundedPreceding, -1)


def _chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per distinct (keys, order) and block of its copies: ``__copies`` in all, ``__n`` in the block, chunk and whether its group goes on."""
    names = [*keys, *order]
    counted = df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("__copies"), *extra)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__copies") - 1) / _EXPAND))
    rows = counted.withColumn("__block", F.explode(blocks))
    rows = rows.withColumn("__n", F.least(F.lit(_EXPAND).cast("bigint"), F.col("__copies") - F.col("__block") * _EXPAND))

    here = F.struct(*[col(c).alias(f"p{i}") for i, c in enumerate([*names, "__block"])])
    group = lambda place: F.struct(*[place[f"p{i}"].alias(f"p{i}") for i in range(len(keys))])
    picked = rows.where(F.pmod(F.xxhash64(*[col(c) for c in [*names, "__block"]]), F.lit(chunk_rows)) < F.col("__n"))
    every = lambda b: F.greatest(F.lit(1), F.ceil(F.size(b) / MOST_CHUNKS))
    bounds = picked.agg(F.sort_array(F.collect_list(here)).alias("b"))
    bounds = bounds.select(F.filter("b", lambda x, i: i % every(F.col("b")) == 0).alias("b"))
    # The bounds come with the steps of the search among so many, and a row is put together once for all comparisons.
    bounds = bounds.select(F.struct("b", F.filter(F.lit(_STEPS), lambda s: s <= F.size("b")).alias("steps")))

    def place(x: Column) -> Column:
        b, row = x["bounds"]["b"], x["row"]
        chunk = F.aggregate(x["bounds"]["steps"], F.lit(0), lambda low, s: F.when(F.get(b, low + s - 1) <= row, low + s).otherwise(low))
        # The group goes on if the bound at either end of the chunk lies in it.
        over = lambda c, i: F.get(b, i).isNotNull() & (group(F.get(b, i)).eqNullSafe(group(row)) if keys else F.lit(True))
        return let(chunk, lambda c: F.struct(c.alias("__chunk"), (over(c, c - 1) | over(c, c)).alias("__over")))

    rows = rows.withColumn("__bounds", bounds.scalar())
    rows = rows.withColumn("__place", let(F.struct(F.col("__bounds").alias("bounds"), here.alias("row")), place)).drop("__bounds")
    # A filter on what a generator makes stays above it, so no row is searched twice.
    return rows.select("*", F.inline_outer(F.array("__place"))).drop("__place")


def _per_chunk(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates of each chunk of the groups that go on over a bound."""
    return rows.where("__over").groupBy(*[col(k) for k in keys], "__chunk").agg(*aggregates)


def _placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The blocks with ``__before`` and ``__steps``: rows and distinct rows before them in their group."""
    key_cols, fresh = [col(k) for k in keys], F.when(F.col("__block") == 0, 1).otherwise(0).cast("bigint")
    totals = _per_chunk(rows, keys, F.sum("__n").alias("__n"), F.sum(fresh).alias("__new"))
    w = Window.partitionBy(*key_cols).orderBy("__chunk").rowsBetween(*_EARLIER)
    starts = totals.withColumns({"__n": F.sum("__n").over(w), "__new": F.sum("__new").over(w)}).where("__n IS NOT NULL")
    both = rows.withColumns({"__new": fresh, "__real": F.lit(True)}).unionByName(
        starts.withColumn("__real", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*key_cols, "__chunk").orderBy("__real", *[col(c) for c in order], "__block").rowsBetween(*_EARLIER)
    zero = F.lit(0).cast("bigint")
    return both.withColumns({
        "__before": F.coalesce(F.sum("__n").over(w), zero), "__steps": F.coalesce(F.sum("__new").over(w), zero),
    }).where("__real")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per distinct (keys, order): copies ``__n``, rows ``__before`` it in its group, distinct ``__steps`` before it.

    ``__before + 1`` is the rank and ``__steps + 1`` the dense rank; NULLs sort first.
    """
    order = [c for c in dict.fromkeys(order) if c not in keys]
    placed = _placed(_chunks(df, keys, order, chunk_rows), keys, order).where("__block = 0")
    return placed.select(*[col(c) for c in [*keys, *order]], F.col("__copies").alias("__n"), "__before", "__steps")


def _holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_floats(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_floats(f.dataType) for f in kind)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def occurrence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | None = None,
    name: str = "occurrence",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Number the rows of each group 1, 2, 3… in ``order`` followed by all other columns, NULLs first.

    The order covers every column, so only exact copies can swap numbers and the result is deterministic.
    """
    rest = [c for c in (order or []) if c not in keys]
    rest += [c for c in df.columns if c not in keys and c not in rest]
    # Grouping turns -0.0 into 0.0: values with a -0.0 are told apart by their text, and come back as they were.
    floats = [f.name for f in df.schema if _holds_floats(f.dataType)]
    text = {f"__sign{i}": col(c).cast("string") for i, c in enumerate(floats)}
    signed = df.withColumns({s: F.when(t.contains("-0.0"), t) for s, t in text.items()}) if floats else df
    own = {c: f"__own{i}" for i, c in enumerate(floats)}
    rows = _chunks(signed, keys, [*rest, *text], chunk_rows, [F.first(col(c)).alias(o) for c, o in own.items()])
    placed = _placed(rows, keys, [*rest, *text])
    copies = placed.withColumn("__step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    return copies.select(
        *[F.col(own[c]).alias(c) if c in own else col(c) for c in df.columns], (F.col("__before") + F.col("__step")).alias(name)
    )


def followed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows (keys, order) with ``__next``: ``value``, one of the order columns, in the next row of the group; null in the last."""
    order = [c for c in dict.fromkeys(order) if c not in keys]
    rows, key_cols = _chunks(df, keys, order, chunk_rows), [col(k) for k in keys]
    first = F.min(F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)], "__block"))
    firsts = _per_chunk(rows, keys, first.alias("__first"))
    w = Window.partitionBy(*key_cols).orderBy("__chunk")
    after = F.lead(F.col("__first")[f"o{order.index(value)}"]).over(w)
    ends = firsts.select(*key_cols, "__chunk", after.alias(value), F.lit(True).alias("__end"))
    both = rows.withColumn("__end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*key_cols, "__chunk").orderBy("__end", *[col(c) for c in order], "__block")
    linked = both.withColumn("__lead", F.lead(col(value)).over(w)).where("NOT __end")
    copies = linked.withColumn("__step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    after = F.when(F.col("__step") < F.col("__n"), col(value)).otherwise(F.col("__lead"))
    return copies.select(*[col(c) for c in dict.fromkeys([*keys, *order])], after.alias("__next"))
