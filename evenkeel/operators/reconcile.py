"""Row by row reconciliation of a source and a target on a business key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..frames import stack_rows
from ..functions.values import col, key_text, let, same
from .ordinal import CHUNK_ROWS, occurrence

BOTH, ONLY_SOURCE, ONLY_TARGET = "both", "source_only", "target_only"
_OCC = "occurrence"
#: Columns of the joined rows; a key of one of these names is shown with ``key_`` before it.
RESERVED = ("status", "matched", _OCC)
#: Parts into which the differing cells of one column are cut before their first limit.
_PARTS = 64
#: A key with more rows than this part of a chunk is hot.
_HOT_PART = 8


@dataclass(frozen=True)
class Pair:
    """A source and a target, the key they share and the columns to compare.

    ``columns`` is a list of common names or a mapping from source to target names; by default every
    common column that is not part of the key. Names are matched without regard to case.
    """

    source: DataFrame
    target: DataFrame
    keys: Sequence[str]
    columns: Sequence[str] | Mapping[str, str] | None = None
    abs_tol: float = 0
    rel_tol: float = 0
    chunk_rows: int = CHUNK_ROWS

    def target_names(self) -> dict[str, str]:
        """Source name to target name, for keys and compared columns."""
        theirs = {c.lower(): c for c in self.target.columns}
        ours = {c.lower(): c for c in self.source.columns}
        given = dict(self.columns) if isinstance(self.columns, Mapping) else {}
        keys = {k: theirs.get(given.get(k, k).lower()) for k in self.keys}
        missing = [k for k, t in keys.items() if t is None or k.lower() not in ours]
        if missing:
            raise ValueError(f"key columns not on both sides: {missing}")
        wanted = self.columns if self.columns is not None else self.source.columns
        key_names = {k.lower() for k in keys}
        pairs = {
            name: theirs.get(given.get(name, name).lower()) for name in wanted if name.lower() not in key_names
        }
        lost = [n for n, other in pairs.items() if other is None or n.lower() not in ours]
        if lost and self.columns is not None:
            raise ValueError(f"columns to compare not on both sides: {lost}")
        return {**keys, **{n: other for n, other in pairs.items() if n not in lost}}

    def compared(self) -> list[str]:
        return [c for c in self.target_names() if c not in set(self.keys)]


def key_name(key: str) -> str:
    """The name of a key column in the joined rows."""
    return f"key_{key}" if key.lower() in RESERVED else key


def _sides(pair: Pair) -> tuple[DataFrame, DataFrame, list[str], set[int]]:
    """Both sides with plain internal names: keys ``k0…`` and values ``v0…``; the keys' names; which keys differ in type.

    A source key of another type is cast to the target's, so ``'01'`` meets 1. What cannot be cast is a key of its own, in ``k0x``. Such
    keys are shown as text, as they were written, from ``g0…``.
    """
    names = pair.target_names()
    src_cols, tgt_cols, ks, mixed = [], [], [], set()
    for i, key in enumerate(pair.keys):
        ours, theirs, k = col(key), col(names[key]), f"k{i}"
        a, b = pair.source.select(ours).schema[0].dataType, pair.target.select(theirs).schema[0].dataType
        ks.append(k)
        if a == b or isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
            src_cols.append(ours.alias(k))
            tgt_cols.append(theirs.alias(k))
            continue
        typed, text = ours.try_cast(b), ours.cast("string")
        src_cols += [typed.alias(k), F.when(typed.isNull(), text).alias(f"{k}x"), text.alias(f"g{i}")]
        tgt_cols += [theirs.alias(k), F.lit(None).cast("string").alias(f"{k}x"), theirs.cast("string").alias(f"g{i}")]
        ks.append(f"{k}x")
        mixed.add(i)
    for i, value in enumerate(pair.compared()):
        src_cols.append(col(value).alias(f"v{i}"))
        tgt_cols.append(col(names[value]).alias(f"v{i}"))
    return pair.source.select(*src_cols), pair.target.select(*tgt_cols), ks, mixed


def key_frames(pair: Pair) -> tuple[DataFrame, DataFrame, list[str]]:
    """The key columns of both sides under common names, ready to be counted."""
    src, tgt, ks, _ = _sides(pair)
    return src.select(*ks), tgt.select(*ks), ks


def _equal(pair: Pair, types: tuple, left: Column, right: Column) -> Column:
    a, b = types
    numbers = isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
    tolerance = (pair.abs_tol, pair.rel_tol) if numbers else (0, 0)
    if a == b or numbers:
        return same(left, right, *tolerance)
    # A value that cannot become the target's type differs from everything, NULL included.
    return left.isNull().eqNullSafe(right.isNull()) & same(left.try_cast(b), right)


def _both(src: DataFrame, tgt: DataFrame, ks: list[str], types: list[tuple]) -> tuple[DataFrame, list[str]]:
    """The rows of both sides under one another: keys, ``side`` and the row as struct ``s`` or ``t``; and what orders the rows of a key.

    Structs are ordered by their values. Where types differ, the struct ``o`` of the values in the target's types orders both sides.
    """
    row = lambda df: F.struct(F.lit(True).alias("is"), *[F.col(c) for c in df.columns if c not in ks])
    cast = F.struct(*[(F.col(f"v{i}") if a == b else F.col(f"v{i}").try_cast(b)).alias(f"v{i}") for i, (a, b) in enumerate(types)]) if types else None
    alike = all(a == b for a, b in types)
    own, other = ([], []) if alike else ([cast.alias("o")], [F.struct(*[F.col(f"v{i}") for i in range(len(types))]).alias("o")])
    ours = src.select(*ks, F.lit("s").alias("side"), row(src).alias("s"), *own)
    theirs = tgt.select(*ks, F.lit("t").alias("side"), row(tgt).alias("t"), *other)
    return ours.unionByName(theirs, allowMissingColumns=True), (["s", "t"] if alike else ["o", "s", "t"])


def _pairs(pair: Pair) -> tuple[DataFrame, list[tuple], list[Column]]:
    """All pairs of rows as structs ``s`` and ``t`` with their occurrence; the types of the compared values; the key columns to show.

    One lazy plan. The sides meet in an aggregate by key, not in a join: both are shuffled once, rows of a hot key shrink to one in every
    map task, NULLs are equal, and a filter on the key reaches both scans. A key with one row on either side at most is done. Rows of
    the other keys, known from the same aggregate, are numbered within their key and side and meet on key and number, which
    spreads a hot key over all tasks; its rows are picked where they are read. Where there is no such key, nothing is shuffled again.
    """
    src, tgt, ks, mixed = _sides(pair)
    types = [(src.schema[f"v{i}"].dataType, tgt.schema[f"v{i}"].dataType) for i in range(len(pair.compared()))]
    both, order = _both(src, tgt, ks, types)
    rows = lambda side: F.count_if(F.col("side") == side)
    one = [F.first("s", True).alias("s"), F.first("t", True).alias("t")]
    met = both.groupBy(*ks).agg(*one, F.greatest(rows("s"), rows("t")).alias("__most"))
    once = met.where("__most = 1").select(*ks, F.lit(1).cast("bigint").alias(_OCC), "s", "t")

    hot = F.col("__most") > max(1, pair.chunk_rows // _HOT_PART)
    often = met.where("__most > 1").select(*[F.col(k).alias(f"__{k}") for k in ks], hot.alias("__hot"))
    on_key = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in ks])
    repeated = both.where(often.agg(F.count(F.lit(1)) > 0).scalar())
    # There is a hot key for so many rows at most. Their rows are known by a small list and do not meet in the join, which shuffles by key.
    few = F.broadcast(often.where("__hot").drop("__hot"))
    warm = repeated.join(few, on_key, "left_anti").join(often.where("NOT __hot"), on_key, "left_semi")
    again = warm.unionByName(repeated.join(few, on_key, "left_semi"))
    again = occurrence(again, [*ks, "side"], order, _OCC, pair.chunk_rows)
    # Numbered copies are many more than the rows they come from: they are dealt out before anything sorts them.
    again = again.repartition(*ks, _OCC).groupBy(*ks, _OCC).agg(*one)
    shown = [
        F.coalesce(F.col(f"s.g{i}"), F.col(f"t.g{i}")).alias(key) if i in mixed else F.col(f"k{i}").alias(key)
        for i, key in enumerate(pair.keys)
    ]
    return once.unionByName(again.select(*ks, _OCC, "s", "t")), types, shown


def _rows(pair: Pair, keep: Column, status: bool) -> DataFrame:
    """Keys, occurrence, flags and values of the pairs that ``keep`` picks."""
    found, types, shown = _pairs(pair)
    names = pair.compared()
    equals = lambda s, t: [_equal(pair, kind, s[f"v{i}"], t[f"v{i}"]) for i, kind in enumerate(types)]
    # Inside a function of the two structs the values are no columns: no constraint on them is rewritten for every alias below.
    agree = let(F.struct("s", "t"), lambda x: ~F.array_contains(F.array(F.lit(True), *equals(x["s"], x["t"])), False))
    matched = F.col("s").isNotNull() & F.col("t").isNotNull() & agree
    kind = F.when(F.col("t").isNull(), ONLY_SOURCE).when(F.col("s").isNull(), ONLY_TARGET).otherwise(BOTH)
    values = []
    for i, (name, equal) in enumerate(zip(names, equals(F.col("s"), F.col("t")))):
        values += [F.col(f"s.v{i}").alias(f"src_{name}"), F.col(f"t.v{i}").alias(f"tgt_{name}"), equal.alias(f"eq_{name}")]
    keys = [c.alias(key_name(k)) for c, k in zip(shown, pair.keys)]
    return found.where(keep).select(*keys, _OCC, *([kind.alias("status")] if status else []), matched.alias("matched"), *values)


def reconcile(pair: Pair) -> DataFrame:
    """Every row of either side once: keys, occurrence, status, matched, ``src_*``, ``tgt_*``, ``eq_*``.

    Rows pair up on NULL-safe keys; repeated keys pair first with first, second with second and so on,
    which also spreads a hot key over all tasks. Keys named ``status``, ``matched`` or ``occurrence`` are shown as ``key_status`` and so on.
    """
    return _rows(pair, F.lit(True), True)


def common_rows(pair: Pair) -> DataFrame:
    """Rows whose key is on both sides, as in :func:`reconcile`."""
    return _rows(pair, F.col("s").isNotNull() & F.col("t").isNotNull(), False)


def mismatched_rows(pair: Pair) -> DataFrame:
    return common_rows(pair).where(~F.col("matched"))


def matched_rows(pair: Pair) -> DataFrame:
    return common_rows(pair).where("matched")


def _alone(pair: Pair, own: str, other: str) -> DataFrame:
    found, _, shown = _pairs(pair)
    values = [F.col(f"{own}.v{i}").alias(c) for i, c in enumerate(pair.compared())]
    return found.where(F.col(other).isNull()).select(*shown, _OCC, *values)


def only_source(pair: Pair) -> DataFrame:
    """Source rows without a partner, under the source's names."""
    return _alone(pair, "s", "t")


def only_target(pair: Pair) -> DataFrame:
    """Target rows without a partner, under the source's names."""
    return _alone(pair, "t", "s")


def compared_columns(rows: DataFrame) -> list[str]:
    return [c[3:] for c in rows.columns if c.startswith("eq_")]


def counts(rows: DataFrame) -> DataFrame:
    """All row measures of a content test from one pass over :func:`reconcile`'s rows."""
    in_src, in_tgt = F.col("status") != ONLY_TARGET, F.col("status") != ONLY_SOURCE
    first, both = F.col(_OCC) == 1, F.col("status") == BOTH
    n = F.count_if
    return rows.agg(
        n(in_src).alias("src_rows"), n(in_src & first).alias("src_distinct"), n(in_src & ~first).alias("src_duplicate"),
        n(in_tgt).alias("tgt_rows"), n(in_tgt & first).alias("tgt_distinct"), n(in_tgt & ~first).alias("tgt_duplicate"),
        n(both).alias("common"), n(both & F.col("matched")).alias("matched"), n(both & ~F.col("matched")).alias("mismatched"),
        n(~in_tgt).alias("only_source"), n(~in_src).alias("only_target"),
    )


def column_summary(rows: DataFrame, only_differing: bool = True) -> DataFrame:
    """Matched and mismatched rows per compared column, over the rows common to both sides."""
    cols = compared_columns(rows)
    both = rows.where(F.col("status") == BOTH) if "status" in rows.columns else rows
    totals = both.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(~col(f"eq_{c}")).alias(f"__bad{i}") for i, c in enumerate(cols)],
    )
    out = stack_rows(totals, [
        {
            "column": F.lit(c), "rows_common": F.col("__rows"),
            "rows_matched": F.col("__rows") - F.col(f"__bad{i}"), "rows_mismatched": F.col(f"__bad{i}"),
        }
        for i, c in enumerate(cols)
    ])
    return out.where("rows_mismatched > 0") if only_differing else out


def column_details(rows: DataFrame, keys: Sequence[str], limit: int | None = 10) -> DataFrame:
    """Distinct (column, key text, source value, target value) of unequal cells, the first ``limit`` per column.

    The limit cuts the cells before anything is shuffled (window group limit), in parts of each column, so that many
    equal cells of one column do not meet in one task either; what is left of the parts is made distinct and limited again.
    """
    cols = compared_columns(rows)
    both = rows.where(F.col("status") == BOTH) if "status" in rows.columns else rows
    places = F.array_compact(F.array(*[F.when(~col(f"eq_{c}"), F.lit(i)) for i, c in enumerate(cols)]))
    values = lambda p: F.array(*[col(f"{p}_{c}").cast("string") for c in cols])
    part = F.pmod(F.col(_OCC), F.lit(_PARTS)) if _OCC in rows.columns else F.lit(0)
    cells = (
        both.where(~F.col("matched"))
        .select(_key_text(keys).alias("key_columns"), values("src").alias("__src"), values("tgt").alias("__tgt"),
                part.alias("__part"), F.explode(places).alias("__at"))
        .select(
            F.get(F.lit(cols), F.col("__at")).alias("column"), "key_columns",
            F.get("__src", F.col("__at")).alias("source_value"), F.get("__tgt", F.col("__at")).alias("target_value"), "__part",
        )
    )
    if limit is None:
        return cells.drop("__part").distinct()
    first = lambda df, *by: df.withColumn("__rn", F.dense_rank().over(
        Window.partitionBy(*by).orderBy("key_columns", "source_value", "target_value"))).where(F.col("__rn") <= limit)
    few = first(cells, "column", "__part").drop("__rn", "__part").distinct()
    return first(few, "column").drop("__rn")


def _key_text(keys: Sequence[str]) -> Column:
    return key_text(keys, lambda k: col(key_name(k)))


def sample_keys(rows: DataFrame, keys: Sequence[str], limit: int | None = 10) -> DataFrame:
    """Key text of the first ``limit`` rows in key order, of all rows without a limit."""
    key_cols = [col(key_name(k)) for k in keys]
    picked = rows.select(*key_cols).orderBy(*key_cols)
    picked = picked if limit is None else picked.limit(limit)
    return picked.select(_key_text(keys).alias("key_columns"))
