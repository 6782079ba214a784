"""Nested columns to plain ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.values import col


def flatten_structs(df: DataFrame) -> DataFrame:
    """Struct fields of every level become ``parent_child`` columns in lower case, in one projection.

    Plain columns keep their place; flattened ones follow, as deep structs are met.
    """
    plain, nested = [], []

    def walk(value, name: str, dtype: T.DataType):
        for f in dtype.fields:
            child, label = value.getField(f.name), f"{name}_{f.name}".lower()
            if isinstance(f.dataType, T.StructType):
                walk(child, label, f.dataType)
            else:
                nested.append(child.alias(label))

    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            walk(col(f.name), f.name, f.dataType)
        else:
            plain.append(col(f.name))
    return df.select(*plain, *nested) if nested else df


def explode_array(df: DataFrame, name: str) -> DataFrame:
    """One row per element; an empty or NULL array keeps one row with NULL."""
    return df.withColumn(name, F.explode_outer(col(name)))


def explode_aligned(df: DataFrame, names: Sequence[str], position: str | None = None) -> DataFrame:
    """One row per position of sibling arrays, so n and m elements give max(n, m) rows and not n times m.

    Shorter arrays are NULL at the positions they lack; a row whose arrays are all empty or NULL keeps one row of NULLs. ``position``
    names a column for the position from 0 (NULL for such a row).
    """
    kinds = {f.name: f.dataType for f in df.schema}
    zipped = F.arrays_zip(*[
        F.coalesce(col(n), F.array().cast(kinds[n])).alias(f"__{k}") for k, n in enumerate(names)
    ])
    keep = [col(c) for c in df.columns if c not in names]
    items = df.select(*keep, F.posexplode_outer(zipped).alias("__position", "__item"))
    place = {n: k for k, n in enumerate(names)}
    out = [F.col("__item")[f"__{place[c]}"].alias(c) if c in place else col(c) for c in df.columns]
    return items.select(*out, *([F.col("__position").alias(position)] if position else []))


def explode_map(df: DataFrame, name: str) -> DataFrame:
    """One row per entry of a map as ``name_key`` and ``name_value`` in its place; an empty or NULL map keeps one row of NULLs."""
    keep = [col(c) for c in df.columns if c != name]
    items = df.select(*keep, F.explode_outer(col(name)).alias("__key", "__value"))
    out = []
    for c in df.columns:
        out += [F.col("__key").alias(f"{name}_key"), F.col("__value").alias(f"{name}_value")] if c == name else [col(c)]
    return items.select(*out)


def flatten(df: DataFrame, explode: bool = True, aligned: bool = False, maps: bool = False) -> DataFrame:
    """Repeat struct flattening and array explosion until every column is plain.

    Arrays that stand side by side are exploded one after another, which multiplies their rows; with ``aligned`` they are
    exploded together by position. Maps stay as they are unless ``maps``.
    """
    while True:
        df = flatten_structs(df)
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        entries = [f.name for f in df.schema if maps and isinstance(f.dataType, T.MapType)]
        if not explode or not (arrays or entries):
            return df
        if arrays:
            df = explode_aligned(df, arrays) if aligned else explode_array(df, arrays[0])
        else:
            df = explode_map(df, entries[0])
