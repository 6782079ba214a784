"""Column mappings compiled into one select, one filter and the lookups it needs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import names as name_list, predicate
from ..functions.values import col

# Transformation types of a mapping sheet and the layer hops it can describe.
DIRECT, DERIVED, HARDCODED, AUTOGENERATED = "directmapped", "derived", "hardcoded", "autogenerated"
SOURCE_TO_STAGE, STAGE_TO_TARGET, SOURCE_TO_TARGET = "source_to_stage", "stage_to_target", "source_to_target"
HOPS = (SOURCE_TO_STAGE, STAGE_TO_TARGET, SOURCE_TO_TARGET)

# Type names of declared schemas that differ from Spark's.
TYPE_ALIASES = {"datetime": "date", "integer": "int"}


def spark_type(name: str | None) -> str | None:
    """A declared type name as a Spark type name; blank means undeclared."""
    text = (name or "").strip().lower()
    return TYPE_ALIASES.get(text, text) or None


@dataclass(frozen=True)
class MappingRow:
    """One target column and where it comes from."""

    target: str
    source: str = ""
    kind: str = DIRECT
    filter_nulls: bool = False
    expression: str = ""
    filter_expression: str = ""
    lookup_table: str = ""
    lookup_key: str = ""
    lookup_return: str = ""
    source_type: str | None = None
    target_type: str | None = None


# Sheet column to field.
_SHEET = {
    "tgtcolumnname": "target", "srccolumnname": "source", "transformationtype": "kind",
    "selectsqlexpression": "expression", "filtersqlexpression": "filter_expression",
    "lookuptablename": "lookup_table", "lookupjoincolumnname": "lookup_key",
    "lookupreturnexpression": "lookup_return",
}


def mapping_rows(sheet: DataFrame, source_type: str = "source_type", target_type: str = "target_type") -> list[MappingRow]:
    """A mapping sheet as rows; sheets are configuration, one row per target column."""
    rows = []
    for r in sheet.collect():
        cell = {k.lower(): ("" if v is None else str(v).strip()) for k, v in r.asDict().items()}
        known = {field: cell.get(name, "") for name, field in _SHEET.items()}
        rows.append(MappingRow(
            **{**known, "kind": known["kind"].lower(), "source": "" if known["source"] == "-" else known["source"]},
            filter_nulls=cell.get("filteroutnulls", "").upper() == "Y",
            source_type=cell.get(source_type) or None, target_type=cell.get(target_type) or None,
        ))
    return rows


def with_schemas(sheet: DataFrame, target_schema: DataFrame, source_schema: DataFrame) -> DataFrame:
    """The sheet with the declared type of each target and source column; unmatched columns stay NULL."""
    def types(schema, label):
        return schema.select(
            F.lower("columnname").alias(f"__{label}"), F.col("datatype").alias(f"{label}_type")
        )

    tgt, src = types(target_schema, "target"), types(source_schema, "source")
    out = sheet.join(tgt, F.lower("tgtcolumnname") == F.col("__target"), "left")
    out = out.join(src, F.lower("srccolumnname") == F.col("__source"), "left")
    return out.drop("__target", "__source")


def _kept(rows: Iterable[MappingRow], exclude) -> list[MappingRow]:
    dropped = {n.lower() for n in name_list(exclude)}
    return [r for r in rows if r.kind != AUTOGENERATED and r.target.lower() not in dropped]


def _join_lookups(src: DataFrame, rows: Sequence[MappingRow], lookups: Mapping[str, DataFrame]):
    """Left join every distinct (table, source column, key) once, in first-seen order; returns value columns by row.

    Join strategy is left to Spark's size checks: a small lookup is broadcast, a large one shuffled, and AQE
    splits hot keys of the left side.
    """
    groups: dict[tuple, list[MappingRow]] = {}
    for r in rows:
        if r.kind == DERIVED and r.lookup_table:
            groups.setdefault((r.lookup_table, r.source, r.lookup_key), []).append(r)
    values: dict[str, Column] = {}
    for i, ((table, source, key), users) in enumerate(groups.items()):
        returns = {r.lookup_return: f"__lk{i}_{j}" for j, r in enumerate(users)}
        lookup = lookups[table].alias(table.rsplit(".", 1)[-1]).select(
            col(key).alias(f"__lk{i}"), *[F.expr(e).alias(a) for e, a in returns.items()]
        )
        src = src.join(lookup, F.col(f"src.{source}") == F.col(f"__lk{i}"), "left")
        values.update({r.target: F.col(returns[r.lookup_return]) for r in users})
    return src, values


def repeated_lookup_keys(rows: Iterable[MappingRow], lookups: Mapping[str, DataFrame]) -> DataFrame | None:
    """(lookup_table, lookup_key, key_value, rows) for every lookup key that repeats, None if no row has a lookup.

    A lookup is a left join, so a source row with a repeated key gives one row per copy; check this first.
    """
    used = dict.fromkeys((r.lookup_table, r.lookup_key) for r in rows if r.kind == DERIVED and r.lookup_table)
    found = [
        lookups[table].where(col(key).isNotNull()).groupBy(col(key).cast("string").alias("key_value"))
        .agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        .select(F.lit(table).alias("lookup_table"), F.lit(key).alias("lookup_key"), "key_value", "rows")
        for table, key in used
    ]
    return reduce(DataFrame.unionByName, found) if found else None


def apply_mapping(
    src: DataFrame,
    rows: Iterable[MappingRow],
    hop: str = SOURCE_TO_TARGET,
    lookups: Mapping[str, DataFrame] | None = None,
    where: str | None = None,
    exclude: Sequence[str] | str = (),
    trim: bool = False,
    cast: str = "strict",
) -> DataFrame:
    """The source side of a mapped test: the source rows as the target should hold them.

    Inside expressions the source is called ``src`` and a lookup by its table name. Trimming, casting and NULL
    filters apply to hops into the target only. ``cast='try'`` turns values that do not fit into NULL.
    """
    if hop not in HOPS:
        raise ValueError(f"unknown hop: {hop!r}")
    kept = _kept(rows, exclude)
    # Filters run on the source alone, so they reach its scan.
    base = src.alias("src")
    conditions = [predicate(r.filter_expression) for r in kept]
    if hop != SOURCE_TO_STAGE:
        for name in dict.fromkeys(r.source for r in kept if r.filter_nulls and r.source):
            base = base.where(F.col(f"src.{name}").isNotNull())
    for text in dict.fromkeys([c for c in conditions if c] + [predicate(where)]):
        if text:
            base = base.where(F.expr(text))
    joined, looked_up = _join_lookups(base, kept, lookups or {})

    def value(r: MappingRow) -> Column:
        if r.target in looked_up:
            out = looked_up[r.target]
        elif r.kind == DIRECT:
            out = F.col(f"src.{r.source}")
        elif r.kind not in (DERIVED, HARDCODED):
            raise ValueError(f"unknown transformation type {r.kind!r} of {r.target}")
        elif r.kind == DERIVED and not r.expression:
            raise ValueError(f"derived column {r.target} has no expression")
        else:
            out = F.expr(r.expression or "NULL")
        if hop == SOURCE_TO_STAGE:
            return out
        want, have = spark_type(r.target_type), spark_type(r.source_type)
        if trim and want == "string":
            out = F.trim(out)
        if want and (r.kind == HARDCODED or (have and want != have)):
            out = out.try_cast(want) if cast == "try" else out.cast(want)
        return out

    return joined.select(*[value(r).alias(r.target) for r in kept])


def target_select(
    tgt: DataFrame, rows: Iterable[MappingRow], where: str | None = None, exclude: Sequence[str] | str = ()
) -> DataFrame:
    """The target side of a mapped test: the mapped columns as they are."""
    base = tgt.alias("tgt")
    text = predicate(where)
    if text:
        base = base.where(F.expr(text))
    return base.select(*[F.col(f"tgt.{r.target}") for r in _kept(rows, exclude)])


def like_select(df: DataFrame, exclude: Sequence[str] | str = (), where: str | None = None) -> DataFrame:
    """All columns but the excluded ones in alphabetical order, after a free-text row filter."""
    dropped = {n.lower() for n in name_list(exclude)}
    text = predicate(where)
    rows = df.where(F.expr(text)) if text else df
    return rows.select(*[col(c) for c in sorted(df.columns) if c.lower() not in dropped])


def join_chain(base: DataFrame, joins: Sequence[tuple[DataFrame, str, str]], where: str | None = None) -> DataFrame:
    """Ordered joins of ``(frame, condition, how)``; the filter stays out of the join conditions."""
    out = reduce(lambda left, j: left.join(j[0], F.expr(j[1]), j[2]), joins, base)
    text = predicate(where)
    return out.where(F.expr(text)) if text else out
