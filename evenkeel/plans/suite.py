"""Running a suite of test cases."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce
from time import monotonic

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.parsing import names as name_list
from ..operators.mapping import SOURCE_TO_TARGET, MappingRow, apply_mapping, target_select
from ..operators.reconcile import Pair
from ..sources.readers import SourceSpec, read_source
from ..sources.sheets import load_mapping
from .report import content_report
from .verdicts import test_content, test_count, test_duplicate, test_fingerprint, test_null, test_schema

DEFAULT_LIMIT = 10


def _target(pair: Pair) -> DataFrame:
    """The target with its key columns under the source's names."""
    names = pair.target_names()
    return pair.target.withColumnsRenamed({names[k]: k for k in pair.keys if names[k] != k})


# The test types of a suite.
TESTS: dict[str, Callable[[Pair], DataFrame]] = {
    "count": lambda p: test_count(p.source, p.target),
    "duplicate": lambda p: test_duplicate(p.source, _target(p), p.keys),
    "null": lambda p: test_null(p.source, p.target),
    "content": test_content,
    "schema": lambda p: test_schema(p.source, p.target),
    "fingerprint": lambda p: test_fingerprint(p.source, _target(p), p.keys),
}

RESULT = (
    "testcase_name string, testcase_type string, test_result string, reason string, src_rows bigint, tgt_rows bigint, "
    "src_distinct bigint, tgt_distinct bigint, matched bigint, mismatched bigint, only_source bigint, "
    "only_target bigint, checks bigint, checks_passed bigint, checks_failed bigint, runtime string, "
    "started string, ended string, run_created_time string, protocol_start_time string, protocol_end_time string, "
    "protocol_total_run_time string"
)
DETAIL = (
    "testcase_name string, kind string, `column` string, key_columns string, source_value string, target_value string"
)
_MEASURES = [f.strip().split(" ")[0] for f in RESULT.split(",")][4:15]
_RENAMED = {"checks": "kpis", "checks_passed": "kpis_passed", "checks_failed": "kpis_failed"}


@dataclass(frozen=True)
class Case:
    """One case: either two frames or two source descriptions.

    With a ``mapping`` the source is compared as the mapping turns it into the target; ``where``, ``target_where``
    and ``exclude`` then apply to the mapped sides.
    """

    name: str
    keys: Sequence[str] | str
    source: DataFrame | SourceSpec
    target: DataFrame | SourceSpec
    execute: str | bool = "Y"
    limit: int | str | None = None
    columns: Mapping[str, str] | None = None
    mapping: Sequence[MappingRow] | None = None
    hop: str = SOURCE_TO_TARGET
    lookups: Mapping[str, DataFrame] = field(default_factory=dict)
    where: str = ""
    target_where: str = ""
    exclude: Sequence[str] | str = ()
    trim: bool = False

    def pair(self, spark: SparkSession) -> Pair:
        read = lambda side: side if isinstance(side, DataFrame) else read_source(spark, side)
        src, tgt = read(self.source), read(self.target)
        if self.mapping is not None:
            src = apply_mapping(src, self.mapping, self.hop, self.lookups, self.where, self.exclude, self.trim)
            tgt = target_select(tgt, self.mapping, self.target_where, self.exclude)
        return Pair(src, tgt, name_list(self.keys), self.columns)

    def sample_limit(self) -> int:
        """Samples to keep per report; blank means the default."""
        return DEFAULT_LIMIT if self.limit in (None, "") else int(self.limit)


def selected(cases: Iterable[Case], names: Sequence[str] | None = None) -> list[Case]:
    """Cases marked to execute, or the named ones whatever their mark."""
    if names is None or [n.lower() for n in names] == ["all"]:
        return [c for c in cases if c.execute is True or str(c.execute).strip().upper() == "Y"]
    wanted = {n.lower() for n in names}
    return [c for c in cases if c.name.lower() in wanted]


def cases_from_rows(rows: Iterable[dict], spark: SparkSession | None = None) -> list[Case]:
    """Cases from the rows of a suite sheet (one dict per row; sheets are configuration).

    Like-object cases read both sides with their filters or manual queries. Mapped cases (``s2tcompare`` in mode
    ``Auto``) take their mapping from the folder in ``s2tpath`` and need the session to read it.
    """
    text = lambda row, name: str(row.get(name) or "").strip()

    def side(row: dict, p: str) -> SourceSpec:
        cell = lambda name: text(row, p + name)
        path = "/".join(x for x in (cell("filepath").rstrip("/"), cell("filename")) if x)
        query = "/".join(x for x in (cell("querysqlpath").rstrip("/"), cell("querysqlfilename")) if x)
        manual = text(row, "testquerygenerationmode").lower() == "manual"
        fmt = cell("fileformat")
        return SourceSpec(
            connection=cell("connectiontype"), format=fmt, path=path, table=cell("filename") if fmt == "table" else "",
            alias=cell("aliasname") or p, query=query if manual else "", exclude=cell("excludecolumnlist"),
            where=cell("filter"), delimiter=cell("filedelimiter") or ",",
        )

    def case(row: dict) -> Case:
        src, tgt = side(row, "source"), side(row, "target")
        plain = Case(
            name=text(row, "test_case_name"), keys=text(row, "primarykey"), source=src, target=tgt,
            execute=row.get("execute") or "N", limit=row.get("samplelimit"),
        )
        if text(row, "comparetype").lower() != "s2tcompare" or src.query:
            return plain
        hop = text(row, "s2tmappingsheet") or SOURCE_TO_TARGET
        sheets = load_mapping(spark, text(row, "s2tpath"), hop)
        # Only text formats need the declared schema; the others bring their own.
        declare = lambda spec, ddl: replace(
            spec, exclude="", where="", schema=ddl if spec.format in ("delimited", "json") else None
        )
        return replace(
            plain, keys=plain.keys or sheets.keys, source=declare(src, sheets.source_schema),
            target=declare(tgt, sheets.target_schema), mapping=sheets.rows, hop=hop, where=src.where,
            target_where=tgt.where, exclude=src.exclude, trim=text(row, "trimwhitespaces").upper() == "Y",
        )

    return [case(r) for r in rows]


def run_suite(
    spark: SparkSession, cases: Iterable[Case], test_type: str, names: Sequence[str] | None = None, workers: int = 4
) -> DataFrame:
    """Run one test type over the selected cases: one result row per case, in their order.

    Up to ``workers`` cases run side by side, each in a scheduler pool of its own, so small cases fill what a large one leaves free
    (with ``spark.scheduler.mode`` FAIR they share evenly). Only verdict rows come to the driver. A case that raises, while planning or
    while running, gives an ``Errored`` row with the reason, and the others go on.
    """
    test, context = TESTS[test_type], spark.sparkContext
    run, run_clock = datetime.now(timezone.utc).isoformat(), monotonic()

    def verdict(case: Case) -> tuple:
        context.setLocalProperty("spark.scheduler.pool", f"case-{case.name}")
        begun, clock = datetime.now(timezone.utc), monotonic()
        try:
            found = test(case.pair(spark)).first().asDict()
            result, reason = found["result"], found["reason"]
        except Exception as error:
            found, result, reason = {}, "Errored", f"Execution Error: {str(error).splitlines()[0]}"
        measures = [found.get(m, found.get(_RENAMED.get(m, m))) for m in _MEASURES]
        return (case.name, test_type, result, reason, *measures, clock_text(monotonic() - clock),
                begun.isoformat(), datetime.now(timezone.utc).isoformat())

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        out = list(pool.map(inheritable_thread_target(spark)(verdict), selected(cases, names)))
    whole = (run, run, datetime.now(timezone.utc).isoformat(), clock_text(monotonic() - run_clock))
    return spark.createDataFrame([row + whole for row in out], RESULT)


def suite_details(spark: SparkSession, cases: Iterable[Case], names: Sequence[str] | None = None) -> DataFrame:
    """What differs in the content of each selected case, as far as its sample limit goes.

    Kinds: ``cell`` (a differing cell), ``mismatched``, ``only_source``, ``only_target`` (keys) and ``errored``, a case
    that could not be planned or joined, with the reason as its source value. The differences of a case are stored once.
    """
    parts = [spark.createDataFrame([], DETAIL)]
    for case in selected(cases, names):
        try:
            report = content_report(case.pair(spark), case.sample_limit())
            found = {
                "cell": report.cells, "mismatched": report.mismatched_keys,
                "only_source": report.only_source_keys, "only_target": report.only_target_keys,
            }
        except Exception as error:
            reason = f"Execution Error: {str(error).splitlines()[0]}"
            parts.append(spark.createDataFrame([(case.name, "errored", None, None, reason, None)], DETAIL))
            continue
        for kind, df in found.items():
            parts.append(df.select(F.lit(case.name).alias("testcase_name"), F.lit(kind).alias("kind"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def clock_text(seconds: float) -> str:
    """``H:MM:SS``."""
    whole = int(seconds)
    return f"{whole // 3600}:{whole // 60 % 60:02d}:{whole % 60:02d}"
