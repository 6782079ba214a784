"""Reports over run results and the run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import let

# Runtime buckets of the report, upper bounds in seconds.
UNKNOWN = "unknown"
BUCKETS = (("0s-45s", 45), ("45s-2m", 120), ("2m-5m", 300), ("5m+", None))


def _is(result: str) -> Column:
    return F.col("test_result") == result


def suite_totals(results: DataFrame) -> DataFrame:
    """Cases, passed, failed and errored of one or many runs' results."""
    return results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(_is("Passed")).alias("passed"),
        F.count_if(_is("Failed")).alias("failed"), F.count_if(_is("Errored")).alias("errored"),
    )


def trend(history: DataFrame, n: int = 40) -> DataFrame:
    """The latest ``n`` runs with total, failed, passed and pass rate."""
    runs = history.groupBy("run_created_time").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_is("Failed")).alias("failed"),
        F.count_if(_is("Passed")).alias("passed"), F.max("db_stored_time").alias("stored"),
    )
    latest = runs.orderBy(F.desc("stored"), F.desc("run_created_time")).limit(n)
    return latest.select(
        "run_created_time", "total", "failed", "passed",
        F.round(F.col("passed") / F.col("total"), 4).alias("pass_rate"),
    )


def outcome_by_type(history: DataFrame) -> DataFrame:
    return history.groupBy("testcase_type", "test_result").agg(F.count(F.lit(1)).alias("cases"))


def outcome_counts(history: DataFrame, run: str | None = None) -> DataFrame:
    """Cases per result, of one run or of all."""
    rows = history if run is None else history.where(F.col("run_created_time") == run)
    return rows.groupBy("test_result").agg(F.count(F.lit(1)).alias("cases"))


def runtime_seconds(runtime: Column) -> Column:
    """Seconds of ``H:MM:SS`` text, with ``N days,`` before it or a fraction behind it; the fraction does not count."""
    days = F.coalesce(F.regexp_extract(runtime, r"^\s*([0-9]+) days?,", 1).try_cast("int"), F.lit(0))
    parts = F.split(F.regexp_replace(F.trim(runtime), r"^[0-9]+ days?,\s*|\.[0-9]+$", ""), ":")
    h, m, s = (F.get(parts, F.lit(i)).try_cast("int") for i in range(3))
    return days * 86400 + h * 3600 + m * 60 + s


def runtime_bucket(runtime: Column) -> Column:
    """The bucket of a runtime, ``unknown`` if the text is none; NULL where there is no text."""
    text = F.when(F.trim(runtime) != "", runtime)
    good = text.rlike("^\\s*([0-9]+ days?,\\s*)?[0-9]+:[0-9]+:[0-9]+(\\.[0-9]+)?\\s*$")
    return let(F.when(good, runtime_seconds(text)), lambda seconds: F.when(text.isNull(), None).when(seconds.isNull(), UNKNOWN).otherwise(_bucket(seconds)))


def _bucket(seconds: Column) -> Column:
    (first, below), *rest = BUCKETS
    out = F.when(seconds < below, first)
    for name, below in rest:
        out = out.otherwise(name) if below is None else out.when(seconds < below, name)
    return out


def runtime_buckets(history: DataFrame) -> DataFrame:
    """Runs and distinct cases per runtime bucket, malformed runtimes in ``unknown``; runs without a runtime are skipped."""
    per_case = runtime_members(history)
    return per_case.groupBy("bucket").agg(F.sum("runs").alias("runs"), F.count(F.lit(1)).alias("cases"))


def runtime_members(history: DataFrame) -> DataFrame:
    """The cases of each bucket, one row per case instead of one growing list per bucket."""
    # Equal texts are counted first, so each runtime is read once; a report has few of them.
    texts = history.groupBy("runtime", "testcase_name").agg(F.count(F.lit(1)).alias("n"))
    rows = texts.select(runtime_bucket(F.col("runtime")).alias("bucket"), "testcase_name", "n").where("bucket IS NOT NULL")
    return rows.groupBy("bucket", "testcase_name").agg(F.sum("n").alias("runs"))


def failed_first(results: DataFrame) -> DataFrame:
    """Results with errored and failed cases before passed ones, by reason and name.

    The remaining columns break ties, so that the sort can cut a common reason into many tasks.
    """
    place = F.when(_is("Passed"), 1).otherwise(0)
    rest = [c for c in results.columns if c not in ("reason", "testcase_name")]
    return results.orderBy(place, "reason", "testcase_name", *rest)
