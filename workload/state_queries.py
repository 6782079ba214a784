"""Profiles from merged states, drift between runs, aligned arrays and maps, and mapping workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import evenkeel as ek
from evenkeel.frames import new_folder
from evenkeel.operators.sketches import QUANTILES

from .registry import register

# The columns of lineitem by kind.
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus"]
OTHERS = ["l_shipdate"]
#: Bounds that the estimates must keep: three standard errors of the distinct sketch, rank error of the quantile sketch.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.03


def profile_sql() -> str:
    """Exact measures of every column of lineitem; for estimates, that they are within their bounds."""
    def number(c, metric, value):
        return f"""SELECT '{c}' AS "column", '{metric}' AS metric, round(CAST({value} AS DOUBLE), 4) + 0.0 AS number, CAST(NULL AS VARCHAR) AS text FROM lineitem"""

    def text(c, metric, value):
        return f"SELECT '{c}', '{metric}', CAST(NULL AS DOUBLE), {value} FROM lineitem HAVING count(*) > 0"

    def listed(c, label, value):
        return f"""SELECT '{c}', '{label}_' || row_number() OVER (ORDER BY count(*) DESC), CAST(NULL AS DOUBLE), {value} || ' (' || count(*) || ')'
                   FROM lineitem WHERE {c} IS NOT NULL GROUP BY {value}"""

    parts = []
    for c in NUMBERS + TEXTS + OTHERS:
        parts += [number(c, "count", f"count({c})"), number(c, "nulls", f"count(*) - count({c})"), text(c, "distinct", "'within'")]
    for c in NUMBERS:
        parts += [number(c, "min", f"min({c})"), number(c, "max", f"max({c})"), number(c, "mean", f"avg({c})"),
                  number(c, "sd", f"stddev_samp({c})"), *[text(c, f"q{q * 100:g}", "'within'") for q in QUANTILES]]
    for c in TEXTS:
        parts += [number(c, "blanks", f"count(CASE WHEN trim({c}) = '' THEN 1 END)"), number(c, "min_length", f"min(length({c}))"),
                  number(c, "max_length", f"max(length({c}))"), listed(c, "top", c),
                  listed(c, "pattern", f"regexp_replace(regexp_replace({c}, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g')")]
    for c in TEXTS + OTHERS:
        parts += [text(c, "min", f"CAST(min({c}) AS VARCHAR)"), text(c, "max", f"CAST(max({c}) AS VARCHAR)")]
    return " UNION ALL ".join(f"SELECT * FROM ({p}) p{k}" for k, p in enumerate(parts))


def held_to_bounds(found: DataFrame, data: DataFrame) -> DataFrame:
    """(column, metric, number, text): exact measures as they are, estimates as ``within`` or ``off`` by an exact count over all rows."""
    found = found.where("metric NOT LIKE 'q%' AND metric <> 'distinct'").unionByName(_judged(found, data))
    numeric = F.col("column").isin(NUMBERS) & (F.col("metric") != "distinct") & ~F.col("metric").startswith("q")
    numeric = numeric | F.col("metric").isin("count", "nulls", "blanks", "min_length", "max_length")
    return found.select("column", "metric", F.when(numeric, F.round(F.col("value").cast("double"), 4) + 0.0).alias("number"),
                        F.when(~numeric, F.col("value")).alias("text"))


def _judged(found: DataFrame, data: DataFrame) -> DataFrame:
    verdict = lambda ok: F.when(ok, "within").otherwise("off").alias("value")
    exact = ek.profile_distinct(data, exact=True)
    distinct = found.where("metric = 'distinct'").join(exact, "column")
    gap = F.abs(F.col("value").cast("double") - F.col("distinct_values"))
    distinct = distinct.select("column", "metric", verdict(gap <= DISTINCT_ERROR * F.col("distinct_values")))
    guesses = found.where("metric LIKE 'q%'").select("column", "metric", F.col("value").cast("double").alias("guess"))
    cells = data.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in NUMBERS]))).where("x IS NOT NULL")
    # Three guesses a column: their number does not depend on the rows.
    ranks = cells.join(F.broadcast(guesses), "column").groupBy("column", "metric").agg(
        F.avg((F.col("x") < F.col("guess")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("guess")).cast("double")).alias("upto"))
    wanted = F.expr("double(substr(metric, 2)) / 100")
    close = (F.col("below") <= wanted + RANK_ERROR) & (F.col("upto") >= wanted - RANK_ERROR)
    return distinct.unionByName(ranks.select("column", "metric", verdict(close)))


@register("profile", profile_sql())
def _(t):
    """The whole profile from one scan."""
    return held_to_bounds(ek.profile(t.lineitem), t.lineitem)


@register("profile_merged", profile_sql())
def _(t):
    """States by return flag, stored with the load and added up later: the same profile without reading the data again."""
    path = new_folder(t.spark, "profile-states")
    ek.profile_state(t.lineitem.withColumn("part", F.coalesce("l_returnflag", F.lit(""))), by=["part"]).write.parquet(path)
    return held_to_bounds(ek.describe(ek.merge_states(t.spark.read.parquet(path))), t.lineitem)


# A later load of the orders: prices by a third higher, a third of the priorities lost.
LATER = {
    "o_totalprice": "o_totalprice * 1.3", "o_orderpriority": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END",
}
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_TEXTS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def drift_sql() -> str:
    """The largest gap of the exact distributions at every value of either load, and the shares of NULLs."""
    parts = []
    for c in ORDER_NUMBERS + ORDER_TEXTS:
        later = LATER.get(c, c)
        mean = (lambda v: f"round(avg({v}), 4)") if c in ORDER_NUMBERS else (lambda v: "CAST(NULL AS DOUBLE)")
        share = lambda v: f"round(1 - count({v}) / count(*), 6)"
        gap = f"""(SELECT max(abs(a - b)) FROM (
            SELECT sum(sum(side)) OVER (ORDER BY x) / (SELECT count(*) FROM orders) AS a, sum(sum(1 - side)) OVER (ORDER BY x) / (SELECT count(*) FROM orders) AS b
            FROM (SELECT {c} AS x, 1 AS side FROM orders UNION ALL SELECT {later}, 0 FROM orders) s GROUP BY x) g)""" if c in ORDER_NUMBERS else "0"
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS rows_before, count(*) AS rows_after, {share(c)} AS nulls_before, {share(later)} AS nulls_after,
            {mean(c)} AS mean_before, {mean(later)} AS mean_after, ({gap} > 0.1 OR abs({share(c)} - {share(later)}) > 0.1) AS drifted FROM orders""")
    return " UNION ALL ".join(parts)


@register("profile_drift", drift_sql())
def _(t):
    """Drift between two loads, from stored states."""
    folder = new_folder(t.spark, "profile-drift")
    later = t.orders.withColumns({c: F.expr(sql) for c, sql in LATER.items()})
    for name, load in (("before", t.orders), ("after", later)):
        ek.profile_state(load).write.parquet(f"{folder}/{name}")
    out = ek.profile_drift(*[t.spark.read.parquet(f"{folder}/{name}") for name in ("before", "after")])
    rounded = {c: F.round(c, d) for c, d in (("nulls_before", 6), ("nulls_after", 6), ("mean_before", 4), ("mean_after", 4))}
    return out.withColumns(rounded).drop("distance")


@register("flatten_siblings", """
    WITH roles AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
         replies AS (SELECT conv_id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place
                     FROM conversations WHERE role = 'assistant' AND conv_id % 7 <> 0)
    SELECT conv_id, CAST(place - 1 AS INT) AS place, role AS roles, CAST(size AS INT) AS replies
    FROM roles FULL JOIN replies USING (conv_id, place)""")
def _(t):
    """All roles of a conversation beside the lengths of its replies (NULL for some): by position, not every role with every reply."""
    in_order = lambda value, when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("turn", value.alias("v"))))), lambda x: x["v"])
    nested = t.conversations.groupBy("conv_id").agg(
        in_order(F.col("role"), F.lit(True)).alias("roles"), in_order(F.length("text"), F.col("role") == "assistant").alias("replies"))
    nested = nested.withColumn("replies", F.when(F.col("conv_id") % 7 != 0, F.col("replies")))
    return ek.explode_aligned(nested, ["roles", "replies"], "place")


ENTRIES = {"name": "c_name", "nation": "CAST(c_nationkey AS STRING)", "segment": "c_mktsegment"}


@register("flatten_map", " UNION ALL ".join(
    f"SELECT c_custkey, '{k}' AS facts_key, {v} AS facts_value FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0" for k, v in ENTRIES.items()
) + " UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 17 = 0")
def _(t):
    """A map column, NULL or empty for some rows, as key and value rows."""
    facts = F.create_map(*[x for k, v in ENTRIES.items() for x in (F.lit(k), F.expr(v))])
    facts = F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).when(F.col("c_custkey") % 17 == 0, F.map_filter(facts, lambda k, v: F.lit(False))).otherwise(facts)
    return ek.flatten(t.customer.select("c_custkey", facts.alias("facts")), aligned=True, maps=True)


@register("mapping_workbook", """
    SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, trim(o_orderpriority) AS priority,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day, 'daily' AS load
    FROM orders_src WHERE o_orderstatus IS NOT NULL""")
def _(t):
    """Configuration, schema and mapping sheets written out, then run: a file without a header, with lengths, scales and trimmed cells."""
    folder = new_folder(t.spark, "workbook")
    t.orders_src.withColumn("o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy")).write.option("sep", "|").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/data/orders")
    config = {
        "mappingname": "orders", "sourceconnectiontype": "local", "sourcefileformat": "delimited", "sourcefilepath": f"{folder}/data",
        "sourcefilename": "orders", "sourcefilehasheader": "N", "sourcefiledelimiter": "|", "sourcetimestampformat": "dd.MM.yyyy",
        "targetconnectiontype": "local", "targetfileformat": "parquet", "targetfilepath": folder, "targetfilename": "none", "trimwhitespaces": "Y",
    }
    sheet = lambda rows, columns: t.spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite")
    sheet(list(config.items()), "key string, value string").csv(f"{folder}/config.csv")
    sheet([
        ("source", "o_orderkey", "bigint", None, None, "Y"), ("source", "o_custkey", "bigint", None, None, None),
        ("source", "o_orderstatus", "string", 1, None, None), ("source", "o_totalprice", "NUMBER", 12, 2, None),
        ("source", "o_orderdate", "date", None, None, None), ("source", "o_orderpriority", "string", None, None, None),
        ("target", "order_id", "bigint", None, None, "Y"), ("target", "price", "number", 12, 2, None), ("target", "priority", "string", 15, None, None),
        ("target", "order_day", "datetime", None, None, None), ("target", "load", "string", None, None, None),
    ], "tabletype string, columnname string, datatype string, length int, scale int, primarykey string").option("header", True).csv(f"{folder}/schema.csv")
    direct = lambda target, source, only=None: (target, source, "directmapped", None, None, only, None, None, None)
    sheet([
        direct("order_id", "o_orderkey"), direct("price", "o_totalprice"), direct("priority", "o_orderpriority"),
        direct("order_day", "o_orderdate", "o_orderstatus IS NOT NULL"),
        ("load", "-", "hardcoded", None, "'daily'", None, None, None, None),
    ], ", ".join(f"{c} string" for c in (
        "tgtcolumnname", "srccolumnname", "transformationtype", "filteroutnulls", "selectsqlexpression", "filtersqlexpression",
        "lookuptablename", "lookupjoincolumnname", "lookupreturnexpression",
    ))).option("header", True).csv(f"{folder}/target_mapping.csv")
    return ek.mapped_rows(t.spark, folder)
