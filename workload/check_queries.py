"""Data quality rules, business rules, history checks, profiles, run results."""

from __future__ import annotations

from pyspark.sql import functions as F

import evenkeel as ek
from evenkeel.frames import new_folder
from evenkeel.functions import debit_credit
from evenkeel.operators.profile import quantiles
from evenkeel.operators.quality import Rule
from evenkeel.sources import HISTORY, append_history, read_table

from .registry import register

# Declarative checks
RULE = """{no} AS rule_no, '{check}' AS "check", '{column}' AS "column", '{kind}' AS check_type, {expected} AS expected"""


def verdict_sql(no, rule: Rule, table: str, ok: str, unexpected: str, observed: str, reason: str, expected: str | None = None) -> str:
    """One verdict row; `n` is the table's row count and `u` the unexpected count."""
    text = expected if expected is not None else "'" + str(rule.value).replace("'", "''") + "'"
    head = RULE.format(no=no, check=rule.check, column=rule.column, kind=rule.check_type, expected=text)
    return f"""SELECT {head}, n AS element_count, u AS unexpected_count, CAST({observed} AS VARCHAR) AS observed,
        CASE WHEN {ok} THEN 'Passed' ELSE 'Failed' END AS result, CASE WHEN {ok} THEN 'Matched' ELSE {reason} END AS reason
        FROM (SELECT count(*) AS n, {unexpected} AS u FROM {table}) x"""


def row_rule_sql(no, rule: Rule, table: str, bad: str, reason: str) -> str:
    return verdict_sql(no, rule, table, "u = 0", f"count(CASE WHEN {bad} THEN 1 END)", "NULL", f"CAST(u AS VARCHAR) || ' {reason}'")


LEN, NUL, NOTNUL = "values do not have the expected length", "values are not null", "values are null"
LENGTH_EQUAL = Rule("Length", "c_mktsegment", "Equal", "9")
LENGTH_BETWEEN = Rule("Length", "c_mktsegment", "Between", "8-9")
IS_NULL = Rule("Null", "o_orderstatus", "Not Required", "")
NOT_NULL = Rule("NotBeNull", "o_orderpriority", "Not Required", "")
UNIQUE_NAME = Rule("Unique", "p_name", "Not Required", "")
UNIQUE_KEY = Rule("Unique", "p_partkey", "Not Required", "")
LANGS = Rule("DistinctSet", "lang", "Not Required", "['de','en','es','xx']")
REGEX = Rule("Regexp", "p_brand", "Not Required", "'^Brand#[0-9]$'")
REGEX_LIST = Rule("Regexplist", "p_brand", "Not Required", "['^Brand#[0-9]$','^Brand#1[0-9]$']")
SUM_OK = Rule("Sum", "quantity", "Between", "1-99999999999")
SUM_BAD = Rule("Sum", "quantity", "Between", "-100--5.5")
COLUMN_COUNT = Rule("ColumnCount", "Table", "Not Required", "7")
PART_ORDER = ["p_partkey", "p_brand", "p_name", "p_type", "p_size"]
COLUMN_ORDER = Rule("ColumnOrder", "Table", "Not Required", str(PART_ORDER))

UNIQUE_SQL = lambda no, rule, table, c: f"""SELECT {RULE.format(no=no, check=rule.check, column=rule.column, kind=rule.check_type, expected="''")},
    n AS element_count, u AS unexpected_count, CAST(NULL AS VARCHAR) AS observed,
    CASE WHEN u = 0 THEN 'Passed' ELSE 'Failed' END AS result,
    CASE WHEN u = 0 THEN 'Matched' ELSE CAST(u AS VARCHAR) || ' values are not unique' END AS reason
    FROM (SELECT CAST(sum(k) AS BIGINT) AS n, CAST(COALESCE(sum(CASE WHEN k > 1 AND v IS NOT NULL THEN k END), 0) AS BIGINT) AS u
          FROM (SELECT {c} AS v, count(*) AS k FROM {table} GROUP BY 1) g) x"""
SUM_SQL = lambda no, rule, lo, hi: verdict_sql(
    no, rule, "lineitem", f"q BETWEEN {lo} AND {hi}", "CAST(NULL AS BIGINT)", "q", "'The sum is outside the range'"
).replace("FROM (SELECT count(*) AS n,", "FROM (SELECT sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, count(*) AS n,")
SET_SQL = lambda no: f"""SELECT {RULE.format(no=no, check='DistinctSet', column='lang', kind='Not Required', expected="'[''de'',''en'',''es'',''xx'']'")},
    (SELECT count(*) FROM documents) AS element_count, u AS unexpected_count,
    CAST(u AS VARCHAR) || ' unexpected, ' || CAST(m AS VARCHAR) || ' missing' AS observed,
    CASE WHEN u = 0 AND m = 0 THEN 'Passed' ELSE 'Failed' END AS result,
    CASE WHEN u = 0 AND m = 0 THEN 'Matched' ELSE 'The distinct values differ from the set' END AS reason
    FROM (SELECT (SELECT count(DISTINCT lang) FROM documents WHERE lang NOT IN ('de','en','es','xx')) AS u,
                 4 - (SELECT count(DISTINCT lang) FROM documents WHERE lang IN ('de','en','es','xx')) AS m) x"""
COUNT_SQL = lambda no: verdict_sql(no, COLUMN_COUNT, "part", "7 = 6", "CAST(NULL AS BIGINT)", "'6'", "'The column count differs'")
ORDER_SQL = lambda no: verdict_sql(
    no, COLUMN_ORDER, "part", "1 = 0", "CAST(3 AS BIGINT)", "'2:p_brand<>p_name,3:p_name<>p_brand,6:-<>p_retailprice'",
    "'The column order differs'")

register("dq_length_equal", row_rule_sql(1, LENGTH_EQUAL, "customer", "length(c_mktsegment) <> 9", LEN))(
    lambda t: ek.run_quality(t.customer, [LENGTH_EQUAL]))
register("dq_length_between", row_rule_sql(1, LENGTH_BETWEEN, "customer", "length(c_mktsegment) NOT BETWEEN 8 AND 9", LEN))(
    lambda t: ek.run_quality(t.customer, [LENGTH_BETWEEN]))
register("dq_null", row_rule_sql(1, IS_NULL, "orders_tgt", "o_orderstatus IS NOT NULL", NUL), also="orders_tgt")(
    lambda t: ek.run_quality(t.orders_tgt, [IS_NULL]))
register("dq_not_null", row_rule_sql(1, NOT_NULL, "orders_tgt", "o_orderpriority IS NULL", NOTNUL), also="orders_tgt")(
    lambda t: ek.run_quality(t.orders_tgt, [NOT_NULL]))
register("dq_unique", UNIQUE_SQL(1, UNIQUE_NAME, "part", "p_name") + " UNION ALL " + UNIQUE_SQL(2, UNIQUE_KEY, "part", "p_partkey"))(
    lambda t: ek.run_quality(t.part, [UNIQUE_NAME, UNIQUE_KEY]))
register("dq_distinct_set", SET_SQL(1))(lambda t: ek.run_quality(t.documents, [LANGS]))
register("dq_column_count", COUNT_SQL(1))(lambda t: ek.run_quality(t.part, [COLUMN_COUNT]))
register("dq_column_order", ORDER_SQL(1))(lambda t: ek.run_quality(t.part, [COLUMN_ORDER]))
register("dq_regex", row_rule_sql(1, REGEX, "part", "NOT regexp_matches(p_brand, '^Brand#[0-9]$')",
                                  "values do not match the pattern"))(lambda t: ek.run_quality(t.part, [REGEX]))
LIST_BAD = "NOT (regexp_matches(p_brand, '^Brand#[0-9]$') OR regexp_matches(p_brand, '^Brand#1[0-9]$'))"
register("dq_regex_list", row_rule_sql(1, REGEX_LIST, "part", LIST_BAD, "values match none of the patterns"))(
    lambda t: ek.run_quality(t.part, [REGEX_LIST]))


def quantities(t):
    return t.lineitem.select(F.col("l_quantity").cast("decimal(18,2)").alias("quantity"))


register("dq_sum_between", SUM_SQL(1, SUM_OK, 1, 99999999999) + " UNION ALL " + SUM_SQL(2, SUM_BAD, -100, -5.5))(
    lambda t: ek.run_quality(quantities(t), [SUM_OK, SUM_BAD]))


@register("dq_distinct_set_values", """
    SELECT COALESCE(d.value, e.value) AS value, COALESCE(d.n, 0) AS rows,
           CASE WHEN e.value IS NULL THEN 'unexpected' WHEN d.value IS NULL THEN 'missing' ELSE 'matched' END AS status
    FROM (SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1) d
    FULL JOIN (SELECT unnest(['de','en','es','xx']) AS value) e ON d.value = e.value""")
def _(t):
    return ek.distinct_set_values(t.documents, "lang", LANGS.value)


SUITE = [REGEX, UNIQUE_NAME, COLUMN_COUNT, REGEX_LIST, UNIQUE_KEY, COLUMN_ORDER]
SUITE_SQL = " UNION ALL ".join([
    row_rule_sql(1, REGEX, "part", "NOT regexp_matches(p_brand, '^Brand#[0-9]$')", "values do not match the pattern"),
    UNIQUE_SQL(2, UNIQUE_NAME, "part", "p_name"), COUNT_SQL(3),
    row_rule_sql(4, REGEX_LIST, "part", LIST_BAD, "values match none of the patterns"),
    UNIQUE_SQL(5, UNIQUE_KEY, "part", "p_partkey"), ORDER_SQL(6),
])


@register("dq_suite", SUITE_SQL)
def _(t):
    return ek.run_quality(t.part, SUITE)


@register("dq_suite_totals", f"""
    SELECT count(*) AS total, count(CASE WHEN result = 'Passed' THEN 1 END) AS passed,
           count(CASE WHEN result = 'Failed' THEN 1 END) AS failed FROM ({SUITE_SQL}) s""")
def _(t):
    return ek.suite_roll_up(ek.run_quality(t.part, SUITE))


# The first unexpected values per rule: the limit is what a sample report is.
HITS = f"""SELECT 1 AS rule_no, p_brand AS value FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$')
    UNION ALL SELECT 2, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 4, p_brand FROM part WHERE {LIST_BAD}"""


@register("dq_samples", f"""
    SELECT * FROM (SELECT rule_no, value, count(*) AS rows,
                          CAST(row_number() OVER (PARTITION BY rule_no ORDER BY value) AS INT) AS sample_no
                   FROM ({HITS}) h GROUP BY rule_no, value) x WHERE sample_no <= 20""")
def _(t):
    return ek.quality_samples(t.part, SUITE)


@register("dq_failed_first", SUITE_SQL)
def _(t):
    return ek.rules_failed_first(ek.run_quality(t.part, SUITE))


# A set given as whole numbers and text, over a decimal column: verdict, values and samples agree.
SET = Rule("DistinctSet", "amount", "", "[1, 2, '3.00', 'many']")
SIZES = "(SELECT CAST(p_size AS DECIMAL(18,2)) AS amount FROM part) x"


@register("dq_set_numeric", f"""
    SELECT 'value' AS kind, COALESCE(v, w) AS value, COALESCE(n, 0) AS rows,
           CASE WHEN v IS NULL THEN 'missing' WHEN w IS NULL THEN 'unexpected' ELSE 'matched' END AS status
    FROM (SELECT CAST(amount AS VARCHAR) AS v, count(*) AS n FROM {SIZES} GROUP BY 1) f
    FULL JOIN (SELECT unnest(['1.00', '2.00', '3.00', 'many']) AS w) g ON v = w
    UNION ALL
    SELECT 'sample', v, n, 'unexpected' FROM (SELECT CAST(amount AS VARCHAR) AS v, count(*) AS n FROM {SIZES}
      WHERE amount NOT IN (1, 2, 3) GROUP BY 1 ORDER BY 1 LIMIT 20) s
    UNION ALL
    SELECT 'verdict', count(DISTINCT CASE WHEN amount NOT IN (1, 2, 3) THEN amount END) || ' unexpected, '
      || 4 - count(DISTINCT CASE WHEN amount IN (1, 2, 3) THEN amount END) || ' missing', count(*), 'Failed' FROM {SIZES}""")
def _(t):
    df = t.part.select(F.col("p_size").cast("decimal(18,2)").alias("amount"))
    values = ek.distinct_set_values(df, "amount", SET.value).select(F.lit("value").alias("kind"), "value", "rows", "status")
    samples = ek.quality_samples(df, [SET]).select(F.lit("sample"), "value", "rows", F.lit("unexpected"))
    return values.union(samples).union(ek.run_quality(df, [SET]).select(F.lit("verdict"), "observed", "element_count", "result"))


# Business rules
MONEY = "CAST({} AS DECIMAL(18,2))"
PRICE = "CAST(sum({0}.o_totalprice) AS DOUBLE)"


def grouped_sql(src: str, tgt: str, group: str) -> str:
    side = lambda t: (f"(SELECT {group} AS g, count(*) AS n, sum(o_totalprice) AS total, min(o_totalprice) AS low, "
                      f"max(o_totalprice) AS high FROM {t} GROUP BY 1)")
    show = ", ".join(f"CAST(s.{c} AS DOUBLE) AS src_{c}, CAST(t.{c} AS DOUBLE) AS tgt_{c}, CAST(s.{c} - t.{c} AS DOUBLE) AS diff_{c}"
                     for c in ("total", "low", "high"))
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in ("n", "total", "low", "high"))
    return f"""
        SELECT COALESCE(s.g, t.g) AS {group}, s.n AS src_n, t.n AS tgt_n, s.n - t.n AS diff_n, {show},
               CASE WHEN t.n IS NULL THEN 'only source' WHEN s.n IS NULL THEN 'only target'
                    WHEN {same} THEN 'match' ELSE 'mismatch' END AS status
        FROM {side(src)} s FULL JOIN {side(tgt)} t ON s.g IS NOT DISTINCT FROM t.g"""


AGGS = {"n": "count(*)", "total": "sum(o_totalprice)", "low": "min(o_totalprice)", "high": "max(o_totalprice)"}


@register("agg_compare", grouped_sql("orders_src", "orders_tgt", "o_orderdate").replace(
    "COALESCE(s.g, t.g) AS o_orderdate", "CAST(COALESCE(s.g, t.g) AS VARCHAR) AS o_orderdate"), also="orders_src orders_tgt")
def _(t):
    return ek.agg_compare(t.orders_src, t.orders_tgt, ["o_orderdate"], AGGS)


@register("agg_compare_null_group", grouped_sql("orders_src", "orders_tgt", "o_orderstatus"), also="orders_src orders_tgt")
def _(t):
    return ek.agg_compare(t.orders_src, t.orders_tgt, ["o_orderstatus"], AGGS)


# A report that was extracted before the last orders were loaded, against the tables behind it.
@register("bi_recon", """
    SELECT COALESCE(r.seg, b.seg) AS c_mktsegment, r.revenue AS src_revenue, b.revenue AS tgt_revenue,
           r.revenue - b.revenue AS diff_revenue,
           CASE WHEN b.seg IS NULL THEN 'only source' WHEN r.seg IS NULL THEN 'only target'
                WHEN abs(r.revenue - b.revenue) <= 1000 OR r.revenue IS NOT DISTINCT FROM b.revenue THEN 'match' ELSE 'mismatch' END AS status
    FROM (SELECT c_mktsegment AS seg, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) r
    FULL JOIN (SELECT c_mktsegment AS seg, CAST(sum(o_totalprice) AS DOUBLE) AS revenue
               FROM orders_tgt JOIN customer ON o_custkey = c_custkey GROUP BY 1) b ON r.seg = b.seg""", also="orders_tgt")
def _(t):
    report = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))
    backend = t.orders_tgt.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return ek.agg_compare(
        report, backend.withColumnRenamed("o_totalprice", "revenue"), ["c_mktsegment"],
        {"revenue": "CAST(sum(revenue) AS DOUBLE)"}, tolerance=1000)


AVG = {kind: f"avg(CASE WHEN event_type = '{kind}' THEN value END)" for kind in ("click", "error", "purchase")}


@register("kpi_rules", " UNION ALL ".join(
    f"""SELECT '{rule}' AS rule, CAST({want} AS DOUBLE) AS expected, round(actual, 6) AS actual,
        CASE WHEN abs(actual - {want}) <= {tol} THEN 'Passed' ELSE 'Failed' END AS result
        FROM (SELECT CAST({sql} AS DOUBLE) AS actual FROM events) x"""
    for rule, sql, want, tol in (
        ("clicks average 50", AVG["click"], 50, 10), ("errors average 1", AVG["error"], 1, 0.5),
        ("purchases in 2024", "count(CASE WHEN event_type = 'purchase' AND year(ts) = 2024 THEN 1 END)", 10, 0))))
def _(t):
    return ek.kpi_rules(t.events, [
        ek.KpiRule("clicks average 50", "avg(value)", 50, "event_type = 'click'", 10),
        ek.KpiRule("errors average 1", "avg(value)", 1, "WHERE event_type = 'error'", 0.5),
        ek.KpiRule("purchases in 2024", "count(*)", 10, "event_type = 'purchase' AND year(ts) = 2024"),
    ]).withColumn("actual", F.round("actual", 6))


# The brands a rule asks for, as the data names them, and one it does not know.
BRANDS = ["Brand#1", "Brand#2", "Brand#17", "Brand#99"]


@register("required_values", f"""
    SELECT value FROM (SELECT unnest({BRANDS}) AS value) w WHERE value NOT IN (SELECT p_brand FROM part)""")
def _(t):
    return ek.required_values(t.part, "p_brand", BRANDS)


@register("balance_check", """
    SELECT c_nationkey, CAST(d AS DOUBLE) AS debits, CAST(c AS DOUBLE) AS credits, CAST(d - c AS DOUBLE) AS difference, d = c AS balanced
    FROM (SELECT c_nationkey, COALESCE(sum(CASE WHEN a >= 0 THEN a END), 0) AS d, COALESCE(sum(CASE WHEN a < 0 THEN -a END), 0) AS c
          FROM (SELECT c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS a FROM customer) x GROUP BY 1) y""")
def _(t):
    rows = t.customer.select("c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("amount"))
    return ek.balance_check(rows, ["c_nationkey"], "amount", debit_credit(F.col("amount")))


ORPHANS = lambda name, child, fk, parent, pk: f"""
    SELECT '{name}' AS relation, count(*) AS orphan_rows, count(DISTINCT {fk}) AS orphan_keys FROM {child}
    WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})"""


@register("ref_integrity", " UNION ALL ".join([
    ORPHANS("order", "li_orphan", "l_orderkey", "orders", "o_orderkey"),
    ORPHANS("part", "li_orphan", "l_partkey", "part", "p_partkey"),
    ORPHANS("supplier", "li_orphan", "l_suppkey", "supplier", "s_suppkey")]), also="li_orphan")
def _(t):
    return ek.ref_integrity(t.li_orphan, [
        ek.Reference("order", "l_orderkey", t.orders, "o_orderkey"), ek.Reference("part", "l_partkey", t.part, "p_partkey"),
        ek.Reference("supplier", "l_suppkey", t.supplier, "s_suppkey")])


@register("orphan_keys", """
    SELECT l_orderkey AS key, count(*) AS rows FROM li_orphan WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def _(t):
    return ek.orphan_keys(t.li_orphan, ek.Reference("order", "l_orderkey", t.orders, "o_orderkey"))


# History checks
CHANGED = "ts > (SELECT max(ts) FROM events_loaded)"


@register("incremental_rows", f"""
    SELECT event_id, CAST(ts AS VARCHAR) AS ts, event_type FROM events_src WHERE {CHANGED}""", also="events_loaded")
def _(t):
    rows = ek.changed_since(t.events_src, "ts", t.events_loaded).select("event_id", "ts", "event_type")
    return rows.withColumn("ts", F.col("ts").cast("string"))


@register("incremental_check", f"""
    SELECT count(s.event_id) AS src_rows, count(s.event_id) AS src_distinct, CAST(0 AS BIGINT) AS src_duplicate,
           count(t.event_id) AS tgt_rows, count(t.event_id) AS tgt_distinct, CAST(0 AS BIGINT) AS tgt_duplicate,
           count(CASE WHEN s.event_id = t.event_id THEN 1 END) AS common,
           count(CASE WHEN s.event_id = t.event_id AND s.event_type = t.event_type THEN 1 END) AS matched,
           count(CASE WHEN s.event_id = t.event_id AND s.event_type <> t.event_type THEN 1 END) AS mismatched,
           count(CASE WHEN t.event_id IS NULL THEN 1 END) AS only_source, count(CASE WHEN s.event_id IS NULL THEN 1 END) AS only_target
    FROM (SELECT * FROM events_src WHERE {CHANGED}) s FULL JOIN (SELECT * FROM events_tgt WHERE {CHANGED}) t
      ON s.event_id = t.event_id""", also="events_src events_tgt events_loaded")
def _(t):
    return ek.incremental_check(t.events_src, t.events_tgt, ["event_id"], "ts", t.events_loaded)


# Two loads of one source: all events up to the mark, then everything; some events have no timestamp.
STAMPED = lambda name: f"(SELECT event_id, CASE WHEN event_id%73=0 THEN NULL ELSE ts END AS ts, event_type, value FROM {name})"
LOAD = lambda run, mark, src, tgt, new: f"""
    SELECT '{run}' AS run, {mark} AS mark, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M') FROM {src} m) AS next_mark,
      count(s.event_id) AS src_rows, count(t.event_id) AS tgt_rows, count(CASE WHEN s.event_id = t.event_id THEN 1 END) AS common,
      count(CASE WHEN s.event_id = t.event_id AND s.event_type = t.event_type THEN 1 END) AS matched,
      count(CASE WHEN t.event_id IS NULL THEN 1 END) AS only_source, count(CASE WHEN s.event_id IS NULL THEN 1 END) AS only_target,
      (SELECT count(*) FROM {src} u WHERE ts IS NULL) AS src_unstamped, (SELECT count(*) FROM {tgt} u WHERE ts IS NULL) AS tgt_unstamped,
      (SELECT count(*) FROM {src} u WHERE NOT ({new}) AND event_id NOT IN (SELECT event_id FROM {tgt} v)) AS src_late,
      (SELECT count(*) FROM {tgt} u WHERE NOT ({new}) AND event_id NOT IN (SELECT event_id FROM {src} v)) AS tgt_late
    FROM (SELECT * FROM {src} a WHERE {new}) s FULL JOIN (SELECT * FROM {tgt} b WHERE {new}) t ON s.event_id = t.event_id"""
FIRST = lambda name: f"(SELECT * FROM {STAMPED(name)} f WHERE ts <= (SELECT max(ts) FROM events_loaded) OR ts IS NULL)"
LAST = f"(SELECT max(ts) FROM {FIRST('events_src')} w)"
LOADS_SQL = f"""{LOAD('first', 'NULL', FIRST('events_src'), FIRST('events_tgt'), 'TRUE')}
    UNION ALL {LOAD('second', f"(SELECT strftime({LAST}, '%Y-%m-%d %H:%M'))", STAMPED('events_src'), STAMPED('events_tgt'), f'ts > {LAST}')}"""
SHOWN = ("src_rows", "tgt_rows", "common", "matched", "only_source", "only_target", "src_unstamped", "tgt_unstamped", "src_late", "tgt_late")


def loads(t, path, runs=("first", "second")):
    """Run the loads in their order; the state is what the last one left."""
    stamp = F.when(F.col("event_id") % 73 != 0, F.col("ts"))
    src, tgt = (df.select("event_id", stamp.alias("ts"), "event_type", "value") for df in (t.events_src, t.events_tgt))
    until = t.events_loaded.agg(F.max("ts").alias("until")).first().until
    first = lambda df: df.where((F.col("ts") <= F.lit(until)) | F.col("ts").isNull())
    for run in runs:
        pair = (first(src), first(tgt)) if run == "first" else (src, tgt)
        ek.incremental_state(*pair, ["event_id"], "ts", path, "events", run)
    minute = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm").alias(c)
    return ek.marks(t.spark, path).select("run", minute("mark"), minute("next_mark"), *SHOWN)


@register("incremental_state", LOADS_SQL, also="events_src events_tgt events_loaded")
def _(t):
    return loads(t, new_folder(t.spark, "marks"))


@register("incremental_unstamped", f"""
    SELECT run, src_unstamped, tgt_unstamped, src_rows + src_unstamped + src_old AS src_all FROM (
      SELECT x.*, CASE WHEN run = 'first' THEN 0 ELSE (SELECT count(*) FROM {STAMPED('events_src')} o WHERE ts <= {LAST}) END AS src_old FROM ({LOADS_SQL}) x) y
    WHERE run = 'second'""", also="events_src events_tgt events_loaded")
def _(t):
    """Every source row is new, at or below the mark, or without a timestamp; a repeated run replaces its row."""
    path = new_folder(t.spark, "marks")
    loads(t, path, ("first", "second", "second"))
    state = ek.marks(t.spark, path).where("run = 'second'")
    known = (F.col("event_id") % 73 != 0) & (F.col("ts") <= state.select(F.col("mark").cast("timestamp")).scalar())
    old = t.events_src.where(known).agg(F.count(F.lit(1))).scalar()
    return state.select("run", "src_unstamped", "tgt_unstamped", (F.col("src_rows") + F.col("src_unstamped") + old).alias("src_all"))


FAULTS = "SELECT c_custkey, count(CASE WHEN is_current = 'Y' THEN 1 END) AS current_rows FROM cust_scd2 GROUP BY 1"


@register("scd2_check", f"""
    SELECT 'one_current' AS rule, count(*) AS violations FROM ({FAULTS}) f WHERE current_rows <> 1
    UNION ALL SELECT 'start_before_end', count(*) FROM cust_scd2 WHERE eff_from > eff_to
    UNION ALL SELECT 'open_if_current', count(*) FROM cust_scd2 WHERE (is_current = 'Y') <> (eff_to = DATE '9999-12-31')""", also="cust_scd2")
def _(t):
    return ek.scd2_check(t.cust_scd2, ["c_custkey"], "eff_from", "eff_to", "is_current")


@register("scd2_current_faults", f"SELECT * FROM ({FAULTS}) f WHERE current_rows <> 1", also="cust_scd2")
def _(t):
    return ek.scd2_current_faults(t.cust_scd2, ["c_custkey"], "is_current")


CHAIN = lambda table, keys, start, end: f"""
    SELECT {keys}, CAST({start} AS VARCHAR) AS {start}, CAST({end} AS VARCHAR) AS {end}, CAST(nxt AS VARCHAR) AS next_start,
           CASE WHEN nxt > {end} + 1 THEN 'gap' ELSE 'overlap' END AS fault
    FROM (SELECT *, lead({start}) OVER (PARTITION BY {keys} ORDER BY {start}, {end}) AS nxt FROM {table}) x
    WHERE nxt <> {end} + 1"""


@register("date_chain", CHAIN("cust_scd2", "c_custkey", "eff_from", "eff_to"), also="cust_scd2")
def _(t):
    return ek.date_chain(t.cust_scd2, ["c_custkey"], "eff_from", "eff_to", ["version"])


SPANS = "(SELECT l_returnflag, CAST(l_shipdate AS DATE) AS start_dt, CAST(l_shipdate AS DATE) AS end_dt FROM lineitem)"


@register("date_chain_hot", CHAIN(SPANS, "l_returnflag", "start_dt", "end_dt"))
def _(t):
    """Three keys hold all line items: the distributed sort takes the place of three window tasks."""
    day = F.col("l_shipdate").cast("date")
    spans = t.lineitem.select("l_returnflag", day.alias("start_dt"), day.alias("end_dt"))
    return ek.date_chain(spans, ["l_returnflag"], "start_dt", "end_dt")


@register("rank_check", """
    SELECT conv_id, place, turn_no, expected, CAST(1 AS BIGINT) AS rows
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, turn_no) - 1 AS expected FROM conv_turns) x
    WHERE turn_no <> expected""")
def _(t):
    return ek.rank_check(t.conv_turns, ["conv_id"], ["place"], "turn_no", first=0)


def rank_sql(function: str, stored: str) -> str:
    return f"""
        SELECT l_orderkey, l_linenumber, {stored}, expected, count(*) AS rows
        FROM (SELECT *, {function}() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected FROM line_ranks) x
        WHERE {stored} <> expected GROUP BY 1, 2, 3, 4"""


@register("rank_check_dense", rank_sql("dense_rank", "dense_no"), also="line_ranks")
def _(t):
    return ek.rank_check(t.line_ranks, ["l_orderkey"], ["l_linenumber"], "dense_no", "dense_rank")


@register("rank_check_rank", rank_sql("rank", "rank_no"), also="line_ranks")
def _(t):
    return ek.rank_check(t.line_ranks, ["l_orderkey"], ["l_linenumber"], "rank_no", "rank")


@register("ranked_hot", """
    SELECT event_type, CAST(value AS DOUBLE) AS value, count(*) AS rows, min(r) AS rank, min(d) AS dense_rank
    FROM (SELECT event_type, value, rank() OVER w AS r, dense_rank() OVER w AS d FROM events_src
          WINDOW w AS (PARTITION BY event_type ORDER BY value)) x GROUP BY 1, 2""")
def _(t):
    return ek.ranked(t.events_src, ["event_type"], ["value"])


@register("row_sequence", """
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_id FROM documents""")
def _(t):
    return ek.sequence(t.documents.select("source", "doc_id"), ["source"], ["doc_id"])


@register("row_sequence_hot", """
    SELECT l_returnflag, l_orderkey, l_linenumber,
           row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS row_id FROM lineitem""")
def _(t):
    """Three files hold all rows; each is numbered across many tasks."""
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber")
    return ek.sequence(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber"])


# Profile
NUMERIC = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]}


def numeric_sql(table: str, cols) -> str:
    q = lambda p, c: f"quantile_disc({c}, {p})"
    metrics = {"count": "count({c})", "nulls": "count(*) - count({c})", "min": "min({c})", "max": "max({c})", "mean": "avg({c})",
               "sd": "stddev_samp({c})", "q25": q(0.25, "{c}"), "q50": q(0.5, "{c}"), "q75": q(0.75, "{c}")}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{m}' AS metric, round(CAST({sql.format(c=c)} AS DOUBLE), 4) + 0.0 AS value FROM {table}"""
        for c in cols for m, sql in metrics.items())


@register("profile_numeric", numeric_sql("lineitem", NUMERIC["lineitem"]))
def _(t):
    rows = ek.profile_numeric(t.lineitem, NUMERIC["lineitem"], exact=True)
    return rows.withColumn("value", F.round("value", 4) + 0.0)  # one sign of zero in both engines


@register("profile_quantiles_hot", """
    SELECT 'l_extendedprice' AS "column", 'q' || p AS metric, v AS value FROM (
      SELECT unnest(['1', '10', '50', '90', '99']) AS p,
             unnest(quantile_disc(l_extendedprice, [0.01, 0.1, 0.5, 0.9, 0.99])) AS v FROM lineitem) x""")
def _(t):
    """Exact quantiles by the distributed sort."""
    return quantiles(t.lineitem, ["l_extendedprice"], (0.01, 0.1, 0.5, 0.9, 0.99))


def string_sql(table: str, cols) -> str:
    metrics = {"count": "count({c})", "nulls": "count(*) - count({c})", "blanks": "count(CASE WHEN trim({c}) = '' THEN 1 END)",
               "min_length": "min(length({c}))", "max_length": "max(length({c}))", "min": "min({c})", "max": "max({c})"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{m}' AS metric, CAST({sql.format(c=c)} AS VARCHAR) AS value FROM {table}"""
        for c in cols for m, sql in metrics.items())


@register("profile_string", string_sql("orders_tgt", ["o_orderstatus", "o_orderpriority"]), also="orders_tgt")
def _(t):
    return ek.profile_string(t.orders_tgt)


TEXTS = ["c_name", "c_mktsegment"]
CELLS = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM customer" for c in TEXTS)


# The most frequent values per column: the limit is what a top-k report is.
@register("profile_topk", f"""
    SELECT col AS "column", CAST(place AS INT) AS place, value, n AS rows
    FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS place
          FROM (SELECT col, value, count(*) AS n FROM ({CELLS}) c GROUP BY 1, 2) g) x WHERE place <= 10""")
def _(t):
    return ek.profile_topk(t.customer, TEXTS)


@register("profile_pattern", f"""
    SELECT col AS "column", regexp_replace(regexp_replace(value, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS pattern, count(*) AS rows
    FROM ({CELLS}) c GROUP BY 1, 2""")
def _(t):
    return ek.profile_pattern(t.customer, TEXTS)


@register("profile_distinct", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM lineitem"""
    for c in NUMERIC["lineitem"] + ["l_returnflag", "l_linestatus", "l_shipdate"]))
def _(t):
    return ek.profile_distinct(t.lineitem, exact=True)


# Suites and run results
def pairs(t) -> list[ek.Case]:
    return [
        ek.Case("drift", "o_orderkey", t.orders_src, t.orders_tgt),
        ek.Case("same", " o_orderkey ", t.orders_src, t.orders_src, execute=True),
        ek.Case("skipped", "o_orderkey", t.orders_src, t.orders_tgt, execute="N"),
        ek.Case("broken", "no_such_column", t.orders_src, t.orders_tgt),
    ]


CASES_SQL = """
    SELECT 'drift' AS testcase_name, 'duplicate' AS testcase_type, CASE WHEN sd = tr AND tr = td THEN 'Passed' ELSE 'Failed' END AS test_result, sr AS src_rows, tr AS tgt_rows
    FROM (SELECT (SELECT count(DISTINCT o_orderkey) FROM orders_src) AS sd, (SELECT count(*) FROM orders_src) AS sr,
                 (SELECT count(DISTINCT o_orderkey) FROM orders_tgt) AS td, (SELECT count(*) FROM orders_tgt) AS tr) x
    UNION ALL SELECT 'same', 'duplicate', 'Passed', count(*), count(*) FROM orders_src
    UNION ALL SELECT 'broken', 'duplicate', 'Errored', NULL, NULL"""


@register("suite_run", CASES_SQL, also="orders_src orders_tgt")
def _(t):
    return ek.run_suite(t.spark, pairs(t), "duplicate").select(
        "testcase_name", "testcase_type", "test_result", "src_rows", "tgt_rows")


@register("suite_history_trend", f"""
    SELECT count(*) AS total, count(CASE WHEN test_result = 'Failed' THEN 1 END) AS failed,
           count(CASE WHEN test_result = 'Passed' THEN 1 END) AS passed,
           round(count(CASE WHEN test_result = 'Passed' THEN 1 END) / count(*), 4) AS pass_rate
    FROM ({CASES_SQL}) x""", also="orders_src orders_tgt")
def _(t):
    """A run of a suite, appended to a new history and reported as its only run."""
    path = new_folder(t.spark, "history")
    append_history(ek.run_suite(t.spark, pairs(t), "duplicate"), path)
    return ek.trend(read_table(t.spark, HISTORY, path)).drop("run_created_time")


@register("suite_details", """
    SELECT 'drift' AS testcase_name, kind, count(*) AS n FROM (
        SELECT DISTINCT 'only_source' AS kind, o_orderkey FROM orders_src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_tgt)
        UNION SELECT 'only_target', o_orderkey FROM orders_tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_src)
    ) x GROUP BY kind""", also="orders_src orders_tgt")
def _(t):
    """Details of a content case; the limit is large enough for every key that is on one side only."""
    case = ek.Case("drift", "o_orderkey", t.orders_src, t.orders_tgt, limit=2_000_000_000)
    found = ek.suite_details(t.spark, [case]).where(F.col("kind").isin("only_source", "only_target"))
    return found.groupBy("testcase_name", "kind").agg(F.countDistinct("key_columns").alias("n"))


@register("suite_totals", """
    SELECT count(*) AS cases, count(CASE WHEN test_result = 'Passed' THEN 1 END) AS passed,
           count(CASE WHEN test_result = 'Failed' THEN 1 END) AS failed, count(CASE WHEN test_result = 'Errored' THEN 1 END) AS errored
    FROM history""")
def _(t):
    return ek.suite_totals(t.history)


# The latest 40 runs: the limit is what the trend report is.
@register("trend_by_run", """
    SELECT run_created_time, count(*) AS total, count(CASE WHEN test_result = 'Failed' THEN 1 END) AS failed,
           count(CASE WHEN test_result = 'Passed' THEN 1 END) AS passed,
           round(count(CASE WHEN test_result = 'Passed' THEN 1 END) / count(*), 4) AS pass_rate
    FROM history GROUP BY 1 ORDER BY max(db_stored_time) DESC, run_created_time DESC LIMIT 40""")
def _(t):
    return ek.trend(t.history)


@register("outcome_by_type", "SELECT testcase_type, test_result, count(*) AS cases FROM history GROUP BY 1, 2")
def _(t):
    return ek.outcome_by_type(t.history)


@register("outcome_counts", """
    SELECT test_result, count(*) AS cases FROM history WHERE run_created_time = '2024-01-02 10' GROUP BY 1""")
def _(t):
    return ek.outcome_counts(t.history, "2024-01-02 10")


SECONDS = """(SELECT testcase_name, CAST(split_part(runtime, ':', 1) AS INT) * 3600 + CAST(split_part(runtime, ':', 2) AS INT) * 60
              + CAST(split_part(runtime, ':', 3) AS INT) AS sec FROM history WHERE runtime <> '')"""
BUCKET = "CASE WHEN sec < 45 THEN '0s-45s' WHEN sec < 120 THEN '45s-2m' WHEN sec < 300 THEN '2m-5m' ELSE '5m+' END"


@register("runtime_buckets", f"""
    SELECT {BUCKET} AS bucket, count(*) AS runs, count(DISTINCT testcase_name) AS cases FROM {SECONDS} x GROUP BY 1""", also="history")
def _(t):
    return ek.runtime_buckets(t.history)


@register("runtime_unknown", """
    SELECT CASE WHEN event_id % 31 = 0 THEN 'unknown' WHEN event_id % 29 = 0 THEN NULL ELSE '2m-5m' END AS bucket,
           count(*) AS runs, count(DISTINCT user_id) AS cases FROM events WHERE event_id % 31 = 0 OR event_id % 29 <> 0 GROUP BY 1""")
def _(t):
    """Texts that are no runtime have a bucket of their own; blank ones have none."""
    text = F.when(F.col("event_id") % 31 == 0, F.when(F.col("event_id") % 2 == 0, "soon").otherwise("1:2:3:4"))
    text = text.when(F.col("event_id") % 29 == 0, " ").otherwise("0:03:00.5")
    return ek.runtime_buckets(t.events.select(text.alias("runtime"), F.col("user_id").cast("string").alias("testcase_name")))


@register("runtime_members", f"SELECT {BUCKET} AS bucket, testcase_name, count(*) AS runs FROM {SECONDS} x GROUP BY 1, 2", also="history")
def _(t):
    return ek.runtime_members(t.history)


@register("failed_first", """
    SELECT testcase_name, test_result, reason, run_created_time FROM history ORDER BY test_result, reason, testcase_name""")
def _(t):
    return ek.failed_first(t.history.select("testcase_name", "test_result", "reason", "run_created_time"))
