"""Reconciliation, verdicts, fingerprint, keys and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

import evenkeel as ek
from evenkeel.operators.reconcile import Pair

from .registry import register

KEY = ["o_orderkey"]
COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders(t, **more) -> Pair:
    return Pair(t.orders_src, t.orders_tgt, KEY, **more)


# The SQL joins the pair once; `eq` is NULL-safe equality per column.
EQ = {c: f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in COLS}
ALL_EQ = " AND ".join(EQ.values())
INNER = "FROM orders_src s JOIN orders_tgt t ON s.o_orderkey = t.o_orderkey"
FULL = "FROM orders_src s FULL JOIN orders_tgt t ON s.o_orderkey = t.o_orderkey"


def out(alias: str, c: str) -> str:
    if c == "o_totalprice":
        return f"CAST({alias}.{c} AS DOUBLE)"
    return f"CAST({alias}.{c} AS VARCHAR)" if c == "o_orderdate" else f"{alias}.{c}"


def text(alias: str, c: str) -> str:
    return f"CAST({alias}.{c} AS VARCHAR)"


VALUES = ", ".join(f"{out('s', c)} AS src_{c}, {out('t', c)} AS tgt_{c}, {EQ[c]} AS eq_{c}" for c in COLS)
SIDE = lambda a: ", ".join(f"{out(a, c)} AS {c}" for c in COLS)


@register("recon_rows", f"""
    SELECT COALESCE(s.o_orderkey, t.o_orderkey) AS o_orderkey, CAST(1 AS BIGINT) AS occurrence,
           CASE WHEN t.o_orderkey IS NULL THEN 'source_only' WHEN s.o_orderkey IS NULL THEN 'target_only' ELSE 'both' END AS status,
           (s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL AND {ALL_EQ}) AS matched,
           {", ".join(f"{out('s', c)} AS src_{c}, {out('t', c)} AS tgt_{c}" for c in COLS)}
    {FULL}""")
def _(t):
    rows = ek.reconcile(orders(t))
    return rows.select(*[c for c in rows.columns if not c.startswith("eq_")])


@register("recon_counts", f"""
    SELECT count(s.o_orderkey) AS src_rows, count(t.o_orderkey) AS tgt_rows,
           count(DISTINCT s.o_orderkey) AS src_distinct, count(DISTINCT t.o_orderkey) AS tgt_distinct,
           count(s.o_orderkey) - count(DISTINCT s.o_orderkey) AS src_duplicate,
           count(t.o_orderkey) - count(DISTINCT t.o_orderkey) AS tgt_duplicate,
           count(CASE WHEN s.o_orderkey = t.o_orderkey THEN 1 END) AS common,
           count(CASE WHEN s.o_orderkey = t.o_orderkey AND {ALL_EQ} THEN 1 END) AS matched,
           count(CASE WHEN s.o_orderkey = t.o_orderkey AND NOT ({ALL_EQ}) THEN 1 END) AS mismatched,
           count(CASE WHEN t.o_orderkey IS NULL THEN 1 END) AS only_source,
           count(CASE WHEN s.o_orderkey IS NULL THEN 1 END) AS only_target
    {FULL}""")
def _(t):
    return ek.counts(ek.reconcile(orders(t)))


@register("rows_only_source", f"""
    SELECT s.o_orderkey, CAST(1 AS BIGINT) AS occurrence, {SIDE('s')} FROM orders_src s
    WHERE NOT EXISTS (SELECT 1 FROM orders_tgt t WHERE t.o_orderkey = s.o_orderkey)""", also="orders_tgt")
def _(t):
    return ek.only_source(orders(t))


@register("rows_only_target", f"""
    SELECT t.o_orderkey, CAST(1 AS BIGINT) AS occurrence, {SIDE('t')} FROM orders_tgt t
    WHERE NOT EXISTS (SELECT 1 FROM orders_src s WHERE t.o_orderkey = s.o_orderkey)""", also="orders_src")
def _(t):
    return ek.only_target(orders(t))


@register("rows_mismatch", f"""
    SELECT s.o_orderkey, CAST(1 AS BIGINT) AS occurrence, FALSE AS matched, {VALUES} {INNER} WHERE NOT ({ALL_EQ})""")
def _(t):
    return ek.mismatched_rows(orders(t))


@register("rows_match", f"""
    SELECT s.o_orderkey, CAST(1 AS BIGINT) AS occurrence, TRUE AS matched, {VALUES} {INNER} WHERE {ALL_EQ}""")
def _(t):
    return ek.matched_rows(orders(t))


SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows_common, count(CASE WHEN {EQ[c]} THEN 1 END) AS rows_matched,
        count(CASE WHEN NOT ({EQ[c]}) THEN 1 END) AS rows_mismatched {INNER}""" for c in COLS)


@register("column_match_summary", f"SELECT * FROM ({SUMMARY}) x WHERE rows_mismatched > 0", also="orders_src orders_tgt")
def column_match_summary(t):
    return ek.column_summary(ek.reconcile(orders(t)))


DETAIL = " UNION ALL ".join(
    f"""SELECT DISTINCT '{c}' AS "column", 'o_orderkey=' || {text('s', 'o_orderkey')} AS key_columns,
        {text('s', c)} AS source_value, {text('t', c)} AS target_value {INNER} WHERE NOT ({EQ[c]})""" for c in COLS)


@register("column_match_details", f"""
    SELECT "column", key_columns, source_value, target_value FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY key_columns, source_value NULLS FIRST, target_value NULLS FIRST) AS rn
      FROM ({DETAIL}) d) x WHERE rn <= 10""", also="orders_src orders_tgt")
def _(t):
    return ek.column_details(ek.common_rows(orders(t)), KEY, 10)


@register("column_match_all_details", f"SELECT * FROM ({DETAIL}) d", also="orders_src orders_tgt")
def _(t):
    return ek.column_details(ek.common_rows(orders(t)), KEY, None)


@register("sample_mismatch", f"""
    SELECT 'o_orderkey=' || CAST(k AS VARCHAR) AS key_columns
    FROM (SELECT s.o_orderkey AS k {INNER} WHERE NOT ({ALL_EQ}) ORDER BY k LIMIT 10) x""", also="orders_src orders_tgt")
def _(t):
    return ek.sample_keys(ek.mismatched_rows(orders(t)), KEY, 10)


@register("key_text", """
    SELECT l_partkey, l_suppkey, 'l_partkey=' || CAST(l_partkey AS VARCHAR) || ', l_suppkey= ' || CAST(l_suppkey AS VARCHAR) AS key_columns
    FROM lineitem""")
def _(t):
    from evenkeel.functions import key_text

    return t.lineitem.select("l_partkey", "l_suppkey", key_text(["l_partkey", "l_suppkey"]).alias("key_columns"))


# Repeated keys: the n-th copy of a key on one side meets the n-th on the other.
def numbered(name: str, key: str, cols: list[str]) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in cols)
    return f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS occ FROM {name})"


DUP = f"{numbered('orders_src', KEY[0], COLS)} s FULL JOIN {numbered('orders_dup', KEY[0], COLS)} t ON s.o_orderkey = t.o_orderkey AND s.occ = t.occ"


@register("recon_dup_keys", f"""
    SELECT count(CASE WHEN s.occ = t.occ THEN 1 END) AS common,
           count(CASE WHEN s.occ = t.occ AND {ALL_EQ} THEN 1 END) AS matched,
           count(CASE WHEN t.occ IS NULL THEN 1 END) AS only_source, count(CASE WHEN s.occ IS NULL THEN 1 END) AS only_target
    FROM {DUP}""", also="orders_src orders_dup")
def _(t):
    return ek.counts(ek.reconcile(Pair(t.orders_src, t.orders_dup, KEY))).select(
        "common", "matched", "only_source", "only_target")


HOT_COLS = ["l_returnflag", "l_linenumber", "l_quantity"]
HOT_EQ = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in HOT_COLS)


@register("recon_hot_key", f"""
    SELECT count(s.occ) AS src_rows, count(t.occ) AS tgt_rows, count(CASE WHEN s.occ = 1 THEN 1 END) AS src_distinct,
           count(CASE WHEN t.occ = 1 THEN 1 END) AS tgt_distinct, count(CASE WHEN s.occ > 1 THEN 1 END) AS src_duplicate,
           count(CASE WHEN t.occ > 1 THEN 1 END) AS tgt_duplicate, count(CASE WHEN s.occ = t.occ THEN 1 END) AS common,
           count(CASE WHEN s.occ = t.occ AND {HOT_EQ} THEN 1 END) AS matched,
           count(CASE WHEN s.occ = t.occ AND NOT ({HOT_EQ}) THEN 1 END) AS mismatched,
           count(CASE WHEN t.occ IS NULL THEN 1 END) AS only_source, count(CASE WHEN s.occ IS NULL THEN 1 END) AS only_target
    FROM {numbered('li_hot_src', 'ref', HOT_COLS)} s FULL JOIN {numbered('li_hot_tgt', 'ref', HOT_COLS)} t
      ON s.ref = t.ref AND s.occ = t.occ""", also="li_hot_src li_hot_tgt")
def _(t):
    """One key holds a third of the rows: numbered by the distributed sort instead of one window task."""
    return ek.counts(ek.reconcile(Pair(t.li_hot_src, t.li_hot_tgt, ["ref"])))


# Verdicts
VERDICT = lambda test, ok, good, bad: (
    f"'{test}' AS test, CASE WHEN {ok} THEN 'Passed' ELSE 'Failed' END AS result, "
    f"CASE WHEN {ok} THEN '{good}' ELSE '{bad}' END AS reason")
N = lambda table: f"(SELECT count(*) FROM {table})"
D = lambda table, key="o_orderkey": f"(SELECT count(DISTINCT {key}) FROM {table})"


@register("test_count", f"""
    SELECT {VERDICT('count', 'src_rows = tgt_rows', 'Count matched', 'Count mismatched')}, src_rows, tgt_rows
    FROM (SELECT {N('orders_src')} AS src_rows, {N('orders_tgt')} AS tgt_rows) x""", also="orders_src orders_tgt")
def _(t):
    return ek.test_count(t.orders_src, t.orders_tgt)


DUP_SQL = lambda s, g: f"""
    SELECT {VERDICT('duplicate', 'src_distinct = tgt_rows AND tgt_rows = tgt_distinct', 'No Duplicates', 'Duplicates')},
           src_rows, src_distinct, src_rows - src_distinct AS src_duplicate,
           tgt_rows, tgt_distinct, tgt_rows - tgt_distinct AS tgt_duplicate
    FROM (SELECT {N(s)} AS src_rows, {D(s)} AS src_distinct, {N(g)} AS tgt_rows, {D(g)} AS tgt_distinct) x"""


@register("test_duplicate", DUP_SQL("orders_src", "orders_dup"), also="orders_src orders_dup")
def _(t):
    return ek.test_duplicate(t.orders_src, t.orders_dup, KEY)


def nulls_sql(table: str, cols, prefix="") -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS {prefix}column, count(*) - count({c}) AS {prefix}nulls FROM {table}"
        for i, c in enumerate(cols)).replace(f" AS {prefix}column", f' AS "{prefix}column"')


ALL = KEY + COLS
NULL_JOIN = f"({nulls_sql('orders_src', ALL, 'src_')}) a JOIN ({nulls_sql('orders_tgt', ALL, 'tgt_')}) b USING (position)"


@register("null_counts", nulls_sql("orders_tgt", ALL))
def _(t):
    return ek.null_counts(t.orders_tgt)


@register("null_compare", f"SELECT * FROM {NULL_JOIN}", also="orders_src orders_tgt")
def _(t):
    return ek.null_compare(t.orders_src, t.orders_tgt)


@register("test_null", f"""
    SELECT {VERDICT('null', 'mismatched = 0', 'Nulls are matching for each column', 'Nulls are not matching for each column')},
           src_null_columns, tgt_null_columns, matched, mismatched
    FROM (SELECT count(CASE WHEN src_nulls > 0 THEN 1 END) AS src_null_columns,
                 count(CASE WHEN tgt_nulls > 0 THEN 1 END) AS tgt_null_columns,
                 count(CASE WHEN src_nulls = tgt_nulls AND src_nulls > 0 THEN 1 END) AS matched,
                 count(CASE WHEN src_nulls <> tgt_nulls THEN 1 END) AS mismatched FROM {NULL_JOIN}) x""",
          also="orders_src orders_tgt")
def _(t):
    return ek.test_null(t.orders_src, t.orders_tgt)


def content_sql(src: str, tgt: str) -> str:
    return f"""
    SELECT {VERDICT('content', 'mismatched = 0 AND only_source = 0 AND only_target = 0', 'Content matched', 'Content mismatched')},
           CAST(6 AS BIGINT) AS matched_columns, CAST(6 AS BIGINT) AS compared_columns,
           CAST(0 AS BIGINT) AS src_only_columns, CAST(0 AS BIGINT) AS tgt_only_columns, x.*
    FROM (SELECT count(s.occ) AS src_rows, count(CASE WHEN s.occ = 1 THEN 1 END) AS src_distinct,
                 count(CASE WHEN s.occ > 1 THEN 1 END) AS src_duplicate, count(t.occ) AS tgt_rows,
                 count(CASE WHEN t.occ = 1 THEN 1 END) AS tgt_distinct, count(CASE WHEN t.occ > 1 THEN 1 END) AS tgt_duplicate,
                 count(CASE WHEN s.occ = t.occ AND {ALL_EQ} THEN 1 END) AS matched,
                 count(CASE WHEN s.occ = t.occ AND NOT ({ALL_EQ}) THEN 1 END) AS mismatched,
                 count(CASE WHEN t.occ IS NULL THEN 1 END) AS only_source, count(CASE WHEN s.occ IS NULL THEN 1 END) AS only_target
          FROM {numbered(src, KEY[0], COLS)} s FULL JOIN {numbered(tgt, KEY[0], COLS)} t
            ON s.o_orderkey = t.o_orderkey AND s.occ = t.occ) x"""


@register("test_content", content_sql("orders_src", "orders_tgt"), also="orders_src orders_tgt")
def _(t):
    return ek.test_content(orders(t))


@register("test_content_dup", content_sql("orders_src", "orders_dup"), also="orders_src orders_dup")
def _(t):
    return ek.test_content(Pair(t.orders_src, t.orders_dup, KEY))


@register("regression_compare", content_sql("orders_src", "orders_src"), also="orders_src")
def _(t):
    """The same object before and after a change that should not touch it."""
    return ek.test_content(Pair(t.orders_src, t.orders_src, KEY))


# The reports of a content case, all from one stored set of differing rows
@register("report_verdict", content_sql("orders_src", "orders_dup"), also="orders_src orders_dup")
def _(t):
    return ek.content_report(Pair(t.orders_src, t.orders_dup, KEY)).verdict


@register("report_columns", f"SELECT * FROM ({SUMMARY}) x WHERE rows_mismatched > 0", also="orders_src orders_tgt")
def _(t):
    return ek.content_report(orders(t)).columns


KEYS_OF = lambda side, other: f"""SELECT 'o_orderkey=' || CAST(o_orderkey AS VARCHAR) AS key_columns FROM (
    SELECT o_orderkey FROM {side} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {other}) ORDER BY 1 LIMIT 10) x"""


@register("report_one_sided_keys", f"""
    SELECT 'source' AS side, * FROM ({KEYS_OF('orders_src', 'orders_tgt')}) a
    UNION ALL SELECT 'target', * FROM ({KEYS_OF('orders_tgt', 'orders_src')}) b""", also="orders_src orders_tgt")
def _(t):
    report = ek.content_report(orders(t))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "key_columns")
    return side(report.only_source_keys, "source").unionByName(side(report.only_target_keys, "target"))


# Fingerprint: one row per KPI
HASH = "md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in ALL) + "))"
ROWS = f"{N('orders_src')} AS src_rows, {N('orders_tgt')} AS tgt_rows"
EMPTY = lambda table: " + ".join(
    f"(CASE WHEN EXISTS (SELECT 1 FROM {table} WHERE trim({c}) = '') THEN 1 ELSE 0 END)" for c in ("o_orderstatus", "o_orderpriority"))
NULLC = lambda table: f"(SELECT count(CASE WHEN n > 0 THEN 1 END) FROM (SELECT nulls AS n FROM ({nulls_sql(table, ALL)}) u) v)"
ALLNULL = lambda table: f"(SELECT count(*) FROM {table} WHERE " + " AND ".join(f"{c} IS NULL" for c in ALL) + ")"
ONLY = lambda a, b: f"(SELECT count(*) FROM (SELECT {HASH} AS h FROM {a} EXCEPT SELECT {HASH} FROM {b}) e)"
DUPROWS = lambda a: f"(SELECT count(*) - count(DISTINCT {HASH}) FROM {a})"
DUPKEYS = lambda a: f"(SELECT count(*) - count(DISTINCT o_orderkey) FROM {a})"
KPI = {
    "row_count": (N("orders_src"), N("orders_tgt"), "s = t", "Row counts match", "Row counts differ"),
    "column_count": ("6", "6", "s = t", "Column counts match", "Column counts differ"),
    "null_columns": (NULLC("orders_src"), NULLC("orders_tgt"), "s = t", "Equally many columns hold nulls",
                     "The number of columns with nulls differs"),
    "null_rows": (ALLNULL("orders_src"), ALLNULL("orders_tgt"), "s = 0 AND t = 0", "No row is entirely null",
                  "Some rows are entirely null"),
    "empty_columns": (f"({EMPTY('orders_src')})", f"({EMPTY('orders_tgt')})", "s = 0 AND t = 0",
                      "No column has blank values", "Some columns have blank values"),
    "duplicate_rows": (DUPROWS("orders_src"), DUPROWS("orders_tgt"), "s = 0 AND t = 0", "No row is repeated",
                       "Some rows are repeated"),
    "duplicate_keys": (DUPKEYS("orders_src"), DUPKEYS("orders_tgt"), "s = 0 AND t = 0", "No key is repeated",
                       "Some keys are repeated"),
    "checksum": (ONLY("orders_src", "orders_tgt"), ONLY("orders_tgt", "orders_src"), "s = 0 AND t = 0",
                 "All row checksums match", "Some row checksums have no match"),
}


def kpi_sql(name: str) -> str:
    s, t, ok, good, bad = KPI[name]
    return f"""SELECT '{name}' AS kpi, src_rows, tgt_rows, s AS src_value, t AS tgt_value,
        CASE WHEN {ok} THEN 'Passed' ELSE 'Failed' END AS result, CASE WHEN {ok} THEN '{good}' ELSE '{bad}' END AS reason
        FROM (SELECT {ROWS}, CAST({s} AS BIGINT) AS s, CAST({t} AS BIGINT) AS t) x"""


for _name, _kpi in (("fp_row_count", "row_count"), ("fp_col_count", "column_count"), ("fp_null_cols", "null_columns"),
                    ("fp_null_rows", "null_rows"), ("fp_empty_cols", "empty_columns"), ("fp_dup_rows", "duplicate_rows"),
                    ("fp_dup_keys", "duplicate_keys"), ("fp_hash_diff", "checksum")):
    register(_name, kpi_sql(_kpi), also="orders_src orders_tgt")(
        lambda t, kpi=_kpi: ek.fingerprint(t.orders_src, t.orders_tgt, KEY, [kpi]))

ALL_KPIS = " UNION ALL ".join(kpi_sql(k) for k in KPI)


@register("fingerprint_kpis", ALL_KPIS, also="orders_src orders_tgt")
def _(t):
    return ek.fingerprint(t.orders_src, t.orders_tgt, KEY)


@register("test_fingerprint", f"""
    SELECT {VERDICT('fingerprint', 'kpis_failed = 0', 'Fingerprint matched', 'One or more fingerprints mismatched')},
           kpis, kpis_passed, kpis_failed, src_rows, tgt_rows
    FROM (SELECT count(*) AS kpis, count(CASE WHEN result = 'Passed' THEN 1 END) AS kpis_passed,
                 count(CASE WHEN result = 'Failed' THEN 1 END) AS kpis_failed, max(src_rows) AS src_rows,
                 max(tgt_rows) AS tgt_rows FROM ({ALL_KPIS}) k) x""", also="orders_src orders_tgt")
def _(t):
    return ek.test_fingerprint(t.orders_src, t.orders_tgt, KEY)


@register("empty_counts", " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", count(CASE WHEN trim(CAST({c} AS VARCHAR)) = '' THEN 1 END) AS blanks FROM orders_src"""
    for i, c in enumerate(ALL)))
def _(t):
    return ek.empty_counts(t.orders_src)


@register("null_rows", """
    SELECT o_orderstatus, o_orderpriority FROM orders_tgt WHERE o_orderstatus IS NULL AND o_orderpriority IS NULL""")
def _(t):
    return ek.null_rows(t.orders_tgt.select("o_orderstatus", "o_orderpriority"))


@register("row_hash", f"SELECT o_orderkey, {HASH} AS row_hash FROM orders_tgt")
def _(t):
    df = t.orders_tgt
    return df.select("o_orderkey", ek.row_hash(df).alias("row_hash"))


@register("row_hash_marked", "SELECT o_orderkey, md5(concat_ws('|', " + ", ".join(
    f"COALESCE(regexp_replace(CAST({c} AS VARCHAR), '([\\\\|])', '\\\\\\1', 'g'), '\\N')" for c in ALL) + ")) AS row_hash FROM orders_tgt")
def _(t):
    df = t.orders_tgt
    return df.select("o_orderkey", ek.row_hash(df, nulls="mark").alias("row_hash"))


@register("hash_diff_rows", f"""
    SELECT h AS row_hash, 'source' AS side FROM (SELECT {HASH} AS h FROM orders_src EXCEPT SELECT {HASH} FROM orders_tgt) a
    UNION ALL SELECT h, 'target' FROM (SELECT {HASH} AS h FROM orders_tgt EXCEPT SELECT {HASH} FROM orders_src) b""")
def _(t):
    return ek.hash_diff(t.orders_src, t.orders_tgt)


MARKED = lambda cols: "md5(concat_ws('|', " + ", ".join(
    f"COALESCE(regexp_replace(CAST({c} AS VARCHAR), '([\\\\|])', '\\\\\\1', 'g'), '\\N')" for c in cols) + "))"
RANGES = lambda table: f"SELECT substr({MARKED(['o_orderkey'])}, 1, 3) AS r, {MARKED(ALL)} AS h FROM {table}"
CHECKSUM = " || ".join(f"lpad(lower(to_hex((COALESCE(sum(CAST('0x' || substr({{0}}, {1 + 8 * i}, 8) AS BIGINT)), 0) % 4294967296)::BIGINT)), 8, '0')" for i in range(4))


@register("checksum_ranges", f"""
    SELECT level, r AS range, count(s) AS src_rows, count(t) AS tgt_rows, {CHECKSUM.format('s')} AS src_checksum, {CHECKSUM.format('t')} AS tgt_checksum
    FROM (SELECT CAST(level AS INT) AS level, substr(r, 1, level) AS r, s, t
          FROM (SELECT r, h AS s, NULL AS t FROM ({RANGES('orders_src')}) a UNION ALL SELECT r, NULL, h FROM ({RANGES('orders_tgt')}) b) x,
               (SELECT unnest([0, 1, 2, 3]) AS level) l) y
    GROUP BY level, r HAVING src_rows <> tgt_rows OR src_checksum <> tgt_checksum""", also="orders_src orders_tgt")
def _(t):
    return ek.checksum_ranges(t.orders_src, t.orders_tgt, KEY)


@register("checksum_rows", f"""
    SELECT o_orderkey, h AS row_hash, CASE WHEN sum(n) > 0 THEN 'source' ELSE 'target' END AS side, abs(sum(n))::BIGINT AS copies
    FROM (SELECT o_orderkey, {MARKED(ALL)} AS h, 1 AS n FROM orders_src UNION ALL SELECT o_orderkey, {MARKED(ALL)}, -1 FROM orders_dup) x
    GROUP BY 1, 2 HAVING sum(n) <> 0""", also="orders_src orders_dup")
def _(t):
    return ek.checksum_rows(t.orders_src, t.orders_dup, KEY)


@register("dup_key_values", """
    SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(t):
    return ek.dup_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@register("dup_key_sample", """
    SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    ORDER BY l_orderkey, l_linenumber LIMIT 10""")
def _(t):
    return ek.dup_keys(t.lineitem, ["l_orderkey", "l_linenumber"], 10)


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_CELLS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM part" for i, c in enumerate(PART))


@register("dup_columns", f"""
    SELECT position, col AS "column", sum(n)::BIGINT AS rows, count(*) AS distinct_values, count(*) < sum(n) AS has_duplicates
    FROM (SELECT position, col, value, count(*) AS n FROM ({PART_CELLS}) c GROUP BY 1, 2, 3) g GROUP BY 1, 2""")
def _(t):
    return ek.dup_columns(t.part)


@register("dup_values", f"""
    SELECT position, col AS "column", value, count(*) AS rows FROM ({PART_CELLS}) c GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(t):
    return ek.dup_values(t.part)


@register("dup_value_lists", f"""
    SELECT position, col AS "column", string_agg(value, '|' ORDER BY value) AS duplicate_values
    FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY value) AS rn
          FROM (SELECT position, col, value FROM ({PART_CELLS}) c GROUP BY 1, 2, 3 HAVING count(*) > 1) g) r
    WHERE rn <= 50 GROUP BY 1, 2""")
def _(t):
    return ek.dup_value_lists(t.part)


ROW = ", ".join(out("x", c) + f" AS {c}" for c in ALL)


@register("symmetric_diff", f"""
    SELECT {ROW}, 'source' AS side, count(*) AS copies FROM (SELECT * FROM orders_src EXCEPT ALL SELECT * FROM orders_dup) x GROUP BY ALL
    UNION ALL
    SELECT {ROW}, 'target', count(*) FROM (SELECT * FROM orders_dup EXCEPT ALL SELECT * FROM orders_src) x GROUP BY ALL""")
def _(t):
    return ek.symmetric_diff(t.orders_src, t.orders_dup)


@register("distinct_keys", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return ek.distinct_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@register("source_except_target", f"""
    SELECT {ROW}, 'source' AS side FROM (SELECT * FROM orders_src EXCEPT SELECT * FROM orders_tgt) x
    UNION ALL SELECT {ROW}, 'target' AS side FROM (SELECT * FROM orders_tgt EXCEPT SELECT * FROM orders_src) x""")
def _(t):
    return ek.data_check(t.orders_src, t.orders_tgt)
