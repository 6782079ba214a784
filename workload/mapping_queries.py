"""Sources, projections, mappings, lookups, scalar functions, ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import evenkeel as ek
from evenkeel.frames import new_folder
from evenkeel.functions import blank_to, date_text_ok, debit_credit, full_name, two_decimals
from evenkeel.operators.mapping import HARDCODED, DERIVED, MappingRow, SOURCE_TO_STAGE, STAGE_TO_TARGET
from evenkeel.sources import HISTORY, RUN_DETAIL, RUN_SUMMARY, append_history, export_samples, read_table, write_run_table

from .registry import register

DAY = lambda c: f"CAST(CAST({c} AS DATE) AS VARCHAR)"
ORDER_ROW = ("o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, "
             "CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority")


def file(t, name: str, **more) -> ek.SourceSpec:
    return ek.SourceSpec("local", "parquet", path=f"{t.sf_dir}/{name}.parquet", alias=f"raw{name}", **more)


# Sources and sinks
@register("scan_parquet", f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus, {DAY('l_shipdate')} AS l_shipdate FROM lineitem""")
def _(t):
    return ek.read_source(t.spark, file(t, "lineitem")).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@register("csv_roundtrip", f"SELECT {ORDER_ROW} FROM orders_src")
def _(t):
    path = new_folder(t.spark, "csv")
    rows = t.orders_src
    (rows.write.option("header", True).option("sep", "|").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return ek.read_source(t.spark, ek.SourceSpec("local", "delimited", path=path, schema=schema, delimiter="|"))


@register("json_roundtrip", """
    SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, u.tag AS tags
    FROM events, (SELECT unnest([1, 2]) AS tag) u""")
def _(t):
    """Nested rows written as JSON lines; read back with inferred schema, structs flattened and arrays exploded."""
    path = new_folder(t.spark, "json")
    nested = t.nested_events.select(
        "event_id", "event_type", "user_id", F.from_json("props", "k bigint").alias("props"),
        F.array(F.lit(1), F.lit(2)).alias("tags"),
    )
    nested.write.json(path)
    rows = ek.read_source(t.spark, ek.SourceSpec("local", "json", path=path))
    return rows.withColumn("tags", F.col("tags").cast("int"))


@register("scan_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    """Read by table name through the catalog."""
    t.customer.createOrReplaceTempView("evenkeel_scan_table_customer")
    return ek.read_source(t.spark, ek.SourceSpec("databricks", "delta", table="evenkeel_scan_table_customer"))


@register("manual_sql", "SELECT c_custkey AS id, upper(c_name) AS name, c_mktsegment AS segment FROM customer")
def _(t):
    sql = "SELECT src.c_custkey AS id, upper(src.c_name) AS name, src.c_mktsegment AS segment FROM rawcustomer src"
    return ek.read_source(t.spark, file(t, "customer", query=sql))


# The first rows of each side: the limit is what a sample export is.
SAMPLE = f"SELECT * FROM (SELECT {{side}} AS side, {ORDER_ROW} FROM {{name}} ORDER BY o_orderkey LIMIT 100) x"


@register("sample_export", SAMPLE.format(side="'source'", name="orders_src") + " UNION ALL "
          + SAMPLE.format(side="'target'", name="orders_tgt"), also="orders_src orders_tgt")
def _(t):
    paths = export_samples(t.orders_src, t.orders_tgt, ["o_orderkey"], new_folder(t.spark, "samples"))
    read = lambda side: t.spark.read.parquet(paths[side]).select(F.lit(side).alias("side"), "*")
    return read("source").unionByName(read("target"))


HISTORY_COLUMNS = ("testcase_name, test_result, runtime, testcase_type, run_created_time, protocol_start_time, "
                   "protocol_end_time, protocol_total_run_time, db_stored_time")


@register("results_history", f"SELECT {HISTORY_COLUMNS} FROM history")
def _(t):
    """Two appends to the history, read back as one table."""
    path = new_folder(t.spark, "history")
    append_history(t.history.where("test_result = 'Failed'"), path)
    append_history(t.history.where("test_result <> 'Failed'"), path)
    return read_table(t.spark, HISTORY, path)


@register("run_summary", """
    SELECT run_created_time AS Test_Protocol_Run_ID, testcase_type AS Testcase_Type, count(*)::INT AS Total_No_of_Test_Cases,
           count(CASE WHEN test_result = 'Failed' THEN 1 END)::INT AS No_of_Test_Cases_Failed,
           count(CASE WHEN test_result = 'Passed' THEN 1 END)::INT AS No_of_Test_Cases_Passed
    FROM history GROUP BY run_created_time, testcase_type""")
def _(t):
    path = new_folder(t.spark, "run_summary")
    runs = t.history.groupBy(F.col("run_created_time").alias("Test_Protocol_Run_ID"), "testcase_type").agg(
        F.count(F.lit(1)).alias("Total_No_of_Test_Cases"),
        F.count_if(F.col("test_result") == "Failed").alias("No_of_Test_Cases_Failed"),
        F.count_if(F.col("test_result") == "Passed").alias("No_of_Test_Cases_Passed"),
    )
    write_run_table(runs, RUN_SUMMARY, path)
    return read_table(t.spark, RUN_SUMMARY, path).select(
        "Test_Protocol_Run_ID", "Testcase_Type", "Total_No_of_Test_Cases", "No_of_Test_Cases_Failed", "No_of_Test_Cases_Passed")


@register("run_detail", """
    SELECT run_created_time AS Test_Protocol_Run_ID, testcase_name AS Testcase_Name, test_result AS Test_Result,
           reason AS Reason, nullif(runtime, '') AS Runtime FROM history""")
def _(t):
    """The detail table loaded from an exported CSV with a header; a blank cell is NULL."""
    path = new_folder(t.spark, "run_detail")
    rows = t.history.withColumnRenamed("run_created_time", "Test_Protocol_Run_ID")
    declared = [f.strip().split(" ")[0] for f in RUN_DETAIL.split(",")]
    have = {c.lower(): c for c in rows.columns}
    rows.select(*[
        F.col(have[d.lower()]).alias(d) if d.lower() in have else F.lit(None).cast("string").alias(d) for d in declared
    ]).write.option("header", True).csv(path)
    return read_table(t.spark, RUN_DETAIL, path, csv=True).select(
        "Test_Protocol_Run_ID", "Testcase_Name", "Test_Result", "Reason", "Runtime")


# Like-for-like selects
@register("like_select", f"""
    SELECT o_custkey, {DAY('o_orderdate')} AS o_orderdate, o_orderkey, o_orderstatus FROM orders""")
def _(t):
    return ek.read_source(t.spark, file(t, "orders", exclude=" o_totalprice , o_orderpriority")).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date"))


@register("like_filter", """
    SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def _(t):
    return ek.read_source(t.spark, file(
        t, "orders", exclude="o_orderdate", where="WHERE o_orderstatus = 'F' AND o_totalprice > 100000"))


# Mappings
R = MappingRow


def mapped(t, rows, **more):
    return ek.apply_mapping(t.orders_stage, rows, **more)


@register("map_direct", "SELECT order_id AS id, cust_id AS customer FROM orders_stage")
def _(t):
    return mapped(t, [R("id", "order_id"), R("customer", "cust_id")])


@register("map_derived", """
    SELECT order_id, concat(status, '_', CAST(cust_id AS VARCHAR)) AS code FROM orders_stage""")
def _(t):
    return mapped(t, [R("order_id", "order_id"),
                      R("code", "status", DERIVED, expression="concat(src.status, '_', src.cust_id)")])


@register("map_hardcoded", """
    SELECT order_id, 'WEEK' AS period_id, CAST(NULL AS BIGINT) AS base, 'Daily Load' AS job_id FROM orders_stage""")
def _(t):
    return mapped(t, [
        R("order_id", "order_id"), R("period_id", kind=HARDCODED, expression="'WEEK'", target_type="string"),
        R("base", kind=HARDCODED, expression="NULL", target_type="bigint"),
        R("job_id", kind=HARDCODED, expression="'Daily Load'"),
    ])


@register("map_skip", "SELECT order_id, status FROM orders_stage")
def _(t):
    return mapped(t, [R("row_key", kind="autogenerated"), R("order_id", "order_id"), R("status", "status")])


@register("map_trim", "SELECT order_id, trim(priority) AS priority FROM orders_stage")
def _(t):
    return mapped(t, [R("order_id", "order_id"), R("priority", "priority", target_type="STRING", source_type="STRING")],
                  trim=True)


@register("map_cast", """
    SELECT order_id, CAST(cust_id AS VARCHAR) AS customer, order_day AS order_date, CAST(price AS DOUBLE) AS price,
           TRY_CAST(status AS BIGINT) AS status_no FROM orders_stage""")
def _(t):
    return mapped(t, [
        R("order_id", "order_id"), R("customer", "cust_id", source_type="bigint", target_type="string"),
        R("order_date", "order_day", source_type="string", target_type="datetime"),
        R("price", "price", source_type="decimal(18,2)", target_type="double"),
        R("status_no", "status", source_type="string", target_type="bigint"),
    ], cast="try")


@register("map_filter_nulls", "SELECT order_id, priority FROM orders_stage WHERE priority IS NOT NULL")
def _(t):
    return mapped(t, [R("order_id", "order_id"), R("priority", "priority", filter_nulls=True)])


@register("map_filter_expr", "SELECT order_id, status FROM orders_stage WHERE status = 'F'")
def _(t):
    return mapped(t, [R("order_id", "order_id"), R("status", "status", filter_expression="status = 'F'")])


@register("map_filter_and", """
    SELECT order_id, priority FROM orders_stage WHERE priority IS NOT NULL AND status = 'F' AND price > 1000""")
def _(t):
    return mapped(t, [R("order_id", "order_id"), R("priority", "priority", filter_nulls=True)],
                  where="AND status = 'F' AND price > 1000")


@register("map_exclude", "SELECT order_id FROM orders_stage")
def _(t):
    return mapped(t, [R("order_id", "order_id"), R("status", "status")], exclude=["status"])


STAGE_ROWS = [
    R("order_id", "o_orderkey"), R("cust_id", "o_custkey"), R("status", "o_orderstatus"),
    R("price", "o_totalprice", DERIVED, expression="CAST(src.o_totalprice AS DECIMAL(18,2))"),
    R("order_day", "o_orderdate", DERIVED, expression="CAST(CAST(src.o_orderdate AS DATE) AS STRING)"),
    R("priority", "o_orderpriority", DERIVED, expression="concat(' ', src.o_orderpriority, ' ')"),
]
PUBLISH_ROWS = [
    R("order_id", "order_id", source_type="bigint", target_type="bigint"), R("cust_id", "cust_id"),
    R("status_code", "status", source_type="string", target_type="string"),
    R("price", "price", source_type="decimal(18,2)", target_type="double"),
    R("order_date", "order_day", source_type="string", target_type="datetime"),
    R("priority", "priority", source_type="string", target_type="string", filter_nulls=True),
]


@register("map_layer_hop", """
    SELECT order_id, cust_id, status AS status_code, CAST(price AS DOUBLE) AS price, order_day AS order_date,
           trim(priority) AS priority FROM orders_stage WHERE priority IS NOT NULL""")
def _(t):
    return ek.apply_mapping(t.orders_stage, PUBLISH_ROWS, STAGE_TO_TARGET, trim=True)


@register("map_target_side", """
    SELECT order_id, cust_id, status_code, CAST(price AS DOUBLE) AS price, CAST(order_date AS VARCHAR) AS order_date,
           priority FROM orders_publish WHERE status_code <> '?'""")
def _(t):
    return ek.target_select(t.orders_publish, PUBLISH_ROWS, where="status_code <> '?'")


STAGE_SQL = """SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_orderstatus AS status,
    CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day,
    concat(' ', o_orderpriority, ' ') AS priority FROM orders"""
PUBLISH_SQL = """SELECT order_id, cust_id, status AS status_code, CAST(price AS DOUBLE) AS price,
    CAST(order_day AS DATE) AS order_date, trim(priority) AS priority FROM orders_stage WHERE priority IS NOT NULL"""
HOP = lambda no, name, a, b: f"""
    SELECT {no} AS hop_no, '{name}' AS hop, m AS missing_in_target, n AS not_in_source,
           CASE WHEN m = 0 AND n = 0 THEN 'Passed' ELSE 'Failed' END AS result
    FROM (SELECT (SELECT count(*) FROM ({a} EXCEPT {b}) x) AS m, (SELECT count(*) FROM ({b} EXCEPT {a}) y) AS n) z"""


@register("layer_hops", HOP(1, "raw to staging", STAGE_SQL, "SELECT * FROM orders_stage") + " UNION ALL "
          + HOP(2, "staging to publish", PUBLISH_SQL, "SELECT * FROM orders_publish"), also="orders_stage orders_publish")
def _(t):
    return ek.layer_report([
        ek.LayerHop("raw to staging", t.orders, t.orders_stage, STAGE_ROWS, SOURCE_TO_STAGE),
        ek.LayerHop("staging to publish", t.orders_stage, t.orders_publish, PUBLISH_ROWS, STAGE_TO_TARGET, trim=True),
    ])


# Validations after a mapping
@register("v_count", """
    SELECT 'count' AS test, CASE WHEN src_rows = tgt_rows THEN 'Passed' ELSE 'Failed' END AS result,
           CASE WHEN src_rows = tgt_rows THEN 'Count matched' ELSE 'Count mismatched' END AS reason, src_rows, tgt_rows
    FROM (SELECT (SELECT count(*) FROM orders_stage WHERE priority IS NOT NULL) AS src_rows,
                 (SELECT count(*) FROM orders_publish) AS tgt_rows) x""", also="orders_stage orders_publish")
def _(t):
    return ek.test_count(ek.apply_mapping(t.orders_stage, PUBLISH_ROWS, STAGE_TO_TARGET, trim=True), t.orders_publish)


@register("v_duplicate", """
    SELECT o_orderkey, count(*) AS rows FROM orders_dup GROUP BY o_orderkey HAVING count(*) > 1""")
def _(t):
    return ek.dup_keys(t.orders_dup, ["o_orderkey"])


PAIRED = "s.status_code = t.status_code AND s.cust_id = t.cust_id AND s.price = t.price AND s.order_date = t.order_date AND s.priority = t.priority"


@register("suite_mapped", f"""
    SELECT 'stage to publish' AS testcase_name, 'content' AS testcase_type,
           CASE WHEN matched = common AND common = src_rows AND common = tgt_rows THEN 'Passed' ELSE 'Failed' END AS test_result,
           src_rows, tgt_rows, matched, common - matched AS mismatched, src_rows - common AS only_source, tgt_rows - common AS only_target
    FROM (SELECT count(s.order_id) AS src_rows, count(t.order_id) AS tgt_rows, count(CASE WHEN s.order_id = t.order_id THEN 1 END) AS common,
                 count(CASE WHEN s.order_id = t.order_id AND {PAIRED} THEN 1 END) AS matched
          FROM ({PUBLISH_SQL}) s FULL JOIN orders_publish t ON s.order_id = t.order_id) x""", also="orders_stage orders_publish")
def _(t):
    """A suite case whose source is compared as its mapping turns it into the target."""
    case = ek.Case("stage to publish", "order_id", t.orders_stage, t.orders_publish, mapping=PUBLISH_ROWS,
                   hop=STAGE_TO_TARGET, trim=True)
    return ek.run_suite(t.spark, [case], "content").select(
        "testcase_name", "testcase_type", "test_result", "src_rows", "tgt_rows", "matched", "mismatched", "only_source",
        "only_target")


# Lookups and joins
@register("lookup_join", """
    SELECT o_orderkey, n.n_name AS nation, c.c_name AS customer, concat(c.c_mktsegment, '!') AS segment
    FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey
    LEFT JOIN nation n ON o_orderkey = n.n_nationkey""")
def _(t):
    rows = [
        R("o_orderkey", "o_orderkey"),
        R("customer", "o_custkey", DERIVED, lookup_table="dw.customer", lookup_key="c_custkey", lookup_return="customer.c_name"),
        R("nation", "o_orderkey", DERIVED, lookup_table="nation", lookup_key="n_nationkey", lookup_return="n_name"),
        R("segment", "o_custkey", DERIVED, lookup_table="dw.customer", lookup_key="c_custkey",
          lookup_return="concat(c_mktsegment, '!')"),
    ]
    return ek.apply_mapping(t.orders, rows, lookups={"dw.customer": t.customer, "nation": t.nation})


@register("enrich_join", """
    SELECT l.asset_id, l.c_custkey, n.n_name AS domain FROM ledger l
    LEFT JOIN nation n ON l.data_source_code = 'SYS' || CAST(n.n_nationkey AS VARCHAR)""")
def _(t):
    reference = t.nation.select(F.concat(F.lit("SYS"), F.col("n_nationkey").cast("string")).alias("code"), "n_name")
    rows = [R("asset_id", "asset_id"), R("c_custkey", "c_custkey"),
            R("domain", "data_source_code", DERIVED, lookup_table="reference", lookup_key="code", lookup_return="n_name")]
    return ek.apply_mapping(t.ledger, rows, lookups={"reference": reference})


@register("join_chain", """
    SELECT r_name, n_name, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_returnflag = 'R' AND o_orderstatus = 'F' GROUP BY r_name, n_name""")
def _(t):
    joined = ek.join_chain(t.lineitem, [
        (t.orders, "l_orderkey = o_orderkey", "inner"), (t.customer, "o_custkey = c_custkey", "inner"),
        (t.nation, "c_nationkey = n_nationkey", "inner"), (t.region, "n_regionkey = r_regionkey", "inner"),
    ], where="WHERE l_returnflag = 'R' AND o_orderstatus = 'F'")
    return joined.groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))


# Schemas; the sheet and the observed nullability come from the data
SHEET = lambda layer: f"""
    SELECT lower(columnname) AS columnname, lower(CASE WHEN length IS NULL OR scale IS NULL THEN datatype
           ELSE datatype || '(' || CAST(CAST(length AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(scale AS BIGINT) AS VARCHAR) || ')' END) AS datatype
    FROM schema_sheet WHERE tabletype = '{layer}'"""
TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "decimal(18,2)",
         "o_orderdate": "date", "o_orderpriority": "string"}


def schema_sql(table: str, types: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS columnname, '{d}' AS datatype, count(*) > count({c}) AS nullable, "
        f"count(*) - count({c}) AS nulls FROM {table}" for i, (c, d) in enumerate(types.items()))


@register("schema_rows", schema_sql("orders_tgt", TYPES))
def _(t):
    return ek.schema_rows(t.orders_tgt, observed=True)


@register("declared_schema", SHEET("target"))
def _(t):
    return ek.declared_schema(t.schema_sheet, "target")


PUBLISH_TYPES = {"order_id": "bigint", "cust_id": "bigint", "status_code": "string", "price": "double",
                 "order_date": "date", "priority": "string"}
STAGE_TYPES = {"order_id": "bigint", "cust_id": "bigint", "status": "string", "price": "decimal(18,2)",
               "order_day": "string", "priority": "string"}
COMPARED = f"""
    SELECT columnname, s.datatype AS src_type, s.nullable AS src_nullable, t.datatype AS tgt_type, t.nullable AS tgt_nullable,
           CASE WHEN t.columnname IS NULL THEN 'only source' WHEN s.columnname IS NULL THEN 'only target'
                WHEN s.datatype <> t.datatype THEN 'type mismatch'
                WHEN s.nullable <> t.nullable THEN 'nullability mismatch' ELSE 'match' END AS status
    FROM ({schema_sql('orders_stage', STAGE_TYPES)}) s FULL JOIN ({schema_sql('orders_publish', PUBLISH_TYPES)}) t USING (columnname)"""
PLAIN = COMPARED.replace("s.nullable <> t.nullable", "1 = 0")


def stage_schemas(t):
    return ek.schema_rows(t.orders_stage, observed=True), ek.schema_rows(t.orders_publish, observed=True)


@register("schema_compare", f"SELECT columnname, src_type, tgt_type, status FROM ({PLAIN}) x", also="orders_stage orders_publish")
def _(t):
    return ek.schema_compare(*stage_schemas(t))


@register("v_schema", COMPARED, also="orders_stage orders_publish")
def _(t):
    return ek.schema_compare(*stage_schemas(t), nullability=True)


@register("test_schema", f"""
    SELECT 'schema' AS test, CASE WHEN bad = 0 THEN 'Passed' ELSE 'Failed' END AS result,
           CASE WHEN bad = 0 THEN 'Schema matched' ELSE 'Schema mismatched' END AS reason,
           src_columns, tgt_columns, matched, only_source, only_target, type_mismatch
    FROM (SELECT count(src_type) AS src_columns, count(tgt_type) AS tgt_columns,
                 count(CASE WHEN status = 'match' THEN 1 END) AS matched,
                 count(CASE WHEN status = 'only source' THEN 1 END) AS only_source,
                 count(CASE WHEN status = 'only target' THEN 1 END) AS only_target,
                 count(CASE WHEN status = 'type mismatch' THEN 1 END) AS type_mismatch,
                 count(CASE WHEN status <> 'match' THEN 1 END) AS bad FROM ({COMPARED}) x) y""",
          also="orders_stage orders_publish")
def _(t):
    return ek.test_schema(t.orders_stage, t.orders_publish, observed=True)


@register("mapping_schema_join", f"""
    SELECT m.tgtcolumnname, m.srccolumnname, t.datatype AS target_type, s.datatype AS source_type
    FROM (VALUES ('p_partkey', '-'), ('p_name', 'p_name'), ('p_size', 'p_retailprice'), ('p_extra', 'p_name')) m(tgtcolumnname, srccolumnname)
    LEFT JOIN ({SHEET('target')}) t ON m.tgtcolumnname = t.columnname
    LEFT JOIN ({SHEET('source')}) s ON m.srccolumnname = s.columnname""", also="schema_sheet")
def _(t):
    sheet = t.spark.createDataFrame(
        [("p_partkey", "-"), ("p_name", "p_name"), ("p_size", "p_retailprice"), ("p_extra", "p_name")],
        "tgtcolumnname string, srccolumnname string")
    declared = t.schema_sheet
    return ek.with_schemas(sheet, ek.declared_schema(declared, "target"), ek.declared_schema(declared, "source"))


ALLOWED = [("oracle", "databricks", "table", "delta"), ("AWS-S3", "databricks", "parquet", "delta"),
           ("snowflake", "BigQuery", "table", "table")]
COMBO = ["sourceconnectiontype", "targetconnectiontype", "sourceformat", "targetformat"]


@register("combo_allowed", f"""
    SELECT * FROM combos c WHERE EXISTS (SELECT 1 FROM (VALUES {', '.join(map(str, ALLOWED))}) a({', '.join(COMBO)}) WHERE """
          + " AND ".join(f"lower(trim(a.{c})) = lower(trim(c.{c}))" for c in COMBO) + ")")
def _(t):
    return ek.combo_allowed(t.combos, t.spark.createDataFrame(ALLOWED, COMBO), COMBO)


# Nested data
@register("flatten_struct", """
    SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS info_props_k, event_type AS info_kind FROM events""")
def _(t):
    return ek.flatten_structs(t.nested_events.select(
        "event_id", F.struct(F.from_json("props", "k bigint").alias("Props"), F.col("event_type").alias("Kind")).alias("Info"),
        "user_id"))


@register("explode_array", """
    SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS part FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0
    UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0""")
def _(t):
    """Whole vectors, empty for some rows and NULL for others."""
    part = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    return ek.explode_array(t.embeddings.select("vec_id", part.alias("part")), "part").withColumn(
        "part", F.col("part").cast("double"))


@register("flatten_nested", """
    SELECT conv_id, CAST(turn AS BIGINT) AS turns_no, role AS turns_who FROM conversations""")
def _(t):
    """Arrays of structs: exploded, then flattened."""
    nested = t.conversations.select(
        "conv_id", F.array(F.struct(F.col("turn").alias("No"), F.col("role").alias("Who"))).alias("turns"))
    return ek.flatten(nested)


# Column rules of three-layer mappings
@register("default_blank", """
    SELECT c_custkey, CASE WHEN asset_id IS NULL OR trim(asset_id) = '' THEN 'UNKNOWN_' || data_source_code ELSE asset_id END AS asset_id,
           COALESCE(affiliate, '') AS affiliate, 'N' AS exception_indicator FROM ledger""")
def _(t):
    return t.ledger.select(
        "c_custkey", blank_to(F.col("asset_id"), F.concat(F.lit("UNKNOWN_"), "data_source_code")).alias("asset_id"),
        blank_to(F.col("affiliate"), "").alias("affiliate"), blank_to(F.lit(None).cast("string"), "N").alias("exception_indicator"))


@register("filter_zero", "SELECT c_custkey, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE amount <> 0")
def _(t):
    return ek.apply_mapping(t.ledger, [R("c_custkey", "c_custkey"), R("amount", "amount", filter_expression="amount <> 0")])


@register("debit_credit_flag", """
    SELECT c_custkey, CASE WHEN amount < 0 THEN 'C' ELSE 'D' END AS debit_credit FROM ledger""")
def _(t):
    return t.ledger.select("c_custkey", debit_credit(F.col("amount")).alias("debit_credit"))


@register("derived_group_id", """
    SELECT c_custkey, upper(split_part(data_source_code, 'S', 3)) AS group_id FROM ledger""")
def _(t):
    rows = [R("c_custkey", "c_custkey"),
            R("group_id", "data_source_code", DERIVED, expression="upper(split_part(src.data_source_code, 'S', 3))")]
    return ek.apply_mapping(t.ledger, rows)


@register("format_validity", r"""
    SELECT o_orderkey, as_of_date,
           CASE WHEN regexp_full_match(as_of_date, '[0-9]{8}') AND try_strptime(as_of_date, '%Y%m%d') IS NOT NULL
                THEN 'In YYYYMMDD' ELSE 'Not in YYYYMMDD' END AS asofdate_valid,
           CASE WHEN exception_indicator = 'N' THEN 'Pass' ELSE 'Fail' END AS indicator,
           CASE WHEN regexp_matches(transaction_amount, '^-?[0-9]+\.[0-9]{2}$') THEN 'Pass' ELSE 'Fail' END AS two_decimal
    FROM order_text""")
def _(t):
    return t.order_text.select(
        "o_orderkey", "as_of_date",
        F.when(date_text_ok(F.col("as_of_date")), "In YYYYMMDD").otherwise("Not in YYYYMMDD").alias("asofdate_valid"),
        F.when(F.col("exception_indicator") == "N", "Pass").otherwise("Fail").alias("indicator"),
        F.when(two_decimals(F.col("transaction_amount")), "Pass").otherwise("Fail").alias("two_decimal"),
    )


# Ad-hoc SQL
LABEL = "SELECT id, concat_ws(' / ', upper(trim(last)), trim(city), zip) AS label, prefix IS NULL AS untitled FROM source_table"


@register("cte_address", f"WITH cte AS ({LABEL.replace('source_table', 'people')}) SELECT * FROM cte WHERE label <> ''", also="people")
def _(t):
    return ek.adhoc_sql(t.spark, f"WITH cte AS ({LABEL}) SELECT * FROM cte WHERE label <> '';", {"source_table": t.people}, limit=None)


@register("cte_colmatch", """
    WITH cte AS (SELECT birthplace, trim(city) AS city FROM people) SELECT * FROM cte WHERE birthplace = city""", also="people")
def _(t):
    return ek.adhoc_sql(t.spark, """
        WITH cte AS (SELECT birthplace, trim(city) AS city FROM target_table)
        SELECT * FROM cte WHERE birthplace = city;""", {"target_table": t.people}, limit=None)


# The first three rows of a query: the limit is what an ad-hoc preview is.
@register("adhoc_sql", """
    SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_mktsegment ORDER BY 1 LIMIT 3""")
def _(t):
    sql = "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM source_table GROUP BY c_mktsegment"
    return ek.adhoc_sql(t.spark, sql, {"source_table": t.customer})


BULK = ["SELECT o_orderstatus AS status, count(*) AS n FROM source_table GROUP BY o_orderstatus",
        "SELECT o_orderkey AS id, o_orderpriority AS priority FROM source_table"]


@register("adhoc_bulk", f"""
    SELECT 1 AS query_no, row_number() OVER (ORDER BY status)::INT AS row_no, $q${BULK[0]}$q$ AS sql,
           to_json({{'status': status, 'n': n}})::VARCHAR AS row_json
    FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY 1 LIMIT 3) a
    UNION ALL SELECT 2, row_number() OVER (ORDER BY id)::INT, $q${BULK[1]}$q$, to_json({{'id': id, 'priority': priority}})::VARCHAR
    FROM (SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders ORDER BY 1, 2 LIMIT 3) b""")
def _(t):
    return ek.adhoc_bulk(t.spark, BULK, {"source_table": t.orders})


# Scalar functions as the mapped queries use them
@register("fn_concat", """
    SELECT l_orderkey, l_linenumber, concat(l_returnflag, '', l_linestatus, '_', CAST(l_linenumber AS VARCHAR)) AS joined,
           concat_ws('|', l_returnflag, CASE WHEN l_linenumber > 3 THEN l_linestatus END) AS listed FROM lineitem""")
def _(t):
    return ek.apply_mapping(t.lineitem, [
        R("l_orderkey", "l_orderkey"), R("l_linenumber", "l_linenumber"),
        R("joined", "l_returnflag", DERIVED, expression="concat(src.l_returnflag, '', src.l_linestatus, '_', src.l_linenumber)"),
        R("listed", "l_returnflag", DERIVED,
          expression="concat_ws('|', src.l_returnflag, CASE WHEN src.l_linenumber > 3 THEN src.l_linestatus END)"),
    ])


@register("fn_trim", "SELECT id, trim(address) AS address, trim(city) AS city FROM people")
def _(t):
    return t.people.select("id", F.trim("address").alias("address"), F.trim("city").alias("city"))


@register("fn_case", "SELECT p_partkey, upper(p_name) AS upper_name, lower(p_type) AS lower_type FROM part")
def _(t):
    return ek.apply_mapping(t.part, [
        R("p_partkey", "p_partkey"), R("upper_name", "p_name", DERIVED, expression="upper(src.p_name)"),
        R("lower_type", "p_type", DERIVED, expression="lower(src.p_type)"),
    ])


@register("fn_fullname", """
    SELECT id, COALESCE(prefix, '') || ' ' || COALESCE(first, '') || ' ' || COALESCE(last, '') || ' ' || COALESCE(suffix, '') AS fullname
    FROM people""")
def _(t):
    return t.people.select("id", full_name(*map(F.col, ("prefix", "first", "last", "suffix"))).alias("fullname"))


@register("fn_week", f"""
    SELECT o_orderkey, CAST(extract(week FROM d) AS INT) AS period_number, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS start_dt,
           CAST(CAST(date_trunc('week', d) AS DATE) + 6 AS VARCHAR) AS end_dt
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) x""")
def _(t):
    rows = [
        R("o_orderkey", "o_orderkey"),
        R("period_number", "o_orderdate", DERIVED, expression="extract(WEEK FROM to_date(src.day, 'yyyy-MM-dd'))"),
        R("start_dt", "o_orderdate", DERIVED, expression="to_date(date_trunc('WEEK', to_date(src.day, 'yyyy-MM-dd')))"),
        R("end_dt", "o_orderdate", DERIVED,
          expression="to_date(date_trunc('WEEK', to_date(src.day, 'yyyy-MM-dd')) + INTERVAL '6' DAY)"),
    ]
    return ek.apply_mapping(t.orders.withColumn("day", F.col("o_orderdate").cast("date").cast("string")), rows)


@register("fn_split_initcap", """
    SELECT p_partkey, upper(substr(w1, 1, 1)) || lower(substr(w1, 2)) AS first_word, upper(substr(w2, 1, 1)) || lower(substr(w2, 2)) AS second_word
    FROM (SELECT p_partkey, split_part(split_part(p_name, ':', 1), ' ', 1) AS w1, split_part(split_part(p_name, ':', 1), ' ', 2) AS w2 FROM part) x""")
def _(t):
    word = lambda n: f"initcap(split_part(split_part(src.p_name, ':', 1), ' ', {n}))"
    return ek.apply_mapping(t.part, [
        R("p_partkey", "p_partkey"), R("first_word", "p_name", DERIVED, expression=word(1)),
        R("second_word", "p_name", DERIVED, expression=word(2)),
    ])


# "Today" is a parameter, so that the same rows come back tomorrow.
TODAY = "2024-03-15"


@register("fn_anniversary", f"""
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders
    WHERE extract(month FROM o_orderdate) = extract(month FROM DATE '{TODAY}')
      AND extract(day FROM o_orderdate) = extract(day FROM DATE '{TODAY}')""")
def _(t):
    same = " AND ".join(f"extract({part} FROM o_orderdate) = extract({part} FROM DATE '{TODAY}')" for part in ("MONTH", "DAY"))
    rows = [R("o_orderkey", "o_orderkey"), R("o_orderdate", "o_orderdate", DERIVED, expression="to_date(src.o_orderdate)")]
    return ek.apply_mapping(t.orders, rows, where=same)


