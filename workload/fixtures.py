"""Source/target pairs derived from the test tables.

Every fixture is one SELECT that Spark and the SQL oracle both accept, over whole tables. The remainder terms
(``key % 41 = 0`` and the like) plant faults for the checks to find: changed cells, NULLs, lost and extra rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from evenkeel.sources.readers import manual_query

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

FIXTURES = {
    "orders_src": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey%53=0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
               CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
               CAST(o_orderdate AS DATE) AS o_orderdate,
               CASE WHEN o_orderkey%59=0 THEN '  ' ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "orders_tgt": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey%53=0 THEN NULL WHEN o_orderkey%41=0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CAST(o_totalprice + CASE WHEN o_orderkey%37=0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS o_totalprice,
               CAST(o_orderdate AS DATE) AS o_orderdate,
               CASE WHEN o_orderkey%43=0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE o_orderkey%101<>0
        UNION ALL
        SELECT o_orderkey+100000000, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)),
               CAST(o_orderdate AS DATE), o_orderpriority
        FROM orders WHERE o_orderkey%211=0""",
    "orders_dup": """
        SELECT * FROM orders_tgt UNION ALL SELECT * FROM orders_tgt WHERE o_orderkey%97=0""",
    # One customer key holds a third of all rows, with many copies of equal rows.
    "li_hot_src": """
        SELECT CASE WHEN l_orderkey%3=0 THEN 0 ELSE l_orderkey END AS ref, l_returnflag, l_linenumber,
               CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity
        FROM lineitem""",
    "li_hot_tgt": """
        SELECT ref, CASE WHEN l_linenumber=7 AND l_quantity>45 THEN 'Z' ELSE l_returnflag END AS l_returnflag,
               l_linenumber, l_quantity
        FROM li_hot_src WHERE NOT (l_linenumber=3 AND l_quantity=50)""",
    "li_orphan": """
        SELECT CASE WHEN l_orderkey%307=0 THEN l_orderkey+900000000 ELSE l_orderkey END AS l_orderkey,
               l_linenumber, l_partkey, l_suppkey
        FROM lineitem""",
    "cust_scd2": """
        SELECT c.c_custkey, v.version,
               CASE WHEN v.version=1 THEN c.c_mktsegment ELSE 'MOVED' END AS segment,
               CASE WHEN v.version=1 THEN DATE '2020-01-01'
                    WHEN c.c_custkey%89=0 THEN DATE '2022-01-03' ELSE DATE '2022-01-01' END AS eff_from,
               CASE WHEN v.version=1 AND c.c_custkey%3=0 THEN DATE '2021-12-31' ELSE DATE '9999-12-31' END AS eff_to,
               CASE WHEN v.version=2 OR c.c_custkey%3<>0 OR c.c_custkey%83=0 THEN 'Y' ELSE 'N' END AS is_current
        FROM customer c JOIN (SELECT 1 AS version UNION ALL SELECT 2) v ON v.version=1 OR c.c_custkey%3=0""",
    "events_src": """
        SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM events""",
    "events_tgt": """
        SELECT event_id, ts, user_id, CASE WHEN event_id%61=0 THEN 'view' ELSE event_type END AS event_type,
               CAST(value AS DECIMAL(18,2)) AS value
        FROM events WHERE event_id%71<>0""",
    "events_loaded": """
        SELECT ts FROM events WHERE event_id*2 < (SELECT max(event_id) FROM events)""",
    "conv_turns": """
        SELECT conv_id, turn AS place, turn + CASE WHEN conv_id%17=0 AND turn=1 THEN 1 ELSE 0 END AS turn_no
        FROM conversations""",
    "line_ranks": """
        SELECT l_orderkey, l_linenumber,
               DENSE_RANK() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)
                 + CASE WHEN l_orderkey%131=0 THEN 1 ELSE 0 END AS dense_no,
               RANK() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)
                 + CASE WHEN l_orderkey%137=0 THEN 1 ELSE 0 END AS rank_no
        FROM lineitem""",
    "order_text": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey%47=0 THEN '20240230' WHEN o_orderkey%67=0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING),1,7)
                    ELSE replace(CAST(CAST(o_orderdate AS DATE) AS STRING),'-','') END AS as_of_date,
               CASE WHEN o_orderkey%29=0 THEN 'Y' ELSE 'N' END AS exception_indicator,
               CASE WHEN o_orderkey%31=0 THEN '12.5' WHEN o_orderkey%37=0 THEN NULL
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS transaction_amount
        FROM orders""",
    "ledger": """
        SELECT c_custkey, CASE WHEN c_custkey%13=0 THEN NULL WHEN c_custkey%17=0 THEN ' ' ELSE c_name END AS asset_id,
               concat('SYS', CAST(c_nationkey AS STRING)) AS data_source_code,
               CASE WHEN c_custkey%19=0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS amount,
               CASE WHEN c_custkey%23=0 THEN NULL ELSE c_mktsegment END AS affiliate
        FROM customer""",
    "people": """
        SELECT c_custkey AS id, concat(' ', c_name) AS address, concat(c_mktsegment, ' ') AS city,
               CASE WHEN c_custkey%11=0 THEN c_mktsegment ELSE n_name END AS birthplace, n_name AS county,
               CAST(10000 + c_custkey AS STRING) AS zip,
               CASE WHEN c_custkey%3=0 THEN NULL ELSE 'Dr.' END AS prefix, c_name AS first, n_name AS last,
               CASE WHEN c_custkey%5=0 THEN 'PhD' ELSE NULL END AS suffix
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    # A run history: one test case per event, its outcome, type and runtime taken from the event.
    "history": """
        SELECT concat('case_', CAST(user_id AS STRING)) AS testcase_name,
               CASE WHEN event_type='error' THEN 'Failed' ELSE 'Passed' END AS test_result,
               CASE WHEN event_id%29=0 THEN ''
                    ELSE concat('0:', lpad(CAST(CAST(floor(value/60) AS INT) AS STRING), 2, '0'), ':',
                                lpad(CAST(CAST(floor(value) AS INT)%60 AS STRING), 2, '0')) END AS runtime,
               CASE event_type WHEN 'view' THEN 'count' WHEN 'click' THEN 'content' WHEN 'purchase' THEN 'duplicate'
                    WHEN 'signup' THEN 'null' ELSE 'fingerprint' END AS testcase_type,
               substr(CAST(ts AS STRING), 1, 13) AS run_created_time,
               CAST(CAST(ts AS DATE) AS STRING) AS protocol_start_time,
               CAST(CAST(ts AS DATE) AS STRING) AS protocol_end_time,
               '0:10:00' AS protocol_total_run_time,
               substr(CAST(ts AS STRING), 1, 13) AS db_stored_time,
               CASE WHEN event_type='error' THEN 'Content mismatched' ELSE 'Content matched' END AS reason
        FROM events""",
    # A declared schema sheet whose lengths are those found in the data.
    "schema_sheet": """
        SELECT 'target' AS tabletype, 'P_PARTKEY' AS columnname, 'NUMBER' AS datatype,
               CAST(max(length(CAST(p_partkey AS STRING))) AS DOUBLE) AS length, CAST(0 AS DOUBLE) AS scale FROM part
        UNION ALL SELECT 'target', 'P_NAME', 'STRING', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM part HAVING count(*) > 0
        UNION ALL SELECT 'target', 'P_SIZE', 'NUMBER', CAST(max(length(CAST(p_size AS STRING))) AS DOUBLE), CAST(0 AS DOUBLE) FROM part
        UNION ALL SELECT 'source', 'P_NAME', 'STRING', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM part HAVING count(*) > 0
        UNION ALL SELECT 'source', 'P_RETAILPRICE', 'NUMBER', CAST(max(length(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING))) AS DOUBLE), CAST(2 AS DOUBLE) FROM part""",
    "nested_events": """
        SELECT event_id, event_type, user_id, props FROM events""",
    # The order's customer name and its day, as a mapped load would store them.
    "orders_stage": """
        SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_orderstatus AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_day,
               CASE WHEN o_orderkey%83=0 THEN NULL ELSE concat(' ', o_orderpriority, ' ') END AS priority
        FROM orders""",
    "orders_publish": """
        SELECT order_id, cust_id, CASE WHEN order_id%109=0 THEN '?' ELSE status END AS status_code,
               CAST(price AS DOUBLE) AS price, CAST(order_day AS DATE) AS order_date, trim(priority) AS priority
        FROM orders_stage WHERE priority IS NOT NULL AND order_id%113<>0""",
    # Cases of a suite, one per order line, and the combinations that may be compared.
    "combos": """
        SELECT l_orderkey, l_linenumber,
               CASE l_returnflag WHEN 'A' THEN ' Oracle ' WHEN 'N' THEN 'aws-s3' ELSE 'Snowflake' END AS sourceconnectiontype,
               CASE l_linestatus WHEN 'F' THEN 'Databricks' ELSE 'bigquery' END AS targetconnectiontype,
               CASE l_returnflag WHEN 'N' THEN 'PARQUET' ELSE 'table' END AS sourceformat,
               CASE l_linestatus WHEN 'F' THEN 'delta ' ELSE 'table' END AS targetformat
        FROM lineitem""",
}


def _reads(sql: str) -> list[str]:
    known = set(FIXTURES) | set(TABLES)
    found = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)
    return [n for n in dict.fromkeys(found) if n in known]


def table(spark: SparkSession, sf_dir: str, name: str, built: dict[str, DataFrame] | None = None) -> DataFrame:
    """A test table or a fixture over the test tables; ``built`` keeps frames that are already planned."""
    built = {} if built is None else built
    if name not in built:
        if name in TABLES:
            built[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = FIXTURES[name]
            built[name] = manual_query(spark, sql, **{n: table(spark, sf_dir, n, built) for n in _reads(sql)})
    return built[name]


def with_fixtures(body: str, also: str = "") -> str:
    """The body with the fixtures it reads (and those named in ``also``) as common table expressions."""
    order: list[str] = []

    def need(name: str):
        if name in TABLES or name in order:
            return
        for other in _reads(FIXTURES[name]):
            need(other)
        order.append(name)

    for name in [*also.split(), *_reads(body)]:
        need(name)
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n].strip()})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
