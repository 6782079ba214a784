"""Readers, sheets and sinks."""

import pytest

import evenkeel as ek
from conftest import SF_TINY, as_set
from evenkeel.sources import HISTORY, append_history, export_samples, load_suite, read_sheet, read_table, suite_header
from evenkeel.sources.readers import catalog_query, database_options, query_text, remote_query


def test_unknown_source_raises(spark):
    with pytest.raises(ValueError, match="floppy"):
        ek.read_source(spark, ek.SourceSpec("floppy", "parquet"))
    with pytest.raises(ValueError, match="oracle"):
        ek.read_source(spark, ek.SourceSpec("oracle", "parquet"))


@pytest.mark.parametrize("fmt", ["avro", "delta"])
def test_missing_packages_are_named(spark, fmt):
    with pytest.raises(RuntimeError, match="package"):
        ek.read_source(spark, ek.SourceSpec("aws-s3", fmt, path="/nowhere"))


def test_csv_without_schema_is_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Name;city\nAnn;Bonn\nBob;\n", encoding="utf-8")
    df = ek.read_source(spark, ek.SourceSpec("local", "delimited", path=str(tmp_path / "p.csv"), delimiter=";"))
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}
    assert as_set(df, "city") == {("Bonn",), (None,)}


def test_json_lines_and_multiline(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"id": 1, "p": {"a": 1, "L": [1, 2]}}\n{"id": 2, "p": null}\n')
    (tmp_path / "m.json").write_text('[{"id": 1,\n "p": {"a": 1, "L": [1, 2]}}]')
    lines = ek.read_source(spark, ek.SourceSpec("adls", "json", path=str(tmp_path / "l.json")))
    assert as_set(lines, "id", "p_a", "p_l") == {(1, 1, 1), (1, 1, 2), (2, None, None)}
    whole = ek.read_source(spark, ek.SourceSpec("adls", "json", path=str(tmp_path / "m.json"), multiline=True))
    assert as_set(whole, "id", "p_l") == {(1, 1), (1, 2)}


def test_manual_query_file_with_braces_and_ctes(spark, tmp_path):
    sql = tmp_path / "q.sql"
    sql.write_text("WITH x AS (SELECT c_custkey, '{k}' AS t\nFROM raw src)\nSELECT t, count(*) AS n FROM x GROUP BY t;\n")
    spec = ek.SourceSpec("local", "parquet", path=f"{SF_TINY}/customer.parquet", alias="raw", query=str(sql))
    assert as_set(ek.read_source(spark, spec)) == {("{k}", 150)}
    assert query_text(str(sql)).endswith("GROUP BY t")
    assert "raw" not in [t.name for t in spark.catalog.listTables()]


def test_database_options():
    name, o = database_options(ek.SourceSpec("Oracle 19c", "table", table="hr.people", where="WHERE id > 5", options={"url": "jdbc:x"}))
    assert name == "jdbc" and o["query"] == "SELECT * FROM hr.people WHERE id > 5" and o["url"] == "jdbc:x"
    assert o["driver"].startswith("oracle") and o["oracle.jdbc.timezoneAsRegion"] == "false"
    for kind in ("sqlserver", "postgres"):
        assert database_options(ek.SourceSpec(kind, "table", table="t"))[1]["dbtable"] == "t"
        assert database_options(ek.SourceSpec(kind, "table", table="t", where="a=1"))[1]["query"] == "SELECT * FROM t WHERE a=1"
    for kind in ("mysql", "teradata"):
        assert database_options(ek.SourceSpec(kind, "table", table="t", query="SELECT 1;"))[1]["query"] == "SELECT 1"
    _, o = database_options(ek.SourceSpec("postgres", "table", table="t", partition_column="id", partition_bounds=(1, 900), partitions=8))
    assert o["dbtable"] == "(SELECT * FROM t) t" and o["numPartitions"] == "8" and "query" not in o
    name, o = database_options(ek.SourceSpec("snowflake", "table", table="db.s.t"))
    assert "snowflake" in name and o["autopushdown"] == "on" and o["query"] == "SELECT * FROM db.s.t"
    assert database_options(ek.SourceSpec("bigquery", "table", table="d.t"))[1] == {"table": "d.t"}
    assert database_options(ek.SourceSpec("bigquery", "table", table="d.t", where="a=1"))[1]["query"] == "SELECT * FROM d.t WHERE a=1"
    assert database_options(ek.SourceSpec("redshift", "table", table="t"))[0] == "redshift"


def test_catalog_queries():
    assert "all_tab_columns" in catalog_query(ek.SourceSpec("oracle", "table", table="hr.people"))
    assert "d.INFORMATION_SCHEMA.COLUMNS" in catalog_query(ek.SourceSpec("bigquery", "table", table="d.t"))
    assert "'t'" in catalog_query(ek.SourceSpec("mysql", "table", table="s.t"))


def test_remote_filter_takes_text_with_or_without_where():
    spec = lambda w: ek.SourceSpec("oracle", "table", table="t", where=w)
    assert remote_query(spec("a=1")) == remote_query(spec(" WHERE a=1 ")) == "SELECT * FROM t WHERE a=1"
    assert remote_query(spec("  ")) == "SELECT * FROM t"


def test_schema_of_a_file(spark):
    rows = ek.source_schema(spark, ek.SourceSpec("local", "parquet", path=f"{SF_TINY}/nation.parquet"))
    assert as_set(rows, "columnname", "datatype") == {("n_name", "string"), ("n_nationkey", "int"), ("n_regionkey", "int")}


def test_mapping_sheet_to_rows(spark, tmp_path):
    sheet = tmp_path / "map.csv"
    sheet.write_text(
        "﻿tgtcolumnname,srccolumnname,transformationtype,filteroutnulls,selectsqlexpression,filtersqlexpression,lookuptablename,"
        "lookupjoincolumnname,lookupreturnexpression\n"
        "row_key,-,autogenerated,,,,,,\n"
        "id,c_custkey,directmapped,Y,,,,,\n"
        "label,-,derived,,\"concat(c_name, '_', c_mktsegment)\",c_mktsegment = 'MACHINERY',,,\n"
        "source_id,-,hardcoded,,'CRM',,,,\n"
        "nation,c_nationkey,derived,Y,,,nation,n_nationkey,n_name\n", encoding="utf-8")
    rows = ek.mapping_rows(read_sheet(spark, str(sheet)))
    read = lambda n: spark.read.parquet(f"{SF_TINY}/{n}.parquet")
    out = ek.apply_mapping(read("customer"), rows, lookups={"nation": read("nation")})
    assert out.columns == ["id", "label", "source_id", "nation"]
    assert out.count() == read("customer").where("c_mktsegment = 'MACHINERY'").count() > 0
    assert out.where("label like '%MACHINERY' and source_id = 'CRM' and nation is not null").count() == out.count()


def test_suite_sheet(spark, tmp_path):
    path = tmp_path / "suite.csv"
    base = f"local,{SF_TINY},nation.parquet,parquet,,n_regionkey,,,,"
    path.write_text(
        "Sno.,test_case_name,execute,primarykey,samplelimit,testquerygenerationmode,"
        + ",".join(f"{s}{c}" for s in ("source", "target") for c in (
            "connectiontype", "filepath", "filename", "fileformat", "filedelimiter", "excludecolumnlist", "filter",
            "querysqlpath", "querysqlfilename", "aliasname"))
        + f"\n1,same,Y, n_nationkey ,,Auto,{base},{base}\n2,off,N,n_nationkey,,Auto,{base},{base}\n,note,Y,,,,{base},{base}\n")
    (tmp_path / "head.csv").write_text("protocol_name,demo\nversion,1\n")
    cases = ek.cases_from_rows(r.asDict() for r in load_suite(spark, str(path)).collect())
    assert [c.name for c in cases] == ["same", "off"] and cases[0].sample_limit() == 10
    assert suite_header(spark, str(tmp_path / "head.csv")) == {"protocol_name": "demo", "version": "1"}
    out = ek.run_suite(spark, cases, "content").collect()
    assert [(r.testcase_name, r.test_result, r.src_rows) for r in out] == [("same", "Passed", 25)]


def test_mapped_case_from_sheets(spark, rows, tmp_path):
    """A delimited source, a mapping folder and a parquet target, end to end."""
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "schema.csv").write_text(
        "tabletype,columnname,datatype,length,scale,primarykey\nsource,id,integer,,,Y\nsource,day,string,,,\n"
        "source,amount,string,,,\ntarget,order_id,integer,,,Y\ntarget,order_day,datetime,,,\ntarget,amount,double,,,\n"
        "target,load,string,,,\n")
    (tmp_path / "map" / "target_mapping.csv").write_text(
        "tgtcolumnname,srccolumnname,transformationtype,filteroutnulls,selectsqlexpression,filtersqlexpression,"
        "lookuptablename,lookupjoincolumnname,lookupreturnexpression\norder_id,id,directmapped,,,,,,\n"
        "order_day,day,directmapped,Y,,,,,\namount,amount,directmapped,,,,,,\nload,-,hardcoded,,'daily',,,,\n")
    (tmp_path / "src.csv").write_text("id|day|amount\n1|2024-01-02|1.50\n2||2.00\n3|2024-01-04|3.25\n9|2024-01-05|1\n")
    rows("order_id int, order_day string, amount double, load string", (1, "2024-01-02", 1.5, "daily"), (3, "2024-01-04", 9.0, "daily")
         ).selectExpr("order_id", "to_date(order_day) AS order_day", "amount", "load").write.parquet(str(tmp_path / "tgt"))
    row = {
        "test_case_name": "mapped", "execute": "Y", "comparetype": "s2tcompare", "testquerygenerationmode": "Auto",
        "s2tpath": str(tmp_path / "map"), "s2tmappingsheet": "source_to_target",
        "sourceconnectiontype": "local", "sourcefilepath": str(tmp_path), "sourcefilename": "src.csv",
        "sourcefileformat": "delimited", "sourcefiledelimiter": "|", "sourcefilter": "id < 9",
        "targetconnectiontype": "local", "targetfilepath": str(tmp_path), "targetfilename": "tgt", "targetfileformat": "parquet",
    }
    cases = ek.cases_from_rows([row], spark)
    assert cases[0].keys == ["order_id"]
    out = ek.run_suite(spark, cases, "content").first()
    assert (out.test_result, out.src_rows, out.tgt_rows, out.matched, out.mismatched) == ("Failed", 2, 2, 1, 1)
    cells = ek.column_details(ek.reconcile(cases[0].pair(spark)), ["order_id"], 5)
    assert as_set(cells) == {("amount", "order_id=3", "3.25", "9.0")}


def test_history_appends_and_prunes(spark, rows, tmp_path):
    path = str(tmp_path / "history")
    for kind in ("count", "null"):
        append_history(rows("testcase_name string, test_result string, testcase_type string", ("a", "Passed", kind)), path)
    df = read_table(spark, HISTORY, path)
    assert df.count() == 2 and df.where("testcase_type = 'null'").count() == 1
    plan = df.where("testcase_type = 'null'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(testcase_type" in plan


def test_sample_export_limit(spark, rows, tmp_path):
    df = rows("k int, v string", *[(i, "x") for i in range(130)])
    paths = export_samples(df, df, ["k"], str(tmp_path / "s"), None)
    assert spark.read.parquet(paths["source"]).count() == 100
    paths = export_samples(df, df, ["k"], str(tmp_path / "t"), 5)
    assert as_set(spark.read.parquet(paths["target"]), "k") == {(i,) for i in range(5)}
