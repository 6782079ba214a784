"""Mergeable profile states, aligned arrays and maps, workbooks, and cases side by side."""

import random

import evenkeel as ek
from conftest import SF_SMALL, as_set
from evenkeel.operators.sketches import QUANTILES
from evenkeel.plans.workbook import workbook_case


def metrics(df):
    return {(r["column"], r["metric"]): r["value"] for r in df.collect()}


def test_states_of_parts_add_up(spark, rows):
    """Merged states against the plain values of all parts: sums exact, estimates within their bounds."""
    rng = random.Random(5)
    data = [(k % 7, rng.gauss(50, 20) if k % 11 else None, f"w{rng.randrange(300)}" if k % 13 else " ") for k in range(20000)]
    df = rows("part int, x double, s string", *data)
    out = metrics(ek.describe(ek.merge_states(ek.profile_state(df, by=["part"]))))
    xs = sorted(x for _, x, _ in data if x is not None)
    mean = sum(xs) / len(xs)
    assert float(out["x", "count"]) == len(xs) and float(out["x", "nulls"]) == len(data) - len(xs)
    assert abs(float(out["x", "mean"]) - mean) < 1e-9
    assert abs(float(out["x", "sd"]) - (sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) ** 0.5) < 1e-6
    assert (float(out["x", "min"]), float(out["x", "max"])) == (xs[0], xs[-1])
    for q in QUANTILES:
        guess = float(out["x", f"q{q * 100:g}"])
        assert abs(sum(x <= guess for x in xs) / len(xs) - q) < 0.03
    assert abs(int(out["s", "distinct"]) - len({s for _, _, s in data})) <= 15
    assert int(out["s", "blanks"]) == sum(s == " " for _, _, s in data)
    top = max({s for _, _, s in data}, key=[s for _, _, s in data].count)
    assert out["s", "top_1"] == f"{top} ({sum(s == top for _, _, s in data)})"


def test_states_of_nothing_and_of_odd_values(spark, rows):
    """An empty table, a column of NULLs, NaN and nested values have a defined profile."""
    empty = metrics(ek.profile(rows("x double, s string", (1.0, "a")).where("x > 1")))
    assert empty["x", "count"] == "0.0" and ("x", "mean") not in empty and ("s", "top_1") not in empty
    odd = rows("x double, n int, a array<int>, `a b` string", (float("nan"), None, [1], None), (2.0, None, None, "Ab1"))
    out = metrics(ek.describe(ek.merge_states(ek.profile_state(odd))))
    assert out["x", "count"] == "2.0" and out["x", "mean"] == "2.0" and ("x", "sd") not in out
    assert out["n", "nulls"] == "2.0" and ("n", "q50") not in out and out["a", "max"] == '{"a":[1]}'
    assert out["a b", "pattern_1"] == "AA9 (1)"


def test_profile_reads_the_data_once(spark):
    plan = ek.profile(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_drift(spark, rows):
    before = rows("x double, y double, s string, gone int", *[(float(k), float(k % 3), "a", 1) for k in range(3000)])
    after = rows("x double, y double, s string, new int", *[(k * 1.5, float(k % 3), None if k % 4 == 0 else "a", 1) for k in range(3000)])
    states = [ek.profile_state(d) for d in (before, after)]
    out = {r["column"]: r for r in ek.profile_drift(*states).collect()}
    assert {c for c, r in out.items() if r.drifted} == {"x", "s", "gone", "new"}
    assert abs(out["x"].distance - 1 / 3) < 0.05 and out["y"].distance < 0.05 and out["s"].distance is None
    assert not any(r.drifted for r in ek.profile_drift(states[0], states[0]).collect())


def test_aligned_arrays(rows):
    df = rows("a array<int>, id int, b array<string>", ([1, 2, 3], 1, ["x"]), ([], 2, None), (None, 3, ["y", None]))
    assert as_set(ek.explode_aligned(df, ["a", "b"], "at")) == {
        (1, 1, "x", 0), (2, 1, None, 1), (3, 1, None, 2), (None, 2, None, None), (None, 3, "y", 0), (None, 3, None, 1)}
    assert ek.explode_aligned(df, ["a", "b"]).columns == ["a", "id", "b"]
    assert ek.flatten(df, aligned=True).count() == 6 and ek.flatten(df).count() == 3 + 1 + 2


def test_maps(rows):
    df = rows("id int, m map<string, struct<v: int>>", (1, {"k": (5,), "l": (None,)}), (2, {}), (3, None))
    assert as_set(ek.flatten(df, maps=True), "id", "m_key", "m_value_v") == {(1, "k", 5), (1, "l", None), (2, None, None), (3, None, None)}
    assert ek.flatten(df).columns == ["id", "m"]


def test_workbook_case(spark, rows, tmp_path):
    """Configuration, lengths and scales decide how both sides are read; a stage hop reads its own cells."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1;2.50\n2;3.25\n2;3.25\n")
    rows("id int, price decimal(9,2)", (1, None)).selectExpr("id", "cast(2.5 as decimal(9,2)) as price").write.parquet(str(tmp_path / "tgt"))
    (tmp_path / "config.csv").write_text(
        f"mappingname,m1\nsourcefileformat,delimited\nsourcefilepath,{tmp_path}/in/\nsourcefilename,a.txt\nsourcefilehasheader,N\n"
        f"sourcefiledelimiter,;\ntargetfileformat,parquet\ntargetfilepath,{tmp_path}\ntargetfilename,tgt\nremoveduplicates,Y\n"
        "stagedatabaseschemaname,s\nstagedatabasetablename,t\nstageconnectiontype,postgres\n")
    (tmp_path / "schema.csv").write_text(
        "tabletype,columnname,datatype,length,scale,primarykey\nsource,id,integer,,,Y\nsource,price,NUMBER,9,2,\n"
        "target,id,integer,,,Y\ntarget,price,decimal,40,2,\n")
    (tmp_path / "target_mapping.csv").write_text(
        "tgtcolumnname,srccolumnname,transformationtype,filteroutnulls,selectsqlexpression,filtersqlexpression,lookuptablename,"
        "lookupjoincolumnname,lookupreturnexpression\nid,id,directmapped,,,,,,\nprice,price,directmapped,,,,,,\n")
    case = workbook_case(spark, str(tmp_path))
    assert (case.name, case.keys, case.source.header, case.source.schema) == ("m1", ["id"], False, "`id` int, `price` decimal(9,2)")
    out = ek.mapped_rows(spark, str(tmp_path))
    assert dict(out.dtypes)["price"] == "decimal(38,2)" and out.count() == 2
    verdict = ek.run_suite(spark, [case], "content").first()
    assert (verdict.test_result, verdict.matched, verdict.only_source) == ("Failed", 1, 2)
    source, target = ek.workbook_sources({"stagedatabaseschemaname": "s", "stagedatabasetablename": "t", "targetfilename": "x"}, "stage_to_target")
    assert (source.format, source.table, target.path, target.header) == ("table", "s.t", "x", False)


def test_settings_of_a_store_stay_with_their_side(spark, rows, tmp_path):
    rows("a int", (1,)).write.parquet(str(tmp_path / "p"))
    spec = ek.SourceSpec("aws-s3", "parquet", path=str(tmp_path / "p"), conf={"fs.s3a.secret.key": "only here"})
    assert ek.read_source(spark, spec).count() == 1
    assert spark.conf.get("fs.s3a.secret.key", None) is None


def test_cases_run_side_by_side(spark, rows):
    """Same rows in the same order as one after another; a case that fails does not stop the others, and cases overlap in time."""
    side = lambda k: rows("id int, v int", *[(i, i % (k + 2)) for i in range(200)])
    cases = [ek.Case(f"c{k}", "id" if k != 3 else "nothing", side(k), side(k % 5), execute=True) for k in range(8)]
    seen = {n: ek.run_suite(spark, cases, "content", workers=n).collect() for n in (1, 4)}
    plain = lambda out: [(r.testcase_name, r.test_result, r.matched, r.mismatched) for r in out]
    assert plain(seen[1]) == plain(seen[4]) and seen[4][3].test_result == "Errored"
    overlaps = lambda out: sum(a.started < b.ended and b.started < a.ended for i, a in enumerate(out) for b in out[:i])
    assert overlaps(seen[1]) == 0 and overlaps(seen[4]) > 0
