"""State that outlives a run: the history and the marks of incremental loads."""

import evenkeel as ek
from conftest import as_set
from evenkeel.sources import HISTORY, append_history, read_table

VERDICT = "testcase_name string, test_result string, testcase_type string, run_created_time string"
EVENT = "k int, ts timestamp, v int"


def test_a_load_appended_twice_is_stored_once(spark, rows, tmp_path):
    path = str(tmp_path / "history")
    one = rows(VERDICT, ("a", "Passed", "count", "r1"), ("b", "Failed", "null", "r1"), ("b", "Failed", "null", "r1"))
    append_history(one, path)
    append_history(one.repartition(3), path)
    append_history(rows(VERDICT, ("c", "Passed", "count", "r1")), path)
    append_history(rows(VERDICT, ("a", "Passed", "count", "r2")), path, load="r2")
    append_history(rows(VERDICT, ("a", "Failed", "count", "r2")), path, load="r2")
    history = read_table(spark, HISTORY, path)
    assert history.columns == [f.split()[0] for f in HISTORY.split(", ")]
    trend = {r.run_created_time: (r.total, r.failed) for r in ek.trend(history).collect()}
    assert trend == {"r1": (4, 2), "r2": (1, 1)}
    assert history.where("testcase_type = 'null'").count() == 2


def test_marks_of_three_loads(spark, rows, tmp_path):
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    path = str(tmp_path / "marks")
    assert ek.marks(spark, path).count() == 0
    src = [(1, at(1), 1), (2, at(2), 2), (3, None, 3)]
    load = lambda run, s, t, name="a": ek.incremental_state(rows(EVENT, *s), rows(EVENT, *t), ["k"], "ts", path, name, run).first()
    first = load("r1", src, src[:2])
    assert (first.mark, first.next_mark, first.src_rows, first.only_source, first.src_unstamped) == (None, "2024-01-01 02:00:00", 3, 1, 1)
    more = [*src, (4, at(5), 4), (5, at(1), 5)]
    second = load("r2", more, [*src[:2], (4, at(5), 9), (None, None, 0), (8, at(2), 1)])
    assert (second.mark, second.next_mark, second.src_rows, second.mismatched) == ("2024-01-01 02:00:00", "2024-01-01 05:00:00", 1, 1)
    assert (second.src_late, second.tgt_late, second.src_unstamped, second.tgt_unstamped) == (1, 1, 1, 1)
    again = load("r2", more, more)
    assert (again.mark, again.matched, again.src_late, ek.marks(spark, path).count()) == (second.mark, 1, 0, 2)
    assert load("r1", [], [], "b").mark is None
    idle = load("r3", [], [])
    assert (idle.mark, idle.next_mark, idle.src_rows) == ("2024-01-01 05:00:00", "2024-01-01 05:00:00", 0)
    assert as_set(ek.marks(spark, path), "source", "run") == {("a", "r1"), ("a", "r2"), ("a", "r3"), ("b", "r1")}
