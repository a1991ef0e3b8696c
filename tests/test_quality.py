"""Declarative tests on a fixture with planted violations."""

from routewise.operators.quality import DataTest, null_profile, run_tests, violations


def test_suite_counts(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.5), (1, "b", 2.0), (2, None, -1.0), (None, "zz", 1.0)],
        "id int, kind string, load double")
    parent = spark.createDataFrame([(1,)], "id int")
    tests = [DataTest("not_null", "id"), DataTest("unique", "id"),
             DataTest("accepted_values", "kind", values=("a", "b")),
             DataTest("accepted_range", "load", lo=0, hi=1.5),
             DataTest("positive", "load"),
             DataTest("relationships", "id", parent="p", parent_col="id"),
             DataTest("unique_combination", "", columns=("id", "kind"))]
    got = {(r.test, r.column_name): r.failures for r in run_tests("m", df, tests, {"p": parent}).collect()}
    assert got == {("not_null", "id"): 1, ("unique", "id"): 1, ("accepted_values", "kind"): 1,
                   ("accepted_range", "load"): 2, ("positive", "load"): 1,
                   ("relationships", "id"): 1, ("unique_combination", "id,kind"): 0}
    assert violations(df, tests[2]).count() == 1


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x"), (4, "y"), (5, "z")], "a int, b string")
    got = {r.column_name: (r.nulls, r.null_rate, r.flagged) for r in null_profile(df).collect()}
    assert got == {"a": (1, 0.2, False), "b": (2, 0.4, True)}
