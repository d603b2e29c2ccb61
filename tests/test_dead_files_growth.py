"""Files and the ends of references are aggregated together."""

from repolens.operators import refactor


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dead_files_in_one_aggregate(spark):
    f = spark.createDataFrame([("p", "a/x.py"), ("p", "a/y.py"), ("p", "a/z.py"), ("p", "a/z.py"), ("p", "a/w.py"), ("p", "top.py"), ("p", None), (None, "a/x.py")], "project_id string, path string")
    e = spark.createDataFrame([("p", "a/x.py", ".y"), (None, "a/x.py", "a/w.py"), ("p", None, "a/q.py")], "project_id string, src string, dst string")
    out = refactor.dead_files(f, e)
    assert "LeftAnti" not in _plan(out)  # three joins of all files before
    assert sorted(map(tuple, out.collect())) == [("p", "a/w.py", "LOW"), ("p", "a/z.py", "LOW")]
