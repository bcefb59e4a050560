"""Checks of one table in one pass, and the steps of a curve, against counts by hand."""

from pyspark.sql import functions as F

from riskframe.operators import attribution as AT
from riskframe.operators import checks as C


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_checks_of_a_table_take_one_pass(spark, tmp_path):
    rows = [(1, 0.2), (2, None), (3, 1.4), (4, 0.9), (None, -1.0)]
    spark.createDataFrame(rows, "a int, p double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    bad = {"in range": ~F.col("p").between(0, 1), "a is small": F.col("a") > 2, "even ones": F.when(F.col("a") % 2 == 0, F.col("p") > 0.5).otherwise(False)}
    one = C.report([], C.together(df, bad, as_many_as_agreed=F.abs(F.count(F.lit(1)) - 7)))
    assert scans(one) == 1
    assert {r["check"]: (r["bad"], r["result"]) for r in one.collect()} == {"in range": (3, "fail"), "a is small": (3, "fail"), "even ones": (2, "fail"), "as many as agreed": (2, "fail")}
    # The same by a check each.
    single = C.report([(name, C.count_bad(df, c)) for name, c in bad.items()])
    assert {tuple(r) for r in single.collect()} == {tuple(r) for r in one.collect() if r["check"] in bad}


def test_checks_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int")
    assert [tuple(r) for r in C.report([], C.together(empty, {"small": F.col("a") > 2}, rows=F.count(F.lit(1)))).collect()] == [("small", 0, "pass"), ("rows", 0, "pass")]


def test_decreasing_steps_of_a_curve(spark, tmp_path):
    spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double").write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    x = F.col("x")
    found = {name: C.decreasing(df, "x", f, 100) for name, f in {"up": x, "flat": F.lit(1.0), "down": -x, "bent": F.abs(x - 1), "null": F.when(x > 1, None).otherwise(x)}.items()}
    assert all(scans(d) == 1 for d in found.values())
    assert {name: d.first()[0] for name, d in found.items()} == {"up": 0, "flat": 0, "down": 100, "bent": 50, "null": 50}


def test_stored_group_sums_are_held_to_the_rows(spark):
    c = spark.createDataFrame([(1, "a1", 1.0), (1, "b1", 2.0), (2, "a1", -1.0), (3, "b1", 0.5)], "id int, feature string, contribution double")
    group = F.substring("feature", 1, 1)
    assert tuple(AT.reconstruction(c, group, "id").first()) == (3, 0)
    stored = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.1), (2, "a", -1.0), (9, "a", 1.0)], "id int, grp string, part double")
    # The first is off, the third has no groups, the ninth no row.
    assert tuple(AT.reconstruction(c, group, "id", stored=stored).first()) == (4, 3)
