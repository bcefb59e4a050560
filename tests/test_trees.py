"""Contributions of trees against the enumeration of all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import checks as C
from riskframe.operators import learn as L
from riskframe.operators import trees as T
from riskframe.plans import registry


def grown(r, features, depth, n=1.0, path=()):
    """(path, value) of the leaves of a random tree, features repeated on paths."""
    if depth == 0 or (depth < 3 and r.random() < 0.2):
        return [(list(path), float(r.normal()))]
    f, threshold, share = int(r.integers(features)), float(np.round(r.normal(), 1)), float(r.uniform(0.1, 0.9))
    return grown(r, features, depth - 1, n, (*path, (f, threshold, True, share))) + grown(r, features, depth - 1, n, (*path, (f, threshold, False, 1 - share)))


def expected(leaves, x, known):
    """The value with some features known: turns on others by their shares."""
    total = 0.0
    for path, value in leaves:
        w = 1.0
        for f, threshold, left, share in path:
            w *= float((x[f] <= threshold) == left) if f in known else share
        total += w * value
    return total


@pytest.mark.parametrize("tabled", [0, 10])
def test_contributions_are_shapley_values(monkeypatch, tabled):
    monkeypatch.setattr(T, "TABLED", tabled)
    r = np.random.default_rng(5)
    for features, depth in ((1, 2), (3, 3), (5, 6)):
        paths = grown(r, features, depth) + grown(r, features, depth)
        leaves = [T.leaf(p, v) for p, v in paths]
        model = T.Trees(leaves, sum(x.value * x.shares.prod() for x in leaves))
        x = np.round(r.normal(size=(6, features)), 1)
        found = model.contributions(x, features)
        for row, own in zip(x, found, strict=True):
            for j in range(features):
                others = [f for f in range(features) if f != j]
                want = sum(factorial(s) * factorial(features - s - 1) / factorial(features) * (expected(paths, row, {*c, j}) - expected(paths, row, set(c))) for s in range(features) for c in combinations(others, s))
                assert own[j] == pytest.approx(want, abs=1e-9)
            assert own.sum() + model.base == pytest.approx(expected(paths, row, set(range(features))), abs=1e-9)


def test_fitted_trees_add_up_and_pass_the_explanation_checks(spark):
    r = np.random.default_rng(2)
    n = 900
    a, b, c = r.normal(size=(3, n))
    y = (a + 0.8 * a * b > 0.5).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), None if i % 9 == 0 else float(b[i]), float(c[i])) for i in range(n)], "id long, y int, a double, b double, c double")
    fitted = L.fit(df.where("id < 600"), "id", "y", ["a", "b", "c"], L.Arm("gbt", strength=0.2, trees=15, depth=4))
    valid = df.where("id >= 600")
    contributions, base = fitted.explain(valid, "id")
    contributions.persist()
    margins = fitted.score(valid).select("id", F.log(F.col("p") / (1 - F.col("p"))).alias("margin"))
    both = contributions.groupBy("id").agg(F.sum("contribution").alias("s")).join(margins, "id").collect()
    assert len(both) == 300 and max(abs(x["s"] + base - x["margin"]) for x in both) < 1e-6
    mass = {x["feature"]: x["m"] for x in contributions.groupBy("feature").agg(F.sum(F.abs("contribution")).alias("m")).collect()}
    assert set(mass) == {"a", "b", "c"} and mass["a"] > mass["b"] > 3 * mass["c"]
    groups = {"a": "first", "b": "first", "c": "second"}
    report = C.explanation_report(contributions, margins, "id", groups, F.when(F.col("feature") == "c", "x").otherwise("y"), df.where("id < 600"), base, ("platt", 1.1, 0.2), 1e-6)
    assert all(x["result"] == "pass" for x in report.collect())


def test_no_rows_give_no_contributions(spark):
    model = T.Trees([T.leaf([(0, 1.0, True, 0.5)], 1.0), T.leaf([(0, 1.0, False, 0.5)], -1.0)], 0.0)
    assert T.tree_contributions(spark.createDataFrame([], "id long, a double"), "id", ["a"], model).collect() == []
    found = T.tree_contributions(spark.createDataFrame([(None, 1.0), (2, 2.0), (2, 2.0)], "id long, a double"), "id", ["a"], model).collect()
    assert sorted((x[0] is not None, x[2]) for x in found) == [(False, 1.0), (True, -1.0), (True, -1.0)]


def test_compact_models_fit_the_whole_once_and_contributions_need_no_shuffle(spark, monkeypatch):
    r = np.random.default_rng(3)
    n = 600
    a, b, c = r.normal(size=(3, n))
    df = spark.createDataFrame([(i, int(a[i] + 0.3 * b[i] > 0.4), float(a[i]), None if i % 7 == 0 else float(b[i]), float(c[i])) for i in range(n)], "id long, y int, a double, b double, c double")
    train, valid = df.where("id < 400"), df.where("id >= 400")
    arm = L.Arm("gbt", strength=0.2, trees=5, depth=3)
    fitted = L.fit(train, "id", "y", ["a", "b", "c"], arm)
    contributions, _ = fitted.explain(train, "id")
    assert "Exchange" not in contributions._jdf.queryExecution().executedPlan().toString()
    assert contributions.count() == contributions.dropDuplicates(["id", "feature"]).count() == 1_200
    ranking = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "feature string, importance double")
    plain = L.compact_models(train, valid, "id", "y", ranking, [1], arm).collect()
    fits, own = [], L.fit
    monkeypatch.setattr(L, "fit", lambda *x, **k: fits.append(x[3]) or own(*x, **k))
    monkeypatch.setattr(L, "prepare", lambda *x: pytest.fail("medians were taken again"))
    found = L.compact_models(train, valid, "id", "y", ranking, [1], arm, fitted).collect()
    assert [x["k"] for x in found] == [3, 1] and all(tuple(x) == pytest.approx(tuple(z), abs=1e-9) for x, z in zip(found, plain, strict=True))
    assert fits == [["a"]]
    with pytest.raises(ValueError):
        L.compact_models(train, valid, "id", "y", ranking.where("feature <> 'c'"), [1], arm, fitted)


def test_columns_of_one_name_are_one_feature(spark):
    model = T.Trees([T.leaf([(0, 1.0, True, 0.5), (1, 0.5, True, 0.25)], 2.0), T.leaf([(0, 1.0, False, 0.5)], -1.0)], 0.0)
    df = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (2, 2.0, 1.0, 3.0)], "id long, a double, a_missing double, b double")
    apart = {(x["id"], x["feature"]): x["contribution"] for x in T.tree_contributions(df, "id", ["a", "a_missing", "b"], model).collect()}
    found = T.tree_contributions(df, "id", ["a", "a_missing", "b"], model, ["a", "a", "b"]).collect()
    assert {(x["id"], x["feature"]): x["contribution"] for x in found} == {(i, f): apart[i, f] + (apart[i, "a_missing"] if f == "a" else 0.0) for i in (1, 2) for f in ("a", "b")}


def test_the_contribution_query_explains_its_rows_once(spark):
    plan = registry.queries()["m20_tree_contributions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # three passes read a table of them


def test_contributions_without_flags_that_say_nothing(spark):
    """Features without gaps in training bring no flag to the trees, and later nulls of theirs are explained all the same."""
    rows = spark.createDataFrame([(i, int(i % 13 > 6), float(i % 13), None if i % 4 == 0 else float(i % 5)) for i in range(120)], "id long, y int, a double, b double")
    fitted = L.fit(rows, "id", "y", ["a", "b"], L.Arm("gbt", strength=0.1, trees=3, depth=3))
    later = spark.createDataFrame([(1, None, 2.0), (2, 9.0, None)], "id long, a double, b double")
    contributions, base = fitted.explain(later, "id")
    assert fitted.model.numFeatures == 3 and contributions.count() == 4
    margins = fitted.score(later).select("id", F.log(F.col("p") / (1 - F.col("p"))).alias("margin"))
    both = contributions.groupBy("id").agg(F.sum("contribution").alias("total")).join(margins, "id").collect()
    assert len(both) == 2 and all(r["total"] + base == pytest.approx(r["margin"]) for r in both)
