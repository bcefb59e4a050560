"""Learning: oversampling against plain Python, folds that leak nothing, scores that separate, calibration."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import learn as L
from riskframe.operators import ordered as O
from riskframe.operators.split import Fold

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    n = 1_200
    a, b = r.normal(size=n), r.normal(size=n)
    y = (a + 0.5 * b + 0.3 * r.normal(size=n) > 1.3).astype(int)
    data = [(i, i // 60, int(y[i]), float(a[i]), None if i % 17 == 0 else float(b[i])) for i in range(n)]
    return spark.createDataFrame(data, "id long, tx_day int, y int, a double, b double").persist()


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_smote_by_plain_python(spark, rows):
    d = rows.where("b IS NOT NULL").select("id", "y", *FEATURES)
    local = d.collect()
    minority = sorted((r["id"], (r["a"], r["b"])) for r in local if r["y"] == 1)
    want = 0.7 * sum(r["y"] == 0 for r in local) / len(minority) - 1
    made = []
    for i, x in minority:
        near = sorted((round((x[0] - z[0]) ** 2 + (x[1] - z[1]) ** 2, 9), j, z) for j, z in minority if j != i)[:5]
        for c in range(1, int(want) + (uniform(i, "n0") < want - int(want)) + 1):
            z = near[int(uniform(i, c, "p0") * len(near))][2]
            u = uniform(i, c, "u0")
            made.append((x[0] + u * (z[0] - x[0]), x[1] + u * (z[1] - x[1])))
    found = [(r["a"], r["b"]) for r in L.smote(d, "id", "y", FEATURES, 0.7).where("id IS NULL").collect()]
    assert len(found) == len(made)
    assert np.allclose(sorted(found), sorted(made))


def test_smote_leaves_alone_what_needs_none(rows):
    d = rows.select("id", "y", "a")
    assert L.smote(d, "id", "y", ["a"], 0.01).count() == d.count()
    assert L.smote(d.where("y = 0"), "id", "y", ["a"], 1.0).count() == d.where("y = 0").count()


def test_each_fold_is_fitted_on_its_training_rows_only(rows):
    folds = [Fold(0, (0, 7), (9, 12)), Fold(1, (0, 11), (13, 19))]
    arm = L.Arm("logreg", ratio=0.6)
    oof = L.out_of_fold(rows, "id", "y", FEATURES, folds, arm).persist()
    assert oof.count() == oof.select("id").distinct().count() == rows.where("tx_day BETWEEN 9 AND 19").count()
    # Rows outside a fold's training block bear on nothing: wild values there leave its scores as they are.
    wild = rows.withColumn("a", F.when(F.col("tx_day") == 8, F.lit(1e6)).otherwise(F.col("a")))
    again = L.out_of_fold(wild, "id", "y", FEATURES, folds[:1], arm)
    both = oof.where("fold = 0").select("id", "p").join(again.select("id", F.col("p").alias("q")), "id")
    assert both.where("abs(p - q) > 1e-9").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        L.out_of_fold(rows, "id", "y", FEATURES, [folds[0], Fold(1, (0, 8), (12, 14))], arm)


@pytest.mark.parametrize("model", ["logreg", "gbt"])
def test_models_separate_and_take_nulls(rows, model):
    m = L.compare(rows.where("tx_day < 14"), {"valid": rows.where("tx_day >= 14")}, "id", "y", FEATURES, {"m": L.Arm(model, strength=0.1 if model == "gbt" else 1e-3)}).first()
    assert m["roc_auc"] > 0.93 and m["pr_auc"] > 3 * m["prevalence"]


def test_calibration_brings_a_weighted_arm_to_the_rate(rows):
    folds = [Fold(0, (0, 5), (6, 9)), Fold(1, (0, 9), (10, 13))]
    train, valid = rows.where("tx_day < 14"), rows.where("tx_day >= 14")
    arm = L.Arm("logreg", weighted=True)
    found = L.calibrator(L.out_of_fold(train, "id", "y", FEATURES, folds, arm), "y")
    s = L.refit_and_score(train, valid, "id", "y", FEATURES, arm, found).agg(F.avg("y"), F.avg("p_raw"), F.avg("p")).first()
    assert found[0] in ("shift", "platt") and abs(s[2] - s[0]) < 0.03 < s[1] - s[0]


def test_sums_and_quantiles_of_crowded_values(spark, monkeypatch):
    """Nearly all values in a thousandth of the range, ties, two groups, some nulls: as numpy has it."""
    monkeypatch.setattr(O, "SHARE", 0.5)
    r = np.random.default_rng(0)
    x = np.concatenate([np.round(r.random(2_000) / 1_000, 5), r.random(40) * 1e6, -r.random(40)])
    data = [("g" if i % 3 else None, float(v)) for i, v in enumerate(x)] + [("g", None)] * 5
    df = spark.createDataFrame(data, "g string, x double")
    probs = [0.0, 0.1, 0.37, 0.5, 0.999, 1.0]
    for g in ("g", None):
        own = np.array([v for k, v in data if k == g and v is not None])
        found = {q["prob"]: q["value"] for q in O.quantiles(df, ["g"], "x", probs).collect() if q["g"] == g}
        assert np.allclose([found[p] for p in probs], np.quantile(own, probs), rtol=1e-12)
    counts = df.where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    edges = O.bucket_edges(df, "x")
    rows = sorted(O.next_value(O.running(counts, [], "x", ["n"], edges), [], "x", edges).collect(), key=lambda r: r["x"])
    values, n = np.unique(x, return_counts=True)
    assert [r["upto_n"] for r in rows] == np.cumsum(n).tolist() and {r["all_n"] for r in rows} == {len(x)}
    assert [r["next"] for r in rows] == [*values[1:].tolist(), None]


def test_known_neighbours_give_the_same_synthetic_rows(rows):
    d = rows.where("b IS NOT NULL").select("id", "y", *FEATURES)
    near = L.neighbours(d, "id", "y", FEATURES).persist()
    for ratio in (0.5, 0.9):
        found, want = ([sorted((r["a"], r["b"]) for r in L.smote(d, "id", "y", FEATURES, ratio, near=z).where("id IS NULL").collect()) for z in (near, None)])
        assert found == want and found


def test_arms_share_medians_and_a_fold_is_ranked_once(spark, rows, monkeypatch):
    folds = [Fold(0, (0, 5), (7, 9)), Fold(1, (0, 9), (11, 13))]
    arms = [L.Arm("logreg"), L.Arm("logreg", weighted=True)]
    train, valid = rows.where("tx_day < 14"), rows.where("tx_day >= 14")
    prepared, ranked, prepare, ranking = [], [], L.prepare, L.ranking_metrics
    monkeypatch.setattr(L, "prepare", lambda *x: prepared.append(x) or prepare(*x))
    monkeypatch.setattr(L, "ranking_metrics", lambda *x: ranked.append(x) or ranking(*x))
    found = L.select_arm(train, valid, "id", "y", FEATURES, folds, arms, lambda d: d.agg(F.count(F.lit(1)).alias("n"))).collect()
    assert len(found) == 2 and len(prepared) == 3
    ranked.clear()
    found = {r["arm"]: r for r in L.search(rows, "id", "y", FEATURES, folds, arms).collect()}
    assert len(ranked) == 2
    each = {arm.name: [r["pr_auc"] for r in L.cross_validate(rows, "id", "y", FEATURES, folds, arm).collect()] for arm in arms}
    assert {n: r["mean_pr_auc"] for n, r in found.items()} == pytest.approx({n: sum(x) / 2 for n, x in each.items()}, abs=1e-9)
    empty = L.search(rows, "id", "y", FEATURES, [Fold(0, (0, 5), (90, 95))], arms[:1]).collect()
    assert [r["mean_pr_auc"] for r in empty] == [None]


def test_rows_laid_out_are_the_same_rows_in_order(spark, rows):
    out = L.laid_out(rows.coalesce(1), "id")
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    assert not out.where("id IS NULL").count() and "LogicalRDD" not in out._jdf.queryExecution().analyzed().toString()


def test_flags_of_features_without_gaps_are_left_out(spark):
    """A flag that is 0 in all training rows is no column of the model; the null of a later row is filled all the same."""
    rows = spark.createDataFrame([(i, i % 2, float(i), None if i % 5 == 0 else 1.0) for i in range(20)], "id long, y int, a double, b double")
    found = L.prepare(rows, ["a", "b"])
    assert found.columns == ["a", "b", "b_missing"] and found.of(["a"]).columns == ["a"]
    fitted = L.fit(rows, "id", "y", ["a", "b"], L.Arm("gbt", trees=2, depth=2))
    later = spark.createDataFrame([(1, None, None)], "id long, a double, b double")
    assert fitted.model.numFeatures == 3 and fitted.score(later).count() == 1


def test_probes_share_their_passes(spark):
    """Two probes at once say what each says alone; a part without labels has no figures."""
    rows = spark.createDataFrame([(i, i * 7 % 10 // 5, float(i % 13), float(i * 7 % 10 // 5)) for i in range(200)], "id long, y int, a double, leak double")
    parts = {"valid": rows.where("id % 3 = 0"), "none": rows.where("false")}
    both = L.leakage_probe(rows, parts, "id", "y", {"clean": ["a"], "leak": ["a", "leak"]})
    for name, features in (("clean", ["a"]), ("leak", ["a", "leak"])):
        alone = {r["part"]: r for r in L.leakage_probe(rows, parts, "id", "y", features).collect()}
        for r in both.where(both["name"] == name).collect():
            assert r["n"] == alone[r["part"]]["n"] and r["plausible"] == alone[r["part"]]["plausible"]
            assert r["pr_auc"] == (None if r["part"] == "none" else pytest.approx(alone[r["part"]]["pr_auc"]))
            assert r["part"] == "none" or r["plausible"] == (name == "clean")


def test_tree_search_takes_all_folds_and_the_whole_grid(spark, monkeypatch):
    from riskframe.plans import learning

    asked = []
    monkeypatch.setattr(learning.L, "search", lambda d, key, y, features, folds, arms: asked.append((folds, arms)) or d.select("id"))
    learning.m10_tree_search(spark, "/root/testdata/sf0.001")
    ((folds, arms),) = asked
    assert folds == learning.FOLDS and len(folds) == 3
    grid = {(a.strength, a.trees, a.depth) for a in arms}
    assert len(grid) == len(arms) == len({x[0] for x in grid}) * len({x[1] for x in grid}) * len({x[2] for x in grid}) == 8
