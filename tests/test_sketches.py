"""Sketches and bin counts by day against the exact forms, and ranks of texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.operators import encode as E
from riskframe.operators import sketches as K


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(60_000).select((F.col("id") % 20).cast("int").alias("day"), F.when(F.col("id") % 11 != 0, F.exp(F.randn(2) + F.when(F.col("id") % 20 >= 15, 0.4).otherwise(0.0))).alias("a"), F.floor(F.rand(3) * 5).cast("double").alias("b"), F.lit(None).cast("double").alias("none"))
    return d.persist()


def test_merged_days_are_the_window_within_the_bound(spark, rows, tmp_path):
    features = ["a", "b", "none"]
    states = K.daily_sketches(rows, features, "day")
    for part in (states, states.where("day = 3")):  # a day again changes nothing
        K.write_days(part, f"{tmp_path}/s", "day")
    stored = spark.read.parquet(f"{tmp_path}/s")
    window = K.window_of(stored, "day", 2, 9)
    n = {r["feature"]: (r["n"], r["missing"]) for r in window.collect()}
    own = rows.where("day between 2 and 9").toPandas()
    assert n == {c: (len(own), int(own[c].isna().sum())) for c in features}
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    for r in K.sketched_quantiles(window, probs).collect():
        x = np.sort(own[r["feature"]].dropna().to_numpy())
        assert np.searchsorted(x, r["value"], "left") / len(x) - K.RANK_ERROR <= r["prob"] <= np.searchsorted(x, r["value"], "right") / len(x) + K.RANK_ERROR
    reference = {r["feature"]: r for r in K.sketched_reference(K.window_of(stored, "day", 0, 9)).collect()}
    exact = {r["feature"]: r for r in D.build_reference(rows.where("day < 10"), ["a", "b"]).collect()}
    assert reference["b"]["edges"] == exact["b"]["edges"] and reference["none"]["edges"] == []
    for c in ("a", "b"):
        assert reference[c]["missing_share"] == exact[c]["missing_share"] and sum(reference[c]["props"]) == pytest.approx(1)
        assert np.allclose(reference[c]["props"], exact[c]["props"], atol=2 * K.RANK_ERROR)


def test_drift_of_any_window_from_states(spark, rows, tmp_path):
    reference = D.build_reference(rows.where("day < 10"), ["a", "b"])
    K.write_days(K.daily_bins(rows, reference, ["a", "b"], "day"), f"{tmp_path}/b", "day")
    sketched = K.daily_sketches(rows, ["a", "b"], "day")
    for first, last in ((10, 14), (12, 19), (16, 16)):
        want = {r["feature"]: r["psi"] for r in D.daily_psi(rows.where(F.col("day").between(first, last)).withColumn("w", F.lit(1)), reference, ["a", "b"], "w").collect()}
        found = {r["feature"]: r["psi"] for r in K.window_psi(spark.read.parquet(f"{tmp_path}/b"), reference, "day", first, last).collect()}
        near = {r["feature"]: r["psi"] for r in K.sketched_psi(K.window_of(sketched, "day", first, last), reference).collect()}
        assert found == pytest.approx(want) and near == pytest.approx(want, abs=0.02)
    assert want["a"] > 0.1 > want["b"]


@pytest.mark.parametrize("share", [0.02, 0.5])
def test_ranks_of_texts(spark, monkeypatch, share):
    monkeypatch.setattr(E, "SHARE", share)
    levels = sorted({f"{(i * 7919) % 1000:x}é{i % 3}" for i in range(900)} | {"", "Z", "日本", "a b"}, key=str.encode)
    df = spark.createDataFrame([(g, x) for g in ("f", "g") for x in levels[: 900 if g == "f" else 3]], "feature string, level string").repartition(5)
    for g in ("f", "g"):
        found = {r["level"]: r["code"] for r in E.text_ranks(df, "feature", "level", "code").where(F.col("feature") == g).collect()}
        assert found == {x: i for i, x in enumerate(levels[: 900 if g == "f" else 3])}
    assert E.text_ranks(df.limit(0), "feature", "level", "code").collect() == []
