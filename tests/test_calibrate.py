import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import attribution as AT
from riskframe.operators import audit as AU
from riskframe.operators import calibrate as CA
from riskframe.plans import registry
from riskframe.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scores(spark):
    """Positives follow a known distortion of p."""
    rows = []
    for i in range(1, 100):
        p = i / 100
        true = 1 / (1 + math.exp(-(0.7 * math.log(p / (1 - p)) - 0.8)))
        ones = round(1000 * true)
        rows += [(p, 1, ones), (p, 0, 1000 - ones)]
    df = spark.createDataFrame(rows, "p double, y int, n int")
    return df.select("p", "y", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


def test_platt_finds_the_distortion(scores):
    a, b = CA.fit_platt(scores, "y", "p")
    assert abs(a - 0.7) < 0.01 and abs(b + 0.8) < 0.01


def test_shift_balances_the_sum(scores):
    b = CA.fit_shift(scores, "y", "p")
    z = F.ln(F.col("p") / (1 - F.col("p"))) + b
    off = scores.agg(F.avg(1 / (1 + F.exp(-z)) - F.col("y"))).first()[0]
    assert abs(off) < 1e-6


def test_fits_need_both_classes(spark):
    one = spark.createDataFrame([(0.2, 1), (0.4, 1)], "p double, y int")
    assert CA.fit_shift(one, "y", "p") is None and CA.fit_platt(one, "y", "p") is None
    assert CA.fit_shift(one.limit(0), "y", "p") is None


def test_choice_prefers_the_better_loss(scores):
    rows = CA.choose(scores.withColumn("fold", F.col("i") % 3), "y", "p", "fold").collect()
    assert [r["kind"] for r in rows] == ["platt", "shift", "identity"]


def test_choice_query_has_three_kinds(spark):
    assert registry.queries()["m14_calibrator_choice"](spark, SF).count() == 3


def test_contributions_add_up(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0), (3, 5.0, 8.0)], "id long, a double, b double")
    total = AT.linear_contributions(df, "id", {"a": 2.0, "b": -1.0}).groupBy("id").agg(F.sum("contribution").alias("s"))
    assert {r["id"]: r["s"] for r in total.collect()} == {1: -4.0, 2: 2.0, 3: 2.0}


def test_structure_finds_each_fault(spark):
    rows = [(1, "train", 0, 1.0), (2, "train", 3, 1.0), (2, "test", 3, 2.0), (4, "test", 6, 2.0)]
    df = spark.createDataFrame(rows, "id long, split string, tx_day int, x double")
    seen = {r["check"]: r["seen"] for r in AU.structure(df, "id", ["x"], ["x"], ["train", "test"], 0).collect()}
    assert seen == {"ordered": 1, "constant": 1, "forbidden": 1, "disjoint": 1}


def test_payloads_round_trip(spark):
    df = spark.createDataFrame([(1, 5, None, 2.5), (2, 6, 1.0, 1.0)], "id long, day int, v1 double, v2 double")
    back = io.parse_payloads(io.day_payloads(df, "day", 5, ["id"], ["v1", "v2"]), "id long", ["v1", "v2"])
    assert [tuple(r) for r in back.collect()] == [(1, None, 2.5)]
    with pytest.raises(ValueError):
        io.decision_log(df, df, "id", "day", ["v1; drop"])


def test_shift_sums_of_tasks_add_up(spark):
    r = np.random.default_rng(4)
    z, y, k = r.normal(size=500), r.integers(0, 2, 500), r.integers(1, 5, 500)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(z, y, k, strict=True)], "_z double, _y double, _k double").repartition(3)
    points = [-750.0, -1.0, 0.0, 2.5, 30.0]
    with np.errstate(over="ignore"):
        want = [float(((1 / (1 + np.exp(-(z + b))) - y) * k).sum()) for b in points]
    assert CA.excess(rows, points) == pytest.approx(want, abs=1e-9)
