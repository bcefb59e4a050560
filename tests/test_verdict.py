"""The measured verdict's signals follow labels and scores."""

import pytest
from pyspark.sql import functions as F

from riskframe.plans import monitoring


def test_signals_follow_labels_and_scores(spark):
    d = monitoring.data(spark, "/root/testdata/sf0.001").persist()
    late = F.col("tx_day") >= 20
    found = d.select("id", (F.col("p") >= 0.7).cast("int").alias("y"))
    missed = d.select("id", F.when(late, F.col("p") < 0.7).otherwise(F.col("p") >= 0.7).cast("int").alias("y"))
    a, b = ({r["tx_day"]: r for r in monitoring.signals(d, labels).collect()} for labels in (found, missed))
    last = max(a)
    assert last > 27 and a[last]["rolling_recall"] == 1.0 and b[last]["rolling_recall"] == 0.0
    moved = d.withColumn("p", F.when(late, F.lit(0.995)).otherwise(F.col("p")))
    c = {r["tx_day"]: r for r in monitoring.signals(moved, found).collect()}
    assert c[last]["score_psi"] > a[last]["score_psi"] + 1 and c[last]["excess"] == pytest.approx(a[last]["excess"])
