"""Joins of bucketed tables: no shuffle on either side."""

import pytest
from pyspark.sql import functions as F

from riskframe.sources import io


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_without_an_exchange(spark, tmp_path, how):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(2_000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
        b = spark.range(0, 900, 2).select(F.col("id").alias("k"), F.lit(1).alias("w"))
        x, y = (io.write_bucketed(df, f"{tmp_path}/{n}", f"bucketed_{how}_{n}", "k", 8) for n, df in (("a", a), ("b", b)))
        found, plain = x.join(y, "k", how), a.join(b, "k", how)
        assert "Exchange" not in plan_of(found) and "Exchange" in plan_of(plain)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for n in ("a", "b"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{how}_{n}")
