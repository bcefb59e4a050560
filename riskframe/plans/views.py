"""The transaction view over the events table that most queries read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.io import shared_folder as folder  # noqa: F401

EPOCH = 1_704_067_200  # 2024-01-01
SPLITS = {"train": (0, 14), "valid": (21, 25), "test": (25, 30)}

TX = """WITH tx AS (
  SELECT *, CAST(floor(t / 86400.0) AS INTEGER) AS tx_day, (k + 0.5) / 100 AS p, k % 5 AS k5, k % 3 AS k3,
         CASE WHEN t < 14 * 86400 THEN 'train' WHEN t >= 21 * 86400 AND t < 25 * 86400 THEN 'valid' WHEN t >= 25 * 86400 AND t < 30 * 86400 THEN 'test' END AS split
  FROM (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t, user_id, event_type, value AS amount,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, CAST(event_type = 'error' AS INTEGER) AS y FROM events)
)
"""


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH
    d = e.select(F.col("event_id").alias("id"), t.alias("t"), "user_id", "event_type", F.col("value").alias("amount"), k.alias("k"), (F.col("event_type") == "error").cast("int").alias("y"))
    d = d.withColumns({"tx_day": F.floor(F.col("t") / 86_400).cast("int"), "p": (F.col("k") + F.lit(0.5)) / 100, "k5": F.col("k") % 5, "k3": F.col("k") % 3})
    from riskframe.operators.split import chrono_split

    return d.withColumn("split", chrono_split(F.col("tx_day"), SPLITS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
