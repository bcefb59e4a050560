"""Categorical encoders fitted on training rows only, and the column drops that go with them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, level) of every row, null levels left out; levels as text."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "feature", "level").where("level is not null")


def fit_frequency(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, level, n)."""
    return levels(train, columns).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))


def fit_ordinal(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, level, code): levels in the order of their text, from 0."""
    return text_ranks(levels(train, columns).distinct(), "feature", "level", "code")


#: Ranges of the order of text_ranks, and the share of the levels that their ends are taken from.
RANGES, SHARE = 64, 0.02


def text_ranks(distinct: DataFrame, group: str, text: str, name: str) -> DataFrame:
    """distinct (pairs of group and text, each once) with the rank of the text within its group, from 0.

    Texts belong to ranges whose ends are those of a sample: ranks are taken within a range, from what the ranges before
    it hold. No task orders a whole group; the sample bears on the cost alone.
    """
    cut = distinct.select(F.col(group).alias("_g"), F.col(text).alias("_x")).sample(SHARE, seed=1)
    place = F.ntile(RANGES).over(Window.partitionBy("_g").orderBy("_x"))
    ends = cut.withColumn("_n", place).groupBy("_g", "_n").agg(F.min("_x").alias("_x")).groupBy("_g").agg(F.array_sort(F.collect_set("_x")).alias("_ends"))
    ends = distinct.sparkSession.createDataFrame(ends.collect(), ends.schema)  # few groups of at most RANGES texts
    dealt = distinct.join(ends, distinct[group].eqNullSafe(ends["_g"]), "left")
    dealt = dealt.select(*distinct.columns, F.coalesce(F.size(F.filter("_ends", lambda e: e <= F.col(text))), F.lit(0)).alias("_r"))
    totals = dealt.groupBy(F.col(group).alias("_g"), F.col("_r").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy("_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_g", "_at", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_r").orderBy(text)) - 1
    ranked = dealt.withColumn("_own", own).join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_at")))
    return ranked.select(*distinct.columns, (F.col("_own") + F.col("_before")).cast("int").alias(name))


def encode(df: DataFrame, maps: DataFrame, columns: list[str], value: str, suffix: str, unseen: int) -> DataFrame:
    """Adds column + suffix: the map's value, `unseen` for a level that is not in it, null for null.

    Maps have a row a level; Spark broadcasts them if they are small enough, else it shuffles.
    """
    for c in columns:
        own = maps.where(F.col("feature") == c).select(F.col("level").alias("_level"), F.col(value).alias("_value"))
        df = df.join(own, F.col(c).cast("string") == F.col("_level"), "left")
        df = df.withColumn(c + suffix, F.when(F.col(c).isNotNull(), F.coalesce("_value", F.lit(unseen)))).drop("_level", "_value")
    return df


def sparse_columns(train: DataFrame, columns: list[str], linked: str, limit: float = 0.95) -> DataFrame:
    """(feature, missing, dropped): missing share among the linked rows alone."""
    wide = train.where(linked).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot([], columns, "feature", "missing").withColumn("dropped", F.col("missing") > limit)


class FeatureEncoder:
    """Frequency and ordinal maps, constant columns dropped, and a fixed order of the features."""

    def __init__(self, frequency: list[str], ordinal: list[str], numeric: list[str]) -> None:
        self.frequency, self.ordinal, self.numeric = frequency, ordinal, numeric
        self.names: list[str] = []

    def fit(self, train: DataFrame) -> FeatureEncoder:
        from riskframe.operators.profile import constant_columns

        self.freq_map, self.ord_map = fit_frequency(train, self.frequency), fit_ordinal(train, self.ordinal)
        constant = {r["feature"] for r in constant_columns(train, self.numeric).where("constant").collect()} if self.numeric else set()
        self.names = [c for c in self.numeric if c not in constant] + [f"{c}_freq" for c in self.frequency] + [f"{c}_code" for c in self.ordinal]
        return self

    def save(self, path: str) -> None:
        """The maps as Parquet, and the column lists and feature names as a line of JSON, under path."""
        self.freq_map.write.mode("overwrite").parquet(f"{path}/frequency")
        self.ord_map.write.mode("overwrite").parquet(f"{path}/ordinal")
        lists = json.dumps({"frequency": self.frequency, "ordinal": self.ordinal, "numeric": self.numeric, "names": self.names})
        self.freq_map.sparkSession.createDataFrame([(lists,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lists")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureEncoder:
        lists = json.loads(spark.read.text(f"{path}/lists").first()[0])
        out = cls(lists["frequency"], lists["ordinal"], lists["numeric"])
        out.names, out.freq_map, out.ord_map = lists["names"], spark.read.parquet(f"{path}/frequency"), spark.read.parquet(f"{path}/ordinal")
        return out

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        df = encode(df, self.freq_map, self.frequency, "n", "_freq", 0)
        return encode(df, self.ord_map, self.ordinal, "code", "_code", -1).select(*keep, *self.names)
