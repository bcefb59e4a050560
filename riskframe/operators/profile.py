"""Profiles of a table: integrity, balance, rates by group, missingness, correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.ordered import quantiles


def split_summary(df: DataFrame, split: str = "split", day: str = "tx_day", y: str = "y") -> DataFrame:
    """Rows, day range, share of all rows, positives and rate of each split."""
    g = df.where(F.col(split).isNotNull()).groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("day_min"), F.max(day).alias("day_max"), F.sum(y).alias("positives"), F.avg(y).alias("rate"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def rate_by(df: DataFrame, column: str, y: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))


def history_coverage(df: DataFrame, day: str, count: str) -> DataFrame:
    return df.groupBy(day).agg(F.avg((F.col(count) > 0).cast("double")).alias("covered"), F.avg(count).alias("mean_history"))


def integrity(df: DataFrame, key: str, y: str, amount: str) -> DataFrame:
    """One row: rows, repeated keys, distinct labels, range of amounts, amounts of zero or less."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(amount).alias("_lo"), F.max(amount).alias("_hi"), F.count_if(F.col(amount) <= 0).alias("_bad"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    return per_key.agg(F.sum("_n").alias("n"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"), F.min("_lo").alias("amount_min"), F.max("_hi").alias("amount_max"), F.sum("_bad").alias("nonpositive"), F.min("_y0").alias("label_min"), F.max("_y1").alias("label_max"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, null among them."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    g = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def describe_by(df: DataFrame, group: str, x: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    probs = {25: 0.25, 50: 0.5, 75: 0.75}
    q = quantiles(df.select(group, F.col(x).alias("x")), [group], "x", list(probs.values())).groupBy(F.col(group).alias("_g"))
    q = q.agg(*(F.max(F.when(F.col("prob") == v, F.col("value"))).alias(f"q{k}") for k, v in probs.items()))
    return g.join(q, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing): one pass over the table, then one row for each column."""
    wide = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot([], columns, "feature", "missing")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for a < b over rows where both are present; null where one is constant.

    Each task sums products of whole blocks of columns, centred on their means: as many numbers as there are pairs,
    whatever the rows.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    row = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first()
    means = np.array([row[c] or 0.0 for c in columns])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(columns)
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - means
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
        i, j = np.triu_indices(k, 1)
        n, s, q, p = total
        out = [i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32 if at < 2 else float)) for at, v in enumerate(out)], ["i", "j", *SUMS])

    numbers = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    sums = numbers.mapInArrow(products, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in SUMS))
    n = F.col("n")

    def spread(s: str, q: str, at: Column) -> Column:
        """n^2 times the variance; null where it is no more than rounding leaves of a constant."""
        v = n * F.col(q) - F.col(s) ** 2
        mean = F.array(*(F.lit(float(m)) for m in means))[at]
        return F.when((v > 1e-12 * n * F.col(q)) & (F.col(q) > n * (1e-12 * mean) ** 2), v)

    names = F.array(*(F.lit(c) for c in columns))
    corr = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("sx", "sxx", F.col("i")) * spread("sy", "syy", F.col("j")))
    return sums.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), corr.alias("corr"))


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, distinct) of the values that are not null: values collapse before they are counted."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "feature", "v").where("v IS NOT NULL")
    return long.groupBy("feature", "v").agg(F.lit(1).alias("one")).groupBy("feature").agg(F.count("one").alias("distinct"))


def missing_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that have the same number of nulls: (missing, columns)."""
    long = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).unpivot([], columns, "feature", "missing")
    return long.groupBy("missing").agg(F.sort_array(F.collect_list("feature")).alias("features"))


def reduce_correlated(df: DataFrame, columns: list[str], limit: float = 0.75) -> list[str]:
    """The columns kept: within a block of equal null counts, by distinct count from high to low (ties by place), a
    column stays if its correlation with every one kept is below the limit. Two aggregates; greedy on k x k numbers."""
    missing = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    distinct = {r["feature"]: r["distinct"] for r in distinct_counts(df, columns).collect()}
    kept: list[str] = []
    blocks: dict[int, list[str]] = {}
    for c in columns:
        blocks.setdefault(missing[c], []).append(c)
    for block in blocks.values():
        corr = {}
        if len(block) > 1:
            for r in correlation(df, block).collect():
                corr[r["a"], r["b"]] = corr[r["b"], r["a"]] = r["corr"]
        own: list[str] = []
        for c in sorted(block, key=lambda c: (-distinct.get(c, 0), columns.index(c))):
            if all(corr[c, k] is None or abs(corr[c, k]) < limit for k in own):
                own.append(c)
        kept += own
    return [c for c in columns if c in kept]


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, constant): at most one value, null being one."""
    wide = df.agg(*(F.max(F.col(c).isNull().cast("int")).alias(c) for c in columns)).unpivot([], columns, "feature", "_null")
    both = wide.join(distinct_counts(df, columns), "feature", "left")
    return both.select("feature", (F.coalesce("distinct", F.lit(0)) + F.coalesce("_null", F.lit(0)) <= 1).alias("constant"))
