"""Sums along an order and exact quantiles, dealt over many tasks.

A window over all rows in order would end in one task. Here values belong to buckets whose edges are quantiles of a
sample, so that buckets hold about as many values each, however crowded the values are: sums run within a bucket,
and over the few bucket totals. The sample bears on the cost alone; sums are exact.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an order, of that of each group, and the share of the rows that their edges are taken from.
BUCKETS, GROUP_BUCKETS, SHARE = 256, 64, 0.02


def bucket_edges(values: DataFrame, x: str, by: list[str] | None = None) -> list[float] | DataFrame:
    """At most BUCKETS - 1 increasing values that cut a sample of a column into equal parts.

    by: groups whose values lie apart, such as features, get edges of their own, a local table of (by, _edges): there
    are few groups.
    """
    n = GROUP_BUCKETS if by else BUCKETS
    probs = F.array(*(F.lit(i / n) for i in range(1, n)))
    sample = values.select(*(by or []), F.col(x).cast("double").alias("x")).sample(SHARE, seed=1)
    cut = F.percentile_approx("x", probs, F.lit(10 * n))
    if not by:
        return sorted(set(sample.agg(cut).first()[0] or []))
    own = sample.groupBy(*by).agg(F.array_sort(F.array_distinct(cut)).alias("_edges"))
    return values.sparkSession.createDataFrame(own.collect(), own.schema)


def bucketed(df: DataFrame, x: str, edges: list[float] | DataFrame) -> DataFrame:
    """df with _b: how many edges are at or below x."""
    if isinstance(edges, DataFrame):
        by = [c for c in edges.columns if c != "_edges"]
        own = edges.select(*(F.col(c).alias(f"_e_{c}") for c in by), "_edges")
        below = F.size(F.filter("_edges", lambda e: e <= F.col(x).cast("double")))
        joined = df.join(own, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in by], "left")
        return joined.select(*df.columns, F.when(F.col("_edges").isNull(), 0).otherwise(below).alias("_b"))
    if not edges:
        return df.withColumn("_b", F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol=x, outputCol="_b", handleInvalid="keep")
    return cut.transform(df.withColumn(x, F.col(x).cast("double"))).withColumn("_b", F.col("_b").cast("int"))


def running(df: DataFrame, by: list[str], x: str, sums: list[str], edges: list[float] | DataFrame, descending: bool = False) -> DataFrame:
    """df, with x distinct in each group of `by`, and upto_<c> (this row among them) and all_<c> for each column of sums."""
    g = bucketed(df, x, edges)
    totals = g.groupBy(*by, "_b").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    order = F.desc if descending else F.asc
    before = Window.partitionBy(*by).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(*by, "_b", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums), *(F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in sums))
    if by:
        same = [g[c].eqNullSafe(totals[c]) for c in by]
        joined = g.join(totals, [*same, g["_b"] == totals["_b"]]).select(g["*"], *(totals[f"{k}_{c}"] for c in sums for k in ("before", "all")))
    else:
        joined = g.join(totals, "_b")
    own = Window.partitionBy(*by, "_b").orderBy(order(x))
    upto = {f"upto_{c}": F.col(f"before_{c}") + F.sum(c).over(own) for c in sums}
    return joined.withColumns(upto).drop("_b", *(f"before_{c}" for c in sums))


def next_value(df: DataFrame, by: list[str], x: str, edges: list[float] | DataFrame) -> DataFrame:
    """df, with x distinct in each group of `by`, and next: the value after x, null after the last."""
    g = bucketed(df, x, edges)
    after = Window.partitionBy(*by).orderBy("_b")
    first = g.groupBy(*by, "_b").agg(F.min(x).alias("_first")).withColumn("_after", F.lead("_first").over(after)).drop("_first")
    own = Window.partitionBy(*by, "_b").orderBy(x)
    return g.join(first, [*by, "_b"]).withColumn("next", F.coalesce(F.lead(x).over(own), "_after")).drop("_b", "_after")


def quantiles(long: DataFrame, by: list[str], x: str, probs: list[float]) -> DataFrame:
    """(by, prob, value): exact quantiles with linear interpolation of the values that are not null, a row each.

    Rows collapse to distinct values; where the running count passes a quantile's rank, its value is read off.
    """
    counts = long.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    c = running(counts, by, "x", ["n"], bucket_edges(long, x, by))
    ranks = F.array(*(F.struct(F.lit(float(p)).alias("prob"), (p * (F.col("all_n") - 1)).alias("at")) for p in probs))
    c = c.withColumn("_before", F.col("upto_n") - F.col("n"))
    covers = lambda at: (F.floor(at) < F.col("upto_n")) & (F.ceil(at) >= F.col("_before"))
    near = c.select(*by, "x", "upto_n", "_before", F.explode(F.filter(ranks, lambda r: covers(r["at"]))).alias("r"))
    holds = lambda at: F.when((at >= F.col("_before")) & (at < F.col("upto_n")), F.col("x"))
    ends = near.groupBy(*by, F.col("r.prob").alias("prob"), F.col("r.at").alias("at")).agg(F.max(holds(F.floor("r.at"))).alias("low"), F.max(holds(F.ceil("r.at"))).alias("high"))
    return ends.select(*by, "prob", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))


def quantile_list(df: DataFrame, x: str, probs: list[float]) -> list[float]:
    """The quantiles of one column as a list, empty without values; as many numbers as probs, which are few."""
    return [r["value"] for r in quantiles(df, [], x, probs).orderBy("prob").collect()]
