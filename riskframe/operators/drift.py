"""Frozen references, population stability, daily drift and ECDF distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.ordered import bucket_edges, next_value, quantiles, running

EPS = 1e-6


def bin_of(x: Column, edges: list[float]) -> Column:
    """Bins closed on the left, outer ones unbounded: how many edges are at or below x; null stays null."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    a = F.array(*(F.lit(float(e)) for e in edges))
    return F.when(x.isNotNull(), F.size(F.filter(a, lambda e: x >= e)))


def frozen(reference: DataFrame) -> DataFrame:
    """A reference as a local table, which is not computed again where it is used: a row a feature, few numbers each."""
    return reference.sparkSession.createDataFrame(reference.collect(), reference.schema)


def build_reference(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, edges, props, missing_share): unique interior quantiles and the shares of their bins."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in features)).unpivot([], features, "feature", "x")
    cuts = quantiles(long, ["feature"], "x", [i / bins for i in range(1, bins)])
    cuts = cuts.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"))
    shares = long.groupBy("feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("missing_share"))
    edges = frozen(shares.join(cuts, "feature", "left").select("feature", F.coalesce("edges", F.array().cast("array<double>")).alias("edges"), "missing_share"))
    counted = bin_counts(long, edges).where("bin is not null").groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    props = full_bins(edges).join(counted, ["feature", "bin"], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("feature")))
    per = props.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda s: s["p"]).alias("props"))
    return frozen(edges.join(per, "feature").select("feature", "edges", "props", "missing_share"))


def bin_counts(long: DataFrame, reference: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, feature, bin (null: missing), n. The reference has a row a feature."""
    r = reference.select("feature", "edges")
    return long.join(r, "feature").groupBy(*by, "feature", F.when(F.col("x").isNotNull(), F.size(F.filter("edges", lambda e: F.col("x") >= e))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def full_bins(reference: DataFrame) -> DataFrame:
    return reference.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))


def daily_psi(df: DataFrame, reference: DataFrame, features: list[str], day: str) -> DataFrame:
    """(day, feature, psi): sum of (c - r) ln(c / r) over all bins and missing, shares clipped and renormalised."""
    long = df.select(day, *(F.col(c).cast("double").alias(c) for c in features)).unpivot([day], features, "feature", "x")
    return psi_of_counts(bin_counts(long, reference, (day,)).withColumn("bin", F.coalesce("bin", F.lit(-1))), reference, (day,))


def psi_of_counts(counts: DataFrame, reference: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, feature, psi) of bin counts (by, feature, bin, n), -1 for missing."""
    present = 1 - F.col("missing_share")
    ref = reference.select("feature", F.posexplode("props").alias("bin", "p"), "missing_share").select("feature", "bin", (F.col("p") * present).alias("r"))
    ref = ref.union(reference.select("feature", F.lit(-1), F.col("missing_share")))
    grid = counts.select(*by, "feature").distinct().join(ref, "feature").join(counts, [*by, "feature", "bin"], "left")
    w = Window.partitionBy(*by, "feature")
    c = F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(w)
    g = grid.withColumns({"_c": F.greatest(c, F.lit(EPS)), "_r": F.greatest("r", F.lit(EPS))})
    g = g.withColumns({"_c": F.col("_c") / F.sum("_c").over(w), "_r": F.col("_r") / F.sum("_r").over(w)})
    return g.groupBy(*by, "feature").agg(F.sum((F.col("_c") - F.col("_r")) * F.ln(F.col("_c") / F.col("_r"))).alias("psi"))


def drift_summary(psi: DataFrame, day: str, warn: float = 0.1, alert: float = 0.25) -> DataFrame:
    """By day: the largest PSI and its feature (ties: the first name), and how many features pass each line."""
    return psi.groupBy(day).agg(F.max("psi").alias("max_psi"), F.min_by("feature", F.struct(-F.col("psi"), F.col("feature"))).alias("top_feature"), F.count_if(F.col("psi") >= warn).alias("n_warn"), F.count_if(F.col("psi") >= alert).alias("n_alert"))


def wasserstein(current: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, distance): area between the two distribution functions, over the reference's deviation."""
    long = current.select(F.lit(1).alias("cur"), *columns).union(reference.select(F.lit(0), *columns)).unpivot(["cur"], columns, "feature", "x").where("x is not null")
    g = long.groupBy("feature", "x").agg(F.sum("cur").alias("c"), F.sum(1 - F.col("cur")).alias("r"))
    edges = bucket_edges(long, "x", ["feature"])
    c = next_value(running(g, ["feature"], "x", ["c", "r"], edges), ["feature"], "x", edges)
    f = F.abs(F.try_divide(F.col("upto_c"), F.col("all_c")) - F.try_divide(F.col("upto_r"), F.col("all_r")))
    area = c.groupBy("feature").agg(F.sum(f * (F.col("next") - F.col("x"))).alias("_area"))
    std = reference.agg(*(F.stddev_pop(c).alias(c) for c in columns)).unpivot([], columns, "feature", "_std")
    return area.join(std, "feature").select("feature", F.try_divide(F.coalesce("_area", F.lit(0.0)), F.col("_std")).alias("distance"))
