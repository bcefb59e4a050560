"""Ranking metrics over a score: rows collapse to distinct scores first, ties count together.

Running sums go by buckets of the score (see ordered.py), so that scores are dealt over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordered import bucket_edges, bucketed, quantile_list, running


def score_curve(df: DataFrame, y: str, p: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """by, p, pos, n, and from the highest score down: tp and seen (this score among them); all_pos and all_neg."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    g = rows.groupBy(*by, F.col(p).cast("double").alias("p"))
    g = g.agg(F.sum(F.col(y) * w).cast("double").alias("pos"), F.sum(w).cast("double").alias("n"))
    c = running(g, list(by), "p", ["pos", "n"], bucket_edges(df, p), descending=True)
    all_neg = F.col("all_n") - F.col("all_pos")
    return c.select(*by, "p", "pos", "n", F.col("upto_pos").alias("tp"), F.col("upto_n").alias("seen"), "all_pos", all_neg.alias("all_neg"))


def ranking_metrics(df: DataFrame, y: str, p: str, by: tuple[str, ...] = (), weight: str | None = None, precision: float = 0.5) -> DataFrame:
    """by, n, prevalence, pr_auc (average precision), roc_auc, lift and recall at a precision."""
    c = score_curve(df, y, p, by, weight)
    prec = F.col("tp") / F.col("seen")
    neg = F.col("n") - F.col("pos")
    out = c.groupBy(*by).agg(
        F.max("all_pos").alias("all_pos"),
        F.max("all_neg").alias("all_neg"),
        F.sum(F.col("pos") * prec).alias("_ap"),
        F.sum(neg * (F.col("tp") - F.col("pos") / 2)).alias("_auc"),
        F.max(F.when(prec >= precision, F.col("tp"))).alias("_tp"),
    )
    ap = F.try_divide(F.col("_ap"), F.col("all_pos"))
    prevalence = F.col("all_pos") / (F.col("all_pos") + F.col("all_neg"))
    return out.select(*by, (F.col("all_pos") + F.col("all_neg")).cast("long").alias("n"), prevalence.alias("prevalence"), ap.alias("pr_auc"), F.try_divide(F.col("_auc"), F.col("all_pos") * F.col("all_neg")).alias("roc_auc"), F.try_divide(ap, prevalence).alias("lift"), F.coalesce(F.try_divide(F.col("_tp"), F.col("all_pos")), F.lit(0.0)).alias("recall_at_precision"))


def pr_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    return score_curve(df, y, p).select("p", (F.col("tp") / F.col("seen")).alias("precision"), F.try_divide(F.col("tp"), F.col("all_pos")).alias("recall"))


def proper_scores(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier score, clipped log loss, mean score."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(p).alias("mean_p"))


def quantile_edges(df: DataFrame, x: str, bins: int) -> list[float]:
    """Unique interior quantiles (linear interpolation): a bounded list."""
    return sorted(set(quantile_list(df, x, [i / bins for i in range(1, bins)])))


def reliability_curve(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean score and positive rate by quantile bin of the score."""
    from riskframe.operators.drift import bin_of

    edges = quantile_edges(df, p, bins)
    return df.groupBy(bin_of(F.col(p), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def feature_auc(df: DataFrame, columns: list[str], y: str, least: int = 100) -> DataFrame:
    """(feature, auc, separation, coverage), one job for all features; those with few values or one class are left out."""
    long = df.select(y, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([y], columns, "feature", "x")
    share = long.groupBy("feature").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"), F.count("x").alias("_n"), F.min(F.when(F.col("x").isNotNull(), F.col(y))).alias("_lo"), F.max(F.when(F.col("x").isNotNull(), F.col(y))).alias("_hi"))
    g = long.where("x is not null").groupBy("feature", "x").agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    c = running(g, ["feature"], "x", ["pos"], bucket_edges(long, "x", ["feature"]), descending=True)
    above = F.sum((F.col("n") - F.col("pos")) * (F.col("upto_pos") - F.col("pos") / 2))
    auc = c.groupBy("feature").agg(F.try_divide(above, F.sum("pos") * (F.sum("n") - F.sum("pos"))).alias("auc"))
    out = share.where((F.col("_n") >= least) & (F.col("_lo") != F.col("_hi"))).join(auc, "feature")
    return out.select("feature", "auc", F.greatest("auc", 1 - F.col("auc")).alias("separation"), "coverage")


def draw_weights(days: DataFrame, day: str, draws: int, seed: int) -> DataFrame:
    """(draw, day, weight): as many days as there are, picked with replacement, for each draw.

    The pick is a hash of draw, place and seed, so that it is the same in each run. days: a row a day, few.
    """
    listed = days.agg(F.sort_array(F.collect_set(day)).alias("days"))
    picks = listed.select("days", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picks = picks.select("days", "draw", F.explode(F.sequence(F.lit(0), F.size("days") - 1)).alias("place"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "place", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    return picks.groupBy("draw", F.get("days", pick % F.size("days")).alias(day)).agg(F.count(F.lit(1)).alias("weight"))


#: Distinct scores of a block of the bootstrap's matrix product.
SCORES = 512


def day_bootstrap(df: DataFrame, y: str, p: str, day: str, threshold: float, draws: int = 2_000, seed: int = 0) -> DataFrame:
    """(draw, pr_auc, precision, recall) over days resampled with replacement.

    Rows collapse to (day, score). Scores are dealt by buckets in their order; a bucket's rows, as a matrix of scores by
    days, are multiplied with the days' weights in all draws within its task, in blocks, so that no row meets a draw
    outside. What lies above a bucket comes from the product of the bucket totals with the same weights. Days and draws
    are few: their weights and the totals of a bucket are on the driver.
    """
    spark = df.sparkSession
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(day).alias("_day"), F.col(p).cast("double").alias("_p"))
    rows = bucketed(rows.agg(F.sum(y).cast("double").alias("_pos"), F.count(F.lit(1)).cast("double").alias("_n")), "_p", bucket_edges(df, p))
    listed = draw_weights(df.select(day).where(F.col(day).isNotNull()).distinct(), day, draws, seed).toArrow()
    schema = "draw int, pr_auc double, precision double, recall double"
    if not listed.num_rows:
        return spark.createDataFrame([], schema)
    days = sorted(set(listed.column(1).to_pylist()))
    place = {d: i for i, d in enumerate(days)}
    weights = np.zeros((len(days), draws))
    weights[[place[d] for d in listed.column(1).to_pylist()], listed.column(0).to_numpy()] = listed.column(2).to_numpy()
    totals = rows.where(F.col("_day").isNotNull()).groupBy("_b", "_day").agg(F.sum("_pos"), F.sum("_n")).collect()
    buckets = sorted({r[0] for r in totals}, reverse=True)
    own = np.zeros((2, len(buckets), len(days)))
    for b, d, pos, n in totals:
        own[:, buckets.index(b), place[d]] = pos, n
    sums = own @ weights  # of positives and rows, by bucket and draw
    above = np.cumsum(sums, 1) - sums
    shared = spark.sparkContext.broadcast((place, weights, {b: above[:, i] for i, b in enumerate(buckets)}))

    def drawn(table: pa.Table) -> pa.Table:
        at, w, before = shared.value
        scores, row = np.unique(-table["_p"].to_numpy(), return_inverse=True)  # from the highest down
        column = np.array([at[d] for d in table["_day"].to_pylist()])
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(scores) + 1))
        tp, seen = (x.copy() for x in before[table["_b"][0].as_py()])
        ap, hit_tp, hit_n = np.zeros((3, w.shape[1]))
        for first in range(0, len(scores), SCORES):
            last = min(first + SCORES, len(scores))
            part = order[ends[first] : ends[last]]
            block = np.zeros((2, last - first, len(at)))
            for i, c in enumerate(("_pos", "_n")):
                block[i, row[part] - first, column[part]] = table[c].to_numpy()[part]
            pos, n = block @ w
            upto_tp, upto_n = tp + np.cumsum(pos, 0), seen + np.cumsum(n, 0)
            ap += np.divide(pos * upto_tp, upto_n, out=np.zeros_like(pos), where=upto_n > 0).sum(0)
            hits = -scores[first:last] >= threshold
            hit_tp, hit_n = hit_tp + pos[hits].sum(0), hit_n + n[hits].sum(0)
            tp, seen = upto_tp[-1], upto_n[-1]
        return pa.table({"draw": np.arange(w.shape[1], dtype=np.int32), "ap": ap, "tp": hit_tp, "n": hit_n})

    parts = rows.where(F.col("_day").isNotNull()).groupBy("_b").applyInArrow(drawn, "draw int, ap double, tp double, n double")
    whole = spark.createDataFrame([(i, float(x)) for i, x in enumerate(sums[0].sum(0))], "draw int, pos double")
    out = parts.groupBy("draw").agg(F.sum("ap").alias("ap"), F.sum("tp").alias("tp"), F.sum("n").alias("n")).join(whole, "draw")
    return out.select("draw", F.try_divide("ap", "pos").alias("pr_auc"), F.try_divide("tp", "n").alias("precision"), F.try_divide("tp", "pos").alias("recall"))


def bootstrap_interval(draws: DataFrame, metrics: list[str], level: float = 0.95) -> DataFrame:
    """(metric, low, median, high): percentiles over the draws, which are few."""
    long = draws.unpivot(["draw"], metrics, "metric", "v")
    q = F.percentile("v", F.array(*(F.lit(x) for x in ((1 - level) / 2, 0.5, (1 + level) / 2))))
    return long.groupBy("metric").agg(q.alias("q")).select("metric", *(F.col("q")[i].alias(n) for i, n in enumerate(("low", "median", "high"))))
