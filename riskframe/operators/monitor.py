"""Monitoring of a decision log: matured performance, attribution shares, emergent drift, retrain verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.drift import drift_summary
from riskframe.operators.rank_metrics import ranking_metrics
from riskframe.operators.windows import persistent


def attach_labels(log: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return log.join(labels, key, "left")


def daily_performance(log: DataFrame, day: str, y: str, p: str, flag: str) -> DataFrame:
    """By day, over labelled rows alone: n, precision, recall and average precision."""
    known = log.where(F.col(y).isNotNull())
    g = known.groupBy(day).agg(F.count(F.lit(1)).alias("n_labelled"), F.count_if((F.col(flag) == 1) & (F.col(y) == 1)).alias("tp"), F.sum(flag).alias("flagged"), F.sum(y).alias("positives"))
    ap = ranking_metrics(known, y, p, (day,)).select(day, "pr_auc")
    return g.join(ap, day).select(day, "n_labelled", F.try_divide("tp", "flagged").alias("precision"), F.try_divide("tp", "positives").alias("recall"), "positives", "pr_auc")


def rolling_recall(perf: DataFrame, day: str, rows: int = 7, least: int = 3) -> DataFrame:
    """Recall pooled over the last `rows` rows: sum(recall * n) / sum(n), null with fewer than `least` of them."""
    w = Window.orderBy(day).rowsBetween(-(rows - 1), 0)  # a row a day
    n = F.when(F.col("recall").isNotNull(), F.col("positives"))
    return perf.withColumn("rolling_recall", F.when(F.count("recall").over(w) >= least, F.try_divide(F.sum(F.col("recall") * n).over(w), F.sum(n).over(w))))


def emergent(psi: DataFrame, baseline, day: str) -> DataFrame:
    """By day: the largest excess of a feature's PSI over its median on the baseline days, and that feature."""
    base = psi.where(baseline).groupBy("feature").agg(F.percentile("psi", 0.5).alias("level"))
    x = psi.join(base, "feature").withColumn("excess", F.col("psi") - F.col("level"))
    return x.groupBy(day).agg(F.max("excess").alias("excess"), F.min_by("feature", F.struct(-F.col("excess"), F.col("feature"))).alias("feature"))


def daily_table(scored: DataFrame, psi: DataFrame, score_psi: DataFrame, day: str, p: str, point: dict[str, float], threshold: float) -> DataFrame:
    """By day: n, review_rate and its deviation relative to the operating point, score_psi, and the drift summary of psi."""
    rate = F.avg((F.col(p) >= threshold).cast("double"))
    base = scored.groupBy(day).agg(F.count(F.lit(1)).alias("n"), rate.alias("review_rate"))
    base = base.withColumn("review_deviation", F.col("review_rate") / point["review_rate"] - 1)
    return base.join(score_psi.select(day, F.col("psi").alias("score_psi")), day, "left").join(drift_summary(psi, day), day, "left")


def merged_days(drift: DataFrame, *others: DataFrame, day: str) -> DataFrame:
    """The daily drift table with further daily tables joined to it; its days alone count, what is missing is null."""
    for other in others:
        drift = drift.join(other, day, "left")
    return drift


SIGNALS = ("feature", "score", "review", "attribution", "performance")


def verdict(days: DataFrame, day: str, limits: dict[str, float], recall: float, persist: int = 2) -> DataFrame:
    """By day: decision, reason, n_signals and how far the pooled recall fell below that of the operating point.

    days: (day, excess, score_psi, review_deviation, named_shift, rolling_recall); limits: one for each of SIGNALS,
    passed only from above. Retrain on lost performance, or on feature drift with a moved review rate that persists;
    investigate on any signal; else no_action. What is null says nothing.
    """
    drop = (recall - F.col("rolling_recall")) / recall
    seen = {"feature": F.col("excess"), "score": F.col("score_psi"), "review": F.abs("review_deviation"), "attribution": F.abs("named_shift"), "performance": drop}
    d = days.withColumns({f"_{k}": F.coalesce(seen[k] > limits[k], F.lit(False)) for k in SIGNALS})
    d = d.withColumn("_held", persistent(F.col("_feature") & F.col("_review"), day, persist))
    reasons = F.concat_ws(", ", *(F.when(F.col(f"_{k}"), F.lit(k)) for k in SIGNALS))
    n = sum((F.col(f"_{k}").cast("int") for k in SIGNALS), F.lit(0))
    decision = F.when(F.col("_performance") | F.col("_held"), "retrain").when(n > 0, "investigate").otherwise("no_action")
    return d.select(day, decision.alias("decision"), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("-")).alias("reason"), n.alias("n_signals"), drop.alias("recall_drop"))


def reason_codes(contributions: DataFrame, id: str, k: int = 3) -> DataFrame:
    """The k largest positive contributions of each id: (id, rank, feature, contribution), ties by name."""
    w = Window.partitionBy(id).orderBy(F.desc("contribution"), "feature")
    return contributions.where("contribution > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def family_attribution(contributions: DataFrame, family, id: str) -> DataFrame:
    """By family: mean |sum of its contributions| a row, sum of the features' mean |contribution|, and its share."""
    c = contributions.withColumn("family", family)
    n = c.select(id).distinct().groupBy().agg(F.count(F.lit(1)).alias("n"))
    net = c.groupBy(id, "family").agg(F.abs(F.sum("contribution")).alias("net"), F.sum(F.abs("contribution")).alias("gross"))
    g = net.groupBy("family").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"))
    total = Window.partitionBy(F.lit(1))
    rows = g.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one")
    return rows.select("family", (F.col("net") / F.col("n")).alias("mean_net"), (F.col("gross") / F.col("n")).alias("mean_gross"), (F.col("gross") / F.sum("gross").over(total)).alias("share"))


def importance(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
