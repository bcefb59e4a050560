"""Decisions by cost: confusion, costs, thresholds and sweeps over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.rowwise import per_row_rule
from riskframe.operators.ordered import bucket_edges, quantile_list, running
from riskframe.operators.rank_metrics import ranking_metrics, score_curve


def evaluate(df: DataFrame, y: str, flag: Column, amount: str, review_cost: float, by: tuple[str, ...] = (), c_fp: float = 1.0, c_fn: float = 10.0) -> DataFrame:
    """Confusion counts, both costs, the baselines, savings, review rate, precision and recall in one aggregate."""
    d = df.select(*by, F.col(y).alias("_y"), flag.cast("int").alias("_f"), F.col(amount).cast("double").alias("_a"))
    f, t = F.col("_f"), F.col("_y")
    g = d.groupBy(*by).agg(
        F.count_if((f == 1) & (t == 1)).alias("tp"),
        F.count_if((f == 1) & (t == 0)).alias("fp"),
        F.count_if((f == 0) & (t == 1)).alias("fn"),
        F.count_if((f == 0) & (t == 0)).alias("tn"),
        F.sum(review_cost * f + F.col("_a") * t * (1 - f)).alias("cost"),
        F.sum(F.col("_a") * t).alias("cost_none"),
        (F.count(F.lit(1)) * review_cost).alias("cost_all"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return g.withColumns(
        {
            "cost_fixed": c_fp * F.col("fp") + c_fn * F.col("fn"),
            "savings": F.when(F.col("cost_none") > 0, (F.col("cost_none") - F.col("cost")) / F.col("cost_none")),
            "review_rate": (F.col("tp") + F.col("fp")) / n,
            "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )


def threshold_grid(df: DataFrame, p: str, n: int = 400) -> list[float]:
    """Quantiles, equal steps and one half: a bounded list, sorted."""
    q = quantile_list(df, p, [i / (n - 1) for i in range(n)])
    return sorted({*q, *(i / (n - 1) for i in range(n)), 0.5})


def cost_curve(df: DataFrame, y: str, p: str, amount: str, review_cost: float, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Cost of flagging p >= threshold, for each threshold: rows are dealt to the grid once, then summed from above."""
    from pyspark.ml.feature import Bucketizer

    grid = sorted(set(thresholds))
    binned = Bucketizer(splits=[-float("inf"), *grid, float("inf")], inputCol=p, outputCol="_b", handleInvalid="skip").transform(df.withColumn(p, F.col(p).cast("double")))
    per = binned.groupBy(*by, F.col("_b").cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(amount) * F.col(y)).alias("loss"))
    total = per.groupBy(*by).agg(F.sum("loss").alias("all_loss"))
    points = total.select(*by, "all_loss", F.posexplode(F.array(*(F.lit(float(t)) for t in grid))).alias("_i", "threshold"))
    points = points.withColumn("_b", F.col("_i") + 1).join(per, [*by, "_b"], "left")
    # At most as many rows a group as the grid has thresholds.
    down = Window.partitionBy(*by).orderBy(F.desc("_b"))
    reviewed, caught = F.sum(F.coalesce("n", F.lit(0))).over(down), F.sum(F.coalesce("loss", F.lit(0.0))).over(down)
    return points.select(*by, "threshold", reviewed.alias("reviewed"), (review_cost * reviewed + F.col("all_loss") - caught).alias("cost"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The cheapest threshold, the lowest of equals."""
    return curve.orderBy(F.round("cost", 6), "threshold").limit(1)


def cost_sweep(df: DataFrame, y: str, p: str, amount: str, review_cost: float) -> DataFrame:
    """The exact cheapest threshold over all distinct scores (ties together), flagging none among the choices."""
    loss = df.withColumn("_l", F.col(amount) * F.col(y))
    curve = score_curve(loss, "_l", p)
    cost = review_cost * F.col("seen") + F.col("all_pos") - F.col("tp")
    rows = curve.select(F.col("p").alias("threshold"), cost.alias("cost"))
    none = curve.groupBy().agg((F.max("p") + 1).alias("threshold"), F.max("all_pos").alias("cost"))
    return rows.union(none).orderBy(F.round("cost", 6), F.desc("threshold")).limit(1)


def all_rules(df: DataFrame, y: str, p: str, amount: str, review_cost: float, thresholds: dict[str, float], c_fp: float = 1.0, c_fn: float = 10.0) -> DataFrame:
    """Each rule's evaluation in one pass: rows meet the few rules as a literal array."""
    rules = [F.struct(F.lit(name).alias("rule"), (F.col(p) >= t).cast("int").alias("flag")) for name, t in thresholds.items()]
    rules.append(F.struct(F.lit("per_row").alias("rule"), per_row_rule(F.col(p), F.col(amount), review_cost).alias("flag")))
    long = df.select(y, p, amount, F.inline(F.array(*rules)))
    return evaluate(long, y, F.col("flag"), amount, review_cost, ("rule",), c_fp, c_fn)


def cost_sensitivity(df: DataFrame, y: str, p: str, amount: str, costs: tuple[float, ...]) -> DataFrame:
    """The exact cheapest threshold for each review cost, from one pass over the scores."""
    curve = score_curve(df.withColumn("_l", F.col(amount) * F.col(y)), "_l", p)
    long = curve.withColumn("review_cost", F.explode(F.array(*(F.lit(float(c)) for c in costs))))
    cost = F.col("review_cost") * F.col("seen") + F.col("all_pos") - F.col("tp")
    ranked = long.withColumn("cost", cost)
    return ranked.groupBy("review_cost").agg(F.min(F.struct(F.round("cost", 6).alias("cost"), (-F.col("p")).alias("p"))).alias("m")).select("review_cost", (-F.col("m.p")).alias("threshold"), F.col("m.cost").alias("cost"))


def prevalence_grid(df: DataFrame, y: str, p: str, threshold: float, priors: tuple[float, ...]) -> DataFrame:
    """Review rate, precision and alerts per 10,000 if the positive share were `prior`, by class-conditional rates."""
    g = df.agg(F.avg(F.when(F.col(y) == 1, (F.col(p) >= threshold).cast("double"))).alias("tpr"), F.avg(F.when(F.col(y) == 0, (F.col(p) >= threshold).cast("double"))).alias("fpr"))
    g = g.withColumn("prior", F.explode(F.array(*(F.lit(x) for x in priors))))
    rate = F.col("prior") * F.col("tpr") + (1 - F.col("prior")) * F.col("fpr")
    return g.select("prior", rate.alias("review_rate"), F.try_divide(F.col("prior") * F.col("tpr"), rate).alias("precision"), (rate * 10_000).alias("alerts_per_10k"))


def prevalence_costs(df: DataFrame, y: str, p: str, amount: str, priors: list[float], costs: list[float]) -> DataFrame:
    """By assumed prevalence and review cost: the cheapest threshold on prior-shifted scores, and what it catches.

    Classes are weighted to the prevalence, rows are not resampled. A review costs the same either way, a missed
    positive its amount (null: nothing). Of equal costs the higher threshold holds, first of all to review none.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    g = rows.groupBy(F.col(p).cast("double").alias("p")).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y) * F.coalesce(F.col(amount), F.lit(0.0))).alias("loss"))
    c = running(g, [], "p", ["pos", "n", "loss"], bucket_edges(df, p), descending=True)
    totals = c.agg(F.max("all_pos").alias("all_pos"), F.max("all_n").alias("all_n"), F.max("all_loss").alias("all_loss"))
    point = ["p", "upto_pos", "upto_n", "upto_loss", "all_pos", "all_n", "all_loss"]
    nothing = totals.select(F.lit(None).cast("double").alias("p"), *(F.lit(0.0).alias(x) for x in point[1:4]), *point[4:])
    grid = F.array(*(F.struct(F.lit(float(a)).alias("prevalence"), F.lit(float(b)).alias("review_cost")) for a in priors for b in costs))
    r = c.select(*point).union(nothing).select("*", F.inline(grid))
    own = F.col("all_pos") / F.col("all_n")
    w1, w0 = F.col("prevalence") / own, (1 - F.col("prevalence")) / (1 - own)
    cost = F.col("review_cost") * (w1 * F.col("upto_pos") + w0 * (F.col("upto_n") - F.col("upto_pos"))) + w1 * (F.col("all_loss") - F.col("upto_loss"))
    r = r.withColumns({"cost": cost, "_own": own})
    best = r.groupBy("prevalence", "review_cost").agg(F.min_by(F.struct(*r.columns), F.struct(F.round("cost", 6), -F.coalesce("p", F.lit(float("inf"))))).alias("b")).select("b.*")
    tpr, fpr = F.try_divide("upto_pos", "all_pos"), F.try_divide(F.col("upto_n") - F.col("upto_pos"), F.col("all_n") - F.col("all_pos"))
    rate = F.col("prevalence") * F.col("recall") + (1 - F.col("prevalence")) * F.col("fpr")
    factor = (F.col("prevalence") / (1 - F.col("prevalence"))) / (F.col("_own") / (1 - F.col("_own")))
    best = best.withColumns({"recall": tpr, "fpr": fpr, "recall_value": F.try_divide("upto_loss", "all_loss")}).withColumn("review_rate", rate)
    threshold = F.col("p") * factor / (1 - F.col("p") + F.col("p") * factor)
    precision = F.try_divide(F.col("prevalence") * F.col("recall"), F.col("review_rate"))
    return best.select("prevalence", "review_cost", threshold.alias("threshold"), "recall", "recall_value", "fpr", "review_rate", precision.alias("precision"), (10_000 * F.col("review_rate")).alias("alerts_per_10k"))


def synthesis(df: DataFrame, arm: str, y: str, p: str, amount: str, review_cost: float, thresholds: list[float]) -> DataFrame:
    """By arm: ranking quality, Brier score, and the cheapest threshold of the grid with its cost and savings."""
    quality = ranking_metrics(df, y, p, (arm,)).select(arm, "pr_auc", "roc_auc")
    whole = df.groupBy(arm).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.sum(F.col(amount) * F.col(y)).alias("none"))
    curve = cost_curve(df, y, p, amount, review_cost, thresholds, (arm,))
    best = curve.groupBy(arm).agg(F.min(F.struct(F.round("cost", 4).alias("cost"), "threshold")).alias("m"))
    rows = quality.join(whole, arm).join(best, arm)
    return rows.select(arm, "pr_auc", "roc_auc", "brier", "m.threshold", "m.cost", F.try_divide(F.col("none") - F.col("m.cost"), F.col("none")).alias("savings"))
