"""Queries of the ranking metrics and decisions by cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import decision as D
from riskframe.operators import rank_metrics as M
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import TX, tx

CURVE = """, g AS (SELECT {by} p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM tx WHERE y IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER a AS PP, sum(n) OVER a AS TT FROM g WINDOW w AS ({part} ORDER BY p DESC), a AS ({part}))
"""
METRICS = """SELECT {by} CAST(max(TT) AS BIGINT) AS n, round(max(PP) / max(TT), 6) AS prevalence, round(sum(pos * tp / seen) / max(PP), 6) AS pr_auc, round(sum((n - pos) * (tp - pos / 2)) / (max(PP) * (max(TT) - max(PP))), 6) AS roc_auc,
round(sum(pos * tp / seen) / max(PP) / (max(PP) / max(TT)), 6) AS lift, round(coalesce(max(CASE WHEN tp / seen >= 0.5 THEN tp END) / max(PP), 0), 6) AS recall_at_precision FROM c {group}"""


@query(TX + CURVE.format(by="", part="") + METRICS.format(by="", group=""))
def a37_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ranking_metrics(tx(spark, sf_dir), "y", "p"))


@query(TX + CURVE.format(by="tx_day,", part="PARTITION BY tx_day") + METRICS.format(by="tx_day,", group="GROUP BY tx_day"))
def a33_metrics_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ranking_metrics(tx(spark, sf_dir), "y", "p", ("tx_day",)))


@query(TX + CURVE.format(by="", part="") + "SELECT p, round(tp / seen, 6) AS precision, round(tp / PP, 6) AS recall FROM c")
def a38_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pr_curve(tx(spark, sf_dir), "y", "p"))


@query(TX + "SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(avg(p), 6) AS mean_p FROM tx")
def a35_proper_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.proper_scores(tx(spark, sf_dir), "y", "p"))


@query(TX + ", e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS e FROM tx) SELECT CAST(len(list_filter(e, lambda x: p >= x)) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM tx, e GROUP BY 1")
def a38_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reliability_curve(tx(spark, sf_dir), "y", "p"))


FEATURE = """SELECT '{x}' AS feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS separation, round(cov, 6) AS coverage FROM (
SELECT sum((n - pos) * (tp - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))) AS auc, (SELECT avg(CAST(x IS NOT NULL AS INTEGER)) FROM (SELECT {e} AS x FROM tx)) AS cov FROM (
SELECT *, sum(pos) OVER (ORDER BY x DESC) AS tp FROM (SELECT {e} AS x, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM tx WHERE ({e}) IS NOT NULL GROUP BY 1)))"""


@query(TX + " UNION ALL ".join(FEATURE.format(x=x, e=e) for x, e in (("amount", "amount"), ("k", "CASE WHEN k % 4 <> 0 THEN k END"), ("leak", "CAST(event_type = 'error' AS INTEGER)"))))
def a39_feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumns({"k": F.when(F.col("k") % 4 != 0, F.col("k")), "leak": (F.col("event_type") == "error").cast("int")})
    return rounded(M.feature_auc(d, ["amount", "k", "leak"], "y"))


EVALUATE = """SELECT {by} count(*) FILTER (WHERE f = 1 AND y = 1) AS tp, count(*) FILTER (WHERE f = 1 AND y = 0) AS fp, count(*) FILTER (WHERE f = 0 AND y = 1) AS fn, count(*) FILTER (WHERE f = 0 AND y = 0) AS tn,
round(sum(4.0 * f + amount * y * (1 - f)), 4) AS cost, round(sum(amount * y), 4) AS cost_none, CAST(count(*) * 4.0 AS DOUBLE) AS cost_all,
CAST(count(*) FILTER (WHERE f = 1 AND y = 0) + 10.0 * count(*) FILTER (WHERE f = 0 AND y = 1) AS DOUBLE) AS cost_fixed, round((sum(amount * y) - sum(4.0 * f + amount * y * (1 - f))) / sum(amount * y), 4) AS savings,
round(avg(f), 4) AS review_rate, round(sum(f * y) / nullif(sum(f), 0), 4) AS precision, round(sum(f * y) / nullif(sum(y), 0), 4) AS recall FROM {src} {group}"""


@query(TX + EVALUATE.format(by="split,", src="(SELECT *, CAST(p >= 0.7 AS INTEGER) AS f FROM tx WHERE split IS NOT NULL)", group="GROUP BY split"))
def a25_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).where("split is not null")
    return rounded(D.evaluate(d, "y", F.col("p") >= 0.7, "amount", 4.0, ("split",)), 4)


RULES = {"half": 0.5, "fixed_analytic": 1 / 11, "global": 0.25}


@query(TX + EVALUATE.format(by="rule,", src="(SELECT rule, y, amount, CAST(p >= th AS INTEGER) AS f FROM tx, (VALUES ('half', 0.5::DOUBLE), ('fixed_analytic', 1.0::DOUBLE / 11), ('global', 0.25::DOUBLE)) r(rule, th) UNION ALL SELECT 'per_row', y, amount, CAST(amount > 0 AND p > 4.0 / nullif(amount, 0) AS INTEGER) FROM tx)", group="GROUP BY rule"))
def a29_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.all_rules(tx(spark, sf_dir), "y", "p", "amount", 4.0, RULES), 4)


@query(TX + ", g AS (SELECT i / 50.0::DOUBLE AS threshold FROM range(51) r(i)) SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS reviewed, round(4.0 * count(*) FILTER (WHERE p >= threshold) + coalesce(sum(amount * y) FILTER (WHERE p < threshold), 0), 4) AS cost FROM tx, g GROUP BY threshold")
def a26_cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.cost_curve(tx(spark, sf_dir), "y", "p", "amount", 4.0, [i / 50 for i in range(51)]), 4)


@query(TX + ", q AS (SELECT unnest(quantile_cont(p, list_transform(range(400), lambda i: i / 399.0::DOUBLE))) AS threshold FROM tx UNION SELECT i / 399.0::DOUBLE FROM range(400) r(i) UNION SELECT 0.5), s AS (SELECT p, count(*) AS n, sum(amount * y) AS l FROM tx GROUP BY p), c AS (SELECT threshold, round(4.0 * coalesce(sum(n) FILTER (WHERE p >= threshold), 0) + coalesce(sum(l) FILTER (WHERE p < threshold), 0), 6) AS cost FROM s, q GROUP BY threshold) SELECT round(threshold, 6) AS threshold, cost FROM c ORDER BY cost, c.threshold LIMIT 1")
def a27_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    curve = D.cost_curve(d, "y", "p", "amount", 4.0, D.threshold_grid(d, "p"))
    return rounded(D.best_threshold(curve).select("threshold", "cost"))


SWEEP = ", s AS (SELECT p, count(*) AS n, sum(amount * y) AS l FROM tx GROUP BY p), c AS (SELECT p, sum(n) OVER (ORDER BY p DESC) AS seen, sum(l) OVER (ORDER BY p DESC) AS tp, sum(l) OVER () AS a FROM s)"


@query(TX + SWEEP + ", r AS (SELECT p AS threshold, round(4.0 * seen + a - tp, 6) AS cost FROM c UNION ALL SELECT max(p) + 1, round(max(a), 6) FROM c) SELECT round(threshold, 6) AS threshold, cost FROM r ORDER BY cost, r.threshold DESC LIMIT 1")
def a28_cost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.cost_sweep(tx(spark, sf_dir), "y", "p", "amount", 4.0))


@query(TX + SWEEP + ", r AS (SELECT ca AS review_cost, p, round(ca * seen + a - tp, 6) AS cost FROM c, (VALUES (1.0::DOUBLE), (4.0::DOUBLE), (16.0::DOUBLE)) v(ca)) SELECT review_cost, round(p, 6) AS threshold, cost FROM (SELECT *, row_number() OVER (PARTITION BY review_cost ORDER BY cost, p DESC) AS k FROM r) WHERE k = 1")
def a31_cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.cost_sensitivity(tx(spark, sf_dir), "y", "p", "amount", (1.0, 4.0, 16.0)))


@query(TX + ", r AS (SELECT avg(CASE WHEN y = 1 THEN CAST(p >= 0.7 AS INTEGER) END) AS tpr, avg(CASE WHEN y = 0 THEN CAST(p >= 0.7 AS INTEGER) END) AS fpr FROM tx) SELECT prior, round(prior * tpr + (1 - prior) * fpr, 6) AS review_rate, round(prior * tpr / (prior * tpr + (1 - prior) * fpr), 6) AS precision, round(10000 * (prior * tpr + (1 - prior) * fpr), 4) AS alerts_per_10k FROM r, (VALUES (0.01::DOUBLE), (0.035::DOUBLE), (0.1::DOUBLE)) v(prior)")
def a32_prevalence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.prevalence_grid(tx(spark, sf_dir), "y", "p", 0.7, (0.01, 0.035, 0.1))
    return rounded(d).withColumn("alerts_per_10k", F.round("alerts_per_10k", 4))


BOOT = TX + """, days AS (SELECT list(tx_day ORDER BY tx_day) AS d FROM (SELECT DISTINCT tx_day FROM tx WHERE tx_day IS NOT NULL)),
w AS (SELECT draw, d[1 + CAST('0x' || substr(md5(draw || ':' || place || ':0'), 1, 8) AS BIGINT) % len(d)] AS tx_day, count(*) AS w FROM days, range(2000) a(draw), (SELECT unnest(range(0, len(d))) AS place FROM days) GROUP BY ALL),
s AS (SELECT tx_day, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM tx GROUP BY ALL),
g AS (SELECT draw, p, sum(pos * w) AS pos, sum(n * w) AS n FROM s JOIN w USING (tx_day) GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS seen FROM g WINDOW o AS (PARTITION BY draw ORDER BY p DESC)),
m AS (SELECT draw, sum(pos * tp / seen) / sum(pos) AS pr_auc, sum(pos) FILTER (WHERE p >= 0.7) / sum(n) FILTER (WHERE p >= 0.7) AS precision, sum(pos) FILTER (WHERE p >= 0.7) / sum(pos) AS recall FROM c GROUP BY draw)
"""


@query(BOOT + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS low, round(median({m}), 6) AS median, round(quantile_cont({m}, 0.975), 6) AS high FROM m" for m in ("pr_auc", "precision", "recall")))
def a59_day_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = M.day_bootstrap(tx(spark, sf_dir), "y", "p", "tx_day", 0.7)
    return rounded(M.bootstrap_interval(draws, ["pr_auc", "precision", "recall"]))
