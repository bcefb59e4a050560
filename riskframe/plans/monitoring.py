"""Queries of drift, monitoring and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.rowwise import feature_family
from riskframe.operators import attribution as AT
from riskframe.operators import drift as D
from riskframe.operators import monitor as M
from riskframe.operators import sketches as K
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import TX, folder, tx
from riskframe.sources import io

FEATURES = ["amount", "k"]
REF = TX + """, long AS (SELECT tx_day, split, 'amount' AS feature, CASE WHEN k % 9 = 0 THEN NULL ELSE amount END AS x FROM tx UNION ALL SELECT tx_day, split, 'k', CAST(k AS DOUBLE) FROM tx{more}),
ref AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS edges, avg(CAST(x IS NULL AS INTEGER)) AS missing_share FROM long WHERE split = 'train' GROUP BY feature),
binned AS (SELECT l.tx_day, l.split, l.feature, CASE WHEN x IS NOT NULL THEN len(list_filter(edges, lambda e: x >= e)) END AS bin FROM long l JOIN ref USING (feature)),
bins AS (SELECT feature, unnest(range(0, len(edges) + 1)) AS bin, missing_share FROM ref),
props AS (SELECT b.feature, b.bin, any_value(b.missing_share) AS missing_share, count(x.feature) / sum(count(x.feature)) OVER (PARTITION BY b.feature) AS p FROM bins b LEFT JOIN (SELECT * FROM binned WHERE split = 'train') x ON x.feature = b.feature AND x.bin = b.bin GROUP BY b.feature, b.bin)
"""
PSI = """, r AS (SELECT feature, bin, p * (1 - missing_share) AS r FROM props UNION ALL SELECT feature, -1, missing_share FROM ref),
n AS (SELECT tx_day, feature, coalesce(bin, -1) AS bin, count(*) AS n FROM binned GROUP BY ALL),
g AS (SELECT d.tx_day, r.feature, r.bin, greatest(r.r, 1e-6) AS r, greatest(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) OVER (PARTITION BY d.tx_day, r.feature), 1e-6) AS c
  FROM (SELECT DISTINCT tx_day FROM tx) d CROSS JOIN r LEFT JOIN n ON n.tx_day = d.tx_day AND n.feature = r.feature AND n.bin = r.bin),
h AS (SELECT tx_day, feature, c / sum(c) OVER (PARTITION BY tx_day, feature) AS c, r / sum(r) OVER (PARTITION BY tx_day, feature) AS r FROM g),
all_psi AS (SELECT tx_day, feature, sum((c - r) * ln(c / r)) AS psi FROM h GROUP BY ALL),
psi AS (SELECT * FROM all_psi WHERE feature <> 'p')
"""
SCORED = REF.replace("{more}", " UNION ALL SELECT tx_day, split, 'p', p FROM tx") + PSI
REF = REF.replace("{more}", "")
PSI = REF + PSI


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).withColumns({"amount": F.when(F.col("k") % 9 != 0, F.col("amount")), "raw": F.col("amount")})


def psi_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = data(spark, sf_dir)
    return D.daily_psi(d, D.build_reference(d.where("split = 'train'"), FEATURES), FEATURES, "tx_day")


@query(REF + "SELECT p.feature, len(any_value(r.edges)) AS n_edges, round(any_value(r.missing_share), 6) AS missing_share, round(sum(p.p * (p.bin + 1)), 6) AS weighted FROM props p JOIN ref r USING (feature) GROUP BY p.feature")
def a42_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.build_reference(data(spark, sf_dir).where("split = 'train'"), FEATURES)
    weighted = F.aggregate(F.transform("props", lambda p, i: p * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(r.select("feature", F.size("edges").cast("long").alias("n_edges"), "missing_share", weighted.alias("weighted")))


@query(PSI + "SELECT tx_day, feature, round(psi, 6) AS psi FROM psi")
def a45_daily_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(psi_of(spark, sf_dir))


@query(PSI + """, w AS (SELECT feature, coalesce(bin, -1) AS bin, count(*) AS n FROM binned WHERE tx_day BETWEEN 20 AND 26 GROUP BY ALL),
wg AS (SELECT r.feature, r.bin, greatest(r.r, 1e-6) AS r, greatest(coalesce(w.n, 0) / sum(coalesce(w.n, 0)) OVER (PARTITION BY r.feature), 1e-6) AS c FROM r LEFT JOIN w ON w.feature = r.feature AND w.bin = r.bin),
wh AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS c, r / sum(r) OVER (PARTITION BY feature) AS r FROM wg)
SELECT feature, round(sum((c - r) * ln(c / r)), 6) AS psi FROM wh GROUP BY feature""")
def a45_window_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's drift from the bin counts of its days, which are stored first, one day of them twice."""
    d = data(spark, sf_dir)
    reference = D.build_reference(d.where("split = 'train'"), FEATURES)
    at, bins = folder(spark, "bins"), K.daily_bins(d, reference, FEATURES, "tx_day")
    K.write_days(bins, at, "tx_day")
    K.write_days(bins.where("tx_day = 21"), at, "tx_day")
    return rounded(K.window_psi(spark.read.parquet(at), reference, "tx_day", 20, 26))


@query(REF + "SELECT feature, prob, count(*) AS n, true AS within FROM long, (SELECT CAST(unnest([0.1, 0.5, 0.9]) AS DOUBLE) AS prob) WHERE split = 'train' AND x IS NOT NULL GROUP BY ALL")
def a42_sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the training days from their stored sketches, and whether the values below and up to each, counted
    in the rows, agree with it within the sketch's rank error."""
    d, at = data(spark, sf_dir), folder(spark, "sketches")
    K.write_days(K.daily_sketches(d.where("split = 'train'"), FEATURES, "tx_day"), at, "tx_day")
    found = D.frozen(K.sketched_quantiles(K.window_of(spark.read.parquet(at), "tx_day", 0, 13), [0.1, 0.5, 0.9]))
    long = d.where("split = 'train'").select(*(F.col(c).cast("double").alias(c) for c in FEATURES)).unpivot([], FEATURES, "feature", "x").where("x IS NOT NULL")
    at_most = (F.count_if(F.col("x") <= F.col("value")) / F.count(F.lit(1))) >= F.first("prob") - K.RANK_ERROR
    at_least = (F.count_if(F.col("x") < F.col("value")) / F.count(F.lit(1))) <= F.first("prob") + K.RANK_ERROR
    return long.join(found, "feature").groupBy("feature", "prob").agg(F.count(F.lit(1)).alias("n"), (at_most & at_least).alias("within"))


POINT = {"review_rate": 0.3, "recall": 0.31}
DRIFT = """, base AS (SELECT tx_day, count(*) AS n, avg(CAST(p >= 0.7 AS INTEGER)) AS review_rate FROM tx GROUP BY tx_day),
drift AS (SELECT b.tx_day, any_value(n) AS n, any_value(review_rate) AS review_rate, any_value(review_rate) / 0.3 - 1 AS review_deviation, max(psi) FILTER (WHERE feature = 'p') AS score_psi, max(psi) FILTER (WHERE feature <> 'p') AS max_psi,
  arg_max(feature, psi) FILTER (WHERE feature <> 'p') AS top_feature, count(*) FILTER (WHERE feature <> 'p' AND psi >= 0.1) AS n_warn, count(*) FILTER (WHERE feature <> 'p' AND psi >= 0.25) AS n_alert FROM base b JOIN all_psi USING (tx_day) GROUP BY b.tx_day)
"""


def drift_table(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The daily drift table of data(), and the PSI of its features."""
    psi = D.daily_psi(d, D.build_reference(d.where("split = 'train'"), [*FEATURES, "p"]), [*FEATURES, "p"], "tx_day")
    features = psi.where("feature <> 'p'")
    return M.daily_table(d, features, psi.where("feature = 'p'"), "tx_day", "p", POINT, 0.7), features


@query(SCORED + DRIFT + "SELECT tx_day, n, round(review_rate, 6) AS review_rate, round(review_deviation, 6) AS review_deviation, round(score_psi, 6) AS score_psi, round(max_psi, 6) AS max_psi, top_feature, n_warn, n_alert FROM drift")
def a46_drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift_table(data(spark, sf_dir))[0])


@query(PSI + ", b AS (SELECT feature, median(psi) AS level FROM psi WHERE tx_day < 14 GROUP BY feature) SELECT tx_day, round(max(psi - level), 6) AS excess, arg_max(feature, psi - level) AS feature FROM psi JOIN b USING (feature) GROUP BY tx_day")
def a51_emergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.emergent(psi_of(spark, sf_dir), F.col("tx_day") < 14, "tx_day"))


@query(TX + ", l AS (SELECT feature, x, sum(c) AS c, sum(1 - c) AS r FROM (SELECT 'amount' AS feature, amount AS x, CAST(split = 'test' AS INTEGER) AS c FROM tx WHERE split IN ('train', 'test') UNION ALL SELECT 'k', k, CAST(split = 'test' AS INTEGER) FROM tx WHERE split IN ('train', 'test')) GROUP BY ALL), w AS (SELECT feature, abs(sum(c) OVER o / sum(c) OVER a - sum(r) OVER o / sum(r) OVER a) * (lead(x) OVER o - x) AS d FROM l WINDOW o AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature)) SELECT feature, round(sum(d) / (SELECT CASE WHEN w.feature = 'amount' THEN stddev_pop(amount) ELSE stddev_pop(k) END FROM tx WHERE split = 'train'), 6) AS distance FROM w GROUP BY feature")
def a47_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("split", "amount", F.col("k").cast("double").alias("k"))
    return rounded(D.wasserstein(d.where("split = 'test'"), d.where("split = 'train'"), FEATURES))


@query(TX + ", x AS (SELECT *, CAST(p >= 0.7 AS INTEGER) AS f FROM tx WHERE k % 3 <> 0), g AS (SELECT tx_day, p, CAST(sum(y) AS DOUBLE) AS pos, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY tx_day ORDER BY p DESC)), ap AS (SELECT tx_day, sum(pos * tp / seen) / nullif(sum(pos), 0) AS pr_auc FROM c GROUP BY tx_day) SELECT x.tx_day, count(*) AS n_labelled, round(sum(f * y) / nullif(sum(f), 0), 6) AS precision, round(sum(f * y) / nullif(sum(y), 0), 6) AS recall, CAST(sum(y) AS BIGINT) AS positives, round(any_value(pr_auc), 6) AS pr_auc FROM x JOIN ap ON ap.tx_day = x.tx_day GROUP BY x.tx_day")
def a50_matured_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    log = d.select("id", "tx_day", "p", (F.col("p") >= 0.7).cast("int").alias("flag"))
    labels = d.where("k % 3 <> 0").select("id", "y")  # those of a third have not come in
    return rounded(M.daily_performance(M.attach_labels(log, labels, "id"), "tx_day", "y", "p", "flag"))


PERFORMANCE = """, known AS (SELECT *, CAST(p >= 0.7 AS INTEGER) AS f FROM tx WHERE k % 3 <> 0),
perf AS (SELECT tx_day, sum(f * y) / nullif(sum(y), 0) AS recall, sum(y) AS positives FROM known GROUP BY tx_day),
rolled AS (SELECT tx_day, CASE WHEN count(recall) OVER w >= 3 THEN sum(recall * positives) OVER w / sum(CASE WHEN recall IS NOT NULL THEN positives END) OVER w END AS rolling_recall FROM perf WINDOW w AS (ORDER BY tx_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
"""


def performance(d: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Daily performance and pooled recall over the rows whose labels have come in: by default those of a third have not."""
    log = d.select("id", "tx_day", "p", (F.col("p") >= 0.7).cast("int").alias("flag"))
    labels = io.labels(d.where("k % 3 <> 0"), "id", "y") if labels is None else labels
    return M.rolling_recall(M.daily_performance(M.attach_labels(log, labels, "id"), "tx_day", "y", "p", "flag"), "tx_day")


@query(TX + PERFORMANCE + "SELECT tx_day, round(rolling_recall, 6) AS rolling_recall FROM rolled")
def w9_rolling_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(performance(tx(spark, sf_dir)).select("tx_day", "rolling_recall"))


SHARES = """, mass AS (SELECT tx_day, sum(abs(k - 50) + abs(k % 7 - 3)) / sum(abs(k - 50) + abs(k % 7 - 3) + abs(raw - 50)) AS share FROM (SELECT *, amount AS raw FROM tx) WHERE p >= 0.7 GROUP BY tx_day),
shares AS (SELECT tx_day, 100 * (share - (SELECT sum(abs(k - 50) + abs(k % 7 - 3)) / sum(abs(k - 50) + abs(k % 7 - 3) + abs(amount - 50)) FROM tx WHERE p >= 0.7 AND tx_day < 14)) AS named_shift FROM mass)
"""


def named_shift(d: DataFrame) -> DataFrame:
    """By day: percentage points by which the named share of flagged rows' contributions left its level before day 14."""
    parts = [(F.lit("V-group 1"), F.col("raw") - 50), (F.lit("amt_log"), (F.col("k") - 50).cast("double")), (F.lit("card_freq"), (F.col("k") % 7 - 3).cast("double"))]
    c = d.where("p >= 0.7").select("id", "tx_day", F.inline(F.array(*(F.struct(f.alias("feature"), x.alias("contribution")) for f, x in parts))))
    daily = AT.attribution_share(c, "tx_day", "id").select("tx_day", "named_share")
    level = AT.attribution_share(c.where("tx_day < 14").withColumn("tx_day", F.lit(0)), "tx_day", "id").select(F.col("named_share").alias("level"))
    return daily.join(F.broadcast(level)).select("tx_day", (100 * (F.col("named_share") - F.col("level"))).alias("named_shift"))  # one level


LIMITS = {"feature": 0.03, "score": 0.05, "review": 0.1, "attribution": 4.0, "performance": 0.1}
LEVELS = ", lev AS (SELECT feature, median(psi) AS level FROM psi WHERE tx_day < 14 GROUP BY feature), em AS (SELECT tx_day, max(psi - level) AS excess FROM psi JOIN lev USING (feature) GROUP BY tx_day)"
JOINED = SCORED + DRIFT + PERFORMANCE + SHARES + LEVELS + ", d AS (SELECT drift.*, excess, named_shift, rolling_recall FROM drift LEFT JOIN em USING (tx_day) LEFT JOIN shares USING (tx_day) LEFT JOIN rolled USING (tx_day))"


def signals(d: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The daily drift table with the emergent excess, the attribution shift and the pooled recall."""
    drift, psi = drift_table(d)
    excess = M.emergent(psi, F.col("tx_day") < 14, "tx_day").select("tx_day", "excess")
    return M.merged_days(drift, excess, named_shift(d), performance(d, labels).select("tx_day", "rolling_recall"), day="tx_day")


@query(JOINED + "SELECT tx_day, n, round(score_psi, 6) AS score_psi, round(excess, 6) AS excess, round(named_shift, 6) AS named_shift, round(rolling_recall, 6) AS rolling_recall FROM d")
def j14_daily_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals(data(spark, sf_dir)).select("tx_day", "n", "score_psi", "excess", "named_shift", "rolling_recall"))


VERDICT = """, seen AS (SELECT tx_day, coalesce(excess > 0.03, false) AS a, coalesce(score_psi > 0.05, false) AS b, coalesce(abs(review_deviation) > 0.1, false) AS c, coalesce(abs(named_shift) > 4, false) AS e, (0.31 - rolling_recall) / 0.31 AS fall FROM d),
sig AS (SELECT *, coalesce(fall > 0.1, false) AS h FROM seen), held AS (SELECT *, row_number() OVER (ORDER BY tx_day) >= 2 AND min(a AND c) OVER (ORDER BY tx_day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS held, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(e AS INTEGER) + CAST(h AS INTEGER) AS n_signals FROM sig)
SELECT tx_day, CASE WHEN h OR held THEN 'retrain' WHEN n_signals > 0 THEN 'investigate' ELSE 'no_action' END AS decision,
coalesce(nullif(concat_ws(', ', CASE WHEN a THEN 'feature' END, CASE WHEN b THEN 'score' END, CASE WHEN c THEN 'review' END, CASE WHEN e THEN 'attribution' END, CASE WHEN h THEN 'performance' END), ''), '-') AS reason, n_signals, round(fall, 6) AS recall_drop FROM held"""


@query(JOINED + VERDICT)
def c1_retrain_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.verdict(signals(data(spark, sf_dir)), "tx_day", LIMITS, POINT["recall"]))


@query(JOINED + VERDICT.replace(", n_signals, round(fall, 6) AS recall_drop", ""))
def c1_measured_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.verdict(signals(data(spark, sf_dir)), "tx_day", LIMITS, POINT["recall"]).select("tx_day", "decision", "reason")


CONTRIB = TX + ", c AS (SELECT id, 'v' || (k % 4) AS feature, amount - 50 AS contribution FROM tx UNION ALL SELECT id, 'amt_log', CAST(k - 50 AS DOUBLE) FROM tx UNION ALL SELECT id, 'card_freq', CAST(k % 7 - 3 AS DOUBLE) FROM tx) "


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    parts = F.array(F.struct(F.concat(F.lit("v"), (F.col("k") % 4).cast("string")).alias("feature"), (F.col("amount") - 50).alias("contribution")), F.struct(F.lit("amt_log").alias("feature"), (F.col("k") - 50).cast("double").alias("contribution")), F.struct(F.lit("card_freq").alias("feature"), (F.col("k") % 7 - 3).cast("double").alias("contribution")))
    return d.select("id", F.inline(parts))


@query(CONTRIB + "SELECT id, feature, round(contribution, 6) AS contribution, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY contribution DESC, feature) AS r FROM c WHERE contribution > 0) WHERE r <= 2")
def t3_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reason_codes(contributions(spark, sf_dir), "id", 2))


@query(CONTRIB + ", f AS (SELECT *, CASE WHEN feature LIKE '%_freq' THEN 'frequency' WHEN feature LIKE 'amt_%' THEN 'amount' ELSE 'anonymous' END AS family FROM c), n AS (SELECT id, family, abs(sum(contribution)) AS net, sum(abs(contribution)) AS gross FROM f GROUP BY ALL) SELECT family, round(sum(net) / (SELECT count(DISTINCT id) FROM c), 6) AS mean_net, round(sum(gross) / (SELECT count(DISTINCT id) FROM c), 6) AS mean_gross, round(sum(gross) / sum(sum(gross)) OVER (), 6) AS share FROM n GROUP BY family")
def a53_family_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.family_attribution(contributions(spark, sf_dir), feature_family(F.col("feature")), "id"))


@query(CONTRIB + "SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM c GROUP BY feature")
def a57_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.importance(contributions(spark, sf_dir)))
