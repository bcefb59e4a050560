"""Queries of attribution shares, calibration, label lookup, payloads and audit checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import attribution as AT
from riskframe.operators import audit as AU
from riskframe.operators import calibrate as CA
from riskframe.operators import decision as D
from riskframe.operators import drift as DR
from riskframe.operators import monitor as M
from riskframe.plans.decisions import CURVE
from riskframe.plans.monitoring import PSI, psi_of
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import TX, tx
from riskframe.sources import io

NAMED = TX + """, c AS (SELECT id, tx_day, p, split, 'V-group ' || (k % 4) AS feature, amount - 50 AS contribution FROM tx UNION ALL SELECT id, tx_day, p, split, 'amt_log', CAST(k - 50 AS DOUBLE) FROM tx UNION ALL SELECT id, tx_day, p, split, 'card_freq', CAST(k % 7 - 3 AS DOUBLE) FROM tx),
b AS (SELECT *, CASE WHEN feature LIKE 'V-group%' THEN 'anonymised' ELSE 'named' END AS block FROM c)
"""


def named_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("V-group "), (F.col("k") % 4).cast("string"))
    parts = [(group, F.col("amount") - 50), (F.lit("amt_log"), (F.col("k") - 50).cast("double")), (F.lit("card_freq"), (F.col("k") % 7 - 3).cast("double"))]
    return tx(spark, sf_dir).select("id", "tx_day", "p", "split", F.inline(F.array(*(F.struct(f.alias("feature"), c.alias("contribution")) for f, c in parts))))


TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY contribution DESC, feature) AS r FROM b WHERE p >= 0.7 AND contribution > 0)"


@query(NAMED + ", " + TOP + """, h AS (SELECT id, max(block = 'named') AS has FROM t WHERE r <= 2 GROUP BY id),
m AS (SELECT tx_day, sum(abs(contribution)) FILTER (WHERE block = 'named') AS named, sum(abs(contribution)) FILTER (WHERE block <> 'named') AS anonymous FROM b WHERE p >= 0.7 GROUP BY tx_day),
f AS (SELECT tx_day, avg(CAST(coalesce(has, false) AS INTEGER)) AS rows_with_named FROM tx LEFT JOIN h USING (id) WHERE p >= 0.7 GROUP BY tx_day)
SELECT tx_day, round(named, 4) AS named, round(anonymous, 4) AS anonymous, round(rows_with_named, 4) AS rows_with_named, round(named / (named + anonymous), 4) AS named_share FROM m JOIN f USING (tx_day)""")
def a48_attribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(AT.attribution_share(named_contributions(spark, sf_dir).where("p >= 0.7"), "tx_day", "id", 2), 4)


@query(NAMED + ", " + TOP + ", n AS (SELECT count(*) AS flagged FROM tx WHERE p >= 0.7) SELECT any_value(flagged) AS flagged, count(*) AS codes, round(avg(CAST(block = 'named' AS INTEGER)), 6) AS named_share, round(count(DISTINCT id) / any_value(flagged), 6) AS coverage FROM t, n WHERE r <= 2")
def a49_reason_code_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = named_contributions(spark, sf_dir).where("p >= 0.7")
    return rounded(AT.reason_code_share(M.reason_codes(c, "id", 2), tx(spark, sf_dir).where("p >= 0.7"), "id"))


@query(PSI + """, v AS (SELECT 'carried' AS variant, feature, median(psi) AS level FROM psi WHERE tx_day < 14 GROUP BY feature UNION ALL SELECT 'own', feature, median(psi) FROM psi WHERE tx_day >= 14 GROUP BY feature)
SELECT variant, tx_day, round(max(psi - level), 6) AS excess, arg_max(feature, psi - level) AS feature FROM psi JOIN v USING (feature) WHERE tx_day >= 14 GROUP BY ALL""")
def a52_emergent_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    psi, late = psi_of(spark, sf_dir), F.col("tx_day") >= 14
    carried = M.emergent(psi, ~late, "tx_day").where(late).withColumn("variant", F.lit("carried"))
    return rounded(carried.unionByName(M.emergent(psi.where(late), late, "tx_day").withColumn("variant", F.lit("own"))))


@query(NAMED + ", n AS (SELECT id, block, abs(sum(contribution)) AS net, sum(abs(contribution)) AS gross FROM b GROUP BY ALL) SELECT block, round(avg(net), 6) AS net, round(avg(gross), 6) AS gross, round(1 - avg(net) / avg(gross), 6) AS cancellation FROM n GROUP BY block")
def a54_two_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(AT.two_block(named_contributions(spark, sf_dir), "id"))


@query(TX + 'SELECT count(DISTINCT id) AS "rows", CAST(0 AS BIGINT) AS off FROM tx')
def a55_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AT.reconstruction(named_contributions(spark, sf_dir), F.substring("feature", 1, 4), "id")


@query(
    NAMED
    + """, g AS (SELECT id, substr(feature, 1, 4) AS grp, sum(contribution) + CASE WHEN id % 11 = 3 THEN 0.01 ELSE 0 END AS part FROM b WHERE id % 13 <> 5 GROUP BY id, substr(feature, 1, 4)),
t AS (SELECT id, sum(part) AS parts FROM g GROUP BY id), w AS (SELECT id, sum(contribution) AS whole FROM b GROUP BY id)
SELECT count(*) AS "rows", count(*) FILTER (WHERE coalesce(abs(whole - parts) > 1e-4, true)) AS off FROM w FULL JOIN t USING (id)"""
)
def a55_stored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a table of group sums with faults: some sums moved, the groups of some rows lost."""
    c, group = named_contributions(spark, sf_dir), F.substring("feature", 1, 4)
    moved = F.col("part") + F.when(F.col("id") % 11 == 3, 0.01).otherwise(0.0)
    stored = AT.group_sums(c.where("id % 13 <> 5"), group, "id").withColumn("part", moved)
    return AT.reconstruction(c, group, "id", stored=stored)


@query(NAMED + """, i AS (SELECT split, feature, avg(abs(contribution)) AS v FROM b WHERE split IN ('train', 'test') GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY v DESC) + (count(*) OVER (PARTITION BY split, v) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY split ORDER BY v DESC, feature) AS k FROM i)
SELECT count(*) AS features, round(corr(x.r, y.r), 6) AS spearman, count(*) FILTER (WHERE x.k <= 3 AND y.k <= 3) AS common_top FROM r x JOIN r y USING (feature) WHERE x.split = 'train' AND y.split = 'test'""")
def a56_rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = named_contributions(spark, sf_dir)
    return rounded(AT.rank_agreement(M.importance(c.where("split = 'train'")), M.importance(c.where("split = 'test'")), 3))


ARMS = TX.replace("WITH tx AS", "WITH tx0 AS") + ", tx AS (SELECT 'fine' AS arm, p, y, amount FROM tx0 UNION ALL SELECT 'coarse', (k5 + 0.5) / 5, y, amount FROM tx0)"


@query(ARMS + CURVE.format(by="arm,", part="PARTITION BY arm") + """, m AS (SELECT arm, sum(pos * tp / seen) / max(PP) AS pr_auc, sum((n - pos) * (tp - pos / 2)) / (max(PP) * (max(TT) - max(PP))) AS roc_auc FROM c GROUP BY arm),
b AS (SELECT arm, avg((p - y) * (p - y)) AS brier, sum(amount * y) AS none FROM tx GROUP BY arm),
th AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(21) r(i)),
k AS (SELECT arm, threshold, 4.0 * count(*) FILTER (WHERE p >= threshold) + coalesce(sum(amount * y) FILTER (WHERE p < threshold), 0) AS cost FROM tx, th GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY round(cost, 4), threshold) AS o FROM k)
SELECT arm, round(pr_auc, 4) AS pr_auc, round(roc_auc, 4) AS roc_auc, round(brier, 4) AS brier, threshold, round(cost, 4) AS cost, round((none - cost) / none, 4) AS savings FROM m JOIN b USING (arm) JOIN best USING (arm) WHERE o = 1""")
def a58_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = F.array(F.struct(F.lit("fine").alias("arm"), F.col("p").alias("score")), F.struct(F.lit("coarse").alias("arm"), ((F.col("k5") + 0.5) / 5).alias("score")))
    return rounded(D.synthesis(tx(spark, sf_dir).select("y", "amount", F.inline(arms)), "arm", "y", "score", "amount", 4.0, [i / 20 for i in range(21)]), 4)


@query(PSI + ", s AS (SELECT tx_day, max(psi) AS m, count(*) FILTER (WHERE psi >= 0.1) AS w FROM psi GROUP BY tx_day) SELECT CASE WHEN tx_day < 14 THEN 'baseline' ELSE 'later' END AS segment, count(*) AS days, round(min(m), 6) AS min_psi, round(max(m), 6) AS max_psi, CAST(sum(w) AS BIGINT) AS warnings FROM s GROUP BY 1")
def a61_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = DR.drift_summary(psi_of(spark, sf_dir), "tx_day")
    segment = F.when(F.col("tx_day") < 14, "baseline").otherwise("later")
    return rounded(days.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("days"), F.min("max_psi").alias("min_psi"), F.max("max_psi").alias("max_psi"), F.sum("n_warn").alias("warnings")))


@query(TX + "SELECT tx_day, count(*) AS n, count(*) FILTER (WHERE k % 3 <> 0) AS n_labelled, CAST(coalesce(sum(y) FILTER (WHERE k % 3 <> 0), 0) AS BIGINT) AS positives FROM tx GROUP BY tx_day")
def j5_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    log = M.attach_labels(d.select("id", "tx_day"), d.where("k % 3 <> 0").select("id", "y"), "id")
    return log.groupBy("tx_day").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_labelled"), F.coalesce(F.sum("y"), F.lit(0)).alias("positives"))


@query(TX + "SELECT 'amount' AS feature, count(*) AS cells, CAST(0 AS BIGINT) AS differing FROM tx UNION ALL SELECT 'k', count(*), count(*) FILTER (WHERE k % 50 = 0) FROM tx")
def j16_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", "amount", "k")
    served = d.select("id", (F.col("amount") * (1 + 1e-6)).alias("amount"), (F.col("k") + (F.col("k") % 50 == 0).cast("int")).alias("k"))
    return io.compare_frames(d, served, "id", ["amount", "k"])


@query(TX + "SELECT event_type, count(*) FILTER (WHERE k % 9 <> 0 AND k % 5 <> 0) AS good, count(*) FILTER (WHERE k % 9 = 0 OR k % 5 = 0) AS bad FROM tx GROUP BY event_type")
def p27_payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("K"), F.col("k").cast("string"))
    fields = F.when(F.col("k") % 5 == 0, F.map_concat(fields, F.create_map(F.lit("other"), F.lit("1")))).otherwise(fields)
    rows = tx(spark, sf_dir).select("event_type", F.when(F.col("k") % 9 != 0, F.col("amount")).alias("amount"), fields.alias("v"))
    good, bad = io.validate_payload(rows, ["amount"], "v", ["k"])
    both = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return both.groupBy("event_type").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query(TX + "SELECT id, CAST(2 AS INTEGER) AS n_fields, CAST(k % 9 = 0 AS INTEGER) AS n_null FROM tx WHERE tx_day = 3")
def io16_day_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", "tx_day", F.when(F.col("k") % 9 != 0, F.col("amount")).alias("v1"), F.col("k").cast("double").alias("v2"))
    payloads = io.day_payloads(d, "tx_day", 3, ["id"], ["v1", "v2"])
    parsed = F.from_json("payload", "id long, v map<string, double>")
    return payloads.select(parsed.alias("x")).select("x.id", F.size("x.v").alias("n_fields"), F.size(F.filter(F.map_values("x.v"), lambda v: v.isNull())).alias("n_null"))


@query(TX + "SELECT tx_day, count(*) AS n, round(avg(CASE WHEN k % 9 <> 0 THEN amount END), 6) AS amount, count(k) AS n_k FROM tx WHERE tx_day BETWEEN 5 AND 9 GROUP BY tx_day")
def io14_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    served = F.to_json(F.struct(F.when(F.col("k") % 9 != 0, F.col("amount")).alias("amount"), "k"), {"ignoreNullFields": "false"})
    log = io.decision_log(d.select("id", "p", served.alias("features")), d.select("id", "tx_day"), "id", "tx_day", ["amount", "k"], 5, 9)
    return rounded(log.groupBy("tx_day").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("amount"), F.count("k").alias("n_k")))


@query(TX + """, g AS (SELECT CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM tx), a AS (SELECT 'natural' AS arm, 1.0::DOUBLE AS weight, pos / neg AS odds, pos / neg AS own FROM g UNION ALL SELECT 'weighted', neg / pos, pos / neg, pos / neg FROM g UNION ALL SELECT 'oversampled', 1.0, 0.5, pos / neg FROM g UNION ALL SELECT 'oversampled_weighted', 2.0, 0.5, pos / neg FROM g)
SELECT arm, round(weight, 6) AS weight, round(odds / (1 + odds), 6) AS prior, round(weight * odds / own, 6) AS odds_factor FROM a""")
def m4_arm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CA.arm_weights(tx(spark, sf_dir), "y", 0.5))


@query(TX + """, x AS (SELECT split, CASE WHEN k % 9 <> 0 THEN amount END AS amount, k FROM tx WHERE split IS NOT NULL), m AS (SELECT median(amount) AS a, median(k) AS k FROM x WHERE split = 'train'),
f AS (SELECT split, coalesce(x.amount, m.a) AS amount, CAST(coalesce(x.k, m.k) AS DOUBLE) AS k FROM x, m), s AS (SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(k) AS mk, stddev_pop(k) AS sk FROM f WHERE split = 'train')
SELECT split, count(*) AS n, round(avg((amount - ma) / sa) + 1e-9, 5) + 0.0 AS amount, round(avg((k - mk) / sk) + 1e-9, 5) + 0.0 AS k FROM f, s GROUP BY split""")
def m5_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).where("split is not null").select("split", F.when(F.col("k") % 9 != 0, F.col("amount")).alias("amount"), "k")
    s = CA.standardised(d, d.where("split = 'train'"), ["amount", "k"])
    return rounded(s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("amount"), F.avg("k").alias("k")), 5, 1e-9)


@query()
def m14_calibrator_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).where("split is not null").withColumn("fold", F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2))
    return rounded(CA.choose(d, "y", "p", "fold"))


@query(TX + ", m AS (SELECT avg(amount) AS a, avg(k) AS k FROM tx), c AS (SELECT 'amount' AS feature, 0.5 * (amount - m.a) AS c FROM tx, m UNION ALL SELECT 'k', -0.25 * (tx.k - m.k) FROM tx, m) SELECT feature, round(avg(abs(c)), 6) AS importance FROM c GROUP BY feature")
def m20_linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.importance(AT.linear_contributions(tx(spark, sf_dir), "id", {"amount": 0.5, "k": -0.25})))


@query(TX + """SELECT 'ordered' AS "check", CAST(0 AS BIGINT) AS seen, true AS ok UNION ALL SELECT 'constant', 0, true UNION ALL SELECT 'forbidden', 0, true
UNION ALL SELECT 'disjoint', count(*), count(*) = 0 FROM (SELECT id FROM tx WHERE split IS NOT NULL GROUP BY id HAVING count(DISTINCT split) > 1)""")
def c2_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.structure(tx(spark, sf_dir), "id", ["amount", "k"], ["id", "y"], ["train", "valid", "test"], 0)


@query(TX + "SELECT d.tx_day, count(tx.id) AS n FROM (SELECT CAST(i AS INTEGER) AS tx_day FROM range(40) r(i)) d LEFT JOIN tx ON tx.tx_day = d.tx_day GROUP BY d.tx_day")
def c8_days_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.days_present(tx(spark, sf_dir), "tx_day", 0, 39)


@query(TX + "SELECT split, count(*) AS \"rows\", min(tx_day) AS first_day, max(tx_day) AS last_day, round(avg(y), 6) AS prevalence, false AS ok FROM tx WHERE split IS NOT NULL GROUP BY split")
def c10_expected_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(AU.expected_shape(tx(spark, sf_dir), {"train": (0, 0, 13, 0.2)}))


@query(TX + "SELECT tx_day, count(*) AS n, count(*) FILTER (WHERE k = 70) AS differing, CAST(1 AS BIGINT) AS thresholds FROM tx GROUP BY tx_day")
def c12_decision_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("decision", F.when(F.col("k") > 70, "review").otherwise("accept"))
    return AU.decision_drift(d, "tx_day", "p", "decision", F.lit(0.7))
