"""Check reports over inputs with planted faults: the SQL counts what the report has to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.rowwise import feature_family
from riskframe.operators import audit as AU
from riskframe.operators import checks as C
from riskframe.operators import drift as DR
from riskframe.operators import rank_metrics as RM
from riskframe.operators.split import Fold
from riskframe.plans.monitoring import CONTRIB, contributions
from riskframe.plans.registry import query
from riskframe.plans.views import TX, tx
from riskframe.sources import io

RESULT = 'SELECT "check", CAST(bad AS BIGINT) AS bad, CASE WHEN bad = 0 THEN \'pass\' ELSE \'fail\' END AS result FROM ({}) r("check", bad)'


def rows_sql(checks: dict[str, str]) -> str:
    return RESULT.format(" UNION ALL ".join(f"SELECT '{name}', ({count})" for name, count in checks.items()))


# Faults: a constant feature, the label among the features, ids in two splits, no gap between train and valid.
FAULTY = TX + """, f AS (SELECT id, y, tx_day, CASE WHEN tx_day < 14 THEN 'train' WHEN tx_day < 20 THEN 'valid' ELSE 'test' END AS split, amount, 7 AS flat, k FROM tx
UNION ALL SELECT id, y, tx_day, 'test', amount, 7, k FROM tx WHERE tx_day < 2 AND k % 10 = 0)
"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    split = F.when(F.col("tx_day") < 14, "train").when(F.col("tx_day") < 20, "valid").otherwise("test")
    first = d.select("id", "y", "tx_day", split.alias("split"), "amount", F.lit(7).alias("flat"), "k")
    return first.union(d.where("tx_day < 2 AND k % 10 = 0").select("id", "y", "tx_day", F.lit("test"), "amount", F.lit(7), "k"))


ORDERED = "SELECT (SELECT CAST(min(tx_day) FILTER (WHERE split = 'valid') - max(tx_day) FILTER (WHERE split = 'train') <= 3 AS INTEGER) + CAST(min(tx_day) FILTER (WHERE split = 'test') - max(tx_day) FILTER (WHERE split = 'valid') <= 3 AS INTEGER) FROM f)"
CONSTANT = "SELECT count(*) FROM (SELECT count(DISTINCT amount) AS n FROM f WHERE split = 'train' UNION ALL SELECT count(DISTINCT flat) FROM f WHERE split = 'train' UNION ALL SELECT count(DISTINCT y) FROM f WHERE split = 'train') WHERE n <= 1"
SHARED = "SELECT count(*) FROM (SELECT id FROM f GROUP BY id HAVING count(DISTINCT split) > 1)"


@query(FAULTY + 'SELECT "check", CAST(seen AS BIGINT) AS seen, seen = 0 AS ok FROM (' + " UNION ALL ".join(f"SELECT '{n}', ({s})" for n, s in {"ordered": ORDERED, "constant": CONSTANT, "forbidden": "SELECT count(*) FROM (SELECT unnest(['amount', 'flat', 'y']) AS c) WHERE c IN ('id', 'y')", "disjoint": SHARED}.items()) + ') r("check", seen)')
def c2_structure_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.structure(faulty(spark, sf_dir), "id", ["amount", "flat", "y"], ["id", "y"], ["train", "valid", "test"], 3)


AUC = """SELECT count(*) FROM (SELECT sum((n - pos) * (tp - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))) AS auc FROM (SELECT feature, pos, n, sum(pos) OVER (PARTITION BY feature ORDER BY x DESC) AS tp FROM (SELECT feature, x, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM (SELECT 'amount' AS feature, amount AS x, y FROM f WHERE split = 'train' UNION ALL SELECT 'y', y, y FROM f WHERE split = 'train' UNION ALL SELECT 'flat', flat, y FROM f WHERE split = 'train') GROUP BY ALL)) GROUP BY feature) WHERE greatest(auc, 1 - auc) > 0.95"""


@query(FAULTY + ", p AS (SELECT * FROM (VALUES ('valid', true), ('test', false)) t(part, plausible)) " + rows_sql({"ordered": ORDERED, "constant": CONSTANT, "forbidden": "SELECT 1", "disjoint": SHARED, "separation": AUC, "unseen": "SELECT count(*) FROM (SELECT split, avg(CAST(k % 3 - 1 = -1 AS INTEGER)) AS s FROM f WHERE split <> 'train' GROUP BY split UNION ALL SELECT split, avg(CAST(flat = -1 AS INTEGER)) FROM f WHERE split <> 'train' GROUP BY split) WHERE s > 0.5", "missing_drift": "SELECT 0", "probe": "SELECT count(*) FROM p WHERE NOT plausible"}))
def c3_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = faulty(spark, sf_dir).withColumn("code", F.col("k") % 3 - 1)
    features = ["amount", "flat", "y"]
    separation = RM.feature_auc(d.where("split = 'train'").withColumn("label", F.col("y")), features, "label")
    probe = spark.createDataFrame([("valid", True), ("test", False)], "part string, plausible boolean")
    return C.validation_report(d, separation, probe, "id", features, ["id", "y"], ["train", "valid", "test"], 3, ["code", "flat"])


FOLDS = [Fold(0, (0, 5), (8, 9)), Fold(1, (0, 8), (10, 13))]


@query(
    TX
    + ", o AS (SELECT id, tx_day, p, CASE WHEN tx_day <= 9 THEN 0 ELSE 1 END AS fold FROM tx WHERE tx_day BETWEEN 8 AND 13 UNION ALL SELECT id, tx_day, p, 1 FROM tx WHERE tx_day = 8 AND k < 20) "
    + rows_sql(
        {
            "same contract": "SELECT 1",
            "key and label absent": "SELECT 0",
            "parts in order": "SELECT CAST((SELECT min(tx_day) FROM tx WHERE split = 'valid') - (SELECT max(tx_day) FROM tx WHERE split = 'train') <= 2 AS INTEGER)",
            "parts disjoint": "SELECT 0",
            "folds purged": "SELECT 1",
            "folds in order": "SELECT 0",
            "validation blocks disjoint": "SELECT 0",
            "out-of-fold rows in their block": "SELECT count(*) FROM o WHERE NOT (fold = 0 AND tx_day BETWEEN 8 AND 9 OR fold = 1 AND tx_day BETWEEN 10 AND 13)",
            "out-of-fold rows once": "SELECT count(*) FROM (SELECT id FROM o GROUP BY id HAVING count(*) > 1)",
            "out-of-fold rows of training only": "SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM tx WHERE split = 'train')",
            "validation prevalence untouched": "SELECT CAST(abs(avg(y) - 0.25) >= 5e-5 AS INTEGER) FROM tx WHERE split = 'valid'",
            "prior correction lowers": "SELECT 0",
            "prior correction keeps order": "SELECT 0",
            "calibrator monotone": "SELECT 0",
        }
    )
)
def c4_protocol_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults: feature orders differ, one gap is wide by a day, rows scored twice, a prevalence that is not the agreed one."""
    d = tx(spark, sf_dir)
    fold = F.when(F.col("tx_day") <= 9, 0).otherwise(1)
    oof = d.where("tx_day BETWEEN 8 AND 13").select("id", "tx_day", "p", fold.alias("fold"))
    oof = oof.union(d.where("tx_day = 8 AND k < 20").select("id", "tx_day", "p", F.lit(1)))
    return C.protocol_report(d.where("split = 'train'"), d.where("split = 'valid'"), oof, FOLDS, "id", "y", "tx_day", 1, (["a", "b"], ["a", "c", "b"]), ["t"], 0.25, ("platt", 0.8, -0.1), (0.3, 0.2))


@query(
    CONTRIB
    + ", m AS (SELECT id, sum(contribution) + 2 + CASE WHEN id % 500 = 3 THEN 0.5 ELSE 0 END AS margin FROM c GROUP BY id), x AS (SELECT id, sum(contribution) AS total FROM c GROUP BY id) "
    + rows_sql(
        {
            "additive on every row": "SELECT count(*) FROM x JOIN m USING (id) WHERE abs(total + 2 - margin) >= 1e-4",
            "mean of sums is the mean margin": "SELECT CAST(abs(avg(total) + 2 - avg(margin)) >= 1e-4 AS INTEGER) FROM x JOIN m USING (id)",
            "every feature in a group": "SELECT count(DISTINCT feature) FROM c WHERE feature NOT IN ('v0', 'v1', 'amt_log', 'card_freq', 'v9')",
            "no group of unknown features": "SELECT count(*) FROM (SELECT unnest(['v0', 'v1', 'amt_log', 'card_freq', 'v9']) AS f) WHERE f NOT IN (SELECT feature FROM c)",
            "every feature in one family": "SELECT 0",
            "family sums make the total": "SELECT 0",
            "selection rows kept out": "SELECT count(*) FROM m WHERE id < 5",
            "one margin a row": "SELECT 0",
            "contributions once a row and feature": "SELECT count(*) FROM (SELECT 1 FROM c GROUP BY id, feature HAVING count(*) > 1)",
            "calibrator monotone": "SELECT 1000",
        }
    )
)
def c5_explanation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults: margins off on some rows, features without a group and a group without features, selection rows among
    the explained, and a calibrator that falls."""
    c = contributions(spark, sf_dir)
    off = F.when(F.col("id") % 500 == 3, 0.5).otherwise(0.0)
    margins = c.groupBy("id").agg(F.sum("contribution").alias("t")).select("id", (F.col("t") + 2 + off).alias("margin"))
    groups = {f: "g1" for f in ("v0", "v1", "amt_log", "card_freq", "v9")}
    selected = tx(spark, sf_dir).where("id < 5").select("id")
    return C.explanation_report(c, margins, "id", groups, feature_family(F.col("feature")), selected, 2.0, ("platt", -0.02, 0.0))


@query(
    TX
    + rows_sql(
        {
            "store sealed": "SELECT count(*) + count(*) FILTER (WHERE k = 7) FROM tx WHERE tx_day > 20",
            "store without repeats": "SELECT count(*) FROM tx WHERE k = 7",
            "served features equal batch": "SELECT count(*) FROM tx WHERE k % 50 = 0",
            "nulls equal batch": "SELECT count(*) FROM tx WHERE k % 50 = 0",
            "decisions follow the threshold": "SELECT count(*) FROM tx WHERE k = 70",
            "no decision flips": "SELECT count(*) FROM tx WHERE k = 71 AND (k + 0.5) / 100 >= 0.7",
            "one decision a key": "SELECT 0",
            "scores are probabilities": "SELECT 0",
            "calibrator monotone": "SELECT 0",
        }
    )
)
def c6_serving_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults: history past its seal, repeated keys, served nulls, a decision at the threshold, and a flip."""
    d = tx(spark, sf_dir)
    history = d.select("id", "tx_day").union(d.where("k = 7").select("id", "tx_day"))
    served = d.select("id", "amount", F.when(F.col("k") % 50 != 0, F.col("k")).alias("k"))
    log = d.select("id", F.when(F.col("k") == 71, 0.69).otherwise(F.col("p")).alias("p"))
    log = log.withColumn("decision", F.when((F.col("p") >= 0.7) & (F.col("p") != 0.705), "review").otherwise("accept"))
    return C.serving_report(history, served, d.select("id", "amount", "k", "p"), log, "id", "tx_day", 20, ["amount", "k"], 0.7, ("platt", 1.2, 0.3))


@query(
    TX
    + ", r AS (SELECT avg(CAST(k % 3 = 0 AS INTEGER)) AS m FROM tx WHERE split = 'train') "
    + rows_sql(
        {
            "sealed keys out of the log": "SELECT count(*) FROM tx WHERE split = 'test' AND k = 5",
            "days inside the window": "SELECT count(*) FROM tx WHERE (split = 'valid' OR split = 'test' AND k = 5) AND tx_day NOT BETWEEN 21 AND 23",
            "sources unchanged": "SELECT 1",
            "one threshold": "SELECT 1",
            "as many monitored features as agreed": "SELECT 1",
            "monitored features in the contract": "SELECT 1",
            "monitored features mostly present": "SELECT CAST(m > 0.3 AS INTEGER) FROM r",
            "references reproduce themselves": "SELECT 0",
            "one decision a key": "SELECT 0",
            "baseline calls for no retraining": "SELECT 1",
        }
    )
)
def c7_monitoring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults: sealed rows in the log, days past the window, a changed source, two thresholds, features too few,
    unknown or mostly missing, and a baseline day that calls for retraining."""
    d = tx(spark, sf_dir)
    log = d.where("split = 'valid' OR split = 'test' AND k = 5").select("id", F.when(F.col("id") % 100 == 0, 0.6).otherwise(0.7).alias("th"))
    train = d.where("split = 'train'").select(F.lit(0).alias("tx_day"), "amount", F.when(F.col("k") % 3 != 0, F.col("k")).alias("k"))
    reference = DR.build_reference(train, ["amount", "k"])
    own = DR.daily_psi(train, reference, ["amount", "k"], "tx_day")
    verdicts = spark.createDataFrame([(0, "no_action"), (1, "retrain")], "tx_day int, decision string")
    digests = (io.digest(train), io.digest(train.where("amount > 1")))
    return C.monitoring_report(log, d.where("split = 'test'"), d.select("id", "tx_day"), reference, own, verdicts, "id", "tx_day", (21, 23), ["amount", "p"], 3, 0.3, F.col("th"), digests)


# Faults: a day left out and one scored too early, rows twice, unlabelled or with another threshold, decisions that do
# not follow it, an earlier run that lost rows, a reference that changed, drift of a sealed day and without its variant,
# a second opening, keys that chose the model or were resampled.
FINAL = TX + ", f AS (SELECT * FROM tx WHERE split = 'test' AND tx_day <> 27) "


@query(
    FINAL
    + rows_sql(
        {
            "opened once": "SELECT 1",
            "as many rows as expected": "SELECT abs((SELECT count(*) + count(*) FILTER (WHERE k = 7) FROM f) - (SELECT count(*) FROM tx WHERE split = 'test'))",
            "every row labelled": "SELECT count(*) FILTER (WHERE k % 50 = 1) FROM f",
            "no run pending": "SELECT count(*) FROM tx WHERE split = 'valid' AND k = 3",
            "one decision a key": "SELECT count(*) FILTER (WHERE k = 7) FROM f",
            "earlier rows untouched": "SELECT 2",
            "days scored in order": "SELECT 1",
            "every day present": "SELECT 1",
            "no day outside": "SELECT 0",
            "one threshold everywhere": "SELECT count(*) FILTER (WHERE k = 65) FROM f",
            "decisions follow the threshold": "SELECT count(*) FILTER (WHERE k = 65) FROM f",
            "specification unchanged": "SELECT 0",
            "reference unchanged": "SELECT 1",
            "sources unchanged": "SELECT 0",
            "drift inside the days": "SELECT 2",
            "both variants of drift": "SELECT 1",
            "no selection on scored rows": "SELECT count(*) FILTER (WHERE k = 9) FROM f",
            "no scored row was resampled": "SELECT count(*) FILTER (WHERE k = 11) FROM f",
        }
    )
)
def c8_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    test = d.where("split = 'test'")
    at = F.timestamp_seconds(F.when(F.col("tx_day") == 26, 10).otherwise(F.col("tx_day")))
    final = test.where("tx_day <> 27").withColumns({"threshold": F.when(F.col("k") == 65, 0.6).otherwise(0.7), "run_label": F.lit("final"), "scored_at": at})
    final = final.withColumn("decision", F.when(F.col("p") >= 0.7, "review").otherwise("accept"))
    old = d.where("split = 'train'").limit(10).withColumns({"threshold": F.lit(0.7), "run_label": F.lit("old-1"), "scored_at": F.timestamp_seconds(F.lit(0)), "decision": F.lit("accept")})
    pending = d.where("split = 'valid' AND k = 3").withColumns({"threshold": F.lit(0.7), "run_label": F.lit("pending"), "scored_at": F.timestamp_seconds(F.lit(0)), "decision": F.lit("accept")})
    log = final.union(final.where("k = 7")).unionByName(old).unionByName(pending)
    labels = d.select("id", F.when(F.col("k") % 50 != 1, F.col("y")).alias("label"))
    days = [(day, variant, 0.1) for day in range(25, 31) for variant in ("carried", "own") if (day, variant) != (26, "own")]
    drift = spark.createDataFrame(days, "tx_day int, variant string, psi double")
    selection = d.where("split = 'valid' OR split = 'test' AND k = 9").select("id")
    frozen = {"specification": ("a", "a"), "reference": ("a", "b"), "sources": (io.digest(test), io.digest(test.orderBy("amount")))}
    return C.evaluation_report(log, labels, drift, "id", "tx_day", "final", test.count(), ("old", 12), (25, 29), [0.7, 0.7], frozen, 2, selection, d.where("k = 11").select("id"))


@query(TX + "SELECT 'first_day: 0 is now 3' AS reason UNION ALL SELECT 'positives: ' || (SELECT sum(y) FROM tx) || ' is now ' || (SELECT sum(y) FROM tx WHERE tx_day >= 3) UNION ALL SELECT 'rows: ' || (SELECT count(*) FROM tx) || ' is now ' || (SELECT count(*) FROM tx WHERE tx_day >= 3)")
def c11_stale_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    cached, current = (C.fingerprint(x, "y", "tx_day", ["amount", "k"]) for x in (d, d.where("tx_day >= 3")))
    return spark.createDataFrame([(r,) for r in C.stale_reasons(cached, current)], "reason string")


@query(TX + ", s AS (SELECT id, amount AS a, amount * (1 + CASE WHEN k % 50 = 1 THEN 0.01 ELSE 1e-6 END) AS b FROM tx) SELECT 'amount' AS feature, count(*) AS cells, count(*) FILTER (WHERE abs(a - b) > 1e-5 + 1e-4 * abs(b)) AS differing FROM s UNION ALL SELECT 'k', count(*), count(*) FILTER (WHERE k % 40 = 0) FROM tx")
def j16_parity_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts off by a hundredth on some rows, and nulls on one side only."""
    d = tx(spark, sf_dir).select("id", "amount", "k")
    served = d.select("id", (F.col("amount") * (1 + F.when(F.col("k") % 50 == 1, 0.01).otherwise(1e-6))).alias("amount"), F.when(F.col("k") % 40 != 0, F.col("k")).alias("k"))
    return io.compare_frames(d, served, "id", ["amount", "k"])


@query(TX + """, g AS (SELECT split, count(*) AS n, min(tx_day) AS a, max(tx_day) AS b, avg(y) AS r FROM tx WHERE split IS NOT NULL GROUP BY split) SELECT split, n AS "rows", a AS first_day, b AS last_day, round(r, 6) AS prevalence, CASE split WHEN 'train' THEN a = 0 AND b = 13 AND abs(r - (SELECT avg(y) FROM tx WHERE split = 'train')) <= 1e-3 WHEN 'valid' THEN b = 23 ELSE false END AS ok FROM g""")
def c10_shape_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.plans.registry import rounded

    d = tx(spark, sf_dir)
    n, r = d.where("split = 'train'").agg(F.count(F.lit(1)), F.avg("y")).first()
    return rounded(AU.expected_shape(d, {"train": (n, 0, 13, r + 5e-4), "valid": (n, 21, 23, 0.2)}))
