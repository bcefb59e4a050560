"""Queries of learning: oversampling, folds, cross-validation, calibration and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import calibrate as CA
from riskframe.operators import decision as D
from riskframe.operators import learn as L
from riskframe.operators import monitor as MO
from riskframe.operators import split as S
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import TX, tx
from riskframe.sources.io import written

FEATURES = ["amount", "k", "hour", "history"]
FOLDS = S.purged_folds(0, 27, 3, 1, 1)
ARMS = [L.Arm("logreg"), L.Arm("logreg", weighted=True), L.Arm("logreg", ratio=0.5)]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a few features, one of them with nulls, and a label that depends on them, laid out for fits."""
    d = tx(spark, sf_dir)
    label = ((F.col("k") + F.col("amount") / 4 + F.col("id") % 40) > 110).cast("int")
    d = d.select("id", "tx_day", "split", "amount", F.when(F.col("k") % 9 != 0, F.col("k").cast("double")).alias("k"), F.pmod(F.floor(F.col("t") / 3600), F.lit(24)).cast("double").alias("hour"), (F.col("user_id") % 7).cast("double").alias("history"), label.alias("y"))
    return L.laid_out(d, "id")


LEARN = TX + ", r AS (SELECT id, tx_day, split, amount, CASE WHEN k % 9 <> 0 THEN k END AS k, CAST(k + amount / 4 + id % 40 > 110 AS INTEGER) AS y FROM tx)"
#: Rows that training and validation have in each fold, by the same arithmetic in SQL.
SPANS = "(VALUES " + ", ".join(f"({f.fold}, '{role}', {lo}, {hi})" for f in FOLDS for role, (lo, hi) in (("train", f.train), ("valid", f.valid))) + ") f(fold, role, lo, hi)"


@query(TX + f"SELECT fold, role, count(*) AS n, round(avg(y), 6) AS rate FROM tx, {SPANS} WHERE tx_day BETWEEN lo AND hi GROUP BY ALL")
def u4_purged_folds_of_the_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    first, last = d.agg(F.min("tx_day"), F.max(F.when(F.col("tx_day") < 28, F.col("tx_day")))).first()
    return rounded(S.fold_table(d, S.purged_folds(first, last, 3, 1, 1), "y"))


@query(LEARN + """, m AS (SELECT id, (amount - a) / s AS x FROM r, (SELECT avg(amount) AS a, stddev_pop(amount) AS s FROM r) WHERE y = 1),
n AS (SELECT 0.8 * count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1) - 1 AS q FROM r), pool AS (SELECT * FROM m),
near AS (SELECT m.id, m.x, o.x AS other, row_number() OVER (PARTITION BY m.id ORDER BY round((m.x - o.x) ** 2, 9), o.id) - 1 AS place, count(*) OVER (PARTITION BY m.id) AS have FROM m JOIN pool o ON o.id <> m.id),
copies AS (SELECT id, CAST(floor(q) AS BIGINT) + CAST(CAST('0x' || substr(md5(id || ':n0'), 1, 8) AS BIGINT) / 4294967296.0 < q - floor(q) AS BIGINT) AS c FROM m, n),
made AS (SELECT id, unnest(range(1, c + 1)) AS j FROM copies),
s AS (SELECT near.x + CAST('0x' || substr(md5(made.id || ':' || j || ':u0'), 1, 8) AS BIGINT) / 4294967296.0 * (other - near.x) AS x FROM made JOIN near ON near.id = made.id AND place = CAST(floor(CAST('0x' || substr(md5(made.id || ':' || j || ':p0'), 1, 8) AS BIGINT) / 4294967296.0 * least(have, 5)) AS BIGINT))
SELECT count(*) AS synthetic, round(sum(x), 4) AS total, round(min(x), 6) AS least, round(max(x), 6) AS most FROM s""")
def m6_smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir).select("id", "y", "amount")
    d = L.smote(L.prepare(d, ["amount"]).apply(d), "id", "y", ["amount"], 0.8).where("id IS NULL")
    out = d.agg(F.count(F.lit(1)).alias("synthetic"), F.sum("amount").alias("total"), F.min("amount").alias("least"), F.max("amount").alias("most"))
    return rounded(out).withColumn("total", F.round("total", 4))


@query()
def m7_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir)
    return rounded(L.compare(d.where("split = 'train'"), {"valid": d.where("split = 'valid'")}, "id", "y", FEATURES, {"logreg": ARMS[0]}), 4)


@query()
def m8_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir)
    return rounded(L.compare(d.where("split = 'train'"), {"valid": d.where("split = 'valid'")}, "id", "y", FEATURES, {"gbt": L.Arm("gbt", strength=0.1)}), 4)


TREES = L.Arm("gbt", strength=0.1, trees=20, depth=5)


@query(LEARN + """, v AS (SELECT count(*) AS n FROM r WHERE split = 'valid'), f(feature) AS (VALUES ('amount'), ('k'), ('hour'), ('history'))
SELECT feature, n AS "rows", CAST(0 AS BIGINT) AS "off", true AS matters FROM f, v WHERE feature IN ('amount', 'k') UNION ALL SELECT feature, n, 0, false FROM f, v WHERE feature NOT IN ('amount', 'k')""")
def m20_tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By feature: rows explained, rows of which the contributions and the base miss the model's log-odds, and whether
    the feature matters (a tenth of the whole mass), as the label's makeup says."""
    d = rows(spark, sf_dir)
    fitted = L.fit(d.where("split = 'train'"), "id", "y", FEATURES, TREES)
    valid = d.where("split = 'valid'")
    contributions, base = fitted.explain(valid, "id")
    contributions = written(contributions, "contributions")  # three passes read them
    margins = fitted.score(valid).select("id", F.log(F.col("p") / (1 - F.col("p"))).alias("margin"))
    off = contributions.groupBy("id").agg((F.sum("contribution") + base).alias("total")).join(margins, "id", "full").agg(F.count_if(F.coalesce(F.abs(F.col("total") - F.col("margin")) > 1e-6, F.lit(True))).alias("off"))
    mass = contributions.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.abs("contribution")).alias("mass"))
    all_ = mass.agg(F.sum("mass").alias("all"))
    return mass.crossJoin(all_).crossJoin(off).select("feature", "rows", "off", (F.col("mass") > 0.1 * F.col("all")).alias("matters"))  # four rows and one each


@query(LEARN + "SELECT CAST(count(*) AS BIGINT) AS \"rows\", true AS all_positive, true AS in_order FROM r WHERE split = 'valid'")
def t3_tree_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest positive contributions of each row, from the fitted trees."""
    d = rows(spark, sf_dir)
    valid = d.where("split = 'valid'")
    contributions, _ = L.fit(d.where("split = 'train'"), "id", "y", FEATURES, TREES).explain(valid, "id")
    codes = MO.reason_codes(contributions, "id", 3).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "contribution"))).alias("c"))
    seen = valid.select("id").join(codes, "id", "left")
    fell = F.forall(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1)["contribution"] >= F.get("c", i)["contribution"])
    return seen.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.min(F.forall("c", lambda x: x["contribution"] > 0).cast("int")) == 1, F.lit(True)).alias("all_positive"), F.coalesce(F.min(F.when(F.size("c") > 1, fell.cast("int"))) == 1, F.lit(True)).alias("in_order"))


@query(LEARN + "SELECT CAST(m AS INTEGER) AS k, count(*) AS n, round(avg(y), 6) AS prevalence, true AS finds FROM r, (SELECT unnest([4, 2, 1]) AS m) WHERE split = 'valid' GROUP BY m")
def t5_compact_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the most important features by their contributions on training rows, and whether each of them finds more
    than chance does."""
    d = rows(spark, sf_dir)
    train, valid = d.where("split = 'train'"), d.where("split = 'valid'")
    fitted = L.fit(train, "id", "y", FEATURES, TREES)
    contributions, _ = fitted.explain(train, "id")
    found = L.compact_models(train, valid, "id", "y", MO.importance(contributions), [2, 1], TREES, fitted)
    return rounded(found.select("k", "n", "prevalence", (F.col("pr_auc") > F.col("prevalence")).alias("finds")))


@query()
def m10_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid over the learning rate, the number and the depth of trees, on all folds."""
    arms = [L.Arm("gbt", strength=rate, trees=n, depth=depth) for rate in (0.1, 0.3) for n in (10, 20) for depth in (2, 4)]
    return rounded(L.search(rows(spark, sf_dir), "id", "y", FEATURES, FOLDS, arms), 4)


@query()
def m9_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.cross_validate(rows(spark, sf_dir), "id", "y", FEATURES, FOLDS, ARMS[0]), 4)


@query()
def m10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.search(rows(spark, sf_dir), "id", "y", FEATURES, FOLDS, ARMS), 4)


@query(LEARN + f"SELECT fold, count(*) AS n, count(DISTINCT id) AS ids, min(tx_day) AS first_day, max(tx_day) AS last_day, round(avg(y), 6) AS rate, true AS in_unit FROM r, {SPANS} WHERE role = 'valid' AND tx_day BETWEEN lo AND hi GROUP BY fold")
def m11_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof = L.out_of_fold(rows(spark, sf_dir), "id", "y", FEATURES, FOLDS, ARMS[0])
    inside = F.min(((F.col("p") > 0) & (F.col("p") < 1)).cast("int")) == 1
    return rounded(oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("tx_day").alias("first_day"), F.max("tx_day").alias("last_day"), F.avg("y").alias("rate"), inside.alias("in_unit")))


@query(TX + """SELECT 'analytic' AS kind, round(avg(p / (p + 2.5 * (1 - p))), 6) AS mean_p FROM tx UNION ALL SELECT 'identity', round(avg(p), 6) FROM tx""")
def m15_fixed_calibrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"identity": CA.IDENTITY, "analytic": CA.analytic(2.5)}
    p = F.array(*(F.struct(F.lit(n).alias("kind"), CA.calibrated(F.col("p"), c).alias("q")) for n, c in kinds.items()))
    return rounded(tx(spark, sf_dir).select(F.inline(p)).groupBy("kind").agg(F.avg("q").alias("mean_p")))


@query()
def m16_refit_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted arm overstates; its calibrator, fitted out of fold, brings the mean score to the rate."""
    d = rows(spark, sf_dir)
    train, valid = d.where("split = 'train'"), d.where("split = 'valid'")
    found = L.calibrator(L.out_of_fold(train, "id", "y", FEATURES, S.purged_folds(0, 13, 3, 1, 1), ARMS[1]), "y", "shift")
    scored = L.refit_and_score(train, valid, "id", "y", FEATURES, ARMS[1], found)
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg("p_raw").alias("mean_raw"), F.avg("p").alias("mean_p")), 4)


@query()
def m17_arm_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir)

    def rules(scored: DataFrame) -> DataFrame:
        found = D.evaluate(scored, "y", F.col("p") >= 0.5, "amount", 4.0)
        return found.select("cost", "savings", "review_rate")

    return rounded(L.select_arm(d.where("split = 'train'"), d.where("split = 'valid'"), "id", "y", FEATURES, S.purged_folds(0, 13, 3, 1, 1), ARMS[:2], rules), 4)


@query()
def m18_ratio_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir)
    return rounded(L.ratio_sweep(d.where("split = 'train'"), d.where("split = 'valid'"), "id", "y", FEATURES, [0.3, 0.6, 1.0]), 4)


@query()
def m19_leakage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the label among the features the probe is too good to be true; that is what it is there to say."""
    d = rows(spark, sf_dir).withColumn("leak", F.col("y").cast("double"))
    others = {s: d.where(F.col("split") == s) for s in ("valid", "test")}
    found = L.leakage_probe(d.where("split = 'train'"), others, "id", "y", {"clean": FEATURES, "leak": [*FEATURES, "leak"]})
    return rounded(found.withColumn("leak", F.col("name") == "leak").drop("name"), 4)
