"""Queries of feature validation, reports, joins, samples and contracts, over inputs with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import rowwise as R
from riskframe.operators import decision as D
from riskframe.operators import profile as P
from riskframe.operators import split as S
from riskframe.operators import validate as V
from riskframe.plans.monitoring import CONTRIB, contributions
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import TX, table, tx
from riskframe.sources import io

CODES = TX + ", codes AS (SELECT split, CASE WHEN k % 10 = 3 AND split = 'valid' THEN -1 ELSE k % 10 END AS a, CASE WHEN k > 90 AND split = 'test' THEN -1 ELSE 0 END AS b, 1 AS c FROM tx)"


def coded(d: DataFrame) -> DataFrame:
    new = lambda bad, other: F.when(bad, -1).otherwise(other)
    return d.withColumns({"a": new((F.col("k") % 10 == 3) & (F.col("split") == "valid"), F.col("k") % 10), "b": new((F.col("k") > 90) & (F.col("split") == "test"), F.lit(0)), "c": F.lit(1)})


@query(CODES + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT split, '{c}' AS feature, round(avg(CAST({c} = -1 AS INTEGER)), 6) AS unseen_share FROM codes WHERE split IS NOT NULL GROUP BY split" for c in "abc") + ") WHERE unseen_share > 0")
def a40_unseen_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.unseen_share(coded(tx(spark, sf_dir)), ["a", "b", "c"]))


@query(TX + """, m AS (SELECT split, CAST(k % 9 = 0 AS INTEGER) AS a, CAST(k % 2 = 0 AND split = 'test' AS INTEGER) AS b FROM tx), s AS (SELECT split, 'a' AS feature, avg(a) AS m FROM m GROUP BY split UNION ALL SELECT split, 'b', avg(b) FROM m GROUP BY split)
SELECT x.feature, round(x.m, 6) AS before, round(y.m, 6) AS after, round(abs(y.m - x.m), 6) AS delta FROM s x JOIN s y USING (feature) WHERE x.split = 'train' AND y.split = 'test' AND abs(y.m - x.m) > 0.25""")
def a41_missing_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumns({"a": F.when(F.col("k") % 9 != 0, F.col("k")), "b": F.when((F.col("k") % 2 != 0) | (F.col("split") != "test"), F.col("k"))})
    return rounded(V.missing_drift(d.where("split = 'train'"), d.where("split = 'test'"), ["a", "b"]))


@query(CONTRIB + ", i AS (SELECT feature, avg(abs(contribution)) AS importance FROM c GROUP BY feature), m AS (SELECT * FROM (VALUES ('v0', 0.1), ('v1', 0.4), ('v2', 0.3), ('v3', 0.0), ('amt_log', 0.0)) t(feature, missing)) SELECT feature, round(importance, 6) AS importance, CAST(missing AS DOUBLE) AS missing FROM i JOIN m USING (feature) WHERE missing <= 0.3 ORDER BY i.importance DESC, feature LIMIT 3")
def a43_monitored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.operators.monitor import importance

    missing = spark.createDataFrame([("v0", 0.1), ("v1", 0.4), ("v2", 0.3), ("v3", 0.0), ("amt_log", 0.0)], "feature string, missing double")
    return rounded(V.choose_monitored(importance(contributions(spark, sf_dir)), missing, 3))


@query(TX + "SELECT count(*) AS n, count(*) FILTER (WHERE p >= 0.7) AS flagged, round(avg(CAST(p >= 0.7 AS INTEGER)), 6) AS review_rate, round(sum(y) FILTER (WHERE p >= 0.7) / count(*) FILTER (WHERE p >= 0.7), 6) AS precision, round(sum(y) FILTER (WHERE p >= 0.7) / sum(y), 6) AS recall FROM tx WHERE split = 'valid'")
def a44_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.operating_point(tx(spark, sf_dir).where("split = 'valid'"), "y", "p", 0.7))


NAMES = ["card_cnt_7d", "card_freq", "tx_hour", "amt_log", "amt_cents", "d1_anchor", "v12", "v300", "miss_c", "has_identity", "dist1"]


@query("SELECT family, count(*) AS n FROM (SELECT CASE WHEN f LIKE '%\\_freq' ESCAPE '\\' THEN 'frequency' WHEN regexp_matches(f, '^(miss|has)_|_missing$') THEN 'missingness' WHEN regexp_matches(f, '^(card|acct)_') THEN 'velocity' WHEN regexp_matches(f, '^(tx|hour|weekday)_') THEN 'time' WHEN f LIKE 'amt\\_%' ESCAPE '\\' THEN 'amount' WHEN f LIKE '%\\_anchor' ESCAPE '\\' THEN 'anchor' WHEN regexp_matches(f, '^v[0-9]+$') THEN 'anonymous' ELSE 'other' END AS family FROM (SELECT DISTINCT p_name AS f FROM part UNION SELECT unnest(" + str(NAMES) + "))) GROUP BY family")
def a20_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct().union(spark.createDataFrame([(n,) for n in NAMES], "f string")).distinct()
    return V.family_counts(names.toDF("feature"))


@query(TX + "SELECT CAST(count(*) FILTER (WHERE k % 9 = 0) AS BIGINT) AS missing, 2 AS columns, 1 AS retained FROM tx UNION ALL SELECT 0, 2, 2 FROM tx HAVING count(*) > 0")
def a19_block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of one block differ by a factor alone, so one of them goes."""
    d = tx(spark, sf_dir).select("amount", F.col("id").cast("double").alias("id"), F.when(F.col("k") % 9 != 0, F.col("k")).alias("a"), F.when(F.col("k") % 9 != 0, F.col("k") * 2).alias("b"))
    return V.reduction_table(P.missing_blocks(d, d.columns), P.reduce_correlated(d, d.columns))


PRIORS, COSTS = [0.01, 0.05, 0.2], [0.5, 4.0, 25.0]


@query(TX + """, g AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n, sum(y * amount) AS loss FROM tx GROUP BY p),
c AS (SELECT p, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(loss) OVER w AS caught, sum(pos) OVER () AS AP, sum(n) OVER () AS AN, sum(loss) OVER () AS AL FROM g WINDOW w AS (ORDER BY p DESC)),
o AS (SELECT * FROM c UNION ALL SELECT NULL, 0, 0, 0, max(AP), max(AN), max(AL) FROM c),
r AS (SELECT *, pi / (AP / AN) AS w1, (1 - pi) / (1 - AP / AN) AS w0, (pi / (1 - pi)) / ((AP / AN) / (1 - AP / AN)) AS f FROM o, (SELECT unnest([0.01::DOUBLE, 0.05, 0.2]) AS pi), (SELECT unnest([0.5::DOUBLE, 4, 25]) AS ca)),
b AS (SELECT *, row_number() OVER (PARTITION BY pi, ca ORDER BY round(ca * (w1 * tp + w0 * (seen - tp)) + w1 * (AL - caught), 6), p DESC NULLS FIRST) AS k FROM r),
s AS (SELECT *, tp / AP AS recall, (seen - tp) / (AN - AP) AS fpr FROM b WHERE k = 1)
SELECT pi AS prevalence, ca AS review_cost, round(p * f / (1 - p + p * f), 6) AS threshold, round(recall, 6) AS recall, round(caught / AL, 6) AS recall_value, round(fpr, 6) AS fpr, round(pi * recall + (1 - pi) * fpr, 6) AS review_rate, round(pi * recall / nullif(pi * recall + (1 - pi) * fpr, 0), 6) AS precision, round(10000 * (pi * recall + (1 - pi) * fpr), 4) AS alerts_per_10k FROM s""")
def a32_prevalence_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.prevalence_costs(tx(spark, sf_dir), "y", "p", "amount", PRIORS, COSTS)).withColumn("alerts_per_10k", F.round("alerts_per_10k", 4))


@query(TX + ", r AS (SELECT 'true_positive' AS kind, id, row_number() OVER (ORDER BY p DESC, id) AS k FROM tx WHERE y = 1 AND p >= 0.7 UNION ALL SELECT 'false_positive', id, row_number() OVER (ORDER BY amount DESC, id) FROM tx WHERE y = 0 AND p >= 0.7 UNION ALL SELECT 'false_negative', id, row_number() OVER (ORDER BY amount DESC, id) FROM tx WHERE y = 1 AND p < 0.7) SELECT kind, id FROM r WHERE k = 1")
def t4_worked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.worked_cases(tx(spark, sf_dir).withColumn("flag", (F.col("p") >= 0.7).cast("int")), "id", "y", "p", "flag", "amount")


@query(CONTRIB + ", i AS (SELECT feature, avg(abs(contribution)) AS v FROM c GROUP BY feature), r AS (SELECT feature, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank FROM i) SELECT CAST(k AS INTEGER) AS k, rank, feature FROM r, (SELECT unnest([2, 4]) AS k) WHERE rank <= k")
def t5_compact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.operators.monitor import importance

    return V.compact_sets(importance(contributions(spark, sf_dir)), [2, 4])


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 500")
def t6_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hash_sample(table(spark, sf_dir, "orders"), "o_orderkey", 500, 42).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 30")
def t2_ranked_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ranked(table(spark, sf_dir, "customer"), "c_acctbal", 30, "c_custkey").select("c_custkey", "c_acctbal")


@query(TX + "SELECT 'extra' AS feature, 'only in the first' AS problem UNION ALL SELECT 'gone', 'only in the second'")
def u7_contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    other = d.drop("k5").withColumn("gone", F.lit(0))
    found = V.contract_diff(d.withColumn("extra", F.lit(0)).drop("k5").columns, other.columns)
    return spark.createDataFrame(found, "feature string, problem string")


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def u6_leaked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    sealed = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").withColumnRenamed("o_orderkey", "l_orderkey")
    return V.leaked_keys(log, sealed, "l_orderkey")


@query("SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS INTEGER) AS has_large FROM customer")
def j9_membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return V.with_exists_flag(table(spark, sf_dir, "customer"), large, "c_custkey", "has_large").select("c_custkey", "has_large")


@query("SELECT n_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY n_name")
def j10_subgroup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    both = orders.join(table(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("c_nationkey", "n_nationkey").join(table(spark, sf_dir, "nation"), "n_nationkey")
    return rounded(both.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")), 4)


@query("SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, round(q, 4) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON l_orderkey = o_orderkey")
def j2_row_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))
    out = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return rounded(out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), "quantity"), 4)


@query(TX + "SELECT f.id, h.amount FROM (SELECT id FROM tx WHERE p >= 0.7) f LEFT JOIN (SELECT id, amount FROM tx WHERE k % 4 <> 0) h USING (id)")
def j6_amount_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    return d.where("p >= 0.7").select("id").join(d.where("k % 4 <> 0").select("id", "amount"), "id", "left")


@query(TX + "SELECT a.id, y, amount FROM (SELECT id, amount FROM tx WHERE k % 2 = 0) a JOIN (SELECT id, y FROM tx WHERE k % 3 = 0) b USING (id)")
def j4_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    return io.join_one_to_one(d.where("k % 2 = 0").select("id", "amount"), d.where("k % 3 = 0").select("id", "y"), "id")


@query(TX + "SELECT id, event_type, coalesce(CAST(CASE WHEN k % 6 <> 0 THEN user_id END AS VARCHAR), '__NULL__') AS user_key FROM tx WHERE tx_day <= 12")
def io11_history_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("user_key", F.when(F.col("k") % 6 != 0, F.col("user_id")))
    return io.build_history(d, ["id", "event_type", "user_key"], ["user_key"], "tx_day", 12)


@query(TX + "SELECT a.event_type, count(*) AS n FROM tx a JOIN (SELECT DISTINCT CASE WHEN k % 6 <> 0 THEN user_id END AS u FROM tx WHERE tx_day < 3) b ON b.u IS NOT DISTINCT FROM CASE WHEN a.k % 6 <> 0 THEN a.user_id END GROUP BY a.event_type")
def j17_null_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = io.with_sentinel(F.when(F.col("k") % 6 != 0, F.col("user_id"))).alias("u")
    d = tx(spark, sf_dir)
    return d.select("event_type", key).join(d.where("tx_day < 3").select(key).distinct(), "u").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(TX + "SELECT id, tx_day, CAST(t // 3600 % 24 AS INTEGER) AS tx_hour, tx_day - CASE WHEN k % 7 = 0 THEN NULL ELSE k END AS d1_anchor, round(ln(1 + amount), 6) AS amt_log, lower(split_part(a, '.', 1)) AS a_provider, nullif(lower(substr(b, strpos(b, '.') + 1)), '') AS b_suffix, CAST(lower(a) = lower(b) AS FLOAT) AS domain_match, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS m FROM (SELECT *, 'Mail' || k % 4 || '.COM' AS a, 'mail' || k % 3 || '.com' AS b FROM tx)")
def p9_stateless_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", "t", "amount", F.when(F.col("k") % 7 != 0, F.col("k")).alias("d1"), F.format_string("Mail%d.COM", F.col("k") % 4).alias("a"), F.format_string("mail%d.com", F.col("k") % 3).alias("b"), F.element_at(F.array(F.lit("T"), F.lit("F"), F.lit("M")), F.col("k") % 3 + 1).alias("m"))
    d = R.stateless(d, "t", ["d1"], "amount", ("a", "b"), ("m",))
    return rounded(d.select("id", "tx_day", "tx_hour", "d1_anchor", "amt_log", "a_provider", "b_suffix", "domain_match", "m"))


@query(TX + "SELECT count(*) FILTER (WHERE tx_day >= 3 AND tx_day < 9) AS half_open, count(*) FILTER (WHERE tx_day BETWEEN 3 AND 9) AS inclusive FROM tx")
def p16_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).agg(F.count_if(R.in_days(F.col("tx_day"), 3, 9)).alias("half_open"), F.count_if(R.in_days(F.col("tx_day"), 3, 10)).alias("inclusive"))


@query(TX + "SELECT id, round(3 * p / (1 - p + 3 * p), 6) AS shifted FROM tx")
def p20_prevalence_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tx(spark, sf_dir).select("id", R.shift_prior(F.col("p"), 3.0).alias("shifted")))


@query(CONTRIB + "SELECT CASE feature WHEN 'v0' THEN 'V-group 1' WHEN 'v1' THEN 'V-group 1' WHEN 'v2' THEN 'V-group 12' ELSE feature END AS label, count(*) AS n FROM c GROUP BY 1")
def p24_reason_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = R.render_feature(F.col("feature"), {"v0": "g1", "v1": "g1", "v2": "g12"})
    return contributions(spark, sf_dir).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(TX + "SELECT id, 1 AS rank, 'amount' AS feature, amount AS contribution FROM tx WHERE k % 5 <> 0 UNION ALL SELECT id, 2, 'k', CAST(k AS DOUBLE) FROM tx WHERE k % 5 <> 0")
def p26_exploded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("contribution")) for c in ("amount", "k")))
    return R.explode_reasons(tx(spark, sf_dir).select("id", F.when(F.col("k") % 5 != 0, reasons).alias("r")), "id", "r")


@query(TX + "SELECT id, round(CASE WHEN k % 9 <> 0 THEN amount * 1.5 END, 6) AS amount FROM tx")
def p28_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", F.when(F.col("k") % 9 != 0, F.col("amount")).alias("amount"))
    return rounded(R.perturb(d, "amount", 1.5))


@query(TX + "SELECT id, y, amount, k AS v7, p FROM tx")
def p29_feature_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", "y", "t", "tx_day", "amount", F.col("k").alias("v7"), F.col("k5").alias("v8"), F.lit(1).alias("flat"), "p")
    return V.feature_select(d, ["id", "y"], ["v7"], ["flat"], ["t", "tx_day"])


@query(TX + """, s AS (SELECT CASE WHEN tx_day < 14 THEN 'train' WHEN tx_day BETWEEN 16 AND 20 THEN 'valid' WHEN tx_day >= 20 THEN 'test' END AS split, tx_day FROM tx), b AS (SELECT min(tx_day) FILTER (WHERE split = 'valid') - max(tx_day) FILTER (WHERE split = 'train') - 1 AS gap, max(tx_day) FILTER (WHERE split = 'valid') AS v, min(tx_day) FILTER (WHERE tx_day >= 20) AS t FROM s)
SELECT 'test does not follow valid' AS problem FROM b WHERE t <= v UNION ALL SELECT 'the embargo is shorter than the longest window' FROM b WHERE gap < 7""")
def u3_split_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split with two faults: a day that both later parts have, and too short an embargo."""
    d = tx(spark, sf_dir)
    valid = d.where("tx_day BETWEEN 16 AND 20").withColumn("split", F.lit("valid"))
    parts = d.where("tx_day < 14").withColumn("split", F.lit("train")).union(valid).union(d.where("tx_day >= 20").withColumn("split", F.lit("test")))
    return spark.createDataFrame([(p,) for p in S.split_problems(parts, ["train", "valid", "test"], 7)], "problem string")


@query(TX + ", u AS (SELECT id, split, k FROM tx WHERE split = 'train' UNION ALL SELECT id, split, k FROM tx WHERE split = 'test') SELECT split, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM u GROUP BY split")
def u1_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", "split", "k")
    both = d.where("split = 'train'").unionByName(d.where("split = 'test'").select("k", "split", "id"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query(TX + "SELECT user_id, id, t, CAST(row_number() OVER (ORDER BY t, id) AS INTEGER) AS place FROM tx QUALIFY row_number() OVER (ORDER BY t, id) <= 100")
def t1_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows in stable order of time, numbered after the limit, so that no task orders all."""
    from pyspark.sql import Window

    first = tx(spark, sf_dir).orderBy("t", "id").limit(100)
    return first.select("user_id", "id", "t", F.row_number().over(Window.orderBy("t", "id")).alias("place"))


@query(TX + "SELECT day, amount, k, split, id, y FROM (SELECT tx_day AS day, CAST(amount AS DOUBLE) AS amount, CAST(k AS FLOAT) AS k, split, id, y FROM tx) WHERE split = 'valid'")
def io8_partition_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = io.load_partition(tx(spark, sf_dir).where("split = 'valid'").select("id", "y", "tx_day", "amount", "k"), "y", "amount", "id", ("amount",))
    return p.df.select(p.day, F.col(p.amount).alias("amount"), *p.features, F.lit("valid").alias("split"), p.key, p.y)


@query(TX + "SELECT id, y FROM tx WHERE k % 3 <> 0")
def io15_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", F.when(F.col("k") % 3 != 0, F.col("y")).alias("y"))
    return io.labels(d.union(d), "id", "y")
