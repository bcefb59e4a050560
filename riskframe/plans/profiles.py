"""Queries of the profiling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import profile as P
from riskframe.operators import windows as W
from riskframe.operators.ordered import quantiles
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import TX, table, tx


@query(TX + "SELECT event_type, count(*) AS n, round(avg(y), 6) AS rate FROM (SELECT event_type, CAST(k < 30 AS INTEGER) AS y FROM tx) GROUP BY event_type")
def a4_rate_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.rate_by(tx(spark, sf_dir).withColumn("y", (F.col("k") < 30).cast("int")), "event_type", "y"))


@query(TX + "SELECT tx_day, count(*) AS n, round(avg(y), 6) AS rate FROM tx GROUP BY tx_day")
def a5_daily_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.rate_by(tx(spark, sf_dir), "tx_day", "y"))


@query(TX + "SELECT tx_day, round(avg(CAST(c > 0 AS INTEGER)), 6) AS covered, round(avg(c), 6) AS mean_history FROM (SELECT tx_day, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM tx) GROUP BY tx_day")
def a6_history_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("c", F.count(F.lit(1)).over(W.past("user_id", "t", None)))
    return rounded(P.history_coverage(d, "tx_day", "c"))


@query("SELECT count(*) AS n, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys, min(l_extendedprice) AS amount_min, max(l_extendedprice) AS amount_max, count(*) FILTER (WHERE l_extendedprice <= 0) AS nonpositive, min(l_linenumber) AS label_min, max(l_linenumber) AS label_max FROM lineitem")
def a7_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.integrity(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l.toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def a8_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "toxic")


@query("SELECT toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1")
def a9_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.class_balance(table(spark, sf_dir, "labels"), "toxic"))


@query("SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY 1")
def a10_describe_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.describe_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query("SELECT 'quality' AS feature, round(avg(CAST(quality IS NULL AS INTEGER)), 6) AS missing FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', round(avg(CAST(lang IS NULL AS INTEGER)), 6) FROM documents")
def a11_missing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(P.missing_share(d, ["quality", "lang"]))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem" for a, b in PAIRS))
def a12_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.correlation(table(spark, sf_dir, "lineitem"), NUMERIC))


@query("SELECT 'l_tax' AS feature, count(DISTINCT l_tax) <= 1 AS constant FROM lineitem UNION ALL SELECT 'one', true")
def a16_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.constant_columns(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1)), ["l_tax", "one"])


@query(TX + "SELECT m AS missing, list_sort(list(f)) AS features FROM (SELECT 'a' AS f, count(*) FILTER (WHERE k % 4 = 0) AS m FROM tx UNION ALL SELECT 'b', count(*) FILTER (WHERE k % 4 = 0) FROM tx UNION ALL SELECT 'c', count(*) FILTER (WHERE k % 3 = 0) FROM tx) GROUP BY m")
def a17_missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumns({"a": F.when(F.col("k") % 4 != 0, F.col("amount")), "b": F.when(F.col("k") % 4 != 0, F.col("p")), "c": F.when(F.col("k") % 3 != 0, F.col("k"))})
    return P.missing_blocks(d, ["a", "b", "c"])


# No column but the last correlates with another, so the greedy choice is: of two that do, the one with more distinct values.
REDUCED = """WITH v AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), w AS (SELECT * FROM v UNION ALL SELECT a.vec_id, 1000, 2 * a.x + 0.001 * b.x FROM v a JOIN v b USING (vec_id) WHERE a.i = 0 AND b.i = 1),
d AS (SELECT i, row_number() OVER (ORDER BY count(DISTINCT x) DESC, i) AS place FROM w GROUP BY i), c AS (SELECT a.i, b.i AS other FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY a.i, b.i HAVING abs(corr(a.x, b.x)) >= 0.75)
SELECT 'v' || d.i AS feature FROM d WHERE NOT EXISTS (FROM c JOIN d e ON e.i = c.other WHERE c.i = d.i AND e.place < d.place)"""


@query(REDUCED)
def a18_reduce_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the embeddings, and one more that follows the first."""
    e = table(spark, sf_dir, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    d = e.select(*(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(size)))
    d = d.withColumn("v1000", F.col("v0") * 2 + 0.001 * F.col("v1"))
    kept = P.reduce_correlated(d, d.columns)
    return P.missing_share(d, kept).select("feature")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def a63_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(TX + "SELECT round(median(amount), 6) AS p50, round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99 FROM tx")
def a62_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles(tx(spark, sf_dir), [], "amount", [0.5, 0.95, 0.99])
    return rounded(q.agg(*(F.max(F.when(F.col("prob") == p / 100, F.col("value"))).alias(f"p{p}") for p in (50, 95, 99))))
