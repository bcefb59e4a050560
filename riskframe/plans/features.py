"""Queries of the row-wise functions, windows, splits and encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions import rowwise as R
from riskframe.operators import encode as E
from riskframe.operators import split as S
from riskframe.operators import windows as W
from riskframe.operators.profile import split_summary
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import SPLITS, TX, folder, table, tx
from riskframe.sources import io

PAST = "PARTITION BY user_id ORDER BY t RANGE BETWEEN {} PRECEDING AND 1 PRECEDING"
D7, ALL = PAST.format(604800), PAST.format("UNBOUNDED")


@query(TX + """SELECT id, tx_day, CAST(t // 3600 % 24 AS INTEGER) AS tx_hour, CAST(tx_day % 7 AS INTEGER) AS tx_weekday,
round(sin(2*pi()*(t // 3600 % 24)/24), 6) + 0.0 AS hour_sin, round(cos(2*pi()*(t // 3600 % 24)/24), 6) + 0.0 AS hour_cos,
round(sin(2*pi()*(tx_day % 7)/7), 6) + 0.0 AS weekday_sin, round(cos(2*pi()*(tx_day % 7)/7), 6) + 0.0 AS weekday_cos,
CAST(t // 3600 % 24 < 6 AS INTEGER) AS tx_night FROM tx""")
def p1_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.time_parts(tx(spark, sf_dir).select("id", "t"))
    return rounded(d.drop("t"))


@query(TX + "SELECT id, tx_day - CASE WHEN k % 7 = 0 THEN NULL ELSE k END AS d1_anchor FROM tx")
def p2_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("d1", F.when(F.col("k") % 7 != 0, F.col("k")))
    return R.anchors(d, ["d1"]).select("id", "d1_anchor")


@query(TX + """SELECT id, round(ln(1 + a), 6) AS amt_log, round(a - floor(a), 6) AS amt_cents, CAST(length(rtrim(lpad(CAST(CAST(round(round(a - floor(a), 6) * 1000000) AS BIGINT) AS VARCHAR), 6, '0'), '0')) AS INTEGER) AS amt_digits,
CAST(a = floor(a) AS INTEGER) AS amt_round FROM (SELECT id, floor(amount * 4) / 4 AS a FROM tx)""")
def p3_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).select("id", (F.floor(F.col("amount") * 4) / 4).alias("amount"))
    return rounded(R.amount_features(d).drop("amount"))


HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"


@query(f"""SELECT page_id, lower(split_part(h, '.', 1)) AS provider, nullif(lower(substr(h, strpos(h, '.') + 1)), '') AS suffix,
CAST(CASE WHEN split_part(h, '.', 1) = lang THEN 1 ELSE 0 END AS FLOAT) AS same FROM (SELECT page_id, {HOST} AS h, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) AS lang FROM pages)""")
def p5_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    lang = F.regexp_extract("url", "^https?://[^/]+/([^/]+)", 1)
    provider = R.domain_provider(host)
    return table(spark, sf_dir, "pages").select("page_id", provider.alias("provider"), R.domain_suffix(host).alias("suffix"), R.match_flag(provider, lang).alias("same"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'T' THEN 1 END AS flag FROM orders")
def p8_map_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", R.map_flag(F.col("o_orderstatus")).alias("flag"))


@query(TX + """SELECT id, CAST(user_id AS VARCHAR) AS card, user_id || '_' || k % 4 AS card_addr, user_id || '_' || k % 4 || '_' || coalesce(CAST(CASE WHEN k % 9 = 0 THEN NULL ELSE k % 3 END AS VARCHAR), 'NA') AS account FROM tx""")
def p11_entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumns({"a": F.col("k") % 4, "d": F.when(F.col("k") % 9 != 0, F.col("k") % 3)})
    return R.entity_keys(d, {"card": ["user_id"], "card_addr": ["user_id", "a"], "account": ["user_id", "a", "d"]}).select("id", "card", "card_addr", "account")


@query("""SELECT d.doc_id, CAST(l.quality IS NOT NULL OR l.toxic IS NOT NULL AS INTEGER) AS has_identity, CAST(l.quality IS NULL AS INTEGER) + CAST(l.toxic IS NULL AS INTEGER) AS miss_labels,
CAST(l.quality IS NULL AS INTEGER) AS quality_missing, CAST(l.toxic IS NULL AS INTEGER) AS toxic_missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def p14_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.missingness_features(d, {"labels": ["quality", "toxic"]}, ["quality", "toxic"]).drop("quality", "toxic")


@query(TX + """SELECT id, round(ln(p / (1 - p)), 6) + 0.0 AS z, round(p / (p + 4.0 * (1 - p)), 6) AS corrected, round(p / (p + (0.5/0.5)/(0.035/0.965) * (1 - p)), 6) AS prior,
round(1 / (1 + exp(-(0.8 * ln(p / (1 - p)) - 0.3))), 6) AS platt, CASE WHEN p >= 0.7 THEN 'review' ELSE 'accept' END AS decision FROM tx""")
def p17_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    d = tx(spark, sf_dir).select("id", R.logit(p).alias("z"), R.odds_correction(p, 4.0).alias("corrected"), R.prior_correction(p, 0.5, 0.035).alias("prior"), R.apply_calibrator(p, "platt", 0.8, -0.3).alias("platt"), R.decide(p, 0.7).alias("decision"))
    return rounded(d)


@query(TX + f"SELECT id, count(*) OVER w AS h7_cnt, round((sum(v) OVER w) + 1e-8, 6) AS h7_sum, round((avg(v) OVER w) + 1e-8, 6) AS h7_mean, round((stddev_samp(v) OVER w) + 1e-8, 6) AS h7_std FROM (SELECT *, CASE WHEN k % 9 = 0 THEN NULL ELSE amount END AS v FROM tx) WINDOW w AS ({D7})")
def w1_past_window_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("v", F.when(F.col("k") % 9 != 0, F.col("amount")))
    return rounded(d.select("id", *(c.alias(n) for n, c in W.past_aggregates("user_id", "t", "v", 7 * W.DAY, "h7").items())), 6, 1e-8)


@query(TX + f"SELECT id, count(*) OVER w AS h7_cnt, round((sum(v) OVER w) + 1e-6, 4) AS h7_sum, round((avg(v) OVER w) + 1e-6, 4) AS h7_mean, round((stddev_samp(v) OVER w) + 1e-6, 4) AS h7_std FROM (SELECT *, CASE WHEN k % 9 = 0 THEN NULL ELSE amount END AS v FROM tx) WINDOW w AS ({D7})")
def w1_past_window_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("v", F.when(F.col("k") % 9 != 0, F.col("amount")))
    return rounded(W.past_window_by_prefix(d, "user_id", "t", "v", 7 * W.DAY, "h7").select("id", "h7_cnt", "h7_sum", "h7_mean", "h7_std"), 4, 1e-6)


@query(TX + f"SELECT id, count(*) OVER w AS hist_cnt, round((sum(amount) OVER w) + 1e-8, 6) AS hist_sum, round((avg(amount) OVER w) + 1e-8, 6) AS hist_mean, round((stddev_samp(amount) OVER w) + 1e-8, 6) AS hist_std, t - max(t) OVER w AS gap FROM tx WINDOW w AS ({ALL})")
def w2_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    return rounded(d.select("id", *(c.alias(n) for n, c in W.past_aggregates("user_id", "t", "amount", None, "hist").items()), W.secs_since_prev("user_id", "t").alias("gap")), 6, 1e-8)


@query("""SELECT o_orderkey, count(*) OVER w AS n, o_s - max(o_s) OVER w AS gap FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS o_s FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_s RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w3_gap_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("s", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return o.select("o_orderkey", F.count(F.lit(1)).over(W.past("o_custkey", "s", None)).alias("n"), W.secs_since_prev("o_custkey", "s").alias("gap"))


@query(TX + f"SELECT id, coalesce(CAST(sum(f) OVER w AS BIGINT), 0) AS types FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, id) = 1 AS INTEGER) AS f FROM tx) WINDOW w AS ({ALL})")
def w4_past_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.past_distinct(tx(spark, sf_dir), "user_id", "t", "event_type", "id", "types").select("id", "types")


def keyed_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("a", F.col("k") % 4)
    return R.entity_keys(d, {"card_key": ["user_id"], "addr_key": ["user_id", "a"], "acct_key": ["user_id", "a", "k3"]})


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.entity_aggregates(keyed_tx(spark, sf_dir), {"card": "card_key", "addr": "addr_key", "acct": "acct_key"}, "t", "amount", {"category": "k5", "device": "k3"})


def entity_sql() -> str:
    keys = {"card": "user_id", "addr": "user_id, k % 4", "acct": "user_id, k % 4, k3"}
    cols = []
    for prefix, key in keys.items():
        over = f"(PARTITION BY {key} ORDER BY t RANGE BETWEEN {{}} PRECEDING AND 1 PRECEDING)"
        for label, s in (("1h", 3600), ("24h", 86400), ("7d", 604800)):
            cols += [f"count(*) OVER {over.format(s)} AS {prefix}_cnt_{label}", f"round((sum(amount) OVER {over.format(s)}) + 1e-6, 4) AS {prefix}_amt_sum_{label}"]
        hist = over.format("UNBOUNDED")
        mean, std = f"avg(amount) OVER {hist}", f"stddev_samp(amount) OVER {hist}"
        cols += [f"round(({mean}) + 1e-6, 4) AS {prefix}_amt_mean_hist", f"round(({std}) + 1e-6, 4) AS {prefix}_amt_std_hist", f"t - max(t) OVER {hist} AS {prefix}_gap"]
        cols += [f"round((CASE WHEN {mean} <> 0 THEN amount / ({mean}) END) + 1e-6, 4) AS {prefix}_amt_ratio", f"round((CASE WHEN {std} <> 0 THEN (amount - {mean}) / ({std}) END) + 1e-6, 4) AS {prefix}_amt_z"]
    for name, other in (("category", "k5"), ("device", "k3")):
        cols.append(f"coalesce(CAST(sum(f_{name}) OVER {over.format('UNBOUNDED')} AS BIGINT), 0) AS acct_{name}_distinct")
    first = ", ".join(f"CAST(row_number() OVER (PARTITION BY user_id, k % 4, k3, {o} ORDER BY t, id) = 1 AS INTEGER) AS f_{n}" for n, o in (("category", "k5"), ("device", "k3")))
    return TX + f"SELECT id, {', '.join(cols)} FROM (SELECT *, {first} FROM tx)"


@query(entity_sql())
def w7_entity_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = entities(spark, sf_dir)
    return rounded(d.select("id", *(c for c in d.columns if c.split("_")[0] in ("card", "addr", "acct") and not c.endswith("_key"))), 4, 1e-6)


def account_sql() -> str:
    cols = []
    for p, c in W.ACCOUNT_FEATURES:
        key = {"card": "user_id", "addr": "user_id, k % 4", "acct": "user_id, k % 4, k3"}[p]
        label, _, stat = c.rpartition("_")
        over = f"(PARTITION BY {key} ORDER BY t RANGE BETWEEN {({'1h': 3600, '24h': 86400, '7d': 604800}.get(label, 'UNBOUNDED'))} PRECEDING AND 1 PRECEDING)"
        mean, std = f"avg(amount) OVER {over}", f"stddev_samp(amount) OVER {over}"
        said = {"cnt": f"count(*) OVER {over}", "sum": f"round((sum(amount) OVER {over}) + 1e-6, 4)", "mean": f"round(({mean}) + 1e-6, 4)", "std": f"round(({std}) + 1e-6, 4)", "gap": f"t - max(t) OVER {over}"}
        said |= {"ratio": f"round((CASE WHEN {mean} <> 0 THEN amount / ({mean}) END) + 1e-6, 4)", "z": f"round((CASE WHEN {std} <> 0 THEN (amount - {mean}) / ({std}) END) + 1e-6, 4)", "distinct": f"coalesce(CAST(sum(f_{label}) OVER {over} AS BIGINT), 0)"}
        cols.append(f"{said[stat]} AS {p}_{c}")
    first = ", ".join(f"CAST(row_number() OVER (PARTITION BY user_id, k % 4, k3, {o} ORDER BY t, id) = 1 AS INTEGER) AS f_{o}" for o in ("k5", "k3"))
    return TX + f"SELECT id, {', '.join(cols)} FROM (SELECT *, {first} FROM tx)"


@query(account_sql())
def w6_account_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.account_block(keyed_tx(spark, sf_dir), {"card": "card_key", "addr": "addr_key", "acct": "acct_key"}, "t", "amount", {"k5": "k5", "k3": "k3"})
    return rounded(d.select("id", *(f"{p}_{c}" for p, c in W.ACCOUNT_FEATURES)), 4, 1e-6)


def entity_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = entities(spark, sf_dir).where("split is not null")
    return rounded(d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("card_cnt_7d").alias("card_cnt_7d"), F.avg("card_amt_ratio").alias("card_amt_ratio"), F.avg("acct_gap").alias("acct_gap"), F.avg("y").alias("rate")))


@query(TX + """SELECT r.id, r.t, count(h.t) FILTER (WHERE h.t >= r.t - 86400) AS cnt_24h, round(sum(h.amount) FILTER (WHERE h.t >= r.t - 86400), 4) AS sum_24h, count(h.t) AS cnt_all, round(sum(h.amount), 4) AS sum_all, r.t - max(h.t) AS gap
FROM (SELECT * FROM tx WHERE split = 'test') r LEFT JOIN tx h ON h.user_id = r.user_id AND h.t < r.t GROUP BY r.id, r.t""")
def j12_history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    out = W.history_lookup(d.where("split = 'test'").select("id", "t", "user_id"), d, "user_id", "t", "amount", "id", {"24h": W.DAY, "all": None})
    return rounded(out, 4)


@query(TX + "SELECT tx_day, n, round(avg(n) OVER (ORDER BY tx_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS trailing FROM (SELECT tx_day, count(*) AS n FROM tx GROUP BY tx_day)")
def w8_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tx(spark, sf_dir).groupBy("tx_day").agg(F.count(F.lit(1)).alias("n"))
    return rounded(days.withColumn("trailing", W.trailing_mean("n", "tx_day", 7)))


@query(TX + "SELECT tx_day, r >= 3 AND lo AS held FROM (SELECT tx_day, row_number() OVER (ORDER BY tx_day) AS r, min(n > 300) OVER (ORDER BY tx_day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS lo FROM (SELECT tx_day, count(*) AS n FROM tx GROUP BY tx_day))")
def w10_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tx(spark, sf_dir).groupBy("tx_day").agg(F.count(F.lit(1)).alias("n"))
    return days.select("tx_day", W.persistent(F.col("n") > 300, "tx_day", 3).alias("held"))


@query(TX + "SELECT tx_day, id, amount, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tx_day ORDER BY amount DESC, id) AS r FROM tx) WHERE r <= 3")
def w12_top_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_by(tx(spark, sf_dir), ["tx_day"], [F.desc("amount"), F.col("id")], 3).select("tx_day", "id", "amount", "rank")


@query(TX + "SELECT split, count(*) AS n, min(tx_day) AS day_min, max(tx_day) AS day_max, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tx WHERE split IS NOT NULL GROUP BY split")
def u2_chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumn("split", S.chrono_split(F.col("tx_day"), SPLITS))
    return rounded(split_summary(d))


@query(TX + """SELECT f AS fold, role, count(*) AS n, round(avg(y), 6) AS rate FROM tx JOIN (VALUES (0,'train',0,-1),(0,'valid',7,13),(1,'train',0,6),(1,'valid',14,20),(2,'train',0,13),(2,'valid',21,29)) v(f, role, lo, hi) ON tx_day BETWEEN lo AND hi GROUP BY ALL""")
def u4_purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    folds = [S.Fold(0, (0, -1), (7, 13)), S.Fold(1, (0, 6), (14, 20)), S.Fold(2, (0, 13), (21, 29))]
    return rounded(S.fold_table(d, folds, "y"))


@query(TX + "SELECT id, CASE WHEN v IS NOT NULL THEN coalesce(n, 0) END AS cat_freq, CASE WHEN v IS NOT NULL THEN coalesce(c, -1) END AS cat_code FROM (SELECT id, CASE WHEN k % 11 = 0 THEN NULL WHEN t >= 1209600 AND k5 = 4 THEN 'new' ELSE CAST(k5 AS VARCHAR) END AS v FROM tx) LEFT JOIN (SELECT v AS lv, count(*) AS n, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS c FROM (SELECT CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k5 AS VARCHAR) END AS v FROM tx WHERE split = 'train') WHERE v IS NOT NULL GROUP BY v) ON lv = v")
def m1_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("k") % 11 == 0, F.lit(None)).when((F.col("t") >= 14 * W.DAY) & (F.col("k5") == 4), "new").otherwise(F.col("k5").cast("string"))
    d = tx(spark, sf_dir).withColumn("cat", v)
    return E.FeatureEncoder(["cat"], ["cat"], []).fit(d.where("split = 'train'")).transform(d, ["id"])


@query(TX + "SELECT 'k5' AS feature, CAST(k5 AS VARCHAR) AS level, count(*) AS n FROM tx WHERE split = 'train' GROUP BY k5 UNION ALL SELECT 'event_type', event_type, count(*) FROM tx WHERE split = 'train' GROUP BY event_type")
def a13_frequency_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fit_frequency(tx(spark, sf_dir).where("split = 'train'"), ["k5", "event_type"])


@query(TX + "SELECT 'event_type' AS feature, event_type AS level, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type FROM tx WHERE split = 'train')")
def a14_ordinal_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fit_ordinal(tx(spark, sf_dir).where("split = 'train'"), ["event_type"])


@query(TX + "SELECT 'a' AS feature, round(avg(CAST(k % 50 <> 0 AS INTEGER)), 6) AS missing, avg(CAST(k % 50 <> 0 AS INTEGER)) > 0.95 AS dropped FROM tx WHERE y = 1 UNION ALL SELECT 'b', round(avg(CAST(k % 2 = 0 AS INTEGER)), 6), avg(CAST(k % 2 = 0 AS INTEGER)) > 0.95 FROM tx WHERE y = 1")
def a15_sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir).withColumns({"a": F.when(F.col("k") % 50 == 0, 1), "b": F.when(F.col("k") % 2 != 0, 1)})
    return rounded(E.sparse_columns(d, ["a", "b"], "y = 1"))


@query(TX + "SELECT id, user_id, amount FROM tx WHERE user_id IN (SELECT user_id FROM tx WHERE split = 'train' AND y = 1)")
def j7_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    keys = d.where("split = 'train' and y = 1").select("user_id").distinct()
    return d.join(keys, "user_id", "left_semi").select("id", "user_id", "amount")


@query(TX + "SELECT id FROM tx WHERE user_id NOT IN (SELECT user_id FROM tx WHERE split = 'train')")
def j8_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tx(spark, sf_dir)
    return d.join(d.where("split = 'train'").select("user_id").distinct(), "user_id", "left_anti").select("id")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_mktsegment, n.n_name FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def j1_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    d = line.join(o, line["l_orderkey"] == o["o_orderkey"], "left").join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return d.select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", "n_name")


@query(TX + "SELECT t, id FROM (SELECT t, id FROM tx ORDER BY t DESC, id DESC LIMIT 100)")
def t7_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).select("t", "id").orderBy(F.desc("t"), F.desc("id")).limit(100)


@query(TX + "SELECT user_id, id AS latest_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, id DESC) AS r FROM tx) WHERE r = 1")
def t8_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).groupBy("user_id").agg(F.max_by("id", F.struct("t", "id")).alias("latest_id"))


@query(TX + "SELECT id, feature, value FROM (SELECT id, amount, CAST(k AS DOUBLE) AS k, p FROM tx) UNPIVOT INCLUDE NULLS (value FOR feature IN (amount, k, p))")
def u9_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).select("id", "amount", F.col("k").cast("double").alias("k"), "p").unpivot(["id"], ["amount", "k", "p"], "feature", "value")


@query(TX + "SELECT event_type, bool_and(d) AS monotone FROM (SELECT event_type, coalesce(t >= lag(t) OVER (PARTITION BY event_type ORDER BY id), true) AS d FROM tx) GROUP BY event_type")
def w13_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.coalesce(F.col("t") >= F.lag("t").over(Window.partitionBy("event_type").orderBy("id")), F.lit(True))
    return tx(spark, sf_dir).withColumn("d", up).groupBy("event_type").agg(F.bool_and("d").alias("monotone"))


def bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines and orders as tables with the same buckets of the order's key."""
    out = []
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        at = folder(spark, name)
        out.append(io.write_bucketed(table(spark, sf_dir, name), at, f"bucketed_{name}_{at[-32:]}", key, 16))
    return out[0], out[1]


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey")
def j1_bucketed_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = bucketed(spark, sf_dir)
    return lines.join(orders.where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus")


@query("SELECT 'known' AS kind, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'new', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j8_bucketed_semi_and_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = bucketed(spark, sf_dir)
    same = F.col("l_orderkey") == F.col("o_orderkey")
    kinds = (("known", "left_semi"), ("new", "left_anti"))
    parts = [lines.join(orders.where("o_orderstatus = 'F'"), same, how).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, how in kinds]
    return parts[0].union(parts[1])
