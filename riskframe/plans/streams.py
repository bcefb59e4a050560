"""Queries that run the streaming operators over the events as a stream; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.rowwise import sigmoid
from riskframe.operators.windows import ACCOUNT_FEATURES, DAY, HOUR, account_features, account_inputs
from riskframe.plans.features import keyed_tx
from riskframe.plans.registry import query, rounded
from riskframe.plans.views import EPOCH, TX, folder, table, tx
from riskframe.sources import io
from riskframe.sources.store import KeyedStore
from riskframe.streaming import keyed
from riskframe.streaming import stream as ST


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with integer seconds, k and a label as tx() has them."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a file or a folder: a pattern takes both
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), t.alias("t"), "user_id", "event_type", F.col("value").alias("amount"), k.alias("k"), ((k + F.lit(0.5)) / 100).alias("p"))


W = "PARTITION BY user_id ORDER BY t RANGE BETWEEN {} PRECEDING AND 1 PRECEDING"


@query(TX + f"SELECT id, user_id AS key, count(*) OVER ({W.format(604800)}) AS cnt_window, round(sum(amount) OVER ({W.format(604800)}), 4) AS sum_window, count(*) OVER ({W.format('UNBOUNDED')}) AS cnt_hist, CAST(t - max(t) OVER ({W.format('UNBOUNDED')}) AS DOUBLE) AS gap FROM tx")
def st2_stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = keyed.entity_features(event_stream(spark, sf_dir), {"user": "user_id"}, "t", "amount", "id", {"w": 7 * DAY, "h": None}, [])
    out = ST.run_through(features, folder(spark, "features"))
    return rounded(out.select("id", F.col("key").cast("long").alias("key"), F.col("w_cnt").alias("cnt_window"), F.col("w_sum").alias("sum_window"), F.col("h_cnt").alias("cnt_hist"), F.col("gap").cast("double").alias("gap")), 4)


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with their three text keys as a stream of four files, ten days each; every 17th row is a file late."""
    at = folder(spark, "arriving")
    d = keyed_tx(spark, sf_dir).withColumn("f", F.floor(F.col("tx_day") / 10) + F.when(F.col("k") % 17 == 0, 1).otherwise(0))
    d = d.select("id", "t", "amount", "k5", "k3", "card_key", "addr_key", "acct_key", "f")
    for f in range(4):
        d.where(F.col("f") == f).drop("f").repartition(1).write.mode("append").parquet(at)  # one file, of rows read by many tasks
    return spark.readStream.schema(d.drop("f").schema).option("maxFilesPerTrigger", 1).parquet(at)


def arriving_sql() -> str:
    cols = []
    for prefix, stat in ACCOUNT_FEATURES:
        label = stat.rsplit("_", 1)[0]
        seconds = {"1h": 3600, "24h": DAY, "7d": 7 * DAY}.get(label)
        own = f"h.t >= r.t - {seconds}" if seconds else "true"
        kind = {"cnt": "count(h.id)", "sum": "sum(h.amount)", "mean": "avg(h.amount)", "std": "stddev_samp(h.amount)"}.get(stat.rsplit("_", 1)[-1])
        kind = {"gap": "min(r.t - h.t)", "k5_distinct": "count(DISTINCT h.k5)", "k3_distinct": "count(DISTINCT h.k3)"}.get(stat, f"{kind} FILTER (WHERE {own})")
        if stat in ("ratio", "z"):
            mean, std = "avg(h.amount)", "stddev_samp(h.amount)"
            kind = f"CASE WHEN {mean} <> 0 THEN r.amount / {mean} END" if stat == "ratio" else f"CASE WHEN {std} <> 0 THEN (r.amount - {mean}) / {std} END"
        cols.append((prefix, f"round(({kind}) + 1e-6, 4)" if stat.endswith(("sum", "mean", "std", "ratio", "z")) else kind, f"{prefix}_{stat}"))
    parts = []
    for prefix, key in {"card": "user_id", "addr": "user_id || '_' || k % 4", "acct": "user_id || '_' || k % 4 || '_' || k3"}.items():
        said = ", ".join(f"{c} AS {name}" for p, c, name in cols if p == prefix)
        parts.append(f"(SELECT r.id, {said} FROM (SELECT *, {key} AS key FROM a) r LEFT JOIN (SELECT *, {key} AS key FROM a) h ON h.key = r.key AND h.t < r.t AND h.f <= r.f GROUP BY r.id, r.t, r.amount) {prefix}")
    names = ", ".join(name for _, _, name in cols)
    return TX + f", a AS (SELECT *, tx_day // 10 + CAST(k % 17 = 0 AS INTEGER) AS f FROM tx) SELECT card.id, {names} FROM {parts[0]} JOIN {parts[1]} USING (id) JOIN {parts[2]} USING (id)"


@query(arriving_sql())
def st2_account_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 account features of each row, from what has arrived in earlier files or is earlier in its own."""
    windows = {"1h": HOUR, "24h": DAY, "7d": 7 * DAY, "hist": None}
    keys = {"card": "card_key", "addr": "addr_key", "acct": "acct_key"}
    stream = keyed.entity_features(arriving(spark, sf_dir), keys, "t", "amount", "id", windows, ["k5", "k3"], lateness=30 * DAY)
    long = ST.run_through(stream, folder(spark, "accounts"))
    wide = long.groupBy("id").agg(*(F.max(F.when(F.col("level") == p, F.col(c))).alias(f"{p}_{c}") for p, c in account_inputs()))
    return rounded(account_features(wide.join(tx(spark, sf_dir).select("id", "amount"), "id"), "amount").select("id", *(f"{p}_{c}" for p, c in ACCOUNT_FEATURES)), 4, 1e-6)


@query(TX + "SELECT id, amount, round(CAST(k AS DOUBLE), 6) AS v1, CAST(1 AS DOUBLE) AS v2 FROM tx WHERE k % 9 <> 0 AND k % 5 <> 0 AND k % 7 <> 0")
def st1_validated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without an amount, with a key too many, or broken JSON go to the other side."""
    v = F.create_map(F.lit("V1"), F.col("k").cast("double"), F.lit("v2"), F.lit(1.0))
    v = F.when(F.col("k") % 5 == 0, F.map_concat(v, F.create_map(F.lit("v3"), F.lit(0.0)))).otherwise(v)
    text = F.to_json(F.struct("id", F.when(F.col("k") % 9 != 0, F.col("amount")).alias("amount"), v.alias("v")))
    payloads = event_stream(spark, sf_dir).select(F.when(F.col("k") % 7 == 0, F.lit("{broken")).otherwise(text).alias("payload"))
    good, _ = ST.validated(payloads, "id bigint, amount double", ["id", "amount"], ["v1", "v2"])
    return rounded(ST.run_through(good, folder(spark, "good")))


SCORES = TX + ", s AS (SELECT id, 1 / (1 + exp(-((k - 50) / 20.0 + (amount - 20) / 40.0))) AS q, (k - 50) / 20.0 AS a, (amount - 20) / 40.0 AS b FROM tx)"


@query(SCORES + "SELECT id, round(q, 6) AS p, CASE WHEN q >= 0.7 THEN 'review' ELSE 'accept' END AS decision, CASE WHEN q >= 0.7 THEN CASE WHEN a > 0 AND (a >= b OR b <= 0) THEN 'k' WHEN b > 0 THEN 'amount' END END AS first_reason FROM s")
def st3_stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream twice, as after a restart without a checkpoint: every key is in the log once."""
    at = folder(spark, "scores")
    log = KeyedStore(spark, f"{at}/log", "id", 8)
    parts = {"k": (F.col("k") - 50) / F.lit(20.0), "amount": (F.col("amount") - 20) / F.lit(40.0)}
    p = sigmoid(parts["k"] + parts["amount"])
    for run in (1, 2):
        ST.score_sink(event_stream(spark, sf_dir), log, f"run{run}", f"{at}/checkpoint{run}", lambda batch: ST.scored(batch, "id", p, 0.7, parts, 1)).awaitTermination()
    return rounded(log.read().select("id", "p", "decision", F.get("reasons", F.lit(0))["feature"].alias("first_reason")))


@query(TX + "SELECT id, event_type FROM tx")
def st4_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row comes twice, in a batch and again after its checkpoint is lost."""
    at = folder(spark, "store")
    store = KeyedStore(spark, f"{at}/rows", "id", 8)
    doubled = event_stream(spark, sf_dir).select("id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    for run in (1, 2):
        store.sink(doubled, f"run{run}", f"{at}/checkpoint{run}").awaitTermination()
    return store.read().select("id", "event_type")


@query(TX + "SELECT tx_day, count(*) AS n, round(avg(CAST(p >= 0.7 AS INTEGER)), 6) AS review_rate FROM tx GROUP BY tx_day")
def st5_daily_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = ST.run_through(ST.daily(event_stream(spark, sf_dir), "ts", "p", 0.7), folder(spark, "days"), "complete")
    day = F.floor((F.unix_seconds("window.start") - EPOCH) / 86_400).cast("int")
    return rounded(days.select(day.alias("tx_day"), "n", "review_rate"))


@query(TX + """, l AS (SELECT tx_day, 'amount' AS feature, CASE WHEN k % 9 = 0 THEN -1 ELSE CAST(amount >= 5 AS INTEGER) + CAST(amount >= 20 AS INTEGER) + CAST(amount >= 80 AS INTEGER) END AS bin FROM tx UNION ALL SELECT tx_day, 'k', CAST(k >= 50 AS INTEGER) FROM tx)
SELECT tx_day, feature, bin, count(*) AS n FROM l GROUP BY ALL""")
def st5_daily_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).withColumn("amount", F.when(F.col("k") % 9 != 0, F.col("amount")))
    days = ST.run_through(ST.daily_bins(e, "ts", {"amount": [5.0, 20.0, 80.0], "k": [50.0]}), folder(spark, "bins"), "complete")
    return days.select(F.floor((F.unix_seconds("window.start") - EPOCH) / 86_400).cast("int").alias("tx_day"), "feature", "bin", "n")


@query(TX + "SELECT a.id, CASE WHEN b.delay <= 30 THEN b.y END AS y FROM (SELECT * FROM tx WHERE tx_day < 20) a LEFT JOIN (SELECT id, y, k % 40 AS delay FROM tx WHERE k % 3 <> 0) b USING (id)")
def st6_matured_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels come k % 40 days after the decision, for two thirds of the rows; those after 30 days are too late."""
    e = event_stream(spark, sf_dir)
    decisions = e.where("t < 20 * 86400").select("id", F.col("ts").alias("decided_at"))
    later = F.timestamp_seconds(F.unix_seconds("ts") + (F.col("k") % 40) * 86_400 + 1)
    labels = e.where("k % 3 <> 0").select("id", later.alias("labelled_at"), (F.col("event_type") == "error").cast("int").alias("y"))
    out = ST.run_through(ST.matured(decisions, labels, "id", "30 days 1 hour").select("id", "y"), folder(spark, "matured"))
    # Decisions that the watermark has not passed yet are still open: in a batch view they have no label.
    open_ = tx(spark, sf_dir).where("tx_day < 20").select("id").join(out, "id", "left_anti").withColumn("y", F.lit(None).cast("int"))
    return out.union(open_)


@query(TX + "SELECT tx_day, count(*) AS n, (SELECT count(DISTINCT user_id) FROM tx b WHERE b.tx_day <= a.tx_day AND b.tx_day >= 5) AS users FROM tx a WHERE tx_day BETWEEN 5 AND 12 GROUP BY tx_day")
def st7_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day appends its users to a store and then counts them all: right only if days come in order."""
    at, rows = folder(spark, "replay"), []

    def process(batch: DataFrame, day: int) -> None:
        io.append_once(batch.select("user_id"), f"{at}/users", "user_id")
        rows.append((day, batch.count(), spark.read.parquet(f"{at}/users").count()))

    ST.replay(tx(spark, sf_dir), "tx_day", 5, 12, process)
    return spark.createDataFrame(rows, "tx_day int, n long, users long")


@query(TX + "SELECT tx_day, count(*) AS n FROM tx WHERE tx_day < 20 AND NOT (tx_day = 12 OR tx_day BETWEEN 10 AND 14 AND k < 10) GROUP BY tx_day")
def st8_recomputed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's days are written anew after some rows went and a day emptied; days outside stay as they were."""
    path, d = folder(spark, "daily"), tx(spark, sf_dir).where("tx_day < 20")
    count = lambda x: x.groupBy("tx_day").agg(F.count(F.lit(1)).alias("n"))
    ST.recompute_window(count(d), path, "tx_day", 0, 19)
    changed = count(d.where("NOT (tx_day = 12 OR k < 10)"))
    for _ in range(2):
        ST.recompute_window(changed, path, "tx_day", 10, 14)
    return spark.read.parquet(path).select(F.col("tx_day").cast("int").alias("tx_day"), "n")
