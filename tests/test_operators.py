import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from riskframe.functions import rowwise as R
from riskframe.operators import decision as D
from riskframe.operators import encode as E
from riskframe.operators import split as S
from riskframe.operators.profile import reduce_correlated
from riskframe.operators.rank_metrics import feature_auc, ranking_metrics
from riskframe.plans import registry
from riskframe.sources import io
from riskframe.streaming import stream as ST

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    a, b = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)

    def rows(values):
        return sorted((tuple(round(v, 4) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in values), key=str)

    assert rows(tuple(r) for r in a.select(*columns).collect()) == rows(b.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


def test_amount_features(spark):
    d = R.amount_features(spark.createDataFrame([(100.0,), (59.99,), (1234.567,), (None,)], "amount double"))
    assert [(r["amt_round"], r["amt_cents"], r["amt_digits"]) for r in d.collect()] == [(1, 0.0, 0), (0, 0.99, 2), (0, 0.567, 3), (None, None, None)]


def test_encoder_unseen_and_missing(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    out = E.FeatureEncoder(["c"], ["c"], []).fit(fit).transform(spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, c string"), ["id"])
    assert {tuple(r) for r in out.collect()} == {(1, 2, 0), (2, 0, -1), (3, None, None)}


def test_collinear_column_is_dropped(spark):
    d = spark.range(500).select(F.randn(1).alias("v1"), F.randn(3).alias("v3")).withColumn("v2", F.col("v1") + 0.01 * F.randn(2))
    kept = reduce_correlated(d, ["v1", "v2", "v3"])
    assert "v3" in kept and len(kept) == 2


def test_leaked_label_is_found(spark):
    d = spark.range(1000).select((F.col("id") % 5 == 0).cast("int").alias("y"), F.rand(1).alias("noise")).withColumn("leak", F.col("y") * 2.0)
    out = {r["feature"]: r["separation"] for r in feature_auc(d, ["noise", "leak"], "y").collect()}
    assert out["leak"] == 1.0 and out["noise"] < 0.6


def test_folds():
    with pytest.raises(ValueError):
        S.purged_folds(0, 100, 4, purge=3, max_window=7)
    for f in S.purged_folds(0, 119, 4, purge=7, max_window=7):
        assert f.valid[0] - f.train[1] - 1 == 7 and f.valid[0] <= f.valid[1]


def test_perfect_and_constant_scores(spark):
    d = spark.createDataFrame([(1, 0.9, 0.5), (1, 0.8, 0.5), (0, 0.2, 0.5), (0, 0.1, 0.5)], "y int, p double, c double")
    assert ranking_metrics(d, "y", "p").first()["roc_auc"] == 1.0
    assert ranking_metrics(d, "y", "c").first()["roc_auc"] == 0.5


def test_per_row_rule(spark):
    d = spark.createDataFrame([(0.99, 100.0), (0.99, 2.0), (0.99, 3.99), (0.99, 500.0), (0.99, 0.0)], "p double, a double")
    assert [r[0] for r in d.select(R.per_row_rule(F.col("p"), F.col("a"), 4.0)).collect()] == [1, 0, 0, 1, 0]


def test_sweep_is_the_cheapest(spark):
    rows = [(i % 3 == 0 and 1 or 0, (i * 37 % 100) / 100, float(i % 11)) for i in range(200)]
    best = D.cost_sweep(spark.createDataFrame(rows, "y int, p double, a double"), "y", "p", "a", 2.0).first()
    costs = [sum(2.0 if p >= t else a * y for y, p, a in rows) for t in {p for _, p, _ in rows} | {2.0}]
    assert best["cost"] == pytest.approx(min(costs))


def test_append_once_and_one_to_one(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    for _ in range(2):
        io.append_once(a, str(tmp_path / "store"), "k")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        io.join_one_to_one(a, a.dropDuplicates(), "k").collect()


def test_stream_features_match_batch(spark, tmp_path):
    from riskframe.operators import windows as W
    from riskframe.plans.views import tx
    from riskframe.streaming import keyed

    d = tx(spark, SF).select("id", "user_id", "t", "amount").orderBy("t", "id")
    rows = d.collect()
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, d.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ST.run_through(keyed.entity_features(s, {"user": "user_id"}, "t", "amount", "id", {"w": 7 * W.DAY}, []), f"{tmp_path}/out")
    got = {r["id"]: r["w_cnt"] for r in out.collect()}
    want = {r["id"]: r["n"] for r in d.select("id", F.count(F.lit(1)).over(W.past("user_id", "t", 7 * W.DAY)).alias("n")).collect()}
    assert got == want


def test_each_feature_has_its_own_buckets(spark, monkeypatch):
    """Values of a feature in the thousands do not put all of another's in [0, 1] into one bucket."""
    from riskframe.operators import ordered

    monkeypatch.setattr(ordered, "SHARE", 0.5)
    df = spark.range(4_000).select(F.col("id").alias("a"), F.rand(1).alias("b")).selectExpr("a + 1000.0 as a", "b").unpivot([], ["a", "b"], "feature", "x")
    edges = ordered.bucket_edges(df, "x", ["feature"])
    most = ordered.bucketed(df, "x", edges).groupBy("feature", "_b").count().groupBy("feature").agg(F.max("count"), F.count("*")).collect()
    assert all(r[1] < 400 and r[2] > 30 for r in most)


def test_bootstrap_by_plain_numpy(spark, monkeypatch):
    """Ties, nulls and days of their own; blocks of three scores; the order of the rows changes nothing."""
    import numpy as np

    from riskframe.operators import rank_metrics as M

    monkeypatch.setattr(M, "SCORES", 3)
    r = np.random.default_rng(1)
    rows = [(int(d), None if i % 29 == 0 else int(r.random() < 0.4), float(np.round(r.random(), 2))) for i, d in enumerate(r.integers(0, 5, 300))]
    df = spark.createDataFrame([*rows, (None, 1, 0.5)], "day int, y int, p double")
    found = {x["draw"]: x for x in M.day_bootstrap(df, "y", "p", "day", 0.6, draws=40, seed=3).collect()}
    weights = {}
    for x in M.draw_weights(df.select("day").where("day is not null").distinct(), "day", 40, 3).collect():
        weights.setdefault(x["draw"], {})[x["day"]] = x["weight"]
    assert len(found) == 40
    for draw, w in weights.items():
        own = [(p, y, w.get(d, 0)) for d, y, p in rows if y is not None]
        pos, ap = sum(y * k for _, y, k in own), 0.0
        for score in sorted({p for p, _, _ in own}):
            here = sum(y * k for p, y, k in own if p == score)
            tp, n = sum(y * k for p, y, k in own if p >= score), sum(k for p, _, k in own if p >= score)
            ap += here * tp / n if n else 0.0
        tp, n = sum(y * k for p, y, k in own if p >= 0.6), sum(k for p, _, k in own if p >= 0.6)
        f = found[draw]
        assert np.allclose([f["pr_auc"], f["precision"], f["recall"]], [ap / pos, tp / n, tp / pos])
    again = M.day_bootstrap(df.orderBy("p"), "y", "p", "day", 0.6, draws=40, seed=3).collect()
    assert all(np.allclose(tuple(x), tuple(found[x["draw"]])) for x in again)
