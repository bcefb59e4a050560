"""The keyed store: each key once, replays that change nothing, and how much an append reads."""

import pytest
from pyspark.sql import functions as F

from riskframe.sources import store as S


def keys(store):
    return sorted((str(r["k"]), r["v"]) for r in store.read().collect())


def test_each_key_once_and_replays_change_nothing(spark, tmp_path):
    store = S.KeyedStore(spark, f"{tmp_path}/s", "k", 8)
    first = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), (None, 1), ("", 1)], "k string, v int")
    assert store.append(first, "q", 0) and not store.append(first, "q", 0)
    assert store.append(spark.createDataFrame([("a", 2), ("c", 2), (None, 2)], "k string, v int"), "q", 1)
    assert store.append(first.withColumn("v", F.lit(9)), "other", 0)
    assert store.append(first.limit(0), "q", 2)
    assert keys(store) == [("", 1), ("None", 1), ("a", 1), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("sought", [1_000, 1])
def test_a_crash_between_write_and_commit_replays_cleanly(spark, tmp_path, monkeypatch, sought):
    monkeypatch.setattr(S, "SOUGHT", sought)
    store = S.KeyedStore(spark, f"{tmp_path}/s", "k", 4)
    batch = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    monkeypatch.setattr(S, "create_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append(batch, "q", 0)
    monkeypatch.undo()
    assert not store.committed("q", 0)
    assert store.append(batch.union(batch.select(F.col("k") + 50, "v")), "q", 0) and store.committed("q", 0)
    assert len(keys(store)) == 100 == len(set(keys(store)))


def test_an_append_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    store = S.KeyedStore(spark, f"{tmp_path}/s", "k", 16)
    for i in range(4):
        store.append(spark.range(1_000 * i, 1_000 * (i + 1)).select(F.col("id").alias("k")), "q", i)
    files = len(store.read().inputFiles())
    new = spark.createDataFrame([(7,), (5_000,)], "k long").withColumn("_bucket", store.bucket())
    known = store.known(new)
    assert sorted(r[0] for r in known.collect()) == [7]
    scan = next(x for x in _nodes(known._jdf.queryExecution().executedPlan()) if x.nodeName().startswith("Scan parquet"))
    read = scan.metrics().get("numFiles").get().value()
    assert 0 < read <= files / 16 * 2 + 1
    assert "PushedFilters: [" in scan.toString() or "In(k" in scan.verboseStringWithOperatorId()


def _nodes(plan):
    out, open_ = [], [plan]
    while open_:
        x = open_.pop()
        out.append(x)
        if x.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            open_.append(x.executedPlan())
        children = x.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return out


def test_a_stream_after_a_lost_checkpoint(spark, tmp_path):
    schema = "k long, v int"
    for i in range(3):
        spark.createDataFrame([(j, i) for j in range(10 * i, 10 * i + 15)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = S.KeyedStore(spark, f"{tmp_path}/s", "k", 4)
    for run in (1, 2):
        store.sink(stream, f"run{run}", f"{tmp_path}/c{run}").awaitTermination()
    found = keys(store)
    assert sorted(int(k) for k, _ in found) == list(range(35))
