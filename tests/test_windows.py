"""Window operators against a plain Python version, with ties, null keys and null values."""

import math
import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import windows as W

SCHEMA = "id int, key string, t long, v double, o string"


@pytest.fixture(scope="module")
def rows():
    """A hot key with bursts of ties, quiet keys, a null key, and a key with no values at all."""
    out = []
    for burst in range(60):
        at = 3_000 * burst + burst * burst
        out += [("hot", at + step // 3, None if step == 4 else 1.5 * burst - step, "xyz"[step % 3]) for step in range(8)]
    for place, key in enumerate(["calm", "rare", None]):
        out += [(key, 40_000 * j + 77 * place, 10.0 * place - j * j, None if j % 3 else "x") for j in range(9)]
    out += [("empty", 900 * j, None, "y") for j in range(12)]
    return [(i, *row) for i, row in enumerate(random.Random(11).sample(out, len(out)))]


def expected(rows, seconds):
    """By key: times in order, then the stretch [t - seconds, t) by bisection."""
    by_key = {}
    for _, key, t, v, _ in sorted(rows, key=lambda r: r[2]):
        by_key.setdefault(key, ([], []))
        by_key[key][0].append(t)
        by_key[key][1].append(v)
    out = {}
    for i, key, t, _, _ in rows:
        times, values = by_key[key]
        end = bisect_left(times, t)
        start = 0 if seconds is None else bisect_left(times, t - seconds)
        inside = np.array([v for v in values[start:end] if v is not None])
        n = len(inside)
        out[i] = (end - start, float(inside.sum()) if n else None, float(inside.mean()) if n else None, float(inside.std(ddof=1)) if n > 1 else None)
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7))


@pytest.mark.parametrize("seconds", [3_600, 86_400, None])
def test_past_window(spark, rows, seconds):
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r[0]: tuple(r)[1:] for r in W.past_window(df, "key", "t", "v", {"w": seconds}, "x").select("id", "x_w_cnt", "x_w_sum", "x_w_mean", "x_w_std").collect()}
    want = expected(rows, seconds)
    assert all(all(map(close, found[i], want[i])) for i in want)


def matches(found, want, label):
    return all(found[i][f"{label}_cnt"] == want[i][0] and all(close(found[i][f"{label}_{c}"], x) for c, x in zip(("sum", "mean", "std"), want[i][1:], strict=True)) for i in want)


@pytest.mark.parametrize("bucket", [60, 1_800, 3_600])
def test_segments_are_the_same(spark, rows, bucket):
    windows = {"h": 3_600, "d": 86_400, "all": None}
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["id"]: r for r in W.segmented(df, "key", "t", "v", windows, distinct={"o": "o", "v": "v"}, bucket=bucket).collect()}
    assert len(found) == len(rows) and all(matches(found, expected(rows, s), label) for label, s in windows.items())
    for r in found.values():
        past = [x for x in rows if x[1] == r["key"] and x[2] < r["t"]]
        assert r["o_distinct"] == len({x[4] for x in past}) and r["v_distinct"] == len({x[3] for x in past})
        assert r["gap"] == (r["t"] - max(x[2] for x in past) if past else None)


def test_segments_of_long_histories_negative_times_and_nan(spark):
    nan = float("nan")
    rows = [(i, "k", t, v, "o") for i, (t, v) in enumerate([(-700_000, 3.0), (-3_601, 1.0), (-3_600, nan), (-1, 2.0), (0, None), (1, 4.0), (3_600, 8.0), (3_599, 1.0), (900_000, 5.0), (90_000_000, 6.0), (90_000_000, 7.0), (90_000_001, 1.0)])]
    found = {r["id"]: r for r in W.segmented(spark.createDataFrame(rows, SCHEMA), "key", "t", "v", {"h": 3_600, "w": 604_800, "all": None}).collect()}
    plain = [(i, k, t, None if v is None or v != v else v, o) for i, k, t, v, o in rows]
    for label, s in (("h", 3_600), ("w", 604_800), ("all", None)):
        assert matches(found, expected(plain, s), label)


def test_a_value_outside_the_window_does_not_bear_on_it(spark):
    """Neither NaN nor a value beside which the others vanish, in the same bucket or an earlier one."""
    day = 30 * 86_400
    for odd in (float("nan"), 1e17):
        rows = [(0, "k", 0, odd, ""), (1, "k", day, 1e17, ""), (2, "k", day + 1_000, 5.0, ""), (3, "k", day + 1_100, 7.0, ""), (4, "k", day + 4_000, 1.0, "")]
        df = spark.createDataFrame(rows, SCHEMA)
        r = {r["id"]: r for r in W.segmented(df, "key", "t", "v", {"w": 3_600}).collect()}[4]
        assert (r["w_cnt"], r["w_sum"], r["w_mean"], r["w_std"]) == (2, 12.0, 6.0, pytest.approx(2**0.5))
        found = {r["id"]: r for r in W.history_lookup(df, df.where("id <> 1"), "key", "t", "v", "id", {"d": 86_400}).collect()}
        assert found[4]["sum_d"] == 12.0
        e = W.entity_aggregates(df.where("id <> 1"), {"a": "key"}, "t", "v", {"o": "o"}).where("id = 4").first()
        assert e["a_amt_sum_24h"] == 12.0 and e["a_o_distinct"] == 1


def test_a_hot_key_is_dealt_over_all_tasks(spark):
    """300,000 rows of one key in 30 days: no task of the windows' stage holds more than its share of the buckets."""
    df = spark.range(300_000, numPartitions=4).select("id", F.when(F.col("id") >= 0, "hot").alias("key"), (F.col("id") * 8).alias("t"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = W.segmented(df, "key", "t", "v", {"h": 3_600, "d": 86_400}).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("count"), F.sum("h_sum"), F.sum("d_sum")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 16 and max(r["count"] for r in rows) < 300_000 / 16 * 3


def test_distinct_and_gap(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = W.past_distinct(df, "key", "t", "o", "id", "n").withColumn("gap", W.secs_since_prev("key", "t"))
    for r in out.collect():
        past = [x for x in rows if x[1] == r["key"] and x[2] < r["t"]]
        assert r["n"] == len({x[4] for x in past})
        assert r["gap"] == (r["t"] - max(x[2] for x in past) if past else None)


def test_ties_do_not_see_each_other(spark):
    df = spark.createDataFrame([("a", 100, 1.0), ("a", 100, 2.0), ("a", 200, 3.0)], "key string, t long, v double")
    found = sorted((r["t"], r["x_all_cnt"], r["x_all_sum"]) for r in W.past_window(df, "key", "t", "v", {"all": None}, "x").collect())
    assert found == [(100, 0, None), (100, 0, None), (200, 2, 3.0)]


def test_history_lookup_sees_strictly_earlier_history_only(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    requests = df.where("id % 5 = 0")
    found = {r["id"]: r for r in W.history_lookup(requests.select("id", "key", "t"), df, "key", "t", "v", "id", {"d": 86_400, "all": None}).collect()}
    assert set(found) == {r[0] for r in rows if r[0] % 5 == 0}
    for label, seconds in (("d", 86_400), ("all", None)):
        want = expected(rows, seconds)
        assert all(r[f"cnt_{label}"] == want[i][0] and close(r[f"sum_{label}"], want[i][1]) for i, r in found.items())
