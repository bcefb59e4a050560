"""Streams in several batches give what one batch gives."""

import time

import pytest
from pyspark.sql import functions as F

from riskframe.streaming import keyed
from riskframe.streaming import stream as ST

SCHEMA = "id long, user_id long, t long, amount double"


@pytest.fixture(scope="module")
def rows():
    return [(i, None if i % 13 == 0 else i % 4, 5_000 * (i // 3), None if i % 7 == 0 else float(i % 11)) for i in range(240)]


def in_batches(spark, rows, folder, n):
    for k in range(n):
        part = [r for r in rows if r[2] * n // (rows[-1][2] + 1) == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def arrived(rows, r, batch_of, windows):
    """What the row of an id sees: strictly earlier rows of its key that are in its batch or an earlier one."""
    import statistics

    past = [x for x in rows if x[1] == r[1] and x[2] < r[2] and batch_of[x[0]] <= batch_of[r[0]]]
    out = {}
    for label, s in windows.items():
        inside = [x for x in past if s is None or x[2] >= r[2] - s]
        v = [x[3] for x in inside if x[3] is not None]
        out |= {f"{label}_cnt": len(inside), f"{label}_sum": sum(v) if v else None, f"{label}_mean": statistics.fmean(v) if v else None, f"{label}_std": statistics.stdev(v) if len(v) > 1 else None}
    return out | {"gap": r[2] - max(x[2] for x in past) if past else None, "o_distinct": len({x[4] for x in past})}


@pytest.mark.parametrize("lateness", [10_000, 10_000_000])
def test_keyed_state_over_batches_with_late_rows(spark, tmp_path, lateness):
    import random

    r = random.Random(3)
    windows = {"w": 43_200, "h": None}
    rows = [(i, None if i % 13 == 0 else f"key {i % 4}", r.randrange(40) * 1_800 * (1 + i // 60), None if i % 7 == 0 else float(i % 11), None if i % 5 == 0 else "xyz"[i % 3]) for i in range(240)]
    batch_of = {x[0]: x[0] // 60 for x in rows}
    schema = "id long, k string, t long, amount double, o string"
    for b in range(4):
        spark.createDataFrame([x for x in rows if batch_of[x[0]] == b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ST.run_through(keyed.entity_features(stream, {"a": "k"}, "t", "amount", "id", windows, ["o"], lateness=lateness), f"{tmp_path}/out")
    found = {x["id"]: x for x in out.collect()}
    assert len(found) == len(rows)
    for x in rows:
        before = [y[2] for y in rows if y[1] == x[1] and batch_of[y[0]] < batch_of[x[0]]]
        late = bool(before) and x[2] // 3_600 < max(before) // 3_600 - lateness // 3_600
        f = found[x[0]]
        assert f["late"] == late and f["level"] == "a" and f["key"] == x[1]
        for c, want in arrived(rows, x, batch_of, windows).items():
            assert f[c] is None if late or want is None else f[c] == pytest.approx(want), (x, c)
    assert any(x["late"] for x in found.values()) == (lateness == 10_000)


def test_an_idle_key_begins_anew(spark, tmp_path):
    schema = "id long, k string, t long, amount double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKS)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    features = keyed.entity_features(stream, {"a": "k"}, "t", "amount", "id", {"h": None}, [], idle=2)
    query = features.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        for i, key in enumerate(["x", "x", "x"]):
            spark.createDataFrame([(i, key, i, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            began = time.time()
            while spark.table("idle").count() <= i and time.time() - began < 30:
                time.sleep(0.2)
            time.sleep(8 if i else 0)
        found = sorted((r["id"], r["h_cnt"]) for r in spark.table("idle").collect())
    finally:
        query.stop()
    assert found == [(0, 0), (1, 1), (2, 0)]


def test_append_sink_after_a_lost_checkpoint(spark, rows, tmp_path):
    stream = in_batches(spark, rows, f"{tmp_path}/in", 3)
    for run in (1, 2):
        ST.append_sink(stream, f"{tmp_path}/store", "id", f"{tmp_path}/c{run}").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [r[0] for r in rows]


def test_broken_payloads_go_aside_as_they_came(spark, tmp_path):
    good = '{"id": 1, "amount": 2.5, "v": {"V1": 0.5, "v2": null}}'
    deep = '{"id": 4, "amount": 1, "v": ' + '{"v1":' * 5_000 + "1" + "}" * 5_001
    bad = ['{"id": 1, "amount": 1, "v": {"V1": 1, "v1": 2, "v2": 3}}', '{"id": 1, "amount": 1, "v": {"v1": 1, "v1": 2, "v2": 3}}', '{"id": 1, "ID": 2, "amount": 1, "v": {"v1": 1, "v2": 2}}', deep]
    bad += ['{"id": 1, "amount": 1, "more": 1, "v": {"v1": 1, "v2": 2}}', '{"id": 1, "amount": 1, "v": [1, 2]}', "[]", "7", "null", '"x"', '{"id": 1, "amount": "a lot", "v": {"v1": 1, "v2": 2}}']
    bad += ["{nope", '{"id": null, "amount": 1, "v": {"v1": 1, "v2": 2}}', '{"id": 2, "amount": 1, "v": {"v1": 1}}', '{"id": 3, "amount": 1}', ""]
    df = spark.createDataFrame([(p,) for p in [good, *bad]], "payload string")
    fine, aside = ST.validated(df, "id bigint, amount double", ["id", "amount"], ["v1", "v2"])
    assert [tuple(r) for r in fine.collect()] == [(1, 2.5, 0.5, None)]
    assert sorted(r[0] for r in aside.collect()) == sorted(bad)


def test_replay_is_in_order_and_recomputed_days_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(3, 1), (1, 1), (2, 5), (9, 1)], "day int, n int")
    seen = []
    assert ST.replay(df, "day", 1, 3, lambda batch, day: seen.append((day, batch.count()))) == [1, 2, 3]
    assert seen == [(1, 1), (2, 1), (3, 1)]
    ST.recompute_window(df, f"{tmp_path}/d", "day", 1, 9)
    for _ in range(2):
        ST.recompute_window(df.where("day <> 2").withColumn("n", F.col("n") + 1), f"{tmp_path}/d", "day", 2, 3)
    assert sorted((r["day"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/d").collect()) == [(1, 1), (3, 2), (9, 1)]


def test_equal_contributions_keep_their_order(spark):
    """k and amount contribute the same: the first given is the first reason."""
    d = spark.createDataFrame([(1, 2.0), (2, -1.0)], "id long, x double").withColumn("p", F.lit(0.9))
    found = ST.scored(d, "id", F.col("p"), 0.7, {"k": F.col("x"), "amount": F.col("x") * 1.0}, 1).orderBy("id").collect()
    assert [[z["feature"] for z in r["reasons"]] for r in found] == [["k"], []]


def test_small_keys_are_one_value_and_grow_out_of_it(spark, tmp_path, monkeypatch, rows):
    """The same features whether keys stay one value, outgrow it between batches, or never are one."""
    found = []
    for small in (0, 40, 512):
        monkeypatch.setattr(keyed, "SMALL", small)
        stream = in_batches(spark, rows, str(tmp_path / f"in{small}"), 3)
        out = ST.run_through(keyed.entity_features(stream, {"user": "user_id"}, "t", "amount", "id", {"w": 36_000, "h": None}, [], lateness=10_000_000), str(tmp_path / f"out{small}"))
        found.append(sorted(map(tuple, out.select("id", "w_cnt", F.round("w_sum", 6), "h_cnt", F.round("h_std", 6), "gap").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_rows_of_a_key_go_to_its_state_as_lists(spark, monkeypatch):
    """One list for a key, whatever its rows' order, but for those of more than PACK rows."""
    import pyarrow as pa

    d = pa.RecordBatch.from_pylist([{"id": i, "_level": "a", "_key": None if i % 3 == 0 else str(i % 3)} for i in range(12)])
    (out,) = keyed.packed(iter([d.slice(0, 5), d.slice(5)]))
    assert {r["_key"]: r["id"] for r in out.to_pylist()} == {None: [0, 3, 6, 9], "1": [1, 4, 7, 10], "2": [2, 5, 8, 11]}
    monkeypatch.setattr(keyed, "PACK", 3)
    (out,) = keyed.packed(iter([d]))
    assert sorted((r["_key"] or "", r["id"]) for r in out.to_pylist()) == [("", [0, 3, 6]), ("", [9]), ("1", [1, 4, 7]), ("1", [10]), ("2", [2, 5, 8]), ("2", [11])]


@pytest.mark.parametrize("dense", [0, 1_024])
def test_features_of_many_rows_at_once(spark, tmp_path, monkeypatch, dense):
    """Whether rows are compared at once or by buckets: late rows, infinite and huge amounts, and the mean of an infinite history."""
    import random

    monkeypatch.setattr(keyed, "DENSE", dense)
    r = random.Random(5)
    rows = [(i, r.randrange(120) * 900, [1e300, float("inf")][i // 50] if i in (7, 50) else None if i % 7 == 0 else float(i % 11), "xyz"[i % 3]) for i in range(150)]
    schema = "id long, t long, amount double, o string"
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("k", F.lit("a"))
    out = ST.run_through(keyed.entity_features(stream, {"a": "k"}, "t", "amount", "id", {"w": 14_400, "h": None}, ["o"], lateness=10_000_000), f"{tmp_path}/out")
    found = {x["id"]: x for x in out.collect()}
    assert len(found) == len(rows)
    for id, t, *_ in rows:
        past = [x for x in rows if x[1] < t and (x[0] < 60 or id >= 60)]
        for label, s in (("w", 14_400), ("h", None)):
            inside = [x for x in past if s is None or x[1] >= t - s]
            v = [x[2] for x in inside if x[2] is not None]
            assert found[id][f"{label}_cnt"] == len(inside)
            assert found[id][f"{label}_sum"] == (pytest.approx(sum(v)) if v else None)
            assert found[id][f"{label}_mean"] == (pytest.approx(sum(v) / len(v)) if v else None)
        assert found[id]["o_distinct"] == len({x[3] for x in past})
        assert found[id]["gap"] == (t - max(x[1] for x in past) if past else None)


def test_small_keys_of_a_group_are_read_and_written_together(monkeypatch):
    """Two batches of 200 keys: one value is read and written in each, whatever the keys; the features are those of each key's past."""
    import random
    import statistics

    calls = []

    class Store(dict):
        def call(self, name, default=None):
            def do(*x):
                calls.append(name)
                if name == "update":
                    self[()] = x[0]
                return self.get((), default)

            return do

    def state(*_):
        own = Store()
        return keyed.View(**{name: own.call(name) for name in ("get", "update", "getValue", "updateValue", "removeKey")})

    monkeypatch.setattr(keyed, "LOOKED_AT", 50)
    processor = keyed.Groups("t", "amount", "id", {"w": 36_000, "h": None}, ["o"], 3_600, 10_000_000, None)
    processor.init(keyed.View(getMapState=state, getValueState=state))
    r = random.Random(2)
    rows = [(i, r.choice([None, *map(str, range(200))]), r.randrange(300) * 600, None if i % 9 == 0 else float(i % 13), "xyz"[i % 3]) for i in range(1_500)]
    found = {}
    for batch in (rows[:700], rows[700:]):
        given = [dict(zip(("id", "_own", "t", "amount", "o"), map(list, zip(*batch[i : i + 300], strict=True)), strict=True)) for i in range(0, len(batch), 300)]
        for out in processor.handleInputRows(("a", "0"), iter(given), None):
            for i, x in enumerate(zip(*out[1:], strict=True)):
                found[x[1]] = dict(zip(out.__fields__[1:], x, strict=True))
    assert calls == ["get", "update"] * 2 and len(found) == len(rows)
    for x in rows:
        past = [y for y in rows if y[1] == x[1] and y[2] < x[2] and (y[0] < 700 or x[0] >= 700)]
        f = found[x[0]]
        assert f["key"] == x[1] and not f["late"] and f["gap"] == (x[2] - max(y[2] for y in past) if past else None) and f["o_distinct"] == len({y[4] for y in past})
        for label, s in (("w", 36_000), ("h", None)):
            inside = [y for y in past if s is None or y[2] >= x[2] - s]
            v = [y[3] for y in inside if y[3] is not None]
            assert f[f"{label}_cnt"] == len(inside) and f[f"{label}_sum"] == (pytest.approx(sum(v)) if v else None)
            assert f[f"{label}_std"] == (pytest.approx(statistics.stdev(v), abs=1e-9) if len(v) > 1 else None)
