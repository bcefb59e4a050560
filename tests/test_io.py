"""Sources and sinks: staging, types, publishing, ledgers, databases, and appends that run again."""

import json

import pytest
from pyspark.sql import functions as F

from riskframe.operators import checks as C
from riskframe.operators.encode import FeatureEncoder
from riskframe.sources import io


def test_staging_types_by_name_and_joins_identity(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,TransactionDT,isFraud,C1,V10,V2,ProductCD\n1,86400,0,1.5,,7,W\n2,90000,1,oops,3,,\n")
    (tmp_path / "i.csv").write_text("TransactionID,id_01,DeviceType\n2,-5,mobile\n")
    raw = io.stage_csv(spark, f"{tmp_path}/t.csv")
    assert {t for _, t in raw.dtypes} == {"string"}
    assert io.split_block(raw.columns)[1] == ["v2", "v10"]
    rows = {r["transactionid"]: r for r in io.extract(spark, f"{tmp_path}/t.csv", f"{tmp_path}/i.csv").collect()}
    assert rows[1]["c1"] == 1.5 and rows[1]["v10"] is None and rows[1]["productcd"] == "W" and rows[1]["id_01"] is None
    assert rows[2]["c1"] is None and rows[2]["isfraud"] == 1 and rows[2]["productcd"] is None and rows[2]["devicetype"] == "mobile"


def test_database_in_key_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).select("id", (F.col("id") * 2).alias("v")).write.jdbc(url, "t", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    df = io.read_jdbc(spark, url, "t", "id", 4, ["v"], driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r[0] for r in df.collect()) == [2 * i for i in range(100)]


def test_publish_and_report_tables(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, 0.5), ("valid", 2, None)], "partition string, id int, x double")
    io.publish_features(df, f"{tmp_path}/features")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/features").where("partition = 'valid'").select("id", "x").collect())) == [(2, None)]
    for kind in ("csv", "json"):
        for _ in range(2):  # the second takes the place of the first
            io.write_table(df, f"{tmp_path}/{kind}", kind)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    assert {r["id"] for r in spark.read.json(f"{tmp_path}/json").collect()} == {1, 2}


def test_append_once_by_day_reads_the_touched_days(spark, tmp_path):
    store = f"{tmp_path}/store"
    a = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "id int, day int")
    for batch in (a, a, spark.createDataFrame([(2, 1), (3, 1)], "id int, day int")):
        io.append_once(batch, store, "id", "day")
    assert sorted(map(tuple, spark.read.parquet(store).select("id", "day").collect())) == [(1, 0), (2, 1), (3, 1)]


def test_bad_amounts_and_missing_roles_are_refused(spark):
    good = spark.createDataFrame([(1, 0, 3, 5.0, 7)], "id int, y int, tx_day int, amount double, k int")
    part = io.load_partition(good, "y", "amount", "id", ("amount",))
    assert part.features == ["k"] and part.day == "day"
    for bad in (None, -1.0, float("inf"), float("nan")):
        df = spark.createDataFrame([(1, 0, 3, bad, 7)], "id int, y int, tx_day int, amount double, k int")
        with pytest.raises(Exception, match="bad amount"):
            io.load_partition(df, "y", "amount", "id").df.collect()
    with pytest.raises(ValueError, match="no day column"):
        io.load_partition(good.drop("tx_day"), "y", "amount", "id")


def test_ledger_opens_once_and_sees_changes(spark, tmp_path):
    ledger, df = C.Ledger(spark, f"{tmp_path}/ledger"), spark.range(10)
    assert ledger.problems({"test": df}) == ["test was opened 0 times"]
    assert ledger.open("test", df, "2024-01-01", "the final score").count() == 10
    assert ledger.problems({"test": df}) == []
    with pytest.raises(PermissionError, match="opened at 2024-01-01"):
        ledger.open("test", df, "2024-01-02", "another look")
    with pytest.raises(PermissionError, match="changed"):
        ledger.open("test", spark.range(11), "2024-01-02", "another look")
    assert ledger.problems({"test": spark.range(11)}) == ["test has changed since it was opened"]


def test_narrow_types_and_interim_tables(spark, tmp_path):
    df = spark.createDataFrame([("1", "10", "1", "2.5", "7", "x", None), ("2", "20", "300", "oops", "NaN", "", "3")], "transactionid string, transactiondt string, isfraud string, c1 string, v2 string, productcd string, v1 string")
    low = io.downcast(df)
    assert dict(low.dtypes) == {"transactionid": "bigint", "transactiondt": "bigint", "isfraud": "tinyint", "c1": "float", "v2": "float", "productcd": "string", "v1": "float"}
    rows = sorted(low.collect())
    assert rows[0]["c1"] == 2.5 and rows[1]["c1"] is None and rows[1]["isfraud"] is None and rows[1]["v1"] == 3.0
    assert io.downcast(spark.createDataFrame([(float("nan"),)], "c1 double")).first()[0] is None
    io.write_interim(low, f"{tmp_path}/interim")
    assert "v1" not in io.read_interim(spark, f"{tmp_path}/interim", []).columns
    back = io.read_interim(spark, f"{tmp_path}/interim", ["v1"])
    assert sorted(back.columns) == sorted(c for c in low.columns if c != "v2") and [r["v1"] for r in back.orderBy("transactionid").collect()] == [None, 3.0]
    assert sorted(io.read_interim(spark, f"{tmp_path}/interim").columns) == sorted(low.columns)


def test_decision_log_rows_go_there_and_back(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.9, 0.8, "review", [("a", 0.5)], 1.5, None), (2, 0.2, 0.1, "accept", None, None, 2)], "id long, p_raw double, p double, decision string, reasons array<struct<feature:string,contribution:double>>, a double, b int")
    rows = io.decision_rows(scored, "id", "trees", "v1", 0.7, ["a", "b"], "final", F.timestamp_seconds(F.lit(5)))
    rows.write.mode("append").parquet(f"{tmp_path}/log")
    r = {x["id"]: x for x in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert json.loads(r[1]["features"]) == {"a": 1.5, "b": None} and json.loads(r[1]["reason_codes"]) == [{"feature": "a", "contribution": 0.5}]
    assert r[2]["reason_codes"] is None and r[2]["threshold"] == 0.7 and r[2]["latency_ms"] is None and r[2]["run_label"] == "final"
    back = io.decision_log(spark.read.parquet(f"{tmp_path}/log"), spark.createDataFrame([(1, 3), (2, 4)], "id long, day int"), "id", "day", ["a", "b"], 4).collect()
    assert [(x["id"], x["a"], x["b"]) for x in back] == [(2, None, 2.0)]


def test_of_two_openings_at_once_one_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def opened(i):
        try:
            C.Ledger(spark, f"file://{tmp_path}/ledger").open("test", spark.range(3), "2024-01-01", f"look {i}")
            return True
        except PermissionError:
            return False

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(opened, range(6))) == 1


def test_digest_is_of_a_multiset(spark):
    of = lambda rows: io.digest(spark.createDataFrame(rows, "a int, b int"))
    assert of([(1, 1), (1, 1), (5, 5)]) != of([(2, 2), (2, 2), (5, 5)])
    assert of([(1, 2), (3, 4), (1, 2)]) == of([(1, 2), (1, 2), (3, 4)]) != of([(1, 2), (3, 4), (3, 4)])
    assert of([(None, 1)]) != of([(1, None)]) and of([]) == (0, "0:0") and of([(None, None)]) != of([])


def test_null_keys_are_appended_once(spark, tmp_path):
    a = spark.createDataFrame([(None, 0), (1, 1), (None, 2)], "id int, v int")
    for _ in range(3):
        io.append_once(a, f"{tmp_path}/store", "id")
    assert sorted(str(r[0]) for r in spark.read.parquet(f"{tmp_path}/store").collect()) == ["1", "None"]


def test_encoders_come_back_as_they_were(spark, tmp_path):
    train = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), ("b", "y", 2.0)], "c string, d string, n double")
    other = spark.createDataFrame([("a", "z", 0.0), ("q", "y", 1.0), (None, None, 5.0)], "c string, d string, n double")
    encoder = FeatureEncoder(["c"], ["d"], ["n"]).fit(train)
    encoder.save(f"{tmp_path}/e")
    back = FeatureEncoder.load(spark, f"{tmp_path}/e")
    rows = [sorted(map(str, e.transform(other, ["c"]).collect())) for e in (encoder, back)]
    assert rows[0] == rows[1] and back.names == encoder.names
    assert json.loads((next((tmp_path / "e" / "lists").glob("part-*"))).read_text())["frequency"] == ["c"]
