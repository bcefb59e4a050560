"""Sources and sinks: text staging, name-driven types, history and decision logs."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

# What the name of a raw column says of its type; the others are text.
WHOLE = ["transactionid", "transactiondt"]
LABEL = "isfraud"
MEASURES = ["transactionamt", "card1", "card2", "card3", "card5", "addr1", "addr2", "dist1", "dist2"]
MEASURES += ["id_01", "id_02", "id_03", "id_04", "id_05", "id_06", "id_07", "id_08", "id_09", "id_10", "id_11"]
NUMBERED_MEASURES = ["c", "d", "v"]  # each with a number behind it


def stage_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text under its lower-case name."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.toDF(*(c.lower() for c in df.columns))


def type_of(name: str) -> str:
    if name in WHOLE:
        return "bigint"
    if name == LABEL:
        return "smallint"
    return "double" if name in MEASURES or name.rstrip("0123456789") in NUMBERED_MEASURES and name[-1].isdigit() else "string"


def typed_select(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty text to null, then the type that the name says; what does not parse becomes null."""
    return df.select(*(F.nullif(F.col(c), F.lit("")).try_cast(type_of(c)).alias(c) for c in columns or df.columns))


#: Narrow types of the typed columns; a value that does not fit becomes null.
NARROW = {"bigint": "bigint", "smallint": "tinyint", "double": "float", "string": "string"}


def downcast(df: DataFrame) -> DataFrame:
    """Each column in the narrowest type that its name allows: keys and times stay long, the label takes a byte, measures
    are floats, the rest is text. What is no number becomes null, and so does NaN."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        if kind in ("double", "float"):
            x = F.when(~F.isnan(x), x)
        out.append(x.try_cast(NARROW[type_of(c)]).alias(c))
    return df.select(*out)


def write_interim(df: DataFrame, path: str, key: str = "transactionid", prefix: str = "v") -> None:
    """The base columns and the numbered block as two tables under path, both with the key, in the place of older ones."""
    base, block = split_block(df.columns, prefix)
    df.select(*base).write.mode("overwrite").parquet(f"{path}/base")
    df.select(key, *block).write.mode("overwrite").parquet(f"{path}/block")


def read_interim(spark: SparkSession, path: str, block: list[str] | None = None, key: str = "transactionid") -> DataFrame:
    """The base with the wanted columns of the block (all by default); none of the block is read where none is wanted."""
    base = spark.read.parquet(f"{path}/base")
    if block == []:
        return base
    other = spark.read.parquet(f"{path}/block")
    return base.join(other.select(key, *block) if block else other, key, "left")


def decision_rows(scored: DataFrame, key: str, model: str, version: str, threshold: float, features: list[str], label: str, scored_at: Column | None = None) -> DataFrame:
    """Rows of the decision log: key, model, scores, threshold, decision, reasons and features as JSON text, latency, run.

    scored: key, p_raw, p, decision, reasons (null for rows that are accepted), the features, and latency_ms if it was
    measured. Nulls are kept in the JSON.
    """
    keep = {"ignoreNullFields": "false"}
    latency = F.col("latency_ms").cast("double") if "latency_ms" in scored.columns else F.lit(None).cast("double")
    return scored.select(
        F.col(key),
        F.lit(model).alias("model_name"),
        F.lit(version).alias("model_version"),
        "p_raw",
        "p",
        F.lit(threshold).alias("threshold"),
        "decision",
        F.when(F.col("reasons").isNotNull(), F.to_json("reasons", keep)).alias("reason_codes"),
        F.to_json(F.struct(*features), keep).alias("features"),
        latency.alias("latency_ms"),
        F.lit(label).alias("run_label"),
        (F.current_timestamp() if scored_at is None else scored_at).alias("scored_at"),
    )


def split_block(columns: list[str], prefix: str = "v") -> tuple[list[str], list[str]]:
    """The other columns, and those of the numbered block in the order of their numbers."""
    block = sorted((c for c in columns if re.fullmatch(rf"{prefix}\d+", c)), key=lambda c: int(c[len(prefix) :]))
    return [c for c in columns if c not in block], block


def extract(spark: SparkSession, transactions: str, identity: str, key: str = "transactionid") -> DataFrame:
    """Typed transactions with their identity, one for none or one."""
    return typed_select(stage_csv(spark, transactions)).join(typed_select(stage_csv(spark, identity)), key, "left")


def publish_features(df: DataFrame, path: str, partition: str = "partition") -> None:
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_bucketed(df: DataFrame, path: str, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table at path, its rows dealt into buckets by a hash of the key and sorted by it within them.

    Tables with as many buckets of keys of one type are joined on them (also semi and anti) where they lie, without a
    shuffle on either side.
    """
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share (on one machine, where none is named, a temporary one)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/riskframe-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and no lost executor takes it away."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_once(batch: DataFrame, store: str, key: str, by: str | None = None) -> None:
    """Appends the rows whose key the store does not have; one of repeated keys. Safe to run again. Null is a key.

    by: a column that partitions the store and that a key always has the same value of, such as its event day: then
    only the partitions that the batch touches are read.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    if exists(spark, store):
        known = spark.read.schema(batch.schema).parquet(store)
        if by:
            known = known.join(batch.select(by).distinct(), by, "left_semi")
        seen = known.select(F.col(key).alias("_seen"))
        new = new.join(seen, new[key].eqNullSafe(seen["_seen"]), "left_anti")
    writer = new.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(store)


def labels(df: DataFrame, key: str, y: str) -> DataFrame:
    """The label lookup: a row for each key that has a label."""
    return df.where(F.col(key).isNotNull() & F.col(y).isNotNull()).select(key, y).dropDuplicates([key])


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, tasks: int, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table of a database in `tasks` key ranges between the smallest and the largest key, one query each.

    The bounds are asked for first; rows with a null key are in the first range. Column pruning and filters reach
    the database.
    """
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    options = {"url": url, "fetchsize": "100000", **options}
    bounds = spark.read.format("jdbc").options(**options, query=f"SELECT min({name}) AS a, max({name}) AS b FROM {table}")
    low, high = bounds.load().first()
    source = spark.read.format("jdbc").options(**options, dbtable=table)
    if low is not None and tasks > 1:
        source = source.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(tasks))
    df = source.load()
    return df.select(*columns) if columns else df


@dataclass(frozen=True)
class Partition:
    """A split with its roles: label, day, amount and key columns, and the ordered features."""

    df: DataFrame
    y: str
    day: str
    amount: str
    key: str
    features: list[str]


DAY_NAMES = ("tx_day", "day", "transactiondt")  # the first that a table has


def load_partition(df: DataFrame, y: str, amount: str, key: str, drop: tuple[str, ...] = ()) -> Partition:
    """Resolves the day column and the features (as float) of a split. Fails, while it runs, on amounts that are
    missing, negative or not finite, as costs could not be told."""
    day = next((c for c in DAY_NAMES if c in df.columns), None)
    if day is None or (gone := [c for c in (y, amount, key) if c not in df.columns]):
        raise ValueError(f"no day column among {DAY_NAMES}" if day is None else f"missing columns: {gone}")
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType | BooleanType)}
    features = [c for c in df.columns if c in numeric and c not in {y, day, key, *DAY_NAMES, *drop}]
    a = F.col(amount).cast("double")
    fine = a.isNotNull() & (a >= 0) & (a < float("inf"))
    checked = F.when(fine, a).otherwise(F.raise_error(F.concat(F.lit("bad amount of "), F.col(key).cast("string"))).cast("double"))
    days = F.col(day).cast("int") if day != "transactiondt" else F.floor(F.col(day) / 86_400).cast("int")
    roles = [F.col(key), F.col(y), days.alias("day"), checked.alias("amount_role")]
    return Partition(df.select(*roles, *(F.col(c).cast("float").alias(c) for c in features)), y, "day", "amount_role", key, features)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report table as CSV with a header or as JSON lines, in the place of an older one."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def with_sentinel(c: Column, sentinel: str = "__NULL__") -> Column:
    return F.coalesce(c.cast("string"), F.lit(sentinel))


def build_history(df: DataFrame, columns: list[str], categories: list[str], day: str, upto: int) -> DataFrame:
    """The history store up to a sealed day, null categories as a level of their own."""
    return df.where(F.col(day) <= upto).select(*(with_sentinel(F.col(c)).alias(c) if c in categories else c for c in columns))


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join that fails on repeated keys, while it runs, on either side."""

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated key on the {side}: "), F.col(key).cast("string")))).otherwise(F.lit(True))
        return df.join(n.where(ok).select(key), key)

    return checked(a, "left").join(checked(b, "right"), key)


def validate_payload(df: DataFrame, required: list[str], map_column: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): required fields present and the map's keys exactly the expected ones, lower-cased.

    Keys that are one when lower-cased make a row bad; its map is then as it came.
    """
    have = F.transform(F.map_keys(map_column), F.lower)
    fine = F.coalesce(F.array_sort(have) == F.array_sort(F.array(*(F.lit(k) for k in keys)).cast("array<string>")), F.lit(False))
    low = df.withColumns({"_fine": fine, map_column: F.when(fine, F.map_from_arrays(have, F.map_values(map_column))).otherwise(F.col(map_column))})
    ok = F.col("_fine")
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return low.where(ok).drop("_fine"), low.where(~ok).drop("_fine")


def read_payload(payload: Column, schema: str, block: list[str], map_column: str = "v") -> dict[str, Column]:
    """The base fields of `schema` ("name type, ...") and the block's names out of JSON text, and `_ok`: whether it is
    an object with no keys but these and the map, whose keys are the block's, all of them, in lower or upper case.

    The text becomes a variant first, which any text does or does not; what is broken, repeats a key (also in another
    case), is nested too deep or holds another kind is not ok, and nothing of it ends a job. A value that is no such
    type is null.
    """
    base = dict(x.split() for x in (part.strip() for part in schema.split(",")))
    x = F.try_parse_json(payload)
    top = F.try_variant_get(x, "$", "map<string,variant>")
    names = F.transform(F.map_keys(top), F.lower)
    clean = F.size(F.array_distinct(names)) == F.size(names)
    known = F.size(F.array_except(names, F.array(*(F.lit(c) for c in [*base, map_column])))) == 0

    def one(values: Column, keys: Column, name: str) -> Column:
        pairs = F.zip_with(keys, F.map_values(values), lambda k, y: F.struct(k.alias("k"), y.alias("y")))
        return F.get(F.filter(pairs, lambda z: z["k"] == name), F.lit(0))["y"]

    inner = F.try_variant_get(one(top, names, map_column), "$", "map<string,variant>")
    inner_names = F.transform(F.map_keys(inner), F.lower)
    exact = F.array_sort(inner_names) == F.array_sort(F.array(*(F.lit(c) for c in block)).cast("array<string>"))
    out = {"_ok": F.coalesce(clean & known & exact, F.lit(False))}
    out |= {c: F.try_variant_get(one(top, names, c), "$", kind) for c, kind in base.items()}
    return out | {c: F.try_variant_get(one(inner, inner_names, c), "$", "double") for c in block}


def compare_frames(a: DataFrame, b: DataFrame, key: str, columns: list[str], rtol: float = 1e-4, atol: float = 1e-5) -> DataFrame:
    """(feature, cells, differing): two feature tables cell by cell, nulls equal."""
    x = a.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([key], columns, "feature", "x")
    y = b.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([key], columns, "feature", "y")
    same = F.col("x").eqNullSafe(F.col("y")) | F.coalesce(F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.abs("y"), F.lit(False))
    return x.join(y, [key, "feature"], "full").groupBy("feature").agg(F.count(F.lit(1)).alias("cells"), F.count_if(~same).alias("differing"))


def digest(df: DataFrame) -> tuple[int, str]:
    """Row count and a digest of the rows as a multiset: sums of two independent hashes of each row, in any order.

    A repeated row counts as often as it comes, and a null in one column is not a null in another.
    """
    parts = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    lanes = [F.sum(F.xxhash64(F.lit(lane), *parts).cast("decimal(38,0)")) for lane in (1, 2)]
    n, a, b = df.agg(F.count(F.lit(1)), *lanes).first()
    return n, f"{int(a or 0):x}:{int(b or 0):x}"


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that nobody has written before; False if it is there already. Of two at once one succeeds."""
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(own.getParent())
    try:
        if fs.getUri().getScheme() == "file":  # the local file system of Hadoop looks first and creates then
            file = jvm.java.nio.file.Paths.get(own.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createFile(file, spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            jvm.java.nio.file.Files.write(file, bytearray(text.encode()), spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
        else:
            out = fs.create(own, False)
            try:
                out.write(bytearray(text.encode()))
            finally:
                out.close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def decision_log(log: DataFrame, history: DataFrame, key: str, day: str, features: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """The log with its event day (of the history, never the wall clock) and the wanted features out of its JSON as
    doubles; days from low to high. JSON nulls and what does not parse become null."""
    if bad := [f for f in features if not re.fullmatch(r"[a-z_][a-z0-9_]*", f)]:
        raise ValueError(f"not lower-case identifiers: {bad}")
    days = history.select(key, day)
    if low is not None:
        days = days.where(F.col(day) >= low)
    if high is not None:
        days = days.where(F.col(day) <= high)
    expanded = log.withColumns({f: F.try_variant_get(F.try_parse_json("features"), f"$.{f}", "double") for f in features})
    return expanded.join(days, key)


def day_payloads(df: DataFrame, day: str, at: int, base: list[str], block: list[str]) -> DataFrame:
    """One event day as JSON payloads: the base fields and the block as a map, nulls kept."""
    v = F.map_from_arrays(F.array(*(F.lit(c) for c in block)), F.array(*(F.col(c).cast("double") for c in block)))
    return df.where(F.col(day) == at).select(F.to_json(F.struct(*base, v.alias("v")), {"ignoreNullFields": "false"}).alias("payload"))


def parse_payloads(df: DataFrame, schema: str, block: list[str]) -> DataFrame:
    """Payloads (JSON text) back to typed columns; schema holds the base fields, the block becomes doubles."""
    found = read_payload(F.col("payload"), schema, block)
    return df.select(*(c.alias(n) for n, c in found.items() if n != "_ok"))
