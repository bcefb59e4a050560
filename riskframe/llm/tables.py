"""Reading tables, writing intermediate ones, and the folds the queries fix."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where that setting is absent a temporary folder stands in, on one machine only: on a cluster it would be another
    folder on each.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows that go to a Python worker in one Arrow batch, at most.
BATCH = 1_000
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """df, of whose rows a Python worker gets BATCH at once: of whole texts or sets Spark's 10,000 take tens of MB, outside
    the heap of the executor and again in each worker. The setting holds for the session; smaller ones stay."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW)) <= BATCH:
        conf.set(ARROW, BATCH)
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and no lost executor takes it away."""
    path = f"{shared_folder(df.sparkSession)}/riskframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/riskframe-" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tasks that the rows of one key are dealt over in join_salted.
SALTS = 16


def join_salted(rows: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined to small, which has a row for each key; a key may hold a third of rows, so that these are dealt by
    key and a hash of `spread`, and small comes in SALTS copies.

    The copies are never broadcast: Spark judges them by the size of small's files, a hundredth of what the driver
    would hold.
    """
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [key, "_salt"], how).drop("_salt")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled(labels: DataFrame, label: str, n: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y): at most `most` labelled ids outside the held-out fold, the first by a hash of the id.

    Repeated labels of an id count once (the larger holds); null ids and labels are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), n) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
