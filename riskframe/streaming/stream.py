"""Streams: validated source, scoring, daily windows, exactly-once appends, matured labels (keyed state: see keyed)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.functions.rowwise import decide
from riskframe.operators.drift import bin_of
from riskframe.sources.io import append_once, read_payload
from riskframe.sources.store import KeyedStore
from riskframe.streaming.keyed import ROCKS

def validated(stream: DataFrame, schema: str, required: list[str], block: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) payloads of a stream with a JSON text column `payload`: parsed, and as they came.

    Good ones are objects of known fields with every required one, and a map v whose keys are exactly the block's names.
    """
    read = read_payload(F.col("payload"), schema, block)
    flat = stream.select("payload", *(c.alias(n) for n, c in read.items()))
    ok = F.col("_ok")
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return flat.where(ok).drop("payload", "_ok"), flat.where(~ok).select("payload")


def scored(batch: DataFrame, id: str, p: Column, threshold: float, contributions: dict[str, Column], k: int = 3) -> DataFrame:
    """The batch's decisions: id, p, decision, and for reviews alone the k largest positive contributions as reasons,
    ties in the order in which the contributions are given."""
    parts = F.array(*(F.struct((-c).alias("_order"), F.lit(i).alias("_place"), F.lit(name).alias("feature"), c.alias("contribution")) for i, (name, c) in enumerate(contributions.items())))
    top = F.slice(F.array_sort(F.filter(parts, lambda x: x["contribution"] > 0)), 1, k)
    reasons = F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))
    d = batch.withColumns({"p": p, "reasons": reasons})
    return d.select(id, "p", decide(F.col("p"), threshold).alias("decision"), F.when(F.col("p") >= threshold, F.col("reasons")).alias("reasons"))


def score_sink(stream: DataFrame, log: KeyedStore, query: str, checkpoint: str, decide_batch: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each row of a stream scored once into a decision log, however often a batch is run again."""
    return log.sink(stream, query, checkpoint, decide_batch)


def replay(df: DataFrame, day: str, first: int, last: int, process: Callable[[DataFrame, int], None]) -> list[int]:
    """Days from first to last in ascending order, each wholly processed before the next, as later ones see its
    writes; days without rows are left out. Returns the days processed."""
    days = [r[0] for r in df.where(F.col(day).between(first, last)).select(day).distinct().orderBy(day).collect()]
    for d in days:
        process(df.where(F.col(day) == d), d)
    return days


def recompute_window(table: DataFrame, path: str, day: str, first: int, last: int) -> None:
    """Writes the days of a window anew, in the place of what the store had of them; other days stay.

    Late and re-scored rows are right after it, and a second run changes nothing. A day that has no rows any more
    is emptied.
    """
    spark = table.sparkSession
    window = F.col(day).between(first, last)
    table.where(window).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    left = table.where(window).select(day).distinct()
    gone = spark.read.parquet(path).where(window).select(day).distinct().join(left, day, "left_anti").collect()
    for (d,) in gone:
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={d}")
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def daily(stream: DataFrame, ts: str, p: str, threshold: float, delay: str = "1 day") -> DataFrame:
    """Decisions and review rate by day, final once the watermark has passed."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(p) >= threshold).cast("double")).alias("review_rate"))


def daily_bins(stream: DataFrame, ts: str, edges: dict[str, list[float]], delay: str = "1 day") -> DataFrame:
    """Rows by day, feature and bin of the feature's frozen edges (-1: missing), final once the watermark has passed:
    what drift of a day, or of any window of days, is computed from. The state is a number for each of them."""
    parts = [F.struct(F.lit(f).alias("feature"), F.coalesce(bin_of(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), e), F.lit(-1)).alias("bin")) for f, e in edges.items()]
    long = stream.withWatermark(ts, delay).select(ts, F.inline(F.array(*parts)))
    return long.groupBy(F.window(ts, "1 day"), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def matured(decisions: DataFrame, labels: DataFrame, key: str, delay: str = "30 days") -> DataFrame:
    """Each decision with the label that comes within `delay` of it, or none once that time has passed.

    decisions: (key, decided_at, ...); labels: (key, labelled_at, y).
    """
    d = decisions.withWatermark("decided_at", "1 hour")
    other = labels.withWatermark("labelled_at", "1 hour").withColumnRenamed(key, "_k")
    within = (F.col(key) == F.col("_k")) & (F.col("labelled_at") >= F.col("decided_at")) & (F.col("labelled_at") <= F.col("decided_at") + F.expr(f"interval {delay}"))
    return d.join(other, within, "left").drop("_k")


def append_sink(stream: DataFrame, store: str, key: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Each key once in the store, however often a batch is run again."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, _: append_once(change(batch), store, key)).trigger(availableNow=True).start()


def run_through(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, as a table under folder: appended rows, or the last complete result."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state needs it; read as a query starts
    out = f"{folder}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
