"""A keyed store that takes each key once: rows in hash buckets of the key, and a manifest of committed batches.

Its readers see a table; an append reads only the buckets that its keys fall in, and of these, for small batches, only
the files whose Bloom filters may hold one of the keys. A batch that is run again, before or after its commit, changes
nothing: what it had written is known by key, what it had committed by name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.sources.io import create_once, exists

#: Buckets of a store, and keys of a batch that are sought by name in the files.
BUCKETS, SOUGHT = 64, 1_000


class KeyedStore:
    """Rows at path/rows/_bucket=n, commits at path/commits. The first append fixes the schema and number of buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("_bucket")

    def committed(self, query: str, batch: int) -> bool:
        return exists(self.spark, f"{self.path}/commits/{query}-{batch}.json")

    def known(self, new: DataFrame) -> DataFrame:
        """Keys that the store has in the buckets of new ones, as _seen."""
        few = [r[0] for r in new.select(self.key).distinct().limit(SOUGHT + 1).collect()]
        rows = self.spark.read.schema(new.schema).parquet(f"{self.path}/rows")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most as many as buckets
        rows = rows.where(F.col("_bucket").isin(touched))
        if len(few) <= SOUGHT:
            named = [k for k in few if k is not None]
            sought = F.col(self.key).isin(named) if named else F.lit(False)
            rows = rows.where(sought | F.col(self.key).isNull() if None in few else sought)
        return rows.select(F.col(self.key).alias("_seen"))

    def append(self, batch: DataFrame, query: str, number: int) -> bool:
        """Adds the rows of batch `number` of `query` whose key the store does not have; of equal keys one, null being
        a key. False, and nothing done, if that batch was committed before."""
        if self.committed(query, number):
            return False
        new = batch.dropDuplicates([self.key]).withColumn("_bucket", self.bucket()).persist()
        try:
            rows = new
            if exists(self.spark, f"{self.path}/rows"):
                seen = self.known(new)
                rows = new.join(seen, new[self.key].eqNullSafe(seen["_seen"]), "left_anti")
            writer = rows.repartition("_bucket").write.mode("append").partitionBy("_bucket")
            writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/rows")
        finally:
            new.unpersist()
        create_once(self.spark, f"{self.path}/commits/{query}-{number}.json", json.dumps({"query": query, "batch": number}))
        return True

    def sink(self, stream: DataFrame, query: str, checkpoint: str, change=lambda batch: batch) -> StreamingQuery:
        """Each key of a stream once, through `change`, whatever is run again."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint)
        return writer.foreachBatch(lambda batch, number: self.append(change(batch), query, number) and None).trigger(availableNow=True).start()
