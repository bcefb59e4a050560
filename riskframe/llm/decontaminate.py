"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark (13 words, or a whole shorter item) are normalised and become a hash set that is
shipped with the scan: in each document every window of the same lengths is hashed and looked up, and a hit is
verified on the words themselves before it counts. That set has a checked size; a benchmark with more distinct
windows than `most` is joined on the windows by a shuffle instead, with the same result.

Null and empty texts have no words and no hits. Items without words are never found. Repeated documents each
keep their row; repeated item ids count once, null ids not at all. Null document ids are kept. Texts of any length
are scanned whole; ties do not arise. An empty table of documents has an empty result, an empty benchmark no hits;
other columns of any name play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import written

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct benchmark windows that are shipped as a set.
MOST = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def gram(w: Column, at: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def starts(w: Column, n: int) -> Column:
    """1, 2, ... as far as a window of n words can begin."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(gram, n, item_id), distinct."""
    w = F.col("w")
    n = F.least(F.size(w), F.lit(WINDOW))
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = items.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size(w) - n + 1)).alias("at"))
    return each.select(gram(w, F.col("at"), F.col("n")).alias("gram"), "n", "item_id").distinct()


def hits_by_set(docs: DataFrame, grams: list[tuple[int, int]]) -> DataFrame:
    """doc_id, text_hash, n_words and the distinct windows found, by the set of (n, hash of a window of n words)."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    found = []
    for n in sorted({n for n, _ in grams}):
        hashes = ",".join(f"{h}L" if h > -(2**63) else "-9223372036854775807L - 1L" for k, h in grams if k == n)
        d = d.withColumn(f"h{n}", F.expr(f"if(size(w) >= {n}, filter(sequence(1, size(w) - {n - 1}), i -> xxhash64(slice(w, i, {n})) IN ({hashes})), cast(array() as array<int>))"))
        found.append(F.expr(f"transform(h{n}, i -> struct(i AS at, {n} AS n))"))
    spans = F.array_sort(F.concat(*found)) if found else F.array().cast("array<struct<at:int,n:int>>")
    return d.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "w", spans.alias("spans"))


def covered(spans: Column) -> Column:
    """The number of words inside spans (at, n), sorted by at."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(x["at"], s["to"]))).alias("n"), F.greatest(s["to"], x["at"] + x["n"]).alias("to")),
        lambda s: s["n"],
    )


def scan(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash."""
    windows = written(item_windows(benchmark), "benchmark")
    known = windows.select("n", F.xxhash64(F.split("gram", " ")).alias("h")).distinct().limit(most + 1).collect()
    if len(known) <= most:
        spans = hits_by_set(docs, [(r["n"], r["h"]) for r in known])
        some = F.size("spans") > 0
        # Verified on the words: a hash alone does not make a hit.
        grams = F.transform("spans", lambda s: gram(F.col("w"), s["at"], s["n"]))
        hits = spans.select("doc_id", "text_hash", "n_words", F.when(some, F.col("spans")).alias("spans"), F.when(some, grams).alias("grams"))
        hits = written(hits, "hits")
        one = hits.where(F.col("grams").isNotNull()).select("doc_id", "grams", F.explode(F.arrays_zip("spans", "grams")).alias("x"))
        one = one.select("doc_id", F.xxhash64("grams").alias("key"), F.col("x.spans").alias("span"), F.col("x.grams").alias("gram"))
        # An item may be repeated under any number of ids: Spark broadcasts the windows only if they are small.
        items = one.join(windows.select("gram", "item_id"), "gram")
        base = hits.select("doc_id", "text_hash", "n_words", F.xxhash64("grams").alias("key"))
    else:
        lengths = [r["n"] for r in windows.select("n").distinct().collect()]
        d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
        d = d.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "w", F.xxhash64("w").alias("key"))
        each = reduce(DataFrame.union, [d.select("doc_id", "key", "w", F.lit(n).alias("n"), F.explode(starts(F.col("w"), n)).alias("at")) for n in lengths])
        each = each.select("doc_id", "key", F.struct("at", "n").alias("span"), gram(F.col("w"), F.col("at"), F.col("n")).alias("gram"))
        items = each.join(windows.select("gram", "item_id"), "gram")
        base = d.select("doc_id", "text_hash", "n_words", "key")
    per_doc = items.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = per_doc.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )
