"""A training corpus from documents: toxic ones go, one of each near-duplicate group stays, benchmark leaks go,
personal data is masked, and what is left becomes tokens.

Null and empty texts are not toxic, similar or leaked: they stay, and have no tokens. Rows without an id stay too, as
far as their texts are clean. Rows are told apart by id and text; repeated ones become one in the second stage. An
empty table gives an empty corpus; texts are read whole, and further columns of any name pass through all stages but
the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, decontaminate, ngram_join, pii, toxicity
from riskframe.llm.queries import THRESHOLD, VOCABULARY, toxicity_model
from riskframe.llm.tables import read, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts score below the threshold. The model learns from the labelled rows of the raw table."""
    return toxicity.below(docs, toxicity_model(spark, sf_dir, read(spark, sf_dir, "documents")), THRESHOLD)


def rows_like(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs that agree with one of keys (doc_id, text_hash) in id and text (left_semi), or with none (left_anti).

    Rows are told by both, as an id may come with several texts, and may be null.
    """
    same = docs["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["text_hash"])
    return docs.join(keys, same, how)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id, and of its rows one.

    Documents without words and rows without an id are in no group and all stay.
    """
    rows = ngram_join.components(docs).where("component_key IS NOT NULL")
    each = written(rows.groupBy("component_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "grouped")
    first = each.groupBy("component_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    # Joined on rows, not on components, of which one may hold a third of all rows.
    first = first.select("first.doc_id", "first.text_hash")
    dropped = written(each.join(first, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash"), "dropped")
    again = written(each.where("n > 1").join(first, ["doc_id", "text_hash"], "left_semi").select("doc_id", "text_hash"), "again")
    once = rows_like(docs, dropped.union(again), "left_anti")
    if again.isEmpty():
        return once
    return once.union(rows_like(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule does not call contaminated, whole."""
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"))
    return rows_like(docs, written(found.where("contaminated").select("doc_id", "text_hash").distinct(), "leaks"), "left_anti")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by placeholders."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the tokens of each text and their hashes."""
    return bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_leaks),
    ("pii", masked),
    ("bpe", tokens),
]

#: Toxicity is a trained model and the tokens are not SQL either; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
