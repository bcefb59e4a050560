"""Batches that go to Python workers."""

import pyarrow as pa

from riskframe.llm import spans


def test_whole_texts_go_to_python_in_small_batches(spark):
    """Of 4,000 rows in one task a worker gets a bounded number at once; a smaller setting of the session stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(4_000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    try:
        for given, most in ((10_000, 1_000), (0, 1_000), (300, 300)):
            spark.conf.set(setting, given)
            assert spans.kept(docs, "text", lambda: lambda texts: [True] * len(texts)).count() == 4_000
            found = [r[0] for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(found) <= most and sum(found) == 4_000
    finally:
        spark.conf.set(setting, before)
