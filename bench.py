"""Times the headline queries: python bench.py, with BENCH_SF_DIR and BENCH_CPUS. One JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from riskframe.plans import registry

HEADLINE = (
    "w7_entity_aggregates",
    "w1_past_window_hot_keys",
    "j12_history_lookup",
    "a46_drift_summary",
    "a39_feature_auc",
    "a26_cost_curve",
    "a59_day_bootstrap",
    "c1_retrain_verdict",
    "j1_left_joins",
    "a12_correlation",
    "st2_stream_features",
    "w6_account_block",
    "a45_window_psi",
    "m20_tree_contributions",
    "m6_smote",
)
LLM = (
    "op1_toxicity",
    "op2_pii",
    "op3_decontamination",
    "op4_secrets",
    "op5_html_text",
    "op6_quality",
    "op7_licenses",
    "op8_ngram_join",
    "op9_bpe",
    "op10_topk",
    "op11_centroids",
    "op12_phrases",
    "op13_sentence_piece",
    "pipeline",
)
#: Queries that take long are run once, the others three times.
ONCE = {"op8_ngram_join", "pipeline", "op1_toxicity", "op12_phrases", "m20_tree_contributions", "m6_smote"}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = list(HEADLINE)
    try:
        from riskframe.llm import queries as llm

        import corpus_pipeline

        queries |= llm.queries() | {"pipeline": corpus_pipeline.run}
        names += LLM
    except ImportError as e:
        if e.name not in ("riskframe.llm", "corpus_pipeline"):
            raise
    took = {}
    for name in names:
        times = []
        for _ in range(1 if name in ONCE else 3):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "median seconds, all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
