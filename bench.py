"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

import lodeweave.plans.search  # noqa: F401  registers all queries
from lodeweave.plans.catalogue import QUERIES, Tables, documents
from lodeweave.session import local_session

HEADLINE = ["tokenize_counts", "vocab_df_idf", "bm25_batch", "rrf_weighted", "filtered_bm25", "pack_context", "eval_quality", "chunk_windows", "kg_match", "kg_contradictions", "kg_traverse", "link_popularity", "corpus_diff", "budget_status"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["corpus_stats"](spark, folder).collect()  # starts the JVM's threads
    began = time.time()
    documents(Tables(spark, folder))  # built once; the queries over documents read it
    took = {"index_build": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
