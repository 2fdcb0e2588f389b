"""Headline timings: one JSON line. Every query runs to the noop sink, so all rows and columns are computed."""

import json
import os
import time

from evirank.plans import load_all
from evirank.plans.registry import QUERIES
from evirank.session import local_session

HEADLINE = [
    "R2_bm25_rank", "R6_coverage_rescoring", "F3_tokenize", "F18_sentence_spans", "U1_sum_rrf", "M4_metric_slices", "K9_consensus_rerank",
    "K24_modes_side_by_side", "K25_evaluate_grid", "B17_paired_bootstrap", "B4_stratified_sample", "J10_recall_curve", "P8_verdict_parse",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(os.environ.get("BENCH_PARTITIONS", "16")))
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
