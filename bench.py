"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from evalspark.plans.queries import queries
from evalspark.session import local_session

#: (A warm-up, then the median of three; results go to a noop sink.)
HEADLINE = ("cube_slices", "mesh_cube", "wer_corpus", "wer_whole", "bleu_corpus", "auc", "eer", "macro_f1", "runtime_percentiles", "ratio_of_sums", "interval_overlap", "dialogue_history", "resume_overlay_left", "token_f1", "repeat_rate")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "12g")
    found, took = queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
