"""Time the headline queries: prints one line of JSON.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from corpusfreq.session import drop_stored  # noqa: E402
from suite import QUERIES  # noqa: E402

HEADLINE = [
    "a7_freq_report",
    "b5_tokenizer",
    "c1_doc_types",
    "d2_inverse_index_corpus",
    "d4_build_vocab",
    "d7_encode_corpus",
    "e1_frequencies",
    "e10_conditional_freqs",
    "e15_cumulative_freqs",
    "f1_bigram_freqs",
    "f4_trigram_model",
    "f5_ngram_interpolation",
    "g1_collocates",
    "g4_get_collocates",
    "g6_collocate_stats_online",
    "h2_t_test_matrix",
    "h4_likelihood_matrix",
    "h5_pmi_matrix",
    "i2_measured_context",
    "i3_kwic",
    "j4_z_score",
    "j10_simple_good_turing",
    "k4_sgt_dist",
    "l4_classify_proba",
    "l9_evaluate",
    "m2_stream_frequencies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusfreq-bench")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='corpusfreq-bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads, the reader and the compiler before the clock runs.
    QUERIES["e1_frequencies"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_stored(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
