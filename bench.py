"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of cores.
Each query runs once to warm the JVM and is then timed writing all of its rows
to Spark's no-op sink, so nothing is skipped and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from inkveil.checks import catalog  # noqa: E402
from inkveil.sources.tables import read_table  # noqa: E402

HEADLINE = [
    "flagship_document_types",
    "S1_document_paragraphs",
    "R4_detect_documents",
    "R4_detect_sentences",
    "R4_detect_pages",
    "G_TYPE_count_by_category",
    "G_DOC_run_summary",
    "M1_mapping",
    "A1_chained_replacement",
    "A2_exact_replacement",
    "A4_redact_pipeline",
    "K1_redacted_documents",
    "K1_reassembled_documents",
    "D18_dictionary_mentions",
    "D18_dictionary_join",
    "E5_span_metrics",
    "E7_evaluation_spans",
    "E8_threshold_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    documents = read_table(spark, sf_dir, "documents")
    n_documents, n_chars = documents.selectExpr("count(*)", "sum(length(text))").first()
    n_paragraphs = catalog.QUERIES["S1_document_paragraphs"](spark, sf_dir).count()
    detect_seconds = seconds["R4_detect_documents"]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "throughput": {
                    "documents_per_sec": round(n_documents / detect_seconds, 1),
                    "paragraphs_per_sec": round(n_paragraphs / detect_seconds, 1),
                    "chars_per_sec": round(n_chars / detect_seconds, 1),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
