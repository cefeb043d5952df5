"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casebook.queries import QUERIES, load_all  # noqa: E402
from casebook.session import local_session  # noqa: E402

HEADLINE = (
    "load_matrix",
    "near_constant_features",
    "normalize_zscore",
    "stratified_folds",
    "first_order_statistics",
    "anova_top_features",
    "kruskal_wallis_top_features",
    "mann_whitney",
    "pearson_filter",
    "rater_agreement",
    "metric_rows",
    "delong_comparison",
    "discriminant_scores",
    "naive_bayes_scores",
    "one_standard_error",
    "kaplan_meier",
    "concordance_index",
    "integrated_brier_score",
    "cox_hazard_ratios",
    "relief_top_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    load_all()
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["matrix_summary"](spark, sf_dir).collect()  # start the executors before the clock runs
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
