"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultgauge.plans import models  # noqa: E402
from faultgauge.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    # measuring and explaining files
    "file_metrics", "html_metrics", "operand_tokens", "cyclomatic_lexical", "scale_features",
    "score_files", "tree_shap", "shap_topk", "file_report", "flagship",
    # roll-ups
    "repo_risk", "repo_scorecard", "language_mix", "hot_dirs", "churn_counts", "analysis_with_files", "dashboard_totals",
    "recent_risky_files", "history", "rank_by_risk", "top_files_by_size", "report_summary",
    # evaluation
    "stratified_split", "threshold_sweep", "roc_auc", "cv_summary", "feature_stats",
    # writing and the grammar
    "persist_analysis", "analyze_and_store", "py_ast_facts", "ast_fallback",
    # comparisons of fits
    "oof_scores", "permutation_importance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    spark.range(1).count()  # the session is up
    if not sys.argv[1:]:
        began = time.time()
        models.model_path(spark, sf_dir)
        seconds["model_fit"] = round(time.time() - began, 3)
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
