"""Time the registered queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rarespark.catalog import inputs  # noqa: E402
from rarespark.catalog.queries import registered  # noqa: E402
from rarespark.operators.autoencoder import fit_autoencoder  # noqa: E402
from rarespark.operators.boosting import TreeParams, fit_trees  # noqa: E402
from rarespark.session import local_session  # noqa: E402

HEADLINE = [
    "left_join_side", "csv_source", "stratified_split", "split_disjoint", "dup_keys", "null_target", "freq_table",
    "num_stats", "encode_dense", "encode_mixed", "saved_preprocessor", "coerce_numeric", "finite_check",
    "class_weight_train", "synth_counts", "average_precision", "roc_auc", "metrics_at_threshold", "threshold_sweep",
    "best_threshold", "pr_curve", "roc_curve", "knn", "smote_vectors", "smote_features", "augmented_rate",
    "scores_wide", "scenario_metrics", "scenario_deltas", "sensitivity_pivot", "best_cell", "ae_oversample",
]


def gbt_20_trees(spark, root):
    """Growing 20 trees on the encoded train rows, without preparing them."""
    train = inputs.encoded(spark, root).where("split = 'train'").persist()
    train.count()
    start = time.perf_counter()
    fit_trees(train, TreeParams(n_estimators=20, learning_rate=0.1, num_leaves=16))
    return time.perf_counter() - start


def autoencoder_epoch(spark, root):
    """One training epoch over the encoded minority rows (and the two judging passes)."""
    rows = inputs.encoded(spark, root).where("split = 'train' AND y = 1").persist()
    rows.count()
    start = time.perf_counter()
    fit_autoencoder(rows.select("id", "features"), 8, epochs=1)
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    catalog = registered()
    # start the executor threads and Python workers outside the timings
    spark.range(1000).mapInPandas(lambda batches: batches, "id bigint").agg(F.sum("id")).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    for measure in (gbt_20_trees, autoencoder_epoch):
        seconds[measure.__name__] = round(measure(spark, root), 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(root.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
