"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line.  Every query is executed to completion with the ``noop``
sink (full execution, no driver collection).  The model steps train a fresh model
inside the run (no cached artifacts), then time scoring, explaining and
recommending over the WHOLE subscriber base, reported as customers per second.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from churnkit import constants as K
    from churnkit.ml import actions, lime, workflow
    from churnkit.ml.blocks import WHOLE
    from churnkit.ml.score import ModelScorer, classify_scored_customers
    from churnkit.plans.registry import all_queries, cleaned, raw
    from churnkit.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="churnkit-bench")
    workflow.CACHE_VERSION = "bench-" + uuid.uuid4().hex[:8]  # fresh artifacts: training is timed too
    q = all_queries()
    times: dict[str, float] = {}

    def run(name: str, df_fn) -> None:
        t0 = time.time()
        df_fn().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    # warm-up: JVM, parquet footers, Python workers (not timed)
    cleaned(spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in ["kpi_summary", "lifecycle_summary", "churn_by_segment", "cohort_summary", "retention_curve",
                 "outlier_summary", "distribution_stats", "chi_square_association", "correlation_matrix",
                 "rule_metrics", "rule_tuned_threshold", "rule_actions"]:
        run(name, lambda n=name: q[n](spark, sf_dir))

    t0 = time.time()
    split = workflow.split_table(spark, sf_dir)
    times["split_write"] = round(time.time() - t0, 3)
    train = split.where(~F.col("is_test"))
    job = workflow.training(spark, sf_dir)
    t0 = time.time()
    job.blocks(oversampled=True)
    times["oversample"] = round(time.time() - t0, 3)
    t0 = time.time()
    job.ensure(["XGBoost"], [WHOLE])
    model = job.model("XGBoost")
    times["train_gbt"] = round(time.time() - t0, 3)

    base = cleaned(spark, sf_dir).cache()
    n = base.count()
    scorer = ModelScorer(model)
    run("score_tier", lambda: classify_scored_customers(raw(spark, sf_dir), scorer))
    run("explain_shap", lambda: actions.explain(spark, model, base))
    t0 = time.time()
    pool = lime.build_pool(spark, lime.training_marginals(train), scorer, train.schema)
    times["lime_pool"] = round(time.time() - t0, 3)
    run("explain_lime", lambda: lime.lime_top_drivers(base, scorer, pool))
    run("recommend", lambda: actions.recommend_for_customers(spark, base, scorer, model))
    base.unpersist()

    per_sec = {k: round(n / times[k], 1) for k in ("score_tier", "explain_shap", "explain_lime", "recommend") if times[k] > 0}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "customers": n, "customers_per_sec": per_sec,
                      "cpus": int(cpus), "subscribers_label": K.TARGET_COLUMN}))
    spark.stop()


if __name__ == "__main__":
    main()
