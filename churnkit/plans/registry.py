"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the
whole test tables.  ``oracle_sql`` in ``churnkit.plans.oracle`` holds the DuckDB
equivalent for every query whose result does not depend on a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions import columns as _columns
from churnkit.operators import association, clean, cohorts, drivers, eda, kpi, metrics, recommend, tiers
from churnkit.sources.subscribers import raw_subscribers

Query = Callable[[SparkSession, str], DataFrame]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_subscribers(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_data(raw_subscribers(spark, sf_dir))


def _on_clean(fn) -> Query:
    return lambda spark, sf_dir: fn(cleaned(spark, sf_dir))


def _clean_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw subscribers as CSV, read back, cleaned and published; then what a reader of the cache sees."""
    import uuid

    from churnkit.session import work_dir
    from churnkit.sources.subscribers import load_clean, read_raw_csv

    folder = work_dir(spark, "csv", uuid.uuid4().hex)
    raw(spark, sf_dir).write.option("header", True).csv(f"{folder}/raw")
    return load_clean(spark, f"{folder}/clean", lambda: read_raw_csv(spark, f"{folder}/raw"))


def _base_queries() -> dict[str, Query]:
    return {
        "raw_subscribers": raw,
        "clean_subscribers": cleaned,
        "scoring_input": lambda s, d: clean.prepare_scoring_input(raw(s, d)),
        "missing_total_charges": lambda s, d: clean.missing_total_charges_rows(raw(s, d)),
        "null_audit": _on_clean(clean.null_audit),
        "frame_audit": _on_clean(clean.frame_audit),
        "describe_numeric": _on_clean(eda.describe_numeric),
        "customer_records": lambda s, d: clean.to_customer_record(raw(s, d)).select(K.ID_COLUMN, "TotalCharges"),
        "unassigned_cohorts": _on_clean(cohorts.unassigned_cohort_count),
        "clean_cache": _clean_cache,
        "new_customers": _on_clean(clean.new_customers),
        "derived_columns": _on_clean(cohorts.derived_columns),
        "churn_by_segment": _on_clean(eda.churn_rate_by_segment),
        "class_balance": _on_clean(eda.class_balance),
        "cohort_summary": _on_clean(cohorts.cohort_summary),
        "kpi_block": _on_clean(kpi.kpi_row),
        "kpi_summary": _on_clean(kpi.kpi_summary),
        "mrr_breakdown": _on_clean(kpi.mrr_breakdown),
        "service_attach_distribution": _on_clean(kpi.service_attach_distribution),
        "outlier_summary": _on_clean(eda.summarize_outliers),
        "distribution_stats": _on_clean(eda.distribution_stats),
        "numeric_correlation": _on_clean(eda.numeric_correlation_with_churn),
        "correlation_matrix": _on_clean(eda.correlation_matrix),
        "group_means": _on_clean(eda.group_means),
        "blank_charge_contract_mix": lambda s, d: eda.value_counts(
            clean.missing_total_charges_rows(raw(s, d)), "Contract"),
        "lifecycle_summary": _on_clean(cohorts.lifecycle_summary),
        "risk_signal_diagnostic": _on_clean(cohorts.risk_signal_diagnostic),
        "retention_curve": _on_clean(cohorts.empirical_retention_curve),
        "tenure_histogram": _on_clean(eda.tenure_histogram),
        "boxplot_stats": _on_clean(eda.boxplot_stats),
        "service_crosstab": _on_clean(association.service_crosstab),
        "chi_square_association": _on_clean(
            lambda df: association.chi_square_statistics(df).drop("_chi2_raw")),
        "chi_square_pvalues": _on_clean(association.chi_square_service_association),
        "class_density": _on_clean(eda.class_density),
        "implied_lifetime": _on_clean(lambda df: kpi.kpi_row(df).select(
            "churn_rate", _columns.implied_lifetime_months(F.col("churn_rate")).alias("implied_lifetime_months"))),
    }


def rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean subscribers + the model-free rule score ``p`` + tier."""
    df = tiers.rule_score(cleaned(spark, sf_dir))
    scored = df.select(K.ID_COLUMN, K.TARGET_COLUMN, F.col(K.TARGET_COLUMN).alias("y"), "p",
                       *[c for c in df.columns if c not in (K.ID_COLUMN, K.TARGET_COLUMN, "p")])
    scored = scored.withColumn("churn_probability", F.bround("p", K.PROBABILITY_DECIMALS)).withColumn(
        "churn_probability_pct", tiers.probability_pct(F.col("p")))
    return tiers.assign_risk_tiers(scored)


def rule_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rule_scored(spark, sf_dir)
    contrib = drivers.rule_contributions(s, keep=["risk_tier"])
    feats = list(drivers.RULE_CONTRIBUTIONS)
    d = contrib.select(K.ID_COLUMN, "risk_tier", drivers.top_drivers(contrib, feats).alias("shap_top_drivers"))
    return d.withColumn("actions", recommend.recommend_actions(F.col("risk_tier"), F.col("shap_top_drivers")))


def _rule_queries() -> dict[str, Query]:
    feats = list(drivers.RULE_CONTRIBUTIONS)
    return {
        "validated_subscribers": lambda s, d: clean.validate(raw(s, d).drop(K.TARGET_COLUMN)).select(
            K.ID_COLUMN, "is_valid", F.array_join("errors", ";").alias("errors")),
        "charge_outliers": lambda s, d: clean.iqr_outliers(cleaned(s, d), "TotalCharges").select(
            K.ID_COLUMN, "TotalCharges"),
        "head_customers": lambda s, d: cleaned(s, d).orderBy(K.ID_COLUMN).limit(10).select(
            K.ID_COLUMN, "tenure", "Contract", "MonthlyCharges", K.TARGET_COLUMN),
        "customer_sample": lambda s, d: clean.hash_sample(raw(s, d), 5).drop(K.TARGET_COLUMN),
        "rule_scored_tiers": lambda s, d: rule_scored(s, d).select(
            K.ID_COLUMN, "churn_probability", "churn_probability_pct", "risk_tier"),
        "rule_tier_summary": lambda s, d: tiers.risk_tier_summary(rule_scored(s, d)),
        "rule_observed_rate_by_tier": lambda s, d: tiers.observed_rate_by_tier(rule_scored(s, d), cleaned(s, d)),
        "rule_metrics": lambda s, d: metrics.classification_metrics(rule_scored(s, d)),
        "rule_ece": lambda s, d: metrics.expected_calibration_error(rule_scored(s, d)),
        "rule_threshold_curve": lambda s, d: metrics.threshold_curve(rule_scored(s, d)),
        "rule_tuned_threshold": lambda s, d: metrics.tune_decision_threshold(rule_scored(s, d)),
        "rule_reliability_curve": lambda s, d: metrics.reliability_curve(rule_scored(s, d)),
        "rule_drivers": lambda s, d: drivers.drivers_long(rule_recommendations(s, d)),
        "rule_actions": lambda s, d: recommend.actions_long(rule_recommendations(s, d)),
        "rule_tier_action_categories": lambda s, d: recommend.tier_action_categories(
            recommend.actions_long(rule_recommendations(s, d))),
        "rule_global_importance": lambda s, d: drivers.global_importance(
            drivers.rule_contributions(cleaned(s, d)), feats),
    }


def _test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.ml import workflow

    return workflow.split_table(spark, sf_dir).where(F.col("is_test"))


def _calibration_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15/M16 comparison: Brier, AUC and ECE on the test rows for the raw model and
    its isotonic and sigmoid 5-fold calibrations (one row per method)."""
    from churnkit.ml import workflow

    return metrics.method_metrics(workflow.method_scores(spark, sf_dir), {"raw": "p_raw", "isotonic": "p_cal", "sigmoid": "p_sig"})


def _diagnostic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC + PR-AUC of the diagnostic model on the test rows, leakage guard."""
    from churnkit.ml import workflow
    from churnkit.ml.score import ModelScorer

    model, w = workflow.diagnostic_model(spark, sf_dir)
    pred = ModelScorer(model).transform(_test_rows(spark, sf_dir).withColumn("y", F.col(K.TARGET_COLUMN)))
    m = metrics.classification_metrics(pred, digits=4)
    row = m.first()
    metrics.check_auc_leakage_guard(float(row["auc"]))
    return spark.createDataFrame([("Diagnostic", row["auc"], row["pr_auc"], w)], "model string, auc double, pr_auc double, positive_weight double")


def _global_shap(spark: SparkSession, sf_dir: str, model) -> DataFrame:
    """Mean |SHAP| per source column over the test rows, top 10."""
    from churnkit.ml.shap import shap_contributions, source_columns

    contrib = shap_contributions(spark, model, _test_rows(spark, sf_dir), keep=[K.ID_COLUMN])
    return drivers.global_importance(contrib, source_columns(model))


def _explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHAP and LIME top drivers side by side for every customer (one row-local
    pass each, no join), and the model they explain."""
    from churnkit.ml import actions, lime, workflow

    shap = actions.explain(spark, workflow.production_model(spark, sf_dir), cleaned(spark, sf_dir))
    both = lime.lime_top_drivers(shap, workflow.raw_scorer(spark, sf_dir), workflow.lime_pool(spark, sf_dir),
                                 keep=[K.ID_COLUMN, "shap_top_drivers"])
    return both.withColumn("explained_model", F.lit(workflow.best_name(spark, sf_dir)))


def _ml_queries() -> dict[str, Query]:
    from churnkit.ml import actions, lime, segment, workflow
    from churnkit.ml.score import classify_scored_customers, score_customers
    from churnkit.sources import artifacts

    def comparison(s, d):
        return workflow.comparison(s, d)

    def model_runs(s, d):
        """The latest event of each candidate's run."""
        comparison(s, d)
        runs = workflow.training(s, d).ledger.runs().where(F.col("event").isin("compared", "selected"))
        return runs.select("run_name", F.col("metrics")["cv_auc_mean"].alias("cv_auc_mean"), F.col("tags")["best_model"].alias("best_model"))

    def classified(s, d):
        return classify_scored_customers(raw(s, d), workflow.calibrated_scorer(s, d))

    def segmented(s, d):
        return segment.assign_value_segment(cleaned(s, d), workflow.segmentation_model(s, d))

    def reliability(s, d):
        long = metrics.long_scores(workflow.method_scores(s, d), {"raw": "p_raw", "calibrated": "p_cal"})
        return metrics.reliability_curve(long, by=["method"]).withColumnRenamed("method", "model")

    def global_shap(s, d):
        return _global_shap(s, d, workflow.production_model(s, d)).withColumn("explained_model", F.lit(workflow.best_name(s, d)))

    def lime_drivers(s, d):
        return lime.lime_long(lime.lime_top_drivers(cleaned(s, d), workflow.raw_scorer(s, d), workflow.lime_pool(s, d)))

    def ranking_comparison(s, d):
        return lime.ranking_comparison(global_shap(s, d), _global_shap(s, d, workflow.diagnostic_model(s, d)[0]),
                                       "production_model", "diagnostic_model")

    return {
        "split_assignment": lambda s, d: workflow.split_table(s, d).select(
            K.ID_COLUMN, K.TARGET_COLUMN, "is_test", "fold"),
        "model_comparison": comparison,
        "best_model": lambda s, d: comparison(s, d).orderBy(F.desc("cv_auc_mean"), "name").limit(1).select(
            "name", "cv_auc_mean", "test_auc", (F.col("test_auc") >= K.TARGET_AUC).alias("meets_target")),
        "leaderboard_display": lambda s, d: artifacts.format_leaderboard(comparison(s, d)),
        "leaderboard_chart": lambda s, d: artifacts.leaderboard_chart_data(comparison(s, d)),
        "model_runs": model_runs,
        "diagnostic_model": _diagnostic_model,
        "scored_customers": lambda s, d: score_customers(raw(s, d), workflow.raw_scorer(s, d)),
        "classified_customers": classified,
        "model_tier_summary": lambda s, d: tiers.risk_tier_summary(classified(s, d)),
        "model_observed_rate_by_tier": lambda s, d: tiers.observed_rate_by_tier(classified(s, d), cleaned(s, d)),
        "calibration_report": lambda s, d: metrics.calibration_report(workflow.method_scores(s, d)),
        "calibration_metrics_file": workflow.calibration_report,
        "calibration_methods": _calibration_methods,
        "sample_actions": lambda s, d: actions.recommend_for_customers(
            s, clean.prepare_scoring_input(clean.hash_sample(raw(s, d), 5)), workflow.calibrated_scorer(s, d),
            workflow.production_model(s, d)).select(K.ID_COLUMN, "risk_tier", "priority", "category", "action"),
        "model_reliability_curve": reliability,
        "value_segments": lambda s, d: segmented(s, d).select(K.ID_COLUMN, "ValueSegment"),
        "segment_summary": lambda s, d: segment.segment_summary(segmented(s, d)),
        "segment_profile": lambda s, d: segment.segment_profile(segment.segment_summary(segmented(s, d))),
        "silhouette": lambda s, d: segment.silhouette_diagnostic(cleaned(s, d)),
        "shap_global_importance": global_shap,
        "shap_top_drivers": lambda s, d: drivers.drivers_long(
            actions.explain(s, workflow.production_model(s, d), cleaned(s, d))),
        "lime_top_drivers": lime_drivers,
        "explanations": _explanations,
        "explanation_agreement": lambda s, d: lime.method_agreement(_explanations(s, d)),
        "global_ranking_comparison": ranking_comparison,
        "recommendations": lambda s, d: actions.recommend_for_customers(
            s, cleaned(s, d), workflow.calibrated_scorer(s, d), workflow.production_model(s, d)),
    }


def _stream_run(spark: SparkSession, sf_dir: str, recommend_mode: bool = False) -> tuple[str, str]:
    """K1/K2 over the subscriber rows landed as files: each run gets its own sink and
    checkpoint folders under the shared run folder; the trigger drains all files."""
    import uuid

    from churnkit.ml import workflow
    from churnkit.streaming import scoring_stream

    landing = workflow.landed(spark, sf_dir)
    scorer = workflow.calibrated_scorer(spark, sf_dir)
    scoring_stream.require_models(spark, workflow.run_dir(spark, sf_dir, "training", "calibrated-isotonic.json"))
    run = workflow.run_dir(spark, sf_dir, "stream", uuid.uuid4().hex)
    stream = scoring_stream.read_subscriber_stream(spark, landing, max_files_per_trigger=2)
    q = scoring_stream.start_scoring_stream(
        spark, stream, scorer, f"{run}/scored", f"{run}/quarantine", f"{run}/_checkpoint",
        recommend_with=workflow.production_model(spark, sf_dir) if recommend_mode else None)
    q.awaitTermination()
    return f"{run}/scored", f"{run}/quarantine"


def _stream_queries() -> dict[str, Query]:
    return {
        "stream_scored_customers": lambda s, d: s.read.parquet(_stream_run(s, d)[0]).drop("batch_id"),
        "stream_recommendations": lambda s, d: s.read.parquet(_stream_run(s, d, True)[0]).drop("batch_id"),
    }


def all_queries() -> dict[str, Query]:
    q = _base_queries()
    q.update(_rule_queries())
    from churnkit.plans.downstream import QUERIES

    q.update(QUERIES)
    q.update(_ml_queries())
    q.update(_stream_queries())
    return q


__all__ = ["all_queries", "cleaned", "raw", "F", "K"]
