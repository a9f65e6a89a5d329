"""Training, registration and drift jobs."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.operators.boosting import BoostingSettings, Ensemble, fit_ensemble
from tallyguard.operators.drift import dataset_drift, preset_drift
from tallyguard.operators.evaluation import (
    average_precision,
    choose_thresholds,
    chronological_split,
    class_balance,
    confusion_matrix,
    rates,
    roc_auc,
    tail_sample,
    threshold_sweep,
)
from tallyguard.operators.features import add_features
from tallyguard.operators.scoring import FittedScorer, Model
from tallyguard.schemas import FEATURES, MODEL_METADATA
from tallyguard.session import written
from tallyguard.sources.sinks import registry_rows, write_report, write_rows
from tallyguard.sources.tables import current_model

# Hyper-parameters of the classifier.
CLASSIFIER = BoostingSettings(
    rounds=220,
    depth=5,
    learning_rate=0.08,
    row_share=0.9,
    column_share=0.9,
    least_hessian=2.0,
    l2=1.0,
    seed=42,
)

DRIFT_SAMPLE = 500
DRIFT_MINIMUM = 50
MODEL_NAME = "fraud_gbt"


def feature_frame(events: DataFrame, labelled_only: bool = False, **options: object) -> DataFrame:
    """One flat row per event: 25 features, label (NULL counts as 0), time and scenario.

    ``labelled_only`` drops events without a label after their features, and those of later
    events, have been computed from the whole history.
    """
    rows = add_features(events, **options)
    if labelled_only:
        rows = rows.where(F.col("label").isNotNull())
    return rows.select(
        "event_id",
        "event_seq",
        F.unix_micros("event_time").alias("event_us"),
        *[F.col("features")[name].alias(name) for name in FEATURES],
        F.coalesce("label", F.lit(0)).alias("label"),
        "simulation_scenario",
    )


def fit_classifier(train_rows: DataFrame, settings: BoostingSettings = CLASSIFIER, cuts=None) -> Ensemble:
    """Boosted trees over the features of a frame; positives weigh as much as the negatives."""
    weight = class_balance(train_rows).first()["positive_weight"]
    return fit_ensemble(
        train_rows, FEATURES, keys=["event_id", "event_seq"], positive_weight=float(weight), settings=settings, cuts=cuts
    )


def evaluate(scores: DataFrame) -> dict[str, object]:
    """Thresholds, metrics and confusion matrix from (label, probability) rows."""
    sweep = threshold_sweep(scores)
    chosen = choose_thresholds(sweep).first()
    review = chosen["review_threshold"]
    cells = {(r["label"], r["prediction"]): r["rows"] for r in confusion_matrix(scores, review).collect()}
    tp, fp, fn = cells[(1, 1)], cells[(0, 1)], cells[(1, 0)]
    one = scores.sparkSession.range(1)
    at_review = one.select(
        *[e.alias(n) for n, e in rates(F.lit(tp), F.lit(fp), F.lit(fn)).items()]
    ).first()
    return {
        "review_threshold": review,
        "block_threshold": chosen["block_threshold"],
        "metrics": {
            **{name: float(at_review[name]) for name in ("precision", "recall", "f1")},
            "pr_auc": float(average_precision(scores).first()[0]),
            "roc_auc": float(roc_auc(scores).first()[0]),
        },
        "confusion_matrix": [[cells[(0, 0)], cells[(0, 1)]], [cells[(1, 0)], cells[(1, 1)]]],
        "threshold_sweep": [row.asDict() for row in sweep.orderBy("threshold").collect()],
    }


def train(
    spark: SparkSession,
    frame: DataFrame,
    model_dir: str,
    alias: str = "champion",
    settings: BoostingSettings = CLASSIFIER,
) -> dict[str, object]:
    """Fits, evaluates, saves and registers a classifier.

    ``frame`` comes from ``feature_frame``. It is written once to the work folder, because
    fitting and evaluation read it many times. The scores of the test rows stay beside the model.
    """
    path = f"{model_dir}/frames/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    train_rows, test_rows = chronological_split(spark.read.parquet(path))
    weight = class_balance(train_rows).first()["positive_weight"]
    ensemble = fit_classifier(train_rows, settings)
    scores_path = f"{path}_scores"
    probability = ensemble.column(*[F.col(name) for name in FEATURES]).alias("probability")
    test_rows.select("event_id", "event_seq", "label", probability).write.parquet(scores_path)
    result = evaluate(spark.read.parquet(scores_path))

    version = str(next_version(spark, model_dir))
    run_id = uuid.uuid4().hex
    ensemble.frame(spark).write.parquet(f"{model_dir}/models/{version}")
    register(spark, model_dir, version, alias, run_id, result)
    sweep = {k: result[k] for k in ("threshold_sweep", "confusion_matrix")}
    schema = T.StructType(
        [
            T.StructField(
                "threshold_sweep",
                T.ArrayType(
                    T.StructType(
                        [T.StructField(n, T.DoubleType()) for n in ("threshold", "precision", "recall", "f1")]
                    )
                ),
            ),
            T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    write_report(spark.createDataFrame([sweep], schema), f"{model_dir}/reports/evaluation-{version}")
    return {**result, "model_version": version, "run_id": run_id, "positive_weight": weight, "scores": scores_path}


def registry(spark: SparkSession, model_dir: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{model_dir}/registry")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def next_version(spark: SparkSession, model_dir: str) -> int:
    rows = registry(spark, model_dir)
    if rows is None:
        return 1
    return int(rows.agg(F.max(F.col("model_version").cast("int"))).first()[0]) + 1


def register(
    spark: SparkSession, model_dir: str, version: str, alias: str, run_id: str, result: dict[str, object]
) -> None:
    """Appends one registry row; the newest row of an alias is the current model."""
    metadata = {
        "model_name": MODEL_NAME,
        "model_version": version,
        "model_alias": alias,
        "registered_at": None,
        "review_threshold": float(result["review_threshold"]),
        "block_threshold": float(result["block_threshold"]),
        "run_id": run_id,
        "metrics": result["metrics"],
    }
    row = spark.createDataFrame([metadata], MODEL_METADATA).withColumns(
        {
            "registered_at": F.timestamp_micros(F.lit(time.time_ns() // 1000)),
            "feature_names": F.array(*[F.lit(name) for name in FEATURES]),
        }
    )
    write_rows(registry_rows(row.withColumn("created_at", F.col("registered_at"))), f"{model_dir}/registry")


def load_scorer(spark: SparkSession, model_dir: str, alias: str = "champion") -> FittedScorer | None:
    """The current model of an alias, or None."""
    rows = registry(spark, model_dir)
    current = None if rows is None else current_model(rows, alias).first()
    if current is None:
        return None
    meta = current["metadata"]
    model = Model(
        meta["model_name"],
        meta["model_version"],
        alias,
        meta["review_threshold"],
        meta["block_threshold"],
        meta["run_id"],
    )
    names = list(meta["feature_names"])
    return FittedScorer(Ensemble.load(spark.read.parquet(f"{model_dir}/models/{meta['model_version']}"), names), model)


def bootstrap(
    spark: SparkSession,
    frame: DataFrame,
    model_dir: str,
    alias: str = "champion",
    force: bool = False,
    settings: BoostingSettings = CLASSIFIER,
) -> dict[str, object]:
    """Trains only if the alias has no model yet, unless forced."""
    rows = registry(spark, model_dir)
    current = None if rows is None or force else current_model(rows, alias).first()
    if current is not None:
        meta = current["metadata"]
        return {
            "model_version": meta["model_version"],
            "review_threshold": meta["review_threshold"],
            "block_threshold": meta["block_threshold"],
            "metrics": dict(meta["metrics"]),
        }
    return train(spark, frame, model_dir, alias, settings)


def drift_samples(
    reference_events: DataFrame, current_events: DataFrame, sample: int = DRIFT_SAMPLE, cold_start: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the last ``sample`` events on each side.

    Features come from the whole history of each side, labelled events are chosen afterwards.
    ``cold_start`` rebuilds the current side from the labelled ones of its last ``sample`` events
    alone, which makes history features look new. With fewer than 50 labelled events among the
    last ``sample`` of the current side, the reference side stands in for it. The samples are
    written to the work folder, as the report reads them many times.
    """
    newest = [F.col("event_time").desc(), F.col("event_seq").desc()]
    reference = written(tail_sample(feature_frame(reference_events), sample), "sample")
    last = current_events.orderBy(*newest).limit(sample).where(F.col("label").isNotNull())
    enough = last.count() >= DRIFT_MINIMUM
    if not cold_start:
        if not enough:
            return reference, reference
        current = tail_sample(feature_frame(current_events, labelled_only=True), sample)
    else:
        current = feature_frame(last if enough else reference_events.orderBy(*newest).limit(sample))
    return reference, written(current, "sample")


def run_drift(reference: DataFrame, current: DataFrame, report_dir: str | None = None) -> DataFrame:
    """Drift per column, each by the test of its kind; the report and its score are also written if
    a folder is given."""
    report = preset_drift(reference, current)
    if report_dir:
        write_report(report, f"{report_dir}/latest_drift_columns")
        write_report(dataset_drift(report), f"{report_dir}/latest_drift_score")
    return report
