from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from conftest import SF_DIR

from tallyguard.operators.labels import labelled
from tallyguard.plans.decisions import decide
from tallyguard.plans.training import (
    CLASSIFIER,
    bootstrap,
    drift_samples,
    feature_frame,
    load_scorer,
    registry,
    run_drift,
    train,
)
from tallyguard.sources.adapter import load_transactions


def test_train_register_reload(spark, tmp_path):
    tx = load_transactions(spark, SF_DIR)
    frame = feature_frame(labelled(tx))
    assert load_scorer(spark, f"{tmp_path}/m") is None
    quick = replace(CLASSIFIER, rounds=3)
    first = train(spark, frame, f"{tmp_path}/m", settings=quick)
    assert first["model_version"] == "1"
    assert 0.1 <= first["review_threshold"] <= 0.95
    assert first["block_threshold"] >= first["review_threshold"]
    assert 0.5 < first["metrics"]["roc_auc"] <= 1.0
    assert len(first["threshold_sweep"]) == 18
    check_metrics(first, spark.read.parquet(first["scores"]).toPandas())
    kept = bootstrap(spark, frame, f"{tmp_path}/m", settings=quick)
    assert kept["model_version"] == "1" and kept["metrics"] == pytest.approx(first["metrics"])
    assert bootstrap(spark, frame, f"{tmp_path}/m", force=True, settings=quick)["model_version"] == "2"
    assert registry(spark, f"{tmp_path}/m").count() == 2
    scorer = load_scorer(spark, f"{tmp_path}/m")
    assert scorer.model.model_version == "2"
    events = decide(tx, scorer=scorer)
    bounds = events.selectExpr("min(model_probability)", "max(model_probability)", "count(*)").first()
    assert 0.0 <= bounds[0] <= bounds[1] <= 1.0 and bounds[2] == tx.count()


def check_metrics(result, scores):
    """Metrics from the written scores by their definitions, row by row."""
    label, p = scores["label"].to_numpy(), scores["probability"].to_numpy()
    guess = p >= result["review_threshold"]
    tp, fp, fn = (label[guess] == 1).sum(), (label[guess] == 0).sum(), (label[~guess] == 1).sum()
    assert result["confusion_matrix"] == [[(label[~guess] == 0).sum(), fp], [fn, tp]]
    wanted = {"precision": tp / max(tp + fp, 1), "recall": tp / max(tp + fn, 1)}
    wanted["f1"] = 2 * tp / max(2 * tp + fp + fn, 1)
    pos, neg = p[label == 1], p[label == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    wanted["roc_auc"] = wins / (len(pos) * len(neg))
    recall = 0.0
    wanted["pr_auc"] = 0.0
    for cut in np.unique(p)[::-1]:
        chosen = label[p >= cut]
        now = chosen.sum() / len(pos)
        wanted["pr_auc"] += (now - recall) * chosen.mean()
        recall = now
    assert result["metrics"] == pytest.approx(wanted, abs=1e-9)


def test_drift_uses_the_reference_when_little_is_labelled(spark, tmp_path):
    tx = load_transactions(spark, SF_DIR)
    reference, current = drift_samples(tx, tx.where("event_seq < 20"), sample=100)
    report = run_drift(reference, current, f"{tmp_path}/drift")
    assert report.where("drifted").count() == 0
    assert spark.read.json(f"{tmp_path}/drift/latest_drift_score").first()["dataset_drift_score"] == 0.0
