"""Scores, decisions and reasons."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.boosting import Ensemble
from tallyguard.schemas import (
    BLOCK_THRESHOLD,
    FEATURES,
    MODEL_METADATA,
    REASON,
    REVIEW_THRESHOLD,
    SEVERITIES,
)

DEFAULT_SCORER = Path(__file__).resolve().parent.parent / "config" / "logistic_scorer.json"

# How rule severities and deltas weigh in the final score.
SEVERITY_WEIGHTS = {"low": 0.04, "medium": 0.08, "high": 0.14, "critical": 0.22}
DELTA_SHARE = 0.25
MODEL_SHARE = 0.78
RULE_WEIGHT_LIMIT = 0.35
REASON_LIMIT = 8

# Feature-based reasons (code, description, feature, lower limit).
FEATURE_REASONS = [
    ("velocity_spike", "Recent transaction velocity is elevated.", "tx_count_5m", 4.0),
    ("geo_jump", "Transaction location changed sharply.", "geo_distance_from_last_tx_km", 500.0),
    ("new_device", "Transaction originated from a new device.", "device_new_for_account", 1.0),
    ("amount_spike", "Amount is far above recent average.", "amount_vs_recent_avg_ratio", 3.0),
    ("high_risk_merchant", "Merchant is flagged as high risk.", "high_risk_merchant_flag", 1.0),
    ("auth_failures", "Recent authentication failures were observed.", "failed_auth_count_recent", 1.0),
]


@dataclass(frozen=True)
class Model:
    """What decisions need to know about the model in use."""

    model_name: str
    model_version: str
    model_alias: str = "champion"
    review_threshold: float = REVIEW_THRESHOLD
    block_threshold: float = BLOCK_THRESHOLD
    run_id: str | None = None

    def column(self) -> Column:
        return F.struct(
            F.lit(self.model_name),
            F.lit(self.model_version),
            F.lit(self.model_alias),
            F.lit(None),
            F.lit(self.review_threshold),
            F.lit(self.block_threshold),
            F.lit(self.run_id).cast("string"),
            F.create_map().cast("map<string,double>"),
        ).cast(MODEL_METADATA)


class LogisticScorer:
    """Probability as one column expression: intercept and weights of a JSON document."""

    def __init__(self, path: str | Path = DEFAULT_SCORER, **model: object) -> None:
        document = json.loads(Path(path).read_text(encoding="utf-8"))
        self.intercept = float(document["intercept"])
        self.weights = {name: float(w) for name, w in document["weights"].items()}
        self.model = Model(document["model_name"], document["model_version"], **model)

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(self.intercept)
        for name, weight in self.weights.items():
            total = total + F.coalesce(F.col("features")[name], F.lit(0.0)) * F.lit(weight)
        return df.withColumn("model_probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))


class FittedScorer:
    """Probability of class 1 from fitted trees. A feature that an event lacks counts as 0."""

    def __init__(self, ensemble: Ensemble, model: Model) -> None:
        self.ensemble = ensemble
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        values = [F.col("features")[name] if name in FEATURES else F.lit(0.0) for name in self.ensemble.features]
        return df.withColumn("model_probability", self.ensemble.column(*values))


def rule_weight(hits: Column) -> Column:
    weights = F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.lit(SEVERITY_WEIGHTS[s]))])

    def add(total: Column, hit: Column) -> Column:
        return total + (weights[hit["severity"]] + hit["score_delta"] * F.lit(DELTA_SHARE))

    return F.aggregate(hits, F.lit(0.0), add)


def final_score(probability: Column, hits: Column) -> Column:
    weight = F.least(rule_weight(hits), F.lit(RULE_WEIGHT_LIMIT))
    return F.least(F.lit(1.0), probability * F.lit(MODEL_SHARE) + weight)


def decision_label(score: Column, hits: Column, review: Column, block: Column) -> Column:
    """BLOCK on a critical hit or a high score, REVIEW on a high hit or a middling score."""

    def has(severity: str) -> Column:
        return F.exists(hits, lambda hit: hit["severity"] == severity)

    return (
        F.when(has("critical") | (score >= block), F.lit("BLOCK"))
        .when((score >= review) | has("high"), F.lit("REVIEW"))
        .otherwise(F.lit("APPROVE"))
    )


def reason_codes(features: Column, hits: Column) -> Column:
    """Rule reasons first, then feature reasons; the first eight."""
    from_rules = F.transform(
        hits,
        lambda hit: F.struct(
            F.concat(F.lit("rule:"), hit["rule_id"]), hit["explanation"], hit["score_delta"]
        ).cast(REASON),
    )
    from_features = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(features[name], F.lit(0.0)) >= limit,
                    F.struct(F.lit(code), F.lit(text), F.lit(None)).cast(REASON),
                )
                for code, text, name, limit in FEATURE_REASONS
            ]
        )
    )
    return F.slice(F.concat(from_rules, from_features), 1, REASON_LIMIT)


def score(df: DataFrame, scorer: LogisticScorer | FittedScorer) -> DataFrame:
    """Adds probability, final score, decision, reasons and model metadata.

    Needs ``features`` and ``rule_hits``.
    """
    hits = F.col("rule_hits")
    model = scorer.model
    scored = scorer.transform(df)
    scored = scored.withColumn("final_score", final_score(F.col("model_probability"), hits))
    return scored.withColumns(
        {
            "decision": decision_label(
                F.col("final_score"), hits, F.lit(model.review_threshold), F.lit(model.block_threshold)
            ),
            "reason_codes": reason_codes(F.col("features"), hits),
            "model_metadata": model.column(),
        }
    )
