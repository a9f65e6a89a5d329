"""Queries over the boosted classifier: its trees, its scores, its test metrics.

The SQL grows the same trees level by level, so it covers bins, gradients, sums, splits, leaves
and scores. It is written for few rounds; the registered model has all 220, and its metrics are
held against plain versions by the tests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyguard.operators.boosting import LEAST_GAIN, UNIT, BoostingSettings
from tallyguard.operators.labels import labelled
from tallyguard.operators.scoring import FittedScorer, Model
from tallyguard.plans.decisions import decide
from tallyguard.plans.oracle_parts import feature_column, features_cte
from tallyguard.plans.registry import WITH_TX, query
from tallyguard.plans.training import (
    bootstrap,
    fit_classifier,
    feature_frame,
    load_scorer,
    registry,
)
from tallyguard.operators.evaluation import chronological_split
from tallyguard.schemas import FEATURES
from tallyguard.session import work_dir, written
from tallyguard.sources.adapter import load_transactions
from tallyguard.sources.tables import current_model

STEPS = 16
SMALL = BoostingSettings(rounds=2, depth=3, learning_rate=0.3, least_hessian=2.0, l2=1.0)

_models: dict[tuple[str, str], str] = {}


def even_cuts(frame):
    """Cuts at even steps between the least and greatest value of every feature."""
    ends = frame.agg(*[f(n).alias(f"{f.__name__}_{i}") for i, n in enumerate(FEATURES) for f in (F.min, F.max)]).first()
    steps = np.arange(1, STEPS) / STEPS
    return [
        np.unique(low + (high - low) * steps)
        for low, high in ((ends[f"min_{i}"], ends[f"max_{i}"]) for i in range(len(FEATURES)))
    ]


def _small_ensemble(spark, sf_dir):
    frame = written(feature_frame(labelled(load_transactions(spark, sf_dir))), "frame")
    train_rows, _ = chronological_split(frame)
    return frame, fit_classifier(train_rows, SMALL, even_cuts(train_rows))


def trees_sql(settings: BoostingSettings = SMALL) -> str:
    """The CTEs of a chronological split and of trees over all labelled events: ``nodes_<tree>``
    holds the nodes of a tree, ``margin_<tree>`` the margins of all rows before it."""
    values = ", ".join(
        f"({i}, CAST({feature_column(name)} AS DOUBLE))" for i, name in enumerate(FEATURES)
    )
    parts = [
        "lab AS (SELECT * FROM tx WHERE label IS NOT NULL)",
        features_cte("lab", "fr"),
        """rows AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY t, event_seq) <= greatest(CAST(floor(count(*) OVER () * 0.8e0) AS BIGINT), 1) AS fits
  FROM fr)""",
        f"long AS MATERIALIZED (SELECT event_seq, fits, u.col, u.v FROM rows, LATERAL (VALUES {values}) u(col, v))",
        "ends AS (SELECT col, min(v) AS low, max(v) AS high FROM long WHERE fits GROUP BY col)",
        f"""bins AS MATERIALIZED (
  SELECT event_seq, col, low, high,
    len(list_filter(range(1, {STEPS}), lambda j: v >= low + (high - low) * (j / {STEPS}e0))) AS bin
  FROM long JOIN ends USING (col))""",
        """balance AS (
  SELECT greatest(count(*) - greatest(sum(label), 1), 1) / greatest(sum(label), 1)::DOUBLE AS weight FROM rows WHERE fits)""",
        "margin_0 AS (SELECT event_seq, fits, CAST(label AS DOUBLE) AS y, 0e0 AS m FROM rows)",
    ]
    for tree in range(settings.rounds):
        parts.append(
            f"""grad_{tree} AS MATERIALIZED (
  SELECT event_seq, fits, y, m, 1e0 / (1e0 + exp(-m)) AS p, CASE WHEN y = 1 THEN weight ELSE 1e0 END AS w
  FROM margin_{tree}, balance),
unit_{tree} AS MATERIALIZED (
  SELECT event_seq, fits, y, m, CAST(round_even(w * (p - y) * {UNIT}, 0) AS BIGINT) AS g,
    CAST(round_even(w * p * (1e0 - p) * {UNIT}, 0) AS BIGINT) AS h FROM grad_{tree}),
at_{tree}_0 AS (SELECT event_seq, 0 AS node FROM unit_{tree})"""
        )
        for level in range(settings.depth):
            first = (1 << level) - 1
            name = f"{tree}_{level}"
            parts.append(
                f"""sums_{name} AS (
  SELECT node, col, bin, low, high, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h
  FROM at_{name} JOIN unit_{tree} USING (event_seq) JOIN bins USING (event_seq)
  WHERE fits AND node >= {first} GROUP BY node, col, bin, low, high),
sides_{name} AS (
  SELECT node, col, bin + 1 AS cut, low + (high - low) * ((bin + 1) / {STEPS}e0) AS threshold,
    sum(g) OVER through / {UNIT}e0 AS lg, sum(h) OVER through / {UNIT}e0 AS lh,
    sum(g) OVER whole / {UNIT}e0 AS g, sum(h) OVER whole / {UNIT}e0 AS h
  FROM sums_{name}
  WINDOW through AS (PARTITION BY node, col ORDER BY bin), whole AS (PARTITION BY node, col)),
best_{name} AS MATERIALIZED (
  SELECT *, 0.5e0 * (lg * lg / (lh + {settings.l2}e0) + (g - lg) * (g - lg) / (h - lh + {settings.l2}e0)
    - g * g / (h + {settings.l2}e0)) AS gain
  FROM sides_{name} WHERE lh >= {settings.least_hessian}e0 AND h - lh >= {settings.least_hessian}e0 AND gain > {LEAST_GAIN}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, col, cut) = 1),
at_{tree}_{level + 1} AS MATERIALIZED (
  SELECT a.event_seq, CASE WHEN s.node IS NULL THEN a.node ELSE 2 * a.node + 1 + CAST(b.bin >= s.cut AS INTEGER) END AS node
  FROM at_{name} a LEFT JOIN best_{name} s USING (node) LEFT JOIN bins b ON b.event_seq = a.event_seq AND b.col = s.col)"""
            )
        inner = " UNION ALL ".join(f"SELECT * FROM best_{tree}_{level}" for level in range(settings.depth))
        last = f"at_{tree}_{settings.depth}"
        parts.append(
            f"""leaves_{tree} AS MATERIALIZED (
  SELECT node, sum(g) / {UNIT}e0 AS g, sum(h) / {UNIT}e0 AS h,
    -(sum(g) / {UNIT}e0) / (sum(h) / {UNIT}e0 + {settings.l2}e0) * {settings.learning_rate}e0 AS value
  FROM {last} JOIN unit_{tree} USING (event_seq) WHERE fits GROUP BY node),
nodes_{tree} AS (
  SELECT {tree} AS tree, node, col, threshold, gain, g, h, NULL AS value FROM ({inner})
  UNION ALL SELECT {tree}, node, NULL, NULL, NULL, g, h, value FROM leaves_{tree}),
margin_{tree + 1} AS MATERIALIZED (
  SELECT event_seq, fits, y, m + value AS m FROM unit_{tree} JOIN {last} USING (event_seq) JOIN leaves_{tree} USING (node))"""
        )
    return f"{WITH_TX}, " + ",\n".join(parts)


_NAMES = ", ".join(f"'{name}'" for name in FEATURES)


@query(
    "boosted_trees",
    f"""{trees_sql()}
    SELECT tree, node, [{_NAMES}][col + 1] AS feature, round(threshold, 6) AS threshold, round(gain, 5) AS gain,
      round(g, 5) AS gradient, round(h, 5) AS hessian, round(value, 8) AS value
    FROM ({" UNION ALL ".join(f"SELECT * FROM nodes_{i}" for i in range(SMALL.rounds))})""",
)
def _boosted_trees(spark, sf_dir):
    """Nodes of the first trees over the earlier events: split, gain and sums, or the leaf's value."""
    nodes = _small_ensemble(spark, sf_dir)[1].frame(spark)
    places = {"threshold": 6, "gain": 5, "gradient": 5, "hessian": 5, "value": 8}
    return nodes.select("tree", "node", "feature", *[F.round(c, n).alias(c) for c, n in places.items()])


@query(
    "boosted_scores",
    f"""{trees_sql()} SELECT event_seq, CAST(y AS BIGINT) AS label, NOT fits AS tested, round(1e0 / (1e0 + exp(-m)), 8) AS probability
    FROM margin_{SMALL.rounds}""",
)
def _boosted_scores(spark, sf_dir):
    """Probability of every labelled event by those trees, from the values of its features."""
    frame, ensemble = _small_ensemble(spark, sf_dir)
    scorer = FittedScorer(ensemble, Model("fraud_gbt", "small"))
    train_rows, test_rows = chronological_split(frame)
    rows = train_rows.withColumn("tested", F.lit(False)).unionByName(test_rows.withColumn("tested", F.lit(True)))
    scored = scorer.transform(rows.withColumn("features", F.struct(*FEATURES)))
    return scored.select(
        "event_seq",
        F.col("label").cast("bigint").alias("label"),
        "tested",
        F.round("model_probability", 8).alias("probability"),
    )


def _model_dir(spark, sf_dir) -> str:
    """The folder of a registry with one full model, trained once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        folder = work_dir(spark, "models")
        bootstrap(spark, feature_frame(labelled(load_transactions(spark, sf_dir))), folder)
        _models[key] = folder
    return _models[key]


@query("trained_classifier")
def _trained_classifier(spark, sf_dir):
    """Registry row of the classifier: thresholds and test metrics of all 220 rounds. The rounds are
    too many for SQL; tests hold trees, scores and metrics against plain versions."""
    row = current_model(registry(spark, _model_dir(spark, sf_dir)))
    meta = F.col("metadata")
    return row.select(
        "model_name",
        "model_version",
        "alias",
        meta["review_threshold"].alias("review_threshold"),
        meta["block_threshold"].alias("block_threshold"),
        F.explode(meta["metrics"]).alias("metric", "value"),
    )


@query("scored_by_classifier")
def _scored_by_classifier(spark, sf_dir):
    """Decisions of all events by the current model of the registry, trained if there is none."""
    scorer = load_scorer(spark, _model_dir(spark, sf_dir))
    return decide(load_transactions(spark, sf_dir), scorer=scorer).select(
        "event_seq", "model_probability", "final_score", "decision", F.col("model_metadata")["model_version"].alias("version")
    )
