"""Queries over labels, evaluation, training and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.operators.drift import categorical_drift, dataset_drift, drift_report, numeric_drift, preset_drift
from tallyguard.operators.evaluation import (
    THRESHOLDS,
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
from tallyguard.operators.labels import feedback_labels, feedback_rollup, labelled, training_frame, training_source
from tallyguard.plans.oracle_parts import TX, feature_column, features_cte
from tallyguard.plans.registry import AS_OF, WITH_CASES, WITH_FEATURES, WITH_SCORES, WITH_TX, query
from tallyguard.plans.store import decision_store
from tallyguard.plans.training import drift_samples, feature_frame
from tallyguard.schemas import FEATURES
from tallyguard.session import work_dir, written
from tallyguard.sources.adapter import load_transactions
from tallyguard.sources.sinks import export_csv, registry_rows
from tallyguard.sources.tables import current_models, read_csv_events

LABELS_SQL = """
rolled AS (SELECT transaction_id, count(*) AS feedback_count, arg_max(feedback_label, created) AS latest FROM feedback GROUP BY 1),
labels_out AS (
  SELECT s.transaction_id, s.event_seq, s.t, s.simulation_scenario, s.final_score, r.latest AS latest_feedback_label,
    coalesce(r.feedback_count, 0) AS feedback_count,
    CAST(CASE WHEN r.latest = 'fraud' THEN 1 WHEN r.latest IN ('false_positive', 'legitimate') THEN 0 ELSE s.label END AS BIGINT) AS label,
    CASE WHEN r.latest IN ('fraud', 'false_positive', 'legitimate') THEN 'analyst_feedback'
         WHEN r.latest IS NOT NULL OR s.label IS NOT NULL THEN 'synthetic' ELSE 'unlabeled' END AS label_source
  FROM scored s LEFT JOIN rolled r USING (transaction_id))"""

OUT = "transaction_id, latest_feedback_label, feedback_count, label, label_source"


def dataset_labels(spark, path):
    """Labelled rows of a CSV data set, with the columns that training needs of table rows."""
    rows = labelled(read_csv_events(spark, path))
    return rows.withColumns({"label": F.col("label").cast("bigint"), "label_source": F.lit("dataset")})


def _labels(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return training_frame(s.raw, s.feedback).withColumn("label", F.col("label").cast("bigint"))


@query("training_labels", f"{WITH_CASES}, {LABELS_SQL} SELECT {OUT} FROM labels_out")
def _training_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select(*OUT.split(", "))


@query("labelled_rows", f"{WITH_CASES}, {LABELS_SQL} SELECT {OUT} FROM labels_out WHERE label IS NOT NULL")
def _labelled_rows(spark, sf_dir):
    return labelled(_labels(spark, sf_dir)).select(*OUT.split(", "))


@query(
    "training_source",
    f"{WITH_CASES}, {LABELS_SQL} SELECT label_source, label, count(*) AS events FROM labels_out WHERE label IS NOT NULL GROUP BY ALL",
)
def _training_source(spark, sf_dir):
    frame = _labels(spark, sf_dir)
    rows = training_source(frame, lambda: dataset_labels(spark, _dataset(spark, sf_dir)))
    return rows.groupBy("label_source", "label").agg(F.count(F.lit(1)).alias("events"))


def _dataset(spark, sf_dir):
    """The events as a CSV data set."""
    path = work_dir(spark, "dataset")
    export_csv(load_transactions(spark, sf_dir), path)
    return path


@query(
    "training_source_from_dataset",
    f"{WITH_TX} SELECT 'dataset' AS label_source, CAST(label AS BIGINT) AS label, count(*) AS events FROM tx WHERE label IS NOT NULL GROUP BY ALL",
)
def _training_source_from_dataset(spark, sf_dir):
    """With too few labelled rows in the table, the labelled rows of the CSV data set."""
    frame = _labels(spark, sf_dir).where("event_seq < 0")
    rows = training_source(frame, lambda: dataset_labels(spark, _dataset(spark, sf_dir)))
    return rows.groupBy("label_source", "label").agg(F.count(F.lit(1)).alias("events"))


@query(
    "feedback_rollup",
    f"{WITH_CASES}, {LABELS_SQL} SELECT transaction_id, feedback_count, latest AS latest_feedback_label FROM rolled",
)
def _feedback_rollup(spark, sf_dir):
    return feedback_rollup(decision_store(spark, sf_dir).feedback)


@query(
    "feedback_label_rows",
    f"""{WITH_CASES} SELECT transaction_id, feedback_label,
    row_number() OVER (PARTITION BY transaction_id ORDER BY created DESC, feedback_id) AS position FROM feedback""",
)
def _feedback_label_rows(spark, sf_dir):
    return feedback_labels(decision_store(spark, sf_dir).feedback)


# Labelled scores, the input of all evaluation queries.
SCORES = "probs AS (SELECT label, model_probability AS p, event_seq, t FROM scored WHERE label IS NOT NULL)"


def eval_scores(spark, sf_dir):
    events = decision_store(spark, sf_dir).events.where(F.col("label").isNotNull())
    return events.select(
        "label", F.col("model_probability").alias("probability"), "event_seq", F.unix_micros("event_time").alias("event_us")
    )


@query(
    "class_balance",
    f"""{WITH_TX}, b AS (SELECT greatest(CAST(sum(label) AS BIGINT), 1) AS positives, count(*) AS n FROM tx WHERE label IS NOT NULL)
    SELECT positives, greatest(n - positives, 1) AS negatives, round(greatest(n - positives, 1) / CAST(positives AS DOUBLE), 6) AS positive_weight FROM b""",
)
def _class_balance(spark, sf_dir):
    balance = class_balance(labelled(load_transactions(spark, sf_dir)))
    return balance.withColumn("positive_weight", F.round("positive_weight", 6))


CELLS = """SELECT CAST(a.v AS BIGINT) AS label, CAST(b.v AS BIGINT) AS prediction,
    (SELECT count(*) FROM probs WHERE label = a.v AND (p >= 0.55e0) = (b.v = 1)) AS "rows"
    FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v)"""


@query("confusion_matrix", f"{WITH_SCORES}, {SCORES} {CELLS}")
def _confusion_matrix(spark, sf_dir):
    cells = confusion_matrix(eval_scores(spark, sf_dir), 0.55)
    return cells.select(F.col("label").cast("bigint"), F.col("prediction").cast("bigint"), "rows")


@query(
    "classification_rates",
    f"""{WITH_SCORES}, {SCORES}, c AS (SELECT count(*) FILTER (label = 1 AND p >= 0.55e0) AS tp, count(*) FILTER (label = 0 AND p >= 0.55e0) AS fp,
      count(*) FILTER (label = 1 AND p < 0.55e0) AS fn FROM probs)
    SELECT round(CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS "precision",
      round(CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""",
)
def _classification_rates(spark, sf_dir):
    hit, actual = F.col("probability") >= 0.55, F.col("label") == 1
    counts = eval_scores(spark, sf_dir).agg(
        F.count_if(actual & hit).alias("tp"), F.count_if(~actual & hit).alias("fp"), F.count_if(actual & ~hit).alias("fn")
    )
    return counts.select(*[F.round(e, 6).alias(n) for n, e in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query(
    "average_precision",
    f"""{WITH_SCORES}, {SCORES}, g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM probs GROUP BY p),
    c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS all_pos FROM g)
    SELECT round(sum(CAST(pos AS DOUBLE) / all_pos * (CAST(tp AS DOUBLE) / seen)), 6) AS pr_auc FROM c""",
)
def _average_precision(spark, sf_dir):
    return average_precision(eval_scores(spark, sf_dir)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query(
    "roc_auc",
    f"""{WITH_SCORES}, {SCORES}, g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM probs GROUP BY p),
    c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY p) - neg AS below FROM g)
    SELECT round(sum(CAST(pos AS DOUBLE) * (below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc FROM c""",
)
def _roc_auc(spark, sf_dir):
    return roc_auc(eval_scores(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


SWEEP = f"""grid AS (SELECT * FROM (VALUES {", ".join(f"({t!r}e0)" for t in THRESHOLDS)}) g(threshold)),
    hits AS (SELECT threshold, count(*) FILTER (label = 1 AND p >= threshold) AS tp, count(*) FILTER (label = 0 AND p >= threshold) AS fp,
      count(*) FILTER (label = 1 AND p < threshold) AS fn FROM grid, probs GROUP BY threshold),
    sweep AS (SELECT threshold, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS prec,
      CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS rec,
      CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1 FROM hits)"""


@query(
    "threshold_sweep",
    f"""{WITH_SCORES}, {SCORES}, {SWEEP} SELECT round(threshold, 6) AS threshold, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1 FROM sweep""",
)
def _threshold_sweep(spark, sf_dir):
    sweep = threshold_sweep(eval_scores(spark, sf_dir))
    return sweep.select(*[F.round(c, 6).alias(c) for c in sweep.columns])


@query(
    "threshold_choice",
    f"""{WITH_SCORES}, {SCORES}, {SWEEP}, pick AS (SELECT
      (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1) AS review,
      coalesce((SELECT max(threshold) FROM sweep WHERE prec >= 0.85e0), (SELECT threshold FROM sweep ORDER BY prec DESC, threshold LIMIT 1)) AS precise)
    SELECT round(review, 6) AS review_threshold, round(least(0.99e0, greatest(review + 0.1e0, precise)), 6) AS block_threshold FROM pick""",
)
def _threshold_choice(spark, sf_dir):
    chosen = choose_thresholds(threshold_sweep(eval_scores(spark, sf_dir)))
    return chosen.select(*[F.round(c, 6).alias(c) for c in chosen.columns])


@query(
    "chronological_split",
    f"""{WITH_TX}, r AS (SELECT event_seq, row_number() OVER (ORDER BY t, event_seq) - 1 AS i, count(*) OVER () AS n FROM tx)
    SELECT event_seq, CASE WHEN i < greatest(CAST(floor(n * 0.8e0) AS BIGINT), 1) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def _chronological_split(spark, sf_dir):
    tx = load_transactions(spark, sf_dir).select("event_seq", F.unix_micros("event_time").alias("event_us"))
    train_rows, test_rows = chronological_split(tx)
    return train_rows.select("event_seq", F.lit("train").alias("part")).unionByName(
        test_rows.select("event_seq", F.lit("test").alias("part"))
    )


@query("tail_sample", f"{WITH_TX} SELECT event_seq, t FROM tx ORDER BY t DESC, event_seq DESC LIMIT 500")
def _tail_sample(spark, sf_dir):
    tx = load_transactions(spark, sf_dir).select("event_seq", F.unix_micros("event_time").alias("event_us"))
    return tail_sample(tx, 500).select("event_seq", F.floor(F.col("event_us") / 1_000_000).cast("bigint").alias("t"))


HALF = AS_OF - 21_600


def ks_sql(columns: list[str], reference: str, current: str) -> str:
    def side(source: str, ref: int, cur: int) -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {feature_column(c)} AS v, {ref} AS r, {cur} AS c FROM {source}" for c in columns
        )

    return f"""vals AS ({side(reference, 1, 0)} UNION ALL {side(current, 0, 1)}),
    g AS (SELECT "column", v, sum(r) AS r, sum(c) AS c FROM vals GROUP BY ALL),
    cdf AS (SELECT "column", sum(r) OVER (PARTITION BY "column" ORDER BY v) / CAST(sum(r) OVER (PARTITION BY "column") AS DOUBLE) AS f1,
      sum(c) OVER (PARTITION BY "column" ORDER BY v) / CAST(sum(c) OVER (PARTITION BY "column") AS DOUBLE) AS f2,
      sum(r) OVER (PARTITION BY "column") AS n1, sum(c) OVER (PARTITION BY "column") AS n2 FROM g),
    ks AS (SELECT "column", max(abs(f1 - f2)) AS statistic, CAST(max(n1) AS DOUBLE) AS n1, CAST(max(n2) AS DOUBLE) AS n2 FROM cdf GROUP BY 1),
    ksx AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12e0 + 0.11e0 / sqrt(n1 * n2 / (n1 + n2))) * statistic AS x FROM ks),
    ksp AS (SELECT "column", statistic, CASE WHEN x < 0.2e0 THEN 1e0 ELSE greatest(0e0, least(1e0,
      (SELECT sum(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * x * x)) FROM range(1, 101) series(k)))) END AS p_value FROM ksx)"""


def halves_sql() -> str:
    return f"ref AS (SELECT * FROM feats WHERE t < {HALF}), cur AS (SELECT * FROM feats WHERE t >= {HALF})"


def _halves(spark, sf_dir):
    frame = written(feature_frame(load_transactions(spark, sf_dir)), "frame")
    early = F.col("event_us") < HALF * 1_000_000
    return frame.where(early), frame.where(~early)


@query(
    "feature_drift_between_halves",
    f"""{WITH_FEATURES}, {halves_sql()}, {ks_sql(FEATURES, "ref", "cur")}
    SELECT "column", 'ks' AS test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05e0 AS drifted FROM ksp""",
)
def _feature_drift_between_halves(spark, sf_dir):
    report = numeric_drift(*_halves(spark, sf_dir))
    return report.select(
        "column", "test", F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"), "drifted"
    )


def chi_sql(column: str, alias: str) -> str:
    return f"""{alias}c AS (SELECT CAST({column} AS VARCHAR) AS k, count(*) FILTER (w = 0) AS r, count(*) FILTER (w = 1) AS c
      FROM (SELECT {column}, 0 AS w FROM ref UNION ALL SELECT {column}, 1 FROM cur) GROUP BY 1),
    {alias}e AS (SELECT r, c, (r + c) * sum(r) OVER () / CAST(sum(r + c) OVER () AS DOUBLE) AS er,
      (r + c) * sum(c) OVER () / CAST(sum(r + c) OVER () AS DOUBLE) AS ec FROM {alias}c),
    {alias} AS (SELECT '{column}' AS "column", sum((r - er) * (r - er) / er + (c - ec) * (c - ec) / ec) AS statistic, count(*) - 1 AS df FROM {alias}e)"""


# The tail of the chi-square distribution by the logarithm of the gamma function: a finite sum for
# an even number of degrees, for an odd one the tail of one degree and a finite sum.
CHI_TAIL = """CASE WHEN df < 1 THEN 1e0 WHEN df % 2 = 0 THEN
      coalesce(list_sum(list_transform(range(0, df // 2), lambda i: exp(i * ln(h) - h - lgamma(i + 1e0)))), 0e0)
    ELSE CASE WHEN h > 25e0 THEN exp(-h) / sqrt(pi() * h) * (1 - 0.5e0 / h + 0.75e0 / (h * h))
      ELSE 1e0 - list_sum(list_transform(range(0, 200), lambda i: exp((i + 0.5e0) * ln(h) - h - lgamma(i + 1.5e0)))) END
      + coalesce(list_sum(list_transform(range(1, df // 2 + 1), lambda i: exp((i - 0.5e0) * ln(h) - h - lgamma(i + 0.5e0)))), 0e0) END"""


def report_sql(*categories: str) -> str:
    """The report over ``ref`` and ``cur`` as further table expressions."""
    chi = ", ".join(chi_sql(c, f"chi_{i}") for i, c in enumerate(categories))
    union = " UNION ALL ".join(f"SELECT * FROM chi_{i}" for i in range(len(categories)))
    return f"""{ks_sql(FEATURES, "ref", "cur")}, {chi},
    chis AS (SELECT *, greatest(statistic / 2, 1e-300) AS h FROM ({union})),
    report AS (SELECT "column", 'ks' AS test, statistic, p_value FROM ksp
      UNION ALL SELECT "column", 'chi_square', statistic, greatest(0e0, least(1e0, {CHI_TAIL})) FROM chis)"""


DRIFT_SQL = f"""{WITH_FEATURES}, halves AS (SELECT * REPLACE (coalesce(label, 0) AS label), t < {HALF} AS early FROM feats),
    ref AS (SELECT * FROM halves WHERE early ORDER BY t DESC, event_seq DESC LIMIT 500),
    cur AS (SELECT * FROM halves WHERE NOT early ORDER BY t DESC, event_seq DESC LIMIT 500),
    {report_sql("label", "simulation_scenario")}"""
REPORT_OUT = """SELECT "column", test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05e0 AS drifted FROM report"""


def _report_out(report):
    return report.select(
        "column", "test", F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"), "drifted"
    )


def _tails(spark, sf_dir):
    return [written(tail_sample(half, 500), "sample") for half in _halves(spark, sf_dir)]


@query("drift_report", f"{DRIFT_SQL} {REPORT_OUT}")
def _drift_report(spark, sf_dir):
    return _report_out(drift_report(*_tails(spark, sf_dir)))


@query(
    "dataset_drift",
    f"""{DRIFT_SQL} SELECT count(*) AS columns, count(*) FILTER (p_value < 0.05e0) AS drifted_columns,
    round(count(*) FILTER (p_value < 0.05e0) / CAST(count(*) AS DOUBLE), 6) AS dataset_drift_score FROM report""",
)
def _dataset_drift(spark, sf_dir):
    score = dataset_drift(drift_report(*_tails(spark, sf_dir)))
    return score.withColumn("dataset_drift_score", F.round("dataset_drift_score", 6))


WIDE_COLUMNS = ["merchant_id", "channel", "country", "device_id"]


@query(
    "category_drift",
    f"""{WITH_TX}, ref AS (SELECT * FROM tx WHERE t < {HALF}), cur AS (SELECT * FROM tx WHERE t >= {HALF}),
    {", ".join(chi_sql(c, f"chi_{i}") for i, c in enumerate(WIDE_COLUMNS))},
    chis AS (SELECT *, greatest(statistic / 2, 1e-300) AS h FROM ({" UNION ALL ".join(f"SELECT * FROM chi_{i}" for i in range(len(WIDE_COLUMNS)))})),
    report AS (SELECT "column", 'chi_square' AS test, statistic, greatest(0e0, least(1e0, {CHI_TAIL})) AS p_value FROM chis)
    {REPORT_OUT}""",
)
def _category_drift(spark, sf_dir):
    """Columns with few and with very many categories, the halves of the events compared."""
    tx = load_transactions(spark, sf_dir)
    early = F.col("event_time") < F.timestamp_seconds(F.lit(HALF))
    parts = [categorical_drift(tx.where(early), tx.where(~early), c) for c in WIDE_COLUMNS]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return _report_out(report)


CATEGORIES = ["label", "simulation_scenario"]


def preset_sql(large_rows: int = 1_000) -> str:
    """Drift by kind over ``ref`` and ``cur``, column by column from counts per distinct value."""

    def side(source: str, r: int, c: int) -> str:
        numbers = [f"SELECT '{n}' AS \"column\", true AS num, CAST({feature_column(n)} AS DOUBLE) AS v, NULL AS k, {r} AS r, {c} AS c FROM {source}" for n in FEATURES]
        names = [f"SELECT '{n}', false, NULL, CAST({n} AS VARCHAR), {r}, {c} FROM {source}" for n in CATEGORIES]
        return " UNION ALL ".join(numbers + names)

    return f"""cells AS MATERIALIZED (SELECT "column", num, v, k, CAST(sum(r) AS DOUBLE) AS a, CAST(sum(c) AS DOUBLE) AS b
      FROM ({side("ref", 1, 0)} UNION ALL {side("cur", 0, 1)}) GROUP BY ALL),
    sized AS (SELECT *, sum(a) OVER w AS n1, sum(b) OVER w AS n2, count(*) OVER w AS u, sum(a * v) OVER w / sum(a) OVER w AS mean,
        sum(a) OVER o / sum(a) OVER w AS f, sum(b) OVER o / sum(b) OVER w AS g, lead(v) OVER (PARTITION BY "column" ORDER BY v) AS next_v,
        row_number() OVER (PARTITION BY "column" ORDER BY v DESC, k DESC) AS place
      FROM cells WINDOW w AS (PARTITION BY "column"), o AS (PARTITION BY "column" ORDER BY v, k)),
    kinds AS (SELECT *, CASE WHEN n1 > {large_rows} AND num AND u > 5 THEN 'wasserstein' WHEN n1 > {large_rows} THEN 'jensen_shannon'
        WHEN num AND u > 5 THEN 'ks' WHEN u > 2 THEN 'chi_square' ELSE 'z' END AS test, (a + b) / (n1 + n2) AS s FROM sized),
    stats AS (SELECT "column", test, n1, n2, u - 1 AS df,
        sqrt(n1 * n2 / (n1 + n2)) AS size, max(abs(f - g)) AS gap,
        coalesce(sum(abs(f - g) * (next_v - v)), 0e0) / greatest(sqrt(sum(a * (v - mean) * (v - mean)) / n1), 0.001e0) AS w1,
        sum((a - s * n1) * (a - s * n1) / (s * n1) + (b - s * n2) * (b - s * n2) / (s * n2)) AS chi,
        sqrt(greatest(0e0, sum(CASE WHEN a > 0 THEN a / n1 * ln(a / n1 / ((a / n1 + b / n2) / 2)) ELSE 0e0 END
          + CASE WHEN b > 0 THEN b / n2 * ln(b / n2 / ((a / n1 + b / n2) / 2)) ELSE 0e0 END) / 2)) AS js,
        max(CASE WHEN place = 1 THEN a / n1 END) AS p1, max(CASE WHEN place = 1 THEN b / n2 END) AS p2
      FROM kinds GROUP BY "column", test, n1, n2, u),
    zs AS (SELECT *, (p1 * n1 + p2 * n2) / (n1 + n2) AS pool FROM stats),
    judged AS (SELECT "column", test, size, gap, df,
        CASE test WHEN 'ks' THEN gap WHEN 'wasserstein' THEN w1 WHEN 'jensen_shannon' THEN js WHEN 'chi_square' THEN chi
          ELSE CASE WHEN pool * (1 - pool) > 0 THEN (p1 - p2) / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)) ELSE 0e0 END END AS statistic
      FROM zs),
    tails AS (SELECT "column", test, statistic, (size + 0.12e0 + 0.11e0 / size) * gap AS x, CASE WHEN test = 'z' THEN 1 ELSE df END AS df,
        greatest(CASE WHEN test = 'z' THEN statistic * statistic ELSE statistic END / 2, 1e-300) AS h FROM judged),
    report AS (SELECT "column", test, statistic, CASE WHEN test = 'ks' THEN CASE WHEN x < 0.2e0 THEN 1e0 ELSE greatest(0e0, least(1e0,
          (SELECT sum(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * x * x)) FROM range(1, 101) series(k)))) END
        WHEN test IN ('z', 'chi_square') THEN greatest(0e0, least(1e0, {CHI_TAIL})) END AS p_value FROM tails)"""


PRESET_OUT = """SELECT "column", test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value,
    CASE WHEN p_value IS NULL THEN statistic >= 0.1e0 ELSE p_value < 0.05e0 END AS drifted FROM report"""
SMALL_SIDES = f"""{WITH_FEATURES}, halves AS (SELECT * REPLACE (coalesce(label, 0) AS label), t < {HALF} AS early FROM feats),
    ref AS (SELECT * FROM halves WHERE early ORDER BY t DESC, event_seq DESC LIMIT 500),
    cur AS (SELECT * FROM halves WHERE NOT early ORDER BY t DESC, event_seq DESC LIMIT 500)"""


@query("drift_by_kind", f"{SMALL_SIDES}, {preset_sql()} {PRESET_OUT}")
def _drift_by_kind(spark, sf_dir):
    """The last 500 events of each half: a test of significance for each kind of column."""
    return _report_out(preset_drift(*_tails(spark, sf_dir)))


@query(
    "drift_by_kind_large",
    f"""{WITH_FEATURES}, halves AS (SELECT * REPLACE (coalesce(label, 0) AS label) FROM feats),
    ref AS (SELECT * FROM halves WHERE t < {HALF}), cur AS (SELECT * FROM halves WHERE t >= {HALF}), {preset_sql(100)} {PRESET_OUT}""",
)
def _drift_by_kind_large(spark, sf_dir):
    """Both halves in full, as large samples: distances between the distributions."""
    return _report_out(preset_drift(*_halves(spark, sf_dir), large_rows=100))


@query(
    "dataset_drift_by_kind",
    f"""{SMALL_SIDES}, {preset_sql()}, out AS ({PRESET_OUT}) SELECT count(*) AS columns, count(*) FILTER (drifted) AS drifted_columns,
    round(count(*) FILTER (drifted) / CAST(count(*) AS DOUBLE), 6) AS dataset_drift_score FROM out""",
)
def _dataset_drift_by_kind(spark, sf_dir):
    score = dataset_drift(preset_drift(*_tails(spark, sf_dir)))
    return score.withColumn("dataset_drift_score", F.round("dataset_drift_score", 6))


COLD_SQL = f"""WITH {TX}, last500 AS (SELECT * FROM (SELECT * FROM tx WHERE t >= {HALF} ORDER BY t DESC, event_seq DESC LIMIT 500) WHERE label IS NOT NULL),
    {features_cte("last500", "cold")}, early_tx AS (SELECT * FROM tx WHERE t < {HALF}), {features_cte("early_tx", "early")},
    ref AS (SELECT * REPLACE (coalesce(label, 0) AS label) FROM early ORDER BY t DESC, event_seq DESC LIMIT 500),
    cur AS (SELECT * REPLACE (coalesce(label, 0) AS label) FROM cold),
    {report_sql("label", "simulation_scenario")}"""


@query("drift_with_cold_start", f"{COLD_SQL} {REPORT_OUT}")
def _drift_with_cold_start(spark, sf_dir):
    """The current side rebuilt from its last 500 events alone: history features look drifted."""
    tx = load_transactions(spark, sf_dir)
    early = F.col("event_time") < F.timestamp_seconds(F.lit(HALF))
    return _report_out(drift_report(*drift_samples(tx.where(early), tx.where(~early), cold_start=True)))


@query(
    "current_models",
    f"""{WITH_TX} SELECT channel AS alias, max(t) AS created, CAST(arg_max(event_seq, t * 1000000000 + event_seq) AS VARCHAR) AS model_version FROM tx GROUP BY channel""",
)
def _current_models(spark, sf_dir):
    """Newest registry row per alias of a registry with one row per event, its channel as alias."""
    tx = load_transactions(spark, sf_dir)
    models = tx.select(
        F.lit("fraud_gbt").alias("model_name"),
        F.lpad(F.col("event_seq").cast("string"), 12, "0").alias("model_version"),
        F.col("channel").alias("model_alias"),
        F.col("event_id").alias("run_id"),
        F.col("event_time").alias("created_at"),
        F.col("event_seq").alias("number"),
    )
    newest = current_models(registry_rows(models))
    return newest.select(
        "alias",
        F.unix_seconds("created_at").alias("created"),
        F.col("metadata")["number"].cast("string").alias("model_version"),
    )
