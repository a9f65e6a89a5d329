"""Classifier evaluation: curves, thresholds and the chronological split.

Scores are first aggregated to one row per distinct score; running sums over score order use
value buckets, so no step sorts everything in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.skew import value_prefix

# Sweep grid and threshold choice.
THRESHOLDS = [float(t) for t in np.linspace(0.1, 0.95, 18)]
MINIMUM_PRECISION = 0.85
BLOCK_MARGIN = 0.1
BLOCK_CEILING = 0.99


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole != 0, whole))


def class_balance(frame: DataFrame) -> DataFrame:
    """Positives and negatives (at least 1 each) and the positive class weight."""
    counts = frame.agg(
        F.greatest(F.coalesce(F.sum("label"), F.lit(0)), F.lit(1)).cast("bigint").alias("positives"),
        F.count(F.lit(1)).alias("rows"),
    )
    negatives = F.greatest(F.col("rows") - F.col("positives"), F.lit(1).cast("bigint"))
    return counts.select(
        "positives", negatives.alias("negatives"), (negatives / F.col("positives")).alias("positive_weight")
    )


def confusion_matrix(scores: DataFrame, threshold: float, probability: str = "probability") -> DataFrame:
    """Counts of all four (label, prediction) cells, zero where empty."""
    predicted = F.col(probability) >= threshold
    actual = F.col("label") == 1
    one = scores.agg(
        F.count_if(~actual & ~predicted).alias("n00"),
        F.count_if(~actual & predicted).alias("n01"),
        F.count_if(actual & ~predicted).alias("n10"),
        F.count_if(actual & predicted).alias("n11"),
    )
    cells = [
        F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"), F.col(f"n{a}{p}").alias("rows"))
        for a in (0, 1)
        for p in (0, 1)
    ]
    return one.select(F.inline(F.array(*cells)))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where undefined."""
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def threshold_sweep(scores: DataFrame, probability: str = "probability") -> DataFrame:
    """Precision, recall and F1 at 18 thresholds in one pass over the scores.

    Each score is reduced to the number of thresholds it reaches; the rest works on at most
    19 rows.
    """
    reached = sum((F.col(probability) >= t).cast("int") for t in THRESHOLDS)
    counts = scores.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    totals = []
    for i in range(len(THRESHOLDS)):
        at_least = F.col("reached") > i
        totals += [
            F.coalesce(F.sum(F.when(at_least, F.col("pos"))), F.lit(0)).alias(f"tp{i}"),
            F.coalesce(F.sum(F.when(at_least, F.col("neg"))), F.lit(0)).alias(f"fp{i}"),
        ]
    one = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), *totals)
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.col(f"tp{i}").alias("tp"),
            F.col(f"fp{i}").alias("fp"),
            (F.col("all_pos") - F.col(f"tp{i}")).alias("fn"),
        )
        for i, t in enumerate(THRESHOLDS)
    ]
    long = one.select(F.inline(F.array(*rows)))
    measures = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return long.select("threshold", *[expr.alias(name) for name, expr in measures.items()])


def choose_thresholds(sweep: DataFrame) -> DataFrame:
    """Review threshold: first best F1. Block threshold: at least 0.1 above it and precise.

    ``precise`` is the last threshold with precision of 0.85 and more, or else the first one
    of the best precision.
    """
    t = F.col("threshold")
    enough = F.col("precision") >= MINIMUM_PRECISION
    picked = sweep.agg(
        F.max_by(t, F.struct(F.col("f1"), -t)).alias("review_threshold"),
        F.max(F.when(enough, t)).alias("last_precise"),
        F.max_by(t, F.struct(F.col("precision"), -t)).alias("best_precise"),
    )
    precise = F.coalesce("last_precise", "best_precise")
    block = F.least(
        F.lit(BLOCK_CEILING), F.greatest(F.col("review_threshold") + BLOCK_MARGIN, precise)
    )
    return picked.select("review_threshold", block.alias("block_threshold"))


def _per_score(scores: DataFrame, probability: str) -> DataFrame:
    counts = scores.groupBy(F.col(probability).alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    return value_prefix(counts.withColumn("grp", F.lit("all")), "grp", "score", ["pos", "neg"])


def average_precision(scores: DataFrame, probability: str = "probability") -> DataFrame:
    """Area under the precision-recall steps: sum of recall gains times precision."""
    ranked = _per_score(scores, probability)
    all_pos = scores.agg(F.count_if(F.col("label") == 1)).scalar()
    all_rows = scores.agg(F.count(F.lit(1))).scalar()
    joined = ranked.withColumns({"all_pos": all_pos, "all_rows": all_rows})
    tp = F.col("all_pos") - F.col("pos_before")
    seen = F.col("all_rows") - F.col("pos_before") - F.col("neg_before")
    return joined.agg(
        F.coalesce(F.sum(_ratio(F.col("pos"), F.col("all_pos")) * (tp / seen)), F.lit(0.0)).alias("pr_auc")
    )


def roc_auc(scores: DataFrame, probability: str = "probability") -> DataFrame:
    """Chance that a positive outranks a negative, ties counted half."""
    ranked = _per_score(scores, probability)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(
        _ratio(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc")
    )


def split_position(rows: int, share: float = 0.8) -> int:
    return max(int(rows * share), 1)


def row_at(df: DataFrame, columns: list[str], position: int) -> list[int]:
    """Values of ``columns`` in the row at ``position`` of their sort order, without a full sort.

    Column by column: counts per distinct value, running counts over value buckets, the value
    that holds the position, then the same within that value.
    """
    found = []
    rest = df.select(*columns)
    for column in columns:
        counts = rest.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.lit("all"))
        ranked = value_prefix(counts, "grp", column, ["n"])
        hit = ranked.where(
            (F.col("n_before") <= position) & (F.col("n_before") + F.col("n") > position)
        ).first()
        found.append(hit[column])
        position -= hit["n_before"]
        rest = rest.where(F.col(column) == hit[column])
    return found


def chronological_split(
    frame: DataFrame, share: float = 0.8, order: tuple[str, str] = ("event_us", "event_seq")
) -> tuple[DataFrame, DataFrame]:
    """First part by (time, sequence) for training, the rest for testing.

    With no rest, the last 200 training rows serve as test rows.
    """
    rows = frame.count()
    if rows == 0:
        raise ValueError("a frame without rows can't be split")
    cut = split_position(rows, share)
    if cut >= rows:
        tail = frame.orderBy(*[F.col(c).desc() for c in order]).limit(min(200, rows))
        return frame, tail
    at = row_at(frame, list(order), cut)
    first, second = order
    before = (F.col(first) < at[0]) | ((F.col(first) == at[0]) & (F.col(second) < at[1]))
    return frame.where(before), frame.where(~before)


def tail_sample(frame: DataFrame, rows: int, order: tuple[str, str] = ("event_us", "event_seq")) -> DataFrame:
    """The last ``rows`` rows by time."""
    return frame.orderBy(*[F.col(c).desc() for c in order]).limit(rows)

