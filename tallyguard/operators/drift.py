"""Drift of feature distributions between a reference and a current sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.skew import value_prefix
from tallyguard.schemas import FEATURES
from tallyguard.session import written

ALPHA = 0.05
SERIES_TERMS = 100
# Fixed values of the drift preset: how many values are few, how many rows are many, the distance
# that counts as drift, and the least spread that a distance is measured in.
FEW_VALUES = 5
LARGE_ROWS = 1_000
FAR = 0.1
LEAST_SPREAD = 0.001

# Beyond this, the tail of one degree of freedom is below 1e-12 and its first terms suffice.
FAR_TAIL = 25.0


def kolmogorov_tail(x: Column) -> Column:
    """Asymptotic probability that the scaled gap exceeds ``x``."""
    terms = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    total = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def chi_square_tail(statistic: Column, freedom: Column) -> Column:
    """Probability that a chi-square variable with a whole number of degrees of freedom exceeds the
    statistic: a finite sum, and for odd numbers the tail of one degree added to it."""
    half = F.greatest(statistic / 2, F.lit(1e-300))
    odd = freedom % 2 == 1
    first = F.when(odd, F.log(half) / 2 - half - F.log(F.lit(math.gamma(1.5)))).otherwise(-half)
    step = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    terms = F.floor(freedom / 2).cast("int")
    # Every term follows from the one before: times half / (i + step).
    start = F.struct(F.lit(0.0).alias("total"), first.alias("log"))
    summed = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        start,
        lambda acc, i: F.struct(
            (acc["total"] + F.exp(acc["log"])).alias("total"),
            (acc["log"] + F.log(half / (i + step))).alias("log"),
        ),
    )["total"]
    one = F.struct(F.lit(0.0).alias("total"), (F.log(half) / 2 - half - F.log(F.lit(math.gamma(1.5)))).alias("log"))
    inside = F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * SERIES_TERMS)),
        one,
        lambda acc, i: F.struct(
            (acc["total"] + F.exp(acc["log"])).alias("total"),
            (acc["log"] + F.log(half / (i + F.lit(0.5)))).alias("log"),
        ),
    )["total"]
    far = F.exp(-half) / F.sqrt(F.lit(math.pi) * half) * (1 - F.lit(0.5) / half + F.lit(0.75) / (half * half))
    tail_of_one = F.when(half > FAR_TAIL, far).otherwise(1 - inside)
    tail = summed + F.when(odd, tail_of_one).otherwise(F.lit(0.0))
    return F.when(freedom < 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def long_values(frame: DataFrame, columns: list[str], side: str) -> DataFrame:
    """(column, value, counts per side), one row per distinct value."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    counts = frame.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    other = "n_cur" if side == "n_ref" else "n_ref"
    return counts.select("column", "value", F.col("n").alias(side), F.lit(0).cast("bigint").alias(other))


def numeric_drift(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value per numeric column."""
    columns = columns or FEATURES
    both = long_values(reference, columns, "n_ref").unionByName(long_values(current, columns, "n_cur"))
    counts = both.groupBy("column", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    sizes = counts.groupBy("column").agg(F.sum("n_ref").alias("ref_rows"), F.sum("n_cur").alias("cur_rows"))
    ranked = value_prefix(counts, "column", "value", ["n_ref", "n_cur"])
    gap = F.abs(
        (F.col("n_ref_before") + F.col("n_ref")) / F.col("ref_rows")
        - (F.col("n_cur_before") + F.col("n_cur")) / F.col("cur_rows")
    )
    stats = (
        ranked.join(F.broadcast(sizes), "column")
        .groupBy("column")
        .agg(F.max(gap).alias("statistic"), F.max("ref_rows").alias("n1"), F.max("cur_rows").alias("n2"))
    )
    size = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    scaled = (size + 0.12 + F.lit(0.11) / size) * F.col("statistic")
    return stats.select(
        "column",
        F.lit("ks").alias("test"),
        "statistic",
        kolmogorov_tail(scaled).alias("p_value"),
        (kolmogorov_tail(scaled) < ALPHA).alias("drifted"),
    )


def categorical_drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Chi-square statistic and p-value of a category column; NULL is a category of its own."""

    def counted(frame: DataFrame, side: str, other: str) -> DataFrame:
        counts = frame.groupBy(F.col(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias(side))
        return counts.withColumn(other, F.lit(0).cast("bigint"))

    cells = (
        counted(reference, "n_ref", "n_cur")
        .unionByName(counted(current, "n_cur", "n_ref"))
        .groupBy("category")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    sized = cells.withColumns(
        {"r": reference.agg(F.count(F.lit(1))).scalar(), "c": current.agg(F.count(F.lit(1))).scalar()}
    )
    both = F.col("n_ref") + F.col("n_cur")
    all_rows = F.col("r") + F.col("c")
    expected_ref, expected_cur = both * F.col("r") / all_rows, both * F.col("c") / all_rows
    part = F.pow(F.col("n_ref") - expected_ref, F.lit(2)) / expected_ref + F.pow(
        F.col("n_cur") - expected_cur, F.lit(2)
    ) / expected_cur
    freedom = (F.count(F.lit(1)) - 1).cast("int")
    stats = sized.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("statistic"), freedom.alias("freedom"))
    judged = stats.withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("freedom")))
    return judged.select(
        F.lit(column).alias("column"),
        F.lit("chi_square").alias("test"),
        "statistic",
        "p_value",
        (F.col("p_value") < ALPHA).alias("drifted"),
    )


def value_cells(
    reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str]
) -> DataFrame:
    """(column, numeric, value, category, counts per side), one row per distinct value of a column.
    Missing numbers are left out, a missing category is a category of its own."""

    def side(frame: DataFrame, here: str, there: str) -> DataFrame:
        cells = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(c in numeric).alias("numeric"),
                (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("value"),
                (F.lit(None).cast("string") if c in numeric else F.col(c).cast("string")).alias("category"),
            )
            for c in [*numeric, *categorical]
        ]
        rows = frame.select(F.inline(F.array(*cells))).where(~F.col("numeric") | F.col("value").isNotNull())
        counts = rows.groupBy("column", "numeric", "value", "category").agg(F.count(F.lit(1)).alias(here))
        return counts.withColumn(there, F.lit(0).cast("bigint"))

    both = side(reference, "n_ref", "n_cur").unionByName(side(current, "n_cur", "n_ref"))
    return both.groupBy("column", "numeric", "value", "category").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")
    )


def chosen_test(large: Column) -> Column:
    """The test of a column: by its kind, its number of distinct values and the size of the
    reference."""
    many = F.col("numeric") & (F.col("distinct") > FEW_VALUES)
    return (
        F.when(large & many, "wasserstein")
        .when(large, "jensen_shannon")
        .when(many, "ks")
        .when(F.col("distinct") > 2, "chi_square")
        .otherwise("z")
    )


def preset_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    large_rows: int = LARGE_ROWS,
) -> DataFrame:
    """Drift per column by the test that suits it.

    Up to ``large_rows`` reference rows: Kolmogorov-Smirnov for numbers, chi-square for columns of
    at most five values or categories, and the z-test of two proportions for at most two, all at
    the 5% level. Beyond: the Wasserstein distance in standard deviations of the reference, and
    the Jensen-Shannon distance, which count as drift from 0.1 on and have no p-value. A side
    without rows shows no drift.
    """
    numeric = FEATURES if numeric is None else numeric
    categorical = [c for c in ("label", "simulation_scenario") if c in reference.columns] if categorical is None else categorical
    cells = written(value_cells(reference, current, numeric, categorical), "drift-cells")
    n_ref, n_cur = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    sizes = cells.groupBy("column", "numeric").agg(
        F.sum(n_ref).alias("r"),
        F.sum(n_cur).alias("c"),
        F.count(F.lit(1)).alias("distinct"),
        F.try_divide(F.sum(n_ref * F.col("value")), F.sum(n_ref)).alias("mean"),
        F.min("value").alias("least"),
    )
    sizes = sizes.withColumn("test", chosen_test(F.col("r") > large_rows))
    # One row for each column of the report.
    sized = cells.join(F.broadcast(sizes), ["column", "numeric"])

    # A side without rows gives nulls.
    p, q = F.try_divide(n_ref, F.col("r")), F.try_divide(n_cur, F.col("c"))
    middle = (p + q) / 2
    share = (n_ref + n_cur) / (F.col("r") + F.col("c"))

    def surprise(seen: Column, expected: Column) -> Column:
        return F.try_divide(F.pow(seen - expected, F.lit(2)), expected)

    chi = surprise(n_ref, share * F.col("r")) + surprise(n_cur, share * F.col("c"))
    part = F.when(p > 0, p * F.log(p / middle)).otherwise(0.0) + F.when(q > 0, q * F.log(q / middle)).otherwise(0.0)
    name = F.struct("value", "category")
    few = sized.where(F.col("test").isin("chi_square", "z", "jensen_shannon")).groupBy("column", "test", "r", "c", "distinct").agg(
        F.sum(chi).alias("chi"),
        F.sqrt(F.greatest(F.sum(part) / 2, F.lit(0.0))).alias("distance"),
        F.max_by(p, name).alias("p"),
        F.max_by(q, name).alias("q"),
    )
    pooled = (F.col("p") * F.col("r") + F.col("q") * F.col("c")) / (F.col("r") + F.col("c"))
    error = F.sqrt(pooled * (1 - pooled) * F.try_divide(F.col("r") + F.col("c"), F.col("r") * F.col("c")))
    z = F.when(error > 0, (F.col("p") - F.col("q")) / F.when(error > 0, error)).otherwise(0.0)
    test = F.col("test")
    few = few.select(
        "column",
        "test",
        F.when(test == "z", z).when(test == "chi_square", F.col("chi")).otherwise(F.col("distance")).alias("statistic"),
        F.when(test == "z", chi_square_tail(z * z, F.lit(1)))
        .when(test == "chi_square", chi_square_tail(F.col("chi"), (F.col("distinct") - 1).cast("int")))
        .alias("p_value"),
    )

    spread = sized.where("numeric").groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum(n_ref * F.pow(F.col("value") - F.col("mean"), F.lit(2))), F.max("r"))).alias("spread")
    )
    many = value_prefix(
        cells.join(F.broadcast(sizes.where(test.isin("ks", "wasserstein")).select("column")), "column", "left_semi"),
        "column",
        "value",
        ["n_ref", "n_cur"],
    )
    many = many.join(F.broadcast(sizes.drop("numeric")), "column").join(F.broadcast(spread), "column")
    before = F.abs(F.try_divide("n_ref_before", "r") - F.try_divide("n_cur_before", "c"))
    after = F.abs(
        F.try_divide(F.col("n_ref_before") + n_ref, F.col("r")) - F.try_divide(F.col("n_cur_before") + n_cur, F.col("c"))
    )
    # The area between the two curves, summed by parts: a value needs only its own two gaps.
    area = F.sum((F.col("value") - F.col("least")) * (before - after))
    many = many.groupBy("column", "test", "r", "c").agg(
        F.max(after).alias("gap"), (area / F.greatest(F.max("spread"), F.lit(LEAST_SPREAD))).alias("distance")
    )
    size = F.sqrt(F.try_divide(F.col("r") * F.col("c"), F.col("r") + F.col("c")))
    many = many.select(
        "column",
        "test",
        F.when(test == "ks", F.col("gap")).otherwise(F.greatest(F.col("distance"), F.lit(0.0))).alias("statistic"),
        F.when(test == "ks", kolmogorov_tail((size + 0.12 + F.try_divide(F.lit(0.11), size)) * F.col("gap"))).alias("p_value"),
    )
    drifted = F.when(F.col("p_value").isNotNull(), F.col("p_value") < ALPHA).otherwise(F.col("statistic") >= FAR)
    return few.unionByName(many).withColumn("drifted", F.coalesce(drifted, F.lit(False)))


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drift per column: numeric features, label and scenario."""
    report = numeric_drift(reference, current, columns)
    for column in ("label", "simulation_scenario"):
        if column in reference.columns:
            report = report.unionByName(categorical_drift(reference, current, column))
    return report


def dataset_drift(report: DataFrame) -> DataFrame:
    """Share of drifted columns."""
    return report.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("drifted").alias("drifted_columns"),
        F.coalesce(F.avg(F.col("drifted").cast("double")), F.lit(0.0)).alias("dataset_drift_score"),
    )
