"""The boosted trees against a plain version that looks at every row and every split."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tallyguard.operators.boosting import (
    LEAST_GAIN,
    UNIT,
    BoostingSettings,
    Ensemble,
    Tree,
    best_splits,
    drawn,
    fit_ensemble,
    quantile_cuts,
)
from tallyguard.operators.evaluation import chronological_split
from tallyguard.operators.labels import labelled
from tallyguard.plans.training import feature_frame, fit_classifier
from tallyguard.schemas import FEATURES
from tallyguard.sources.adapter import load_transactions

NAMES = ["a", "b", "c"]


def table(seed, n):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n).round(2), rng.integers(0, 4, n).astype(float)
    c = rng.exponential(size=n).round(1)
    label = ((a + b > 2) ^ (rng.random(n) < 0.1)).astype(int)
    return [(i, float(x), float(y), float(z), int(k)) for i, (x, y, z, k) in enumerate(zip(a, b, c, label))]


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").repartition(parts)


def plain_tree(values, g, h, depth, l2, least, rate, node=0):
    """{node: (feature, threshold) or value} by trying every threshold of every column."""
    total_g, total_h = g.sum(), h.sum()
    best = (LEAST_GAIN, None, None)
    if depth:
        for feature in range(values.shape[1]):
            for threshold in np.unique(values[:, feature])[1:]:
                left = values[:, feature] < threshold
                lg, lh = g[left].sum(), h[left].sum()
                rg, rh = total_g - lg, total_h - lh
                if min(lh, rh) < least:
                    continue
                gain = 0.5 * (lg**2 / (lh + l2) + rg**2 / (rh + l2) - total_g**2 / (total_h + l2))
                if gain > best[0] + 1e-9:
                    best = (gain, feature, threshold)
    if best[1] is None:
        return {node: -total_g / (total_h + l2) * rate}
    left = values[:, best[1]] < best[2]
    out = {node: (best[1], float(best[2]))}
    for side, child in ((left, 2 * node + 1), (~left, 2 * node + 2)):
        out |= plain_tree(values[side], g[side], h[side], depth - 1, l2, least, rate, child)
    return out


def plain_value(tree, row):
    node = 0
    while isinstance(tree[node], tuple):
        feature, threshold = tree[node]
        node = 2 * node + 1 + (row[feature] >= threshold)
    return tree[node]


def as_plain(tree: Tree, node=0):
    if tree.feature[node] < 0:
        return {node: tree.value[node]}
    out = {node: (int(tree.feature[node]), float(tree.threshold[node]))}
    return out | as_plain(tree, 2 * node + 1) | as_plain(tree, 2 * node + 2)


@pytest.mark.parametrize("weight", [1.0, 3.7])
def test_trees_equal_brute_force(spark, weight):
    rows = table(1, 200)
    settings = BoostingSettings(rounds=4, depth=3, learning_rate=0.3, least_hessian=1.5, l2=1.0)
    found = fit_ensemble(rows_of(spark, rows), NAMES, positive_weight=weight, settings=settings)
    values = np.array([r[1:4] for r in rows])
    label = np.array([r[4] for r in rows], dtype=float)
    w = np.where(label == 1, weight, 1.0)
    margin = np.zeros(len(rows))
    for tree in found.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (p - label) * UNIT) / UNIT, np.rint(w * p * (1 - p) * UNIT) / UNIT
        wanted = plain_tree(values, g, h, 3, 1.0, 1.5, 0.3)
        got = as_plain(tree)
        assert {n for n, x in got.items() if isinstance(x, tuple)} == {n for n, x in wanted.items() if isinstance(x, tuple)}
        for node, x in wanted.items():
            if isinstance(x, tuple):
                # The same rows go left; between two values of a node any threshold does.
                assert got[node][0] == x[0]
            else:
                assert got[node] == pytest.approx(x, rel=1e-9)
        steps = [plain_value(wanted, row) for row in values]
        assert [plain_value(got, row) for row in values] == pytest.approx(steps, rel=1e-9)
        margin += steps
    assert found.probability(values.T) == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-9)


def test_partitions_and_store_points_do_not_matter(spark, monkeypatch):
    from tallyguard.operators import boosting

    rows = table(2, 300)
    settings = BoostingSettings(rounds=5, depth=3, row_share=0.7, column_share=0.6, seed=3)
    one = fit_ensemble(rows_of(spark, rows, 1), NAMES, keys=["id"], settings=settings)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 40)
    monkeypatch.setattr(boosting, "TREES_PER_STORE", 2)
    many = fit_ensemble(rows_of(spark, rows[::-1], 7), NAMES, keys=["id"], settings=settings)
    assert [as_plain(t) for t in one.trees] == [as_plain(t) for t in many.trees]
    other = fit_ensemble(rows_of(spark, rows), NAMES, keys=["id"], settings=BoostingSettings(**{**vars(settings), "seed": 4}))
    assert [as_plain(t) for t in one.trees] != [as_plain(t) for t in other.trees]


def test_shares_of_rows(spark):
    draw = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 100_000)
    seen = [drawn(draw, tree, 42, 0.9) for tree in range(3)]
    assert all(abs(s.mean() - 0.9) < 0.005 for s in seen)
    assert abs((seen[0] & seen[1]).mean() - 0.81) < 0.01
    assert drawn(draw, 0, 42, 1.0).all()


def test_best_split_ties_and_limits():
    g = np.array([[[-4, 0, 4], [-4, 0, 4]]]) * UNIT
    h = np.array([[[2, 0, 2], [2, 0, 2]]]) * UNIT
    gain, column, cut, own_g, own_h = best_splits(g, h, 1.0, 1.0)
    assert (column[0], cut[0], own_g[0], own_h[0]) == (0, 1, 0, 4)
    assert gain[0] == pytest.approx(0.5 * (16 / 3 + 16 / 3))
    assert best_splits(g, h, 1.0, 3.0)[0][0] == -math.inf
    assert best_splits(g[:, :, :1], h[:, :, :1], 1.0, 1.0)[0][0] == -math.inf


def test_missing_values_one_class_and_no_rows(spark):
    settings = BoostingSettings(rounds=3, depth=2)
    rows = [(1, None, float("nan"), 0.0, 0), (2, 5.0, 1.0, None, 1), (3, None, 1.0, 1.0, None)] * 20
    found = fit_ensemble(rows_of(spark, rows), NAMES, settings=settings)
    filled = [(i, *(0.0 if x is None or x != x else x for x in values), label or 0) for i, *values, label in rows]
    same = fit_ensemble(rows_of(spark, filled), NAMES, settings=settings)
    assert [as_plain(t) for t in found.trees] == [as_plain(t) for t in same.trees]
    scored = rows_of(spark, rows).select(found.column(F.col("a"), F.col("b"), F.col("c")).alias("p"), "label")
    means = {r[0]: r[1] for r in scored.groupBy("label").agg(F.avg("p")).collect()}
    assert means[1] > 0.5 > means[0] and means[0] == pytest.approx(means[None], abs=0.2)
    constant = fit_ensemble(rows_of(spark, [(i, 1.0, 1.0, 1.0, 0) for i in range(30)]), NAMES, settings=settings)
    assert all(t.feature[0] == -1 for t in constant.trees) and constant.probability(np.ones((3, 1)))[0] < 0.5
    empty = fit_ensemble(rows_of(spark, []), NAMES, settings=settings)
    assert empty.trees == [] and empty.probability(np.ones((3, 2))).tolist() == [0.5, 0.5]


def test_stored_trees_score_the_same(spark, tmp_path):
    rows = table(4, 150)
    found = fit_ensemble(rows_of(spark, rows), NAMES, settings=BoostingSettings(rounds=3, depth=4))
    found.frame(spark).write.parquet(f"{tmp_path}/m")
    again = Ensemble.load(spark.read.parquet(f"{tmp_path}/m"), NAMES)
    values = np.array([r[1:4] for r in rows]).T
    assert again.probability(values).tolist() == found.probability(values).tolist()
    df = rows_of(spark, rows)
    scored = df.select("id", again.column(F.col("a"), F.col("b"), F.col("c")).alias("p")).collect()
    assert {r.id: r.p for r in scored} == dict(zip([r[0] for r in rows], found.probability(values).tolist()))


def test_cuts_are_quantiles(spark):
    df = spark.range(1000).selectExpr("cast(id as double) a", "cast(id % 2 as double) b", "7.0d c")
    a, b, c = quantile_cuts(df, NAMES, 10)
    assert len(a) == 10 and np.abs(np.diff(a) - 100).max() <= 2 and b.tolist() == [1.0] and c.tolist() == []


def test_the_classifier_learns(spark):
    frame = feature_frame(labelled(load_transactions(spark, SF_DIR)))
    train_rows, test_rows = chronological_split(frame.cache())
    settings = BoostingSettings(rounds=12, depth=4, learning_rate=0.3, row_share=0.9, column_share=0.9, least_hessian=2.0)
    found = fit_classifier(train_rows, settings)
    losses = []
    rows = train_rows.select("label", *FEATURES).toPandas()
    label, values = rows["label"].to_numpy(), rows[FEATURES].to_numpy().T.astype(float)
    for n in (0, 3, 12):
        p = Ensemble(FEATURES, found.trees[:n]).probability(values)
        weight = np.where(label == 1, (label == 0).sum() / (label == 1).sum(), 1.0)
        losses.append(-(weight * np.where(label == 1, np.log(p), np.log(1 - p))).sum())
    assert losses[0] > losses[1] > losses[2]
    assert found.column(*[F.col(f) for f in FEATURES]) is not None and test_rows.count() > 0


def test_jobs_and_trees_applied_per_level(spark, monkeypatch):
    """A level is one job, and no pass applies older trees again (a tree is added to the margins once)."""
    from tallyguard.operators import boosting

    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 60)
    applied = []
    kept = boosting._kept
    monkeypatch.setattr(boosting, "_kept", lambda blocks, tree: applied.append(tree) or kept(blocks, tree))
    settings = BoostingSettings(rounds=6, depth=2, learning_rate=0.3)
    found = fit_ensemble(rows_of(spark, table(5, 300)), NAMES, settings=settings)
    assert len(found.trees) == 6
    assert [id(t) for t in applied] == [id(t) for t in found.trees[:5]]


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("tasks, trees_per_job, held", [(1, 55, 10**9), (3, 3, 10**9), (4, 55, 1_000)])
def test_trees_of_tasks_that_run_together_equal_those_of_passes(spark, monkeypatch, tasks, trees_per_job, held):
    """Many trees take no job for each level; blocks, tasks, codes and files do not change them."""
    from tallyguard.operators import boosting, together

    rows = table(6, 800)
    settings = BoostingSettings(rounds=8, depth=4, learning_rate=0.3, row_share=0.7, column_share=0.6, seed=3)
    passes = fit_ensemble(rows_of(spark, rows), NAMES, keys=["id"], positive_weight=2.5, settings=settings)
    monkeypatch.setattr(boosting, "TREES_TOGETHER", 8, raising=False)
    monkeypatch.setattr(boosting, "ROWS_TOGETHER", math.ceil(800 / tasks), raising=False)
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 70)
    monkeypatch.setattr(together, "ROWS_AT_ONCE", 150)
    monkeypatch.setattr(together, "HELD_BYTES", held)
    monkeypatch.setattr(together, "TREES_PER_JOB", trees_per_job)
    found, jobs = jobs_of(
        spark,
        f"together{tasks}",
        lambda: fit_ensemble(rows_of(spark, rows[::-1], 5), NAMES, keys=["id"], positive_weight=2.5, settings=settings),
    )
    for one, other in zip(passes.trees, found.trees, strict=True):
        for x, y in zip(vars(one).values(), vars(other).values()):
            assert np.array_equal(x, y)
    assert jobs < settings.rounds * settings.depth


def test_the_whole_classifier_takes_few_jobs(spark):
    settings = BoostingSettings(rounds=30, depth=3, learning_rate=0.3)
    found, jobs = jobs_of(spark, "whole", lambda: fit_ensemble(rows_of(spark, table(7, 200)), NAMES, settings=settings))
    assert len(found.trees) == 30 and jobs < 30


def test_columns_share_codes():
    from tallyguard.operators.together import Codes

    rng = np.random.default_rng(3)
    sizes = [300, 2, 2, 7, 1, 256, 2, 40]
    bins = np.stack([rng.integers(0, n, 500) for n in sizes])
    codes = Codes(sizes)
    assert len(codes.sizes) < len(sizes) and math.prod(codes.sizes) == math.prod(sizes)
    units = rng.integers(-9, 9, (2, 500)).astype(float)
    found = codes.of(bins)
    for column, (code, _) in enumerate(codes.place):
        assert codes.bin(found[code], column).tolist() == bins[column].tolist()
        totals = np.stack([np.bincount(found[code], u, codes.sizes[code]) for u in units])[:, None]
        wanted = [np.bincount(bins[column], u, sizes[column]).tolist() for u in units]
        assert codes.sums(totals, code, column)[:, 0].tolist() == wanted


@pytest.mark.parametrize("depth", [1, 5, 6, 7])
def test_leaf_tables_equal_a_walk(depth):
    from tallyguard.operators.boosting import LeafTables

    rng = np.random.default_rng(depth)
    trees = []
    for _ in range(12):
        tree = Tree.empty(depth)
        for node in range((1 << depth) - 1):
            if (not node or tree.feature[(node - 1) // 2] >= 0) and rng.random() < 0.8:
                tree.feature[node], tree.threshold[node] = rng.integers(0, 4), rng.integers(0, 20) / 2
        tree.value[:] = rng.normal(size=len(tree.value))
        trees.append(tree)
    columns = rng.integers(-2, 22, (4, 1_500)) / 2.0
    columns[0, 3], columns[1, 4], columns[2, 5] = np.nan, np.inf, -np.inf
    margin = np.zeros(1_500)
    for tree in trees:
        margin += tree.value[tree.nodes(columns, tree.threshold)]
    assert LeafTables(trees).margins(columns).tolist() == margin.tolist()
