"""Forests against a plain recursive version on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from langmix.operators import forest as FO


def plain_tree(x, y, w, cuts, allowed, depth):
    """(feature, bin, left, right) or the leaf's means; x: bins, y: targets."""
    mean = [(w * y[:, k]).sum() / w.sum() for k in range(y.shape[1])]
    best = (round(-1.0, 9), 0, 0)
    for f in allowed:
        for b in range(len(cuts[f]) + 1):
            left = x[:, f] <= b
            wl, wr = w[left].sum(), w[~left].sum()
            if wl < 0.5 or wr < 0.5:
                continue
            gain = sum((w[left] * y[left, k]).sum() ** 2 / wl + (w[~left] * y[~left, k]).sum() ** 2 / wr - (w * y[:, k]).sum() ** 2 / w.sum()
                       for k in range(y.shape[1]))
            if left[w > 0].any():
                best = max(best, (round(gain, 9), -f, -b))
    if depth == 0 or best[0] <= 1e-9:
        return mean
    f, b = -best[1], -best[2]
    left = x[:, f] <= b
    return (f, b, plain_tree(x[left], y[left], w[left], cuts, allowed, depth - 1), plain_tree(x[~left], y[~left], w[~left], cuts, allowed, depth - 1))


def plain_predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def table(spark, n=160, seed=3):
    rng = random.Random(seed)
    rows = [(k, float(rng.randrange(5)), float(rng.randrange(40)), float(rng.randrange(2)), 0.0, 0.0) for k in range(n)]
    rows = [(k, a, b, c, a * 3 + c + rng.randrange(3), b / 8 - a * c) for k, a, b, c, *_ in rows]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double").repartition(3)


def keys_of(df):
    return {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}


@pytest.mark.parametrize("joint", [True, False])
@pytest.mark.parametrize("bootstrap", [True, False])
def test_trees_equal_plain_recursion(spark, joint, bootstrap, monkeypatch):
    monkeypatch.setattr(FO, "CELLS", 500)  # several blocks a level
    rows, df = table(spark)
    model = FO.fit_forest(df, ["a", "b", "c"], ["y", "z"], "id", num_trees=2, max_depth=3, bootstrap=bootstrap, joint=joint)
    assert [len(c) + 1 for c in model.cuts] == [len({r[f] for r in rows}) for f in (1, 2, 3)]
    x = np.stack([np.searchsorted(model.cuts[f], [r[1 + f] for r in rows], "left") for f in range(3)], 1)
    y = np.array([[r[4], r[5]] for r in rows])
    h = keys_of(df)
    keys = np.array([h[r[0]] for r in rows]).astype(np.int64).view(np.uint64)
    want = np.zeros((len(rows), 2))
    for group in ([0, 1],) if joint else ([0], [1]):
        for k in range(2):
            w = FO.bootstrap_weights(keys, k) if bootstrap else np.ones(len(rows))
            tree = plain_tree(x, y[:, group], w, model.cuts, [0, 1, 2], 3)
            want[:, group] += np.array([plain_predict(tree, r) for r in x]) / 2
    got = {r.id: r.pred for r in model.predict(df).collect()}
    assert np.allclose([got[r[0]] for r in rows], want, atol=1e-9)
    for target in ("y", "z"):
        assert abs(sum(v for t, _, v in model.importances() if t == target) - 1) < 1e-9


def test_subsets_grow_together_as_alone(spark):
    _, df = table(spark, 90, 5)
    both = FO.fit_forest(df, ["a", "b"], ["y"], "id", num_trees=3, max_depth=4, subsets=[("a",), ("a", "b")])
    alone = FO.fit_forest(df, ["a"], ["y"], "id", num_trees=3, max_depth=4)
    one = {r.id: r.pred for r in both.predict(df, ("a",)).collect()}
    two = {r.id: r.pred for r in alone.predict(df).collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k]) for k in one)
    assert {f for _, f, v in both.importances(("a",)) if v > 0} == {"a"}


def test_many_values_and_errors(spark):
    df = spark.range(3000).select("id", (F.col("id") % 1000).cast("double").alias("a"), ((F.col("id") % 1000) > 500).cast("double").alias("y"))
    model = FO.fit_forest(df, ["a"], ["y"], "id", num_trees=4, max_depth=6, max_bins=16)
    assert len(model.cuts[0]) <= 15
    rows = {r.target: r for r in FO.errors(model.predict(df), ["y"]).collect()}
    assert rows["y"].mse < 0.01 and rows["average"].mse == rows["y"].mse


def test_empty_table_raises_and_nulls_are_left_out(spark):
    empty = spark.createDataFrame([], "id long, a double, y double")
    with pytest.raises(ValueError):
        FO.fit_forest(empty, ["a"], ["y"], "id", num_trees=1)
    some = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 9.0), (3, 2.0, None), (4, 1.0, 2.0)], "id long, a double, y double")
    assert FO.fit_forest(some, ["a"], ["y"], "id", num_trees=1, bootstrap=False).forests[("a",), ("y",)][0].mean[0] == [2.0]
