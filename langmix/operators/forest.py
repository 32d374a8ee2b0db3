"""Random forests for several targets, grown together (M5-M9).

Trees grow level by level on Spark aggregates.  Features are cut into at most
``max_bins`` bins at quantiles of their distinct values; a job per group of open nodes adds up, per
(tree, node, feature, bin), the weight and the weighted sums of all targets of the tree,
and the split with the largest joint reduction of squared error wins:

    gain = sum over targets of SL^2 / WL + SR^2 / WR - S^2 / W

Rows are read once per level where they lie.  A task holds one dense block of sums
(at most ``CELLS`` cells) and emits its non-zero cells; what reaches the driver is the
model: a split and two means per node.  A forest of its own for each target (as the
reference fits them) or one forest that splits for all targets at once, and forests over
several feature subsets, all grow in the same jobs: one pass over the rows a level.

Bootstrap weights are Poisson(1), drawn from a hash of (row key, tree), so they do not
depend on how rows are dealt out.  Equal gains go to the earlier feature, then the lower bin.
Rows with a null feature or target are left out; an empty table raises.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.session import cut_lineage

SEED = 42  # fixed value
#: cells (node, feature, bin) whose sums one task holds at a time
CELLS = 1 << 21
_LEAST_GAIN = 1e-12
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def bootstrap_weights(keys: np.ndarray, tree: int, seed: int = SEED) -> np.ndarray:
    """Poisson(1) weights of rows with 64-bit keys in one tree."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / 2.0**53, "right").astype(np.float64)


@dataclass
class Tree:
    """Nodes in order of creation; a leaf has feature -1."""
    allowed: tuple[int, ...]  # features and targets, by position
    targets: tuple[int, ...]
    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])  # rows of bins <= at go left
    left: list[int] = field(default_factory=lambda: [-1])
    mean: list[list[float]] = field(default_factory=lambda: [[]])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins (rows x features) has come to."""
        feature, at, left = np.array(self.feature), np.array(self.at), np.array(self.left)
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            here = node[rows]
            node[rows] = left[here] + (bins[rows, feature[here]] > at[here])
        return node


@dataclass
class Forest:
    features: list[str]
    targets: list[str]
    cuts: list[list[float]]  # upper edge of each bin but the last, per feature
    #: by features and targets
    forests: dict[tuple[tuple[str, ...], tuple[str, ...]], list[Tree]]

    def _bins(self, columns) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(c), np.asarray(x, np.float64), "left") for c, x in zip(self.cuts, columns)], 1)

    def _of(self, subset: tuple[str, ...] | None) -> dict[tuple[str, ...], list[Tree]]:
        return {group: trees for (own, group), trees in self.forests.items() if own == (subset or tuple(self.features))}

    def predict(self, df: DataFrame, subset: tuple[str, ...] | None = None) -> DataFrame:
        """``df`` with a column ``pred``: the mean of the trees, an entry per target."""
        forests = [[(t, np.array(t.mean)) for t in trees] for trees in self._of(subset).values()]
        bins, names, n_t = self._bins, self.features, len(self.targets)

        def work(batches):
            for b in batches:
                x = bins([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in names])
                y = np.zeros((len(x), n_t))
                for trees in forests:
                    y[:, trees[0][0].targets] = sum(mean[t.route(x)] for t, mean in trees) / len(trees)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, "pred"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(work, f"{fields}, pred array<double>")

    def importances(self, subset: tuple[str, ...] | None = None) -> list[tuple[str, str, float]]:
        """M9: (target, feature, importance): a feature's share of a tree's gain,
        averaged over the trees of the target's forest."""
        out = []
        for group, trees in self._of(subset).items():
            gains = np.array([np.bincount([f for f in t.feature if f >= 0], [g for f, g in zip(t.feature, t.gain) if f >= 0],
                                          len(self.features)) for t in trees])
            gains = gains[gains.sum(1) > 0]
            share = (gains / gains.sum(1, keepdims=True)).mean(0) if len(gains) else np.zeros(len(self.features))
            out += [(t, f, float(v)) for t in group for f, v in zip(self.features, share)]
        return out


def cut_points(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Midways between neighbouring distinct values where a feature has at most
    ``max_bins`` of them, else approximate quantiles; bounded by max_bins per feature."""
    some = [F.slice(F.array_sort(F.collect_set(F.col(f).cast("double"))), 1, max_bins + 1).alias(f"s{k}") for k, f in enumerate(features)]
    few = df.agg(*[F.approx_count_distinct(f).alias(f"n{k}") for k, f in enumerate(features)]).first()
    exact = [k for k in range(len(features)) if few[f"n{k}"] <= 2 * max_bins]
    aggs = [some[k] if k in exact else F.lit(None).alias(f"s{k}") for k in range(len(features))]
    aggs += [F.percentile_approx(F.col(f).cast("double"), [i / max_bins for i in range(1, max_bins)], 10_000).alias(f"q{k}")
             for k, f in enumerate(features)]
    row = df.agg(*aggs).first()
    out = []
    for k in range(len(features)):
        values = row[f"s{k}"] if k in exact else None
        if values is not None and len(values) <= max_bins:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:])])
        else:
            out.append(sorted(set(row[f"q{k}"])))
    return out


def fit_forest(train: DataFrame, features: Sequence[str], targets: Sequence[str], key_col: str, num_trees: int = 100,
               max_depth: int = 8, max_bins: int = 64, bootstrap: bool = True, seed: int = SEED,
               subsets: Sequence[tuple[str, ...]] | None = None, joint: bool = False) -> Forest:
    """M5: for each subset of the features (by default all of them) a forest per
    target, or one for all targets if ``joint``."""
    features, targets = list(features), list(targets)
    data = train.select(F.xxhash64(key_col).alias("_key"), *[F.col(c).cast("double").alias(c) for c in [*features, *targets]]).na.drop()
    cuts = cut_points(data, features, max_bins)
    subsets = [tuple(s) for s in (subsets or [features])]
    groups = [tuple(targets)] if joint else [(t,) for t in targets]
    forest = Forest(features, targets, cuts, {
        (own, group): [Tree(tuple(map(features.index, own)), tuple(map(targets.index, group))) for _ in range(num_trees)]
        for own in subsets for group in groups})
    trees = [(k, t) for some in forest.forests.values() for k, t in enumerate(some)]  # (which bootstrap, tree)
    data = cut_lineage(data)
    n_bins = max(len(c) for c in cuts) + 1
    most = max(1, CELLS // (n_bins * len(features)))
    open_nodes = [(i, 0) for i in range(len(trees))]
    for depth in range(max_depth):
        grown = []
        for at in range(0, len(open_nodes), most):
            block = open_nodes[at:at + most]
            for slot, f, b, gain, w, wl, total, left in _best_splits(data, forest, trees, block, n_bins, bootstrap, seed):
                tree_id, node = block[slot]
                tree = trees[tree_id][1]
                tree.mean[node] = [s / w for s in total]
                if f is None or gain <= _LEAST_GAIN:
                    continue
                tree.feature[node], tree.at[node], tree.left[node], tree.gain[node] = f, b, len(tree.feature), gain
                for sums, weight in ((left, wl), ([x - y for x, y in zip(total, left)], w - wl)):
                    grown.append((tree_id, len(tree.feature)))
                    for column, value in ((tree.feature, -1), (tree.at, 0), (tree.left, -1), (tree.mean, [s / weight for s in sums]), (tree.gain, 0.0)):
                        column.append(value)
        open_nodes = grown
        if not open_nodes:
            break
    if any(not t.mean[0] for _, t in trees):
        raise ValueError("a tree got no rows: the table is empty or too small to resample")
    return forest


def _best_splits(data: DataFrame, forest: Forest, trees: list[tuple[int, Tree]], block: list[tuple[int, int]], n_bins: int,
                 bootstrap: bool, seed: int) -> list[tuple]:
    """(slot, feature, bin, gain, weight, weight left, sums, sums left) of each open
    node of the block that has rows; feature is null where nothing can be split."""
    n_f, n_t = len(forest.features), max(len(t.targets) for _, t in trees)
    slots: dict[int, dict[int, int]] = {}
    for slot, (tree_id, node) in enumerate(block):
        slots.setdefault(tree_id, {})[node] = slot
    held = {i: trees[i] for i in slots}
    bins, names = forest._bins, (forest.features, forest.targets)
    size = n_f * n_bins

    def work(batches):
        sums = np.zeros((n_t + 1, len(block) * size))
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            x, y, key = bins([col(c) for c in names[0]]), [col(c) for c in names[1]], col("_key").view(np.uint64)
            weights: dict[int, np.ndarray] = {}
            for tree_id, (k, tree) in held.items():
                own = np.full(len(tree.feature), -1, np.int64)
                own[list(slots[tree_id])] = list(slots[tree_id].values())
                slot = own[tree.route(x)]
                if k not in weights:
                    weights[k] = bootstrap_weights(key, k, seed) if bootstrap else np.ones(len(key))
                w = weights[k]
                rows = np.flatnonzero((slot >= 0) & (w > 0))
                low, high = (int(slot[rows].min()), int(slot[rows].max()) + 1) if len(rows) else (0, 0)
                for f in tree.allowed if len(rows) else ():
                    cell = (slot[rows] - low) * size + f * n_bins + x[rows, f]
                    for j, v in enumerate([None, *(y[t] for t in tree.targets)]):
                        sums[j, low * size:high * size] += np.bincount(cell, w[rows] if v is None else w[rows] * v[rows], (high - low) * size)
        cells = np.flatnonzero(sums[0])
        for at in range(0, len(cells), 10_000):
            c = cells[at:at + 10_000]
            slot, rest = np.divmod(c, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(rest // n_bins), pa.array(rest % n_bins), *[pa.array(sums[j][c]) for j in range(n_t + 1)]],
                names=["slot", "f", "b", "w", *[f"s{j}" for j in range(n_t)]])

    s = [f"s{j}" for j in range(n_t)]
    cells = (data.mapInArrow(work, "slot long, f long, b long, w double, " + ", ".join(f"{c} double" for c in s))
             .groupBy("slot", "f", "b").agg(*[F.sum(c).alias(c) for c in ["w", *s]]))
    upto = Window.partitionBy("slot", "f").orderBy("b")  # at most max_bins rows
    whole = Window.partitionBy("slot", "f")
    run = cells.select("slot", "f", "b", *[F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(f"l_{c}") for c in ["w", *s]],
                       *[F.sum(c).over(whole).alias(f"t_{c}") for c in ["w", *s]])
    right = F.col("t_w") - F.col("l_w")
    gain = sum((F.pow(f"l_{c}", F.lit(2)) / F.col("l_w") + F.try_divide(F.pow(F.col(f"t_{c}") - F.col(f"l_{c}"), F.lit(2)), right)
                - F.pow(f"t_{c}", F.lit(2)) / F.col("t_w") for c in s), F.lit(0.0))
    run = run.withColumn("gain", F.when(right > 0.5, gain))  # weights are whole numbers
    order = F.struct(F.round(F.coalesce("gain", F.lit(-1.0)), 9).alias("g"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"))
    row = F.struct("f", "b", "gain", F.col("t_w"), F.col("l_w"), F.array(*[f"t_{c}" for c in s]).alias("t"), F.array(*[f"l_{c}" for c in s]).alias("l"))
    best = run.groupBy("slot").agg(F.max_by(row, order).alias("x"))
    return [(r.slot, None if r.x.gain is None else r.x.f, r.x.b, r.x.gain or 0.0, r.x.t_w, r.x.l_w, r.x.t, r.x.l) for r in sorted(best.collect())]


def errors(pred: DataFrame, targets: Sequence[str]) -> DataFrame:
    """M6: (target, mse, mae) of predictions, and their averages."""
    diff = lambda k, t: F.col(t) - F.col("pred")[k]
    one = pred.agg(*[F.struct(F.avg(F.pow(diff(k, t), 2)).alias("mse"), F.avg(F.abs(diff(k, t))).alias("mae"), F.lit(t).alias("target")).alias(f"_{k}")
                     for k, t in enumerate(targets)])
    per = one.select(F.explode(F.array(*[f"_{k}" for k in range(len(targets))])).alias("x")).select("x.*")
    return per.unionByName(per.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae")).withColumn("target", F.lit("average")))
