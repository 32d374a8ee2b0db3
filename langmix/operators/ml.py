"""Models (M5-M13): forests (:mod:`langmix.operators.forest`), clustering by
keyed sums, PCA (MLlib)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.operators.forest import errors, fit_forest
from langmix.session import cut_lineage

SEED = 42  # fixed value


def as_vector(df: DataFrame, arr_col: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.transform(arr_col, lambda x: x.cast("double"))))


@dataclass
class KMeans:
    """The centres of k-means models of one table, by k."""
    centres: dict[int, np.ndarray]

    def assignments(self, df: DataFrame, key_col: str, vec_col: str) -> DataFrame:
        """(key, k, cluster): the nearest centre of every vector, the first of equals."""
        centres = self.centres

        @F.arrow_udf("array<int>")
        def nearest(v: pa.Array) -> pa.Array:
            x = _matrix(v)
            return pa.array(np.stack([_squares(x, c).argmin(1) for c in centres.values()], 1).tolist(), pa.list_(pa.int32()))

        rows = df.where(F.col(vec_col).isNotNull()).select(key_col, nearest(vec_col).alias("_at"))
        every = F.array(*[F.struct(F.lit(k).alias("k"), F.col("_at")[i].alias("cluster")) for i, k in enumerate(centres)])
        return rows.select(key_col, F.explode(every).alias("_x")).select(key_col, "_x.k", "_x.cluster")

    def centre_rows(self, spark) -> DataFrame:
        """(k, cluster, feature, value): a row per cluster and dimension."""
        rows = [(k, c, i, float(v)) for k, centre in self.centres.items() for c, x in enumerate(centre) for i, v in enumerate(x)]
        return spark.createDataFrame(rows, "k int, cluster int, feature int, value double")


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres, rounded so that equal ones tie."""
    return np.stack([np.round(((x - c) ** 2).sum(1), 9) for c in centres], 1) if len(x) else np.zeros((0, len(centres)))


def kmeans(df: DataFrame, key_col: str, vec_col: str, ks: Sequence[int], rounds: int = 10) -> KMeans:
    """Lloyd's rounds from a farthest-first start, for several k in the same
    passes.  The first centre is the vector with the least key, each next one the
    vector farthest from all before it (ties: least key).  A round adds up, per task,
    the vectors of each cluster; what the driver sees are centres.  Clusters that lose
    all vectors keep their centre.  Null vectors are left out; all others have one length."""
    data = cut_lineage(df.where(F.col(vec_col).isNotNull()).select(F.col(key_col).cast("long").alias("key"), F.col(vec_col).alias("v")))
    first = data.orderBy("key").limit(1).collect()
    if not first:
        raise ValueError("no vectors")
    start = [np.array(first[0].v, np.float64)]
    while len(start) < max(ks):
        so_far = np.array(start)

        @F.arrow_udf("double")
        def far(v: pa.Array) -> pa.Array:
            return pa.array(_squares(_matrix(v), so_far).min(1) if len(v) else [], pa.float64())  # noqa: B023

        row = data.select("key", "v", far("v").alias("d")).agg(F.max_by("v", F.struct("d", -F.col("key"))).alias("v")).first()
        start.append(np.array(row.v, np.float64))
    centres = {k: np.array(start[:k]) for k in ks}
    for _ in range(rounds):
        now = dict(centres)

        def add_up(batches):
            total = {k: np.zeros((k, c.shape[1] + 1)) for k, c in now.items()}  # noqa: B023
            for b in batches:
                x = _matrix(b.column(0))
                for k, c in now.items():  # noqa: B023
                    at = _squares(x, c).argmin(1)
                    np.add.at(total[k], at, np.column_stack([x, np.ones(len(x))]))
            for k, t in total.items():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k] * t.size, pa.int32()), "cell": pa.array(range(t.size), pa.int32()), "s": t.ravel()})

        sums = data.select("v").mapInArrow(add_up, "k int, cell int, s double").groupBy("k", "cell").agg(F.sum("s").alias("s")).collect()
        moved = False
        for k in ks:
            t = np.zeros(centres[k].shape[0] * (centres[k].shape[1] + 1))
            for r in sums:
                if r.k == k:
                    t[r.cell] = r.s
            t = t.reshape(k, -1)
            new = np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1), centres[k])
            moved |= bool((new != centres[k]).any())
            centres[k] = new
        if not moved:
            break
    return KMeans(centres)


def pca2(df: DataFrame, key_col: str, features: str = "features") -> DataFrame:
    """First two principal components of the *centred* vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    pipe = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_c"),
                            PCA(k=2, inputCol="_c", outputCol="_pc")])
    out = pipe.fit(df).transform(df).select(key_col, vector_to_array("_pc").alias("_a"))
    return out.select(key_col, F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2"))


def forest_per_target(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], targets: Sequence[str], key_col: str,
                      num_trees: int = 100, joint: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """M5/M6/M9: a random forest per target (seed 42), or one that splits for all of
    them.  Returns (per-target MSE/MAE plus an ``average`` row, feature importances)."""
    forest = fit_forest(train, feature_cols, targets, key_col, num_trees, joint=joint, **options)
    imp = train.sparkSession.createDataFrame(forest.importances(), "target string, feature string, importance double")
    return errors(forest.predict(test.select(*feature_cols, *targets)), targets), imp


def top_features(imp: DataFrame, k: int = 10, how: str = "sum") -> DataFrame:
    """Top-k features by the sum (or median) of importances over targets."""
    agg = F.sum("importance") if how == "sum" else F.percentile("importance", 0.5)
    return imp.groupBy("feature").agg(agg.alias("score")).orderBy(F.desc("score"), "feature").limit(k)


def subset_ablation(train: DataFrame, test: DataFrame, base: Sequence[str], optional: Sequence[str], targets: Sequence[str],
                    key_col: str, num_trees: int = 20, **options) -> DataFrame:
    """M7: mean squared error over the targets for every subset of the ``optional``
    features (always with the ``base`` ones): (variables, mse).  All forests of all
    subsets grow in the same jobs, one pass over the rows a level."""
    features = [*base, *optional]
    subsets = [c for n in range(len(optional) + 1) for c in combinations(sorted(optional), n)]
    forest = fit_forest(train, features, targets, key_col, num_trees, subsets=[(*base, *c) for c in subsets], **options)
    out = None
    for c in subsets:
        pred = forest.predict(test.select(*features, *targets), (*base, *c))
        one = errors(pred, targets).where("target = 'average'").select(F.lit("baseline+" + ",".join(c)).alias("variables"), "mse")
        out = one if out is None else out.unionByName(one)
    return out


def collect_ablations(settings: dict[str, DataFrame], order_by: str) -> DataFrame:
    """M8: the (variables, mse) tables of several settings side by side: only
    variables known in all of them, sorted by one."""
    out = None
    for name, df in settings.items():
        one = df.select("variables", F.col("mse").alias(name))
        out = one if out is None else out.join(one, "variables")
    return out.orderBy(order_by, "variables")
