"""Confusion matrices and their divergence from similarity matrices.

All matrices are coordinate-form DataFrames; several similarity sources are
handled in one job keyed by ``sim_name`` (K15) instead of a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.operators import matrix as Mx

EPS = 1e-10  # fixed value: smoothing added to both distributions


def confusion_matrix(dist: DataFrame, expected_col: str = "expected", training_col: str | None = None,
                     pivot_lang: str | None = "en", code_map: DataFrame | None = None) -> DataFrame:
    """K1/K2: cell (row = predicted, col = expected) = mean over units of
    ``-(1-p) ln p`` when the predicted language is the expected one, the pivot
    language (K1) or a training language (K2), else ``-p ln p``."""
    d = dist.select(F.col(expected_col).alias("col"), F.col("lang").alias("row"), "p",
                    *([training_col] if training_col else []))
    if code_map is not None:
        d = Mx.rename_labels(d, code_map)
    inside = F.col("row") == F.col("col")
    if pivot_lang:
        inside = inside | (F.col("row") == pivot_lang)
    if training_col:
        inside = inside | F.array_contains(training_col, F.col("row"))
    term = -F.when(inside, 1 - F.col("p")).otherwise(F.col("p")) * F.ln("p")
    return d.groupBy("row", "col").agg(F.avg(term).alias("value"))


def confusion_by_training(dist: DataFrame, training_col: str = "training", expected_col: str = "expected") -> DataFrame:
    """K3: one column per training language (training list exploded)."""
    d = dist.select("*", F.explode(training_col).alias("_train"))
    inside = (F.col("lang") == F.col(expected_col)) | F.array_contains(training_col, F.col("lang"))
    term = -F.when(inside, 1 - F.col("p")).otherwise(F.col("p")) * F.ln("p")
    return d.groupBy(F.col("lang").alias("row"), F.col("_train").alias("col")).agg(F.avg(term).alias("value"))


def kl_by_column(p: DataFrame, q: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per column, P and Q restricted to rows where P != 0, each normalised
    over those rows, +1e-10, ``sum P ln(P/Q)``.  A missing Q cell counts as 0;
    a column whose Q sums to 0 gets NULL (the reference's NaN)."""
    keys = list(keys)
    pp = p.filter(F.col("value") != 0).select(*keys, "row", "col", F.col("value").alias("pv"))
    j = pp.join(q.select(*keys, "row", "col", F.col("value").alias("qv")), keys + ["row", "col"], "left") \
        .fillna(0.0, subset=["qv"])
    w = Window.partitionBy(*keys, "col")
    j = (j.withColumn("pn", F.col("pv") / F.sum("pv").over(w) + F.lit(EPS))
          .withColumn("qn", F.try_divide(F.col("qv"), F.sum("qv").over(w)) + F.lit(EPS)))
    return j.groupBy(*keys, "col").agg(F.sum(F.col("pn") * F.ln(F.col("pn") / F.col("qn"))).alias("kl"))


def kl_mean(kl: DataFrame, keys: Sequence[str] = (), finite_only: bool = True) -> DataFrame:
    """K11 mean / K12 mean over finite columns only."""
    v = F.col("kl")
    if finite_only:
        v = F.when(F.col("kl").isNotNull() & ~F.isnan("kl") & (F.abs("kl") != float("inf")), F.col("kl"))
    if keys:
        return kl.groupBy(*keys).agg(F.avg(v).alias("kl_mean"))
    return kl.agg(F.avg(v).alias("kl_mean"))


def kl_whole(p: DataFrame, q: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Normalise each matrix by its total over all (aligned) cells, +1e-10,
    ``sum P ln(P/Q)`` over the union of their cells (missing = 0)."""
    keys = list(keys)
    j = p.select(*keys, "row", "col", F.col("value").alias("pv")).join(
        q.select(*keys, "row", "col", F.col("value").alias("qv")), keys + ["row", "col"], "full") \
        .fillna(0.0, subset=["pv", "qv"])
    w = Window.partitionBy(*keys)
    j = (j.withColumn("pn", F.try_divide(F.col("pv"), F.sum("pv").over(w)) + F.lit(EPS))
          .withColumn("qn", F.try_divide(F.col("qv"), F.sum("qv").over(w)) + F.lit(EPS)))
    out = j.groupBy(*keys) if keys else j.groupBy()
    return out.agg(F.sum(F.col("pn") * F.ln(F.col("pn") / F.col("qn"))).alias("kl_whole"))


def nan_euclidean(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), n_cells: DataFrame | None = None) -> DataFrame:
    """``sqrt(n / n_present * sum((a-b)^2))`` over aligned cells where both
    values are present; n = all cells of the aligned grid (rows x cols)."""
    keys = list(keys)
    j = a.select(*keys, "row", "col", F.col("value").alias("av")).join(
        b.select(*keys, "row", "col", F.col("value").alias("bv")), keys + ["row", "col"], "full")
    present = F.col("av").isNotNull() & F.col("bv").isNotNull()
    g = j.groupBy(*keys) if keys else j.groupBy()
    agg = g.agg(F.countDistinct("row").alias("nr"), F.countDistinct("col").alias("nc"),
                F.count_if(present).alias("np"),
                F.sum(F.when(present, F.pow(F.col("av") - F.col("bv"), 2))).alias("ss"))
    return agg.select(*keys, F.sqrt(F.try_divide(F.col("nr") * F.col("nc"), F.col("np")) * F.col("ss"))
                      .alias("nan_euclidean"))


def robust_row_mean(m: DataFrame) -> DataFrame:
    """Per row, drop the maximum (all ties) and average the rest."""
    w = Window.partitionBy("row")
    x = m.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("_mx", F.max("value").over(w))
    return x.filter(F.col("value") < F.col("_mx")).groupBy("row").agg(F.avg("value").alias("robust_mean"))


def top_k_per_col(m: DataFrame, k: int = 20, positive_only: bool = True) -> DataFrame:
    """The k largest cells of every column (ties broken by row label)."""
    x = m.filter(F.col("value") > 0) if positive_only else m
    w = Window.partitionBy("col").orderBy(F.desc("value"), F.asc("row"))
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
