"""Entropy family over long-form distributions.

Every variant is one ``groupBy(unit)`` of conditional sums, so all variants of
one unit come out of a single aggregation (map-side partial sums, one shuffle).
Natural log unless noted; p > 0 is guaranteed upstream (D1/D2 drop zeros).
The entropy of an empty set is defined as 0.0 (the reference depends on the
library version here).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANTS = ("entropy_all", "entropy_out", "entropy_out_expected", "reweighted_entropy",
            "reweighted_entropy_expected", "weighted_entropy")


def _shannon(mask: Column | None = None) -> Column:
    """H(p/S) = ln S - sum(p ln p)/S over the rows selected by ``mask``."""
    p = F.col("p") if mask is None else F.when(mask, F.col("p"))
    s = F.sum(p)
    plnp = F.sum(p * F.ln(p))
    return F.when(s > 0, F.ln(s) - plnp / s).otherwise(F.lit(0.0))


def _in_expected_or_training(expected_col: str, training_col: str | None) -> Column:
    m = F.col("lang") == F.col(expected_col)
    if training_col:
        m = m | F.array_contains(F.col(training_col), F.col("lang"))
    return m


def entropy_columns(expected_col: str = "expected", training_col: str | None = "training") -> dict[str, Column]:
    """Aggregate expressions for every variant (use inside ``groupBy(...).agg``)."""
    inside = _in_expected_or_training(expected_col, training_col)
    is_exp = F.col("lang") == F.col(expected_col)
    p, lnp = F.col("p"), F.ln(F.col("p"))
    return {
        # E1
        "entropy_all": _shannon(),
        # Outside expected and training languages
        "entropy_out": _shannon(~inside),
        # Outside the expected language only
        "entropy_out_expected": _shannon(~is_exp),
        # Reweighted, training-aware
        "reweighted_entropy": F.sum(-F.when(inside, 1 - p).otherwise(p) * lnp),
        # E5: reweighted, expected only
        "reweighted_entropy_expected": F.sum(-F.when(is_exp, 1 - p).otherwise(p) * lnp),
        # Outside-mass weighted
        "weighted_entropy": (-(F.lit(1.0) - F.coalesce(F.sum(F.when(inside, p)), F.lit(0.0)))
                             * F.coalesce(F.sum(F.when(~inside, lnp)), F.lit(0.0))) + F.lit(0.0),
    }


def entropies(dist: DataFrame, keys: Sequence[str], expected_col: str = "expected",
              training_col: str | None = "training", variants: Sequence[str] = VARIANTS,
              decimals: int | None = 6) -> DataFrame:
    """E1-E6 (E8 = pick ``variants``): one row per unit.  ``decimals=None``
    keeps full precision (use it when the values are averaged further, so that
    rounding ties are not created before the mean)."""
    keys = list(keys)
    cols = entropy_columns(expected_col, training_col)
    group = keys + [c for c in (expected_col, training_col) if c and c not in keys]
    aggs = [(cols[v] if decimals is None else F.round(cols[v], decimals)).alias(v) for v in variants]
    return dist.groupBy(*group).agg(*aggs)


def norm_entropy_base2(values: DataFrame, keys: Sequence[str], value_col: str = "v") -> DataFrame:
    """Normalise a list of values by its sum, skip zeros, base-2 entropy."""
    keys = list(keys)
    v = F.when(F.col(value_col) > 0, F.col(value_col))
    s = F.sum(F.col(value_col))
    h = F.log2(s) - F.sum(v * F.log2(v)) / s
    return values.groupBy(*keys).agg(F.round(F.when(s > 0, h), 6).alias("norm_entropy"))


def mean_by(ent: DataFrame, keys: Sequence[str], value_cols: Sequence[str], decimals: int = 6) -> DataFrame:
    """Mean entropy by any key set (one shuffle, several averages)."""
    return ent.groupBy(*keys).agg(*[F.round(F.avg(c), decimals).alias(f"mean_{c}") for c in value_cols])


def training_key(training_col: str = "training") -> Column:
    """Key of a training set = sorted languages joined by '_'."""
    return F.array_join(F.array_sort(F.col(training_col)), "_")


def complete_steps(df: DataFrame, keys: Sequence[str], step_col: str, n_steps: int) -> DataFrame:
    """Keep units that have exactly ``n_steps`` rows (one per step)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == n_steps).drop("_n")


def setting_filter(df: DataFrame, setting: str, expected_col: str = "expected",
                   training_col: str = "training") -> DataFrame:
    """crosslingual = expected not in training; monolingual = in training; else all."""
    flag = F.array_contains(F.col(training_col), F.col(expected_col))
    if setting == "crosslingual":
        return df.filter(~flag)
    if setting == "monolingual":
        return df.filter(flag)
    return df
