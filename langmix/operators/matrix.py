"""Labelled matrices in coordinate form ``(row, col, value)``.

Zero cells are simply absent, so "drop all-zero rows/columns" is implicit and
memory grows with the non-zeros, not with rows x columns.  Wide layouts are
produced only for display/CSV (:func:`to_wide`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
UNKNOWN_LABELS = ("unknown", "unk")
# ---------------------------------------------------------------------------


def drop_zero_lines(m: DataFrame) -> DataFrame:
    """K5 (dense semantics): zero-fill, then drop rows and columns whose cells
    are all zero; zero cells inside kept rows/columns stay."""
    from pyspark.sql import Window
    nz = (F.col("value") != 0).cast("int")
    m = m.withColumn("_r", F.max(nz).over(Window.partitionBy("row"))) \
         .withColumn("_c", F.max(nz).over(Window.partitionBy("col")))
    return m.filter((F.col("_r") == 1) & (F.col("_c") == 1)).drop("_r", "_c")


def drop_labels(m: DataFrame, labels: Sequence[str] = UNKNOWN_LABELS) -> DataFrame:
    """K6: remove labels on both axes."""
    return m.filter(~F.col("row").isin(*labels) & ~F.col("col").isin(*labels))


def rename_labels(m: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename codes on both axes with a (code, mapped) table (broadcast:
    one row per code)."""
    mp = F.broadcast(mapping.select("code", "mapped"))
    out = (m.join(mp.withColumnRenamed("code", "row"), "row", "left")
           .withColumn("row", F.coalesce("mapped", "row")).drop("mapped"))
    return (out.join(mp.withColumnRenamed("code", "col"), "col", "left")
            .withColumn("col", F.coalesce("mapped", "col")).drop("mapped"))


def restrict(m: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """K7: keep cells whose row and column are both in ``labels``."""
    lab = labels.select(F.col(label_col).alias("_l")).distinct()
    return (m.join(lab.withColumnRenamed("_l", "row"), "row", "left_semi")
            .join(lab.withColumnRenamed("_l", "col"), "col", "left_semi"))


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """K9: restrict both matrices to the intersection of their row labels and
    of their column labels (per ``keys`` group, e.g. a similarity name)."""
    keys = list(keys)
    rows = a.select(*keys, "row").distinct().join(b.select(*keys, "row").distinct(), keys + ["row"])
    cols = a.select(*keys, "col").distinct().join(b.select(*keys, "col").distinct(), keys + ["col"])
    f = lambda m: m.join(rows, keys + ["row"], "left_semi").join(cols, keys + ["col"], "left_semi")
    return f(a), f(b)


def distance_to_similarity(m: DataFrame) -> DataFrame:
    """``1 - d``."""
    return m.withColumn("value", F.lit(1.0) - F.col("value"))


def symmetric(edges: DataFrame, a: str = "a", b: str = "b", value: str = "value") -> DataFrame:
    """Edge list (one triangle) -> both triangles as (row, col, value)."""
    e = edges.select(F.col(a).alias("row"), F.col(b).alias("col"), F.col(value).alias("value"))
    t = edges.select(F.col(b).alias("row"), F.col(a).alias("col"), F.col(value).alias("value"))
    return e.unionByName(t).distinct()


def to_wide(m: DataFrame, col_labels: Sequence[str]) -> DataFrame:
    """Pivot for display (explicit column list: no discovery job)."""
    return m.groupBy("row").pivot("col", list(col_labels)).agg(F.first("value"))
