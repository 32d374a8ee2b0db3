"""Typology-style categorical features and pair features (Y1-Y16), long form
``(node, feature, value)`` with missing = NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.operators.ranking import prefix_sums


def encode_first_appearance(t: DataFrame, order_col: str) -> DataFrame:
    """Per feature, categories numbered 0.. in order of first appearance
    (by ``order_col``); missing values stay NULL (N10)."""
    first = (t.filter(F.col("value").isNotNull()).groupBy("feature", "value")
             .agg(F.min(order_col).alias("_first")))
    w = Window.partitionBy("feature").orderBy("_first", "value")
    codes = first.withColumn("code", F.dense_rank().over(w) - 1).drop("_first")
    return t.join(codes, ["feature", "value"], "left")


def crop_nodes(t: DataFrame, perc: float, n_features: int) -> DataFrame:
    """Y2: keep nodes with present features >= perc x number of features."""
    keep = (t.groupBy("node").agg(F.count("value").alias("present"))
            .filter(F.col("present") >= perc * n_features))
    return t.join(keep.select("node"), "node", "left_semi")


def features_with_coverage(t: DataFrame, share: float) -> DataFrame:
    """Y3 (share < 1) / Y4 (share = 1): features present for >= share of nodes."""
    n_nodes = t.agg(F.countDistinct("node")).scalar()
    keep = (t.groupBy("feature").agg(F.count("value").alias("present"))
            .filter(F.col("present") >= F.lit(share) * n_nodes))
    return t.join(keep.select("feature"), "feature", "left_semi")


def pair_match(t: DataFrame, value_col: str = "code") -> DataFrame:
    """For every node pair a < b and feature: 1 equal, 0 different,
    -1 when either is missing.  Pairs per feature are bounded by the node set."""
    a = t.select(F.col("node").alias("a"), "feature", F.col(value_col).alias("va"))
    b = t.select(F.col("node").alias("b"), F.col("feature").alias("_f"), F.col(value_col).alias("vb"))
    j = a.join(b, (F.col("feature") == F.col("_f")) & (F.col("a") < F.col("b")))
    m = (F.when(F.col("va").isNull() | F.col("vb").isNull(), F.lit(-1))
         .when(F.col("va") == F.col("vb"), F.lit(1)).otherwise(F.lit(0)))
    return j.select("a", "b", "feature", m.alias("match"))


def or_combine(matches: DataFrame, keys, value_col: str = "match") -> DataFrame:
    """Combine several matches: -1 if any missing, else 1 if any 1, else 0."""
    return matches.groupBy(*keys).agg(
        F.when(F.min(value_col) == -1, F.lit(-1)).when(F.max(value_col) == 1, F.lit(1)).otherwise(F.lit(0))
        .alias(value_col))


def drop_uninformative(matches: DataFrame, keys, value_col: str = "match") -> DataFrame:
    """Drop keys whose every feature value is -1."""
    keep = matches.groupBy(*keys).agg(F.max(value_col).alias("_mx")).filter(F.col("_mx") > -1)
    return matches.join(keep.drop("_mx"), list(keys), "left_semi")


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Sorted distinct values -> 0..n-1: the number of distinct values before
    each one, over range partitions."""
    vals = df.select(F.lit(0).alias("_all"), F.col(col).alias("_value"), F.lit(1).alias("_one")).distinct().filter(F.col("_value").isNotNull())
    codes = prefix_sums(vals, "_all", "_value", "_one").select(F.col("_value").alias(col), F.col("before").alias(out))
    return df.join(codes, col, "left")


def missing_to_null(df: DataFrame, cols, marker: int = -1) -> DataFrame:
    """Marker -> NULL, then drop rows with a NULL."""
    for c in cols:
        df = df.withColumn(c, F.nullif(F.col(c), F.lit(marker)))
    return df.na.drop(subset=list(cols))


def hash_split(df: DataFrame, key_col: str, train_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """Reproducible split by a hash of the key (not by row order)."""
    b = F.pmod(F.xxhash64(F.col(key_col)), F.lit(100))
    return df.filter(b < train_pct), df.filter(b >= train_pct)


def attribute_matches(units: DataFrame, keys, training_col: str, eval_col: str, attrs: DataFrame) -> DataFrame:
    """Y9 + Y10: per unit, 1 if any training language shares the eval language's
    script (code suffix), family, word order (``ND`` matches all) or script
    direction; plus whether the first two training languages share direction
    (1 for a single training language).  The attribute table is a fixed
    dimension (one row per language), broadcast."""
    keys = list(keys)
    a = F.broadcast(attrs)
    t = units.select(*keys, eval_col, F.posexplode(training_col).alias("_pos", "_t"))
    ta = a.select(F.col("code").alias("_t"), F.col("family").alias("tf"), F.col("word_order").alias("tw"),
                  F.col("direction").alias("td"))
    ea = a.select(F.col("code").alias(eval_col), F.col("family").alias("ef"), F.col("word_order").alias("ew"),
                  F.col("direction").alias("ed"))
    j = t.join(ta, "_t", "left").join(ea, eval_col, "left")
    script = (F.split_part(F.col("_t"), F.lit("_"), F.lit(2)) == F.split_part(F.col(eval_col), F.lit("_"), F.lit(2)))
    wo = (F.col("tw") == "ND") | (F.col("ew") == "ND") | (F.col("tw") == F.col("ew"))
    b = lambda c: F.max(F.when(c, 1).otherwise(0)).alias
    g = j.groupBy(*keys, eval_col).agg(
        b(script)("script"), b(F.col("tf") == F.col("ef"))("family"), b(wo)("word_order"),
        b(F.col("td") == F.col("ed"))("script_lr"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_pos") == 0, F.col("td"))).alias("_d0"),
        F.max(F.when(F.col("_pos") == 1, F.col("td"))).alias("_d1"))
    y10 = F.when(F.col("_n") == 1, 1).when(F.col("_d0") == F.col("_d1"), 1).otherwise(0)
    return g.select(*keys, eval_col, "script", "family", "word_order", "script_lr",
                    y10.alias("training_script_lr"))
