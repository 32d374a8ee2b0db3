"""Language distributions in long form.

A distribution is a set of rows ``(unit keys..., lang, p)``; map columns are
only produced at the edges (:func:`to_map`).  All operators are aggregates or
windows keyed by the unit, so they shuffle on the unit key only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmix.operators.lid import OTHERS, UNKNOWN

# --- fixed values -----------------------------------------------------------
RATIO_DECIMALS = 2            # ratios are rounded to 2 decimals
PRUNE_LABELS = (UNKNOWN, OTHERS)
PRUNE_MIN_P = 0.05            # D3 keeps p > 0.05
UNK = "unk"                   # D4 residual label
OFF_TARGET_MIN_P = 0.01       # D13/D14 keep p > / >= 0.01
# ---------------------------------------------------------------------------


def ratios(labelled: DataFrame, keys: Sequence[str], label_col: str = "pred_lang", count_col: str | None = None) -> DataFrame:
    """``round(count/total, 2)`` per unit, zeros dropped.  ``count_col``: how
    many labels a row stands for (default: one).

    One pre-aggregated count per (unit, lang), then a unit window - the window
    only sees one row per language of a unit."""
    keys = list(keys)
    cnt = labelled.groupBy(*keys, F.col(label_col).alias("lang")).agg(
        (F.sum(count_col) if count_col else F.count(F.lit(1))).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*keys))
    out = cnt.select(*keys, "lang", F.round(F.col("n") / tot, RATIO_DECIMALS).alias("p"))
    return out.filter(F.col("p") > 0)


def prune(dist: DataFrame, min_p: float = PRUNE_MIN_P, drop_labels=PRUNE_LABELS) -> DataFrame:
    """D3: drop unknown/others and p <= 0.05."""
    return dist.filter(~F.col("lang").isin(*drop_labels) & (F.col("p") > min_p))


def complete_unknown(dist: DataFrame, keys: Sequence[str], units: DataFrame | None = None) -> DataFrame:
    """Add ``unk = round(1 - sum(p), 2)`` when positive.  ``units``: all units,
    so that one with an empty distribution gets ``unk`` = 1."""
    keys = list(keys)
    sums = dist.groupBy(*keys).agg(F.sum("p").alias("s"))
    if units is not None:
        sums = units.select(*keys).distinct().join(sums, keys, "left")
    resid = (sums.select(*keys, F.round(F.lit(1.0) - F.coalesce("s", F.lit(0.0)), RATIO_DECIMALS).alias("p"))
             .filter(F.col("p") > 0).select(*keys, F.lit(UNK).alias("lang"), "p"))
    return dist.select(*keys, "lang", "p").unionByName(resid)


def first_values(dist_lists: DataFrame) -> DataFrame:
    """D5 (first step): map<lang, array<double>> -> map<lang, double> (first value)."""
    return dist_lists.withColumn("dist", F.transform_values("dist", lambda k, v: F.element_at(v, 1)))


def to_map(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form -> one ``map<string,double>`` per unit (for JSON output)."""
    return dist.groupBy(*keys).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("lang", "p")))).alias("dist"))


def append_merge(dist: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """List of values per (unit, lang) across inputs, ordered by ``order_col``."""
    return (dist.groupBy(*keys, "lang")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("p").alias("v"))))
                 .alias("vals"))
            .select(*keys, "lang", F.transform("vals", lambda x: x["v"]).alias("ps")))


def keep_one(df: DataFrame, keys: Sequence[str], order_col: str, last: bool = False) -> DataFrame:
    """First-wins (or last-wins) per key by input order; one pre-aggregated
    row per key meets in a task, however many rows repeat it."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), F.col(order_col)).alias("_row")).select("_row.*")


def widen(dist: DataFrame, keys: Sequence[str], targets: Sequence[str], units: DataFrame | None = None) -> DataFrame:
    """One column per target language (missing 0) plus ``other = 1 - sum``,
    for all ``units`` (default: those with a distribution).

    The explicit value list keeps ``pivot`` from running a discovery job."""
    keys = list(keys)
    wide = (dist.filter(F.col("lang").isin(*targets)).groupBy(*keys)
            .pivot("lang", list(targets)).agg(F.first("p")))
    base = (dist if units is None else units).select(*keys).distinct()
    wide = base.join(wide, keys, "left").fillna(0.0, subset=list(targets))
    total = sum((F.col(t) for t in targets[1:]), F.col(targets[0]))
    return wide.withColumn("other", F.round(F.lit(1.0) - total, 6))


def lang_set_frequency(dist: DataFrame, keys: Sequence[str], expected_col: str | None = None) -> DataFrame:
    """Frequency of each predicted-language set (sorted, '_'-joined),
    optionally suffixed with the expected language."""
    keys = list(keys)
    s = dist.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("lang")), "_").alias("lang_set"))
    if expected_col:
        s = s.withColumn("lang_set", F.concat_ws("_", "lang_set", F.col(expected_col)))
    return s.groupBy("lang_set").agg(F.count(F.lit(1)).alias("n_units"))


def multi_language_units(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units whose distribution has more than one language."""
    return dist.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_langs")).filter("n_langs > 1")


def extra_languages(dist: DataFrame, keys: Sequence[str], expected_col: str, training_col: str,
                    exclude: str = "en") -> DataFrame:
    """set(pred) - (training + expected); keep non-empty sets without ``exclude``."""
    keys = list(keys)
    s = dist.groupBy(*keys).agg(F.collect_set("lang").alias("pred"))
    extra = F.array_sort(F.array_except("pred", F.array_union(F.col(training_col),
                                                              F.array(F.col(expected_col)))))
    out = s.select(*keys, extra.alias("extra"))
    return out.filter((F.size("extra") > 0) & ~F.array_contains("extra", exclude))


def unit_ranking(dist: DataFrame) -> DataFrame:
    """Number of units per language."""
    return dist.groupBy("lang").agg(F.count(F.lit(1)).alias("n_units"))


def off_target(dist: DataFrame, expected_col: str, training_col: str, step_col: str,
               n_steps: int) -> DataFrame:
    """Mean p of languages neither expected nor in training, per step;
    languages kept when they have a mean for all ``n_steps`` steps and every
    mean is > 0.01 (the reference left-joins steps and drops gaps)."""
    off = dist.filter((F.col("lang") != F.col(expected_col)) & ~F.array_contains(training_col, F.col("lang")))
    m = off.groupBy("lang", step_col).agg(F.avg("p").alias("mean_p"))
    keep = (m.groupBy("lang").agg(F.min("mean_p").alias("mn"), F.count(F.lit(1)).alias("ns"))
            .filter((F.col("mn") > OFF_TARGET_MIN_P) & (F.col("ns") == n_steps)))
    return m.join(keep.select("lang"), "lang", "left_semi")


def probability_pool(dist: DataFrame) -> DataFrame:
    """Pool of probabilities per language (>= 0.01), summarised."""
    return (dist.filter(F.col("p") >= OFF_TARGET_MIN_P).groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"),
                 F.round(F.max("p"), 6).alias("max_p")))
