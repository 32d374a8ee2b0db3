"""Statistics.

Correlations are aggregates over the whole table; ranks and quantiles come from
:mod:`langmix.operators.ranking`; only the k x k result (k = number of measures)
is turned back into rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.operators.ranking import average_ranks, exact_quantiles, looked_up
from langmix.session import cut_lineage


def pearson_long(df: DataFrame, cols: Sequence[str], decimals: int = 6, with_n: bool = False) -> DataFrame:
    """M4 (+M3 lower triangle): Pearson r for every pair a < b (by position),
    on the rows where both are known; NULL if one is constant there (guards N11)."""
    pairs = list(combinations(cols, 2))
    aggs = []
    for a, b in pairs:
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
        aggs += [F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias(f"{a}__{b}"), F.count(x).alias(f"{a}__{b}__n")]
    wide = df.agg(*aggs)
    stack = wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r"), F.col(f"{a}__{b}__n").alias("n")) for a, b in pairs
    ])).alias("x"))
    return stack.select("x.a", "x.b", F.round("x.r", decimals).alias("r"), *["x.n"] * with_n)


def spearman_long(df: DataFrame, cols: Sequence[str], decimals: int = 6, with_n: bool = False) -> DataFrame:
    """M1 (+M3): Spearman rho = Pearson r of the average ranks, each pair on the
    rows where both are known.  Measures without missing values share one ranking;
    pairs with missing values are ranked on their own rows.  One job ranks all of
    them (:func:`langmix.operators.ranking.average_ranks`); ranks are looked up by value."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    missing = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    whole = [c for c in cols if not missing[c]]
    groups = [whole] if len(whole) > 1 else []
    groups += [[a, b] for a, b in combinations(cols, 2) if missing[a] or missing[b]]
    wide = [F.when(reduce(and_, [F.col(x).isNotNull() for x in group]), F.col(c)).alias(f"{k}:{c}") for k, group in enumerate(groups) for c in group]
    ranks = cut_lineage(average_ranks(rows.select(*wide).unpivot([], [f"{k}:{c}" for k, group in enumerate(groups) for c in group], "measure", "v")))
    sizes = {r["measure"]: r["count"] for r in ranks.groupBy("measure").count().collect()}
    out = None
    for k, group in enumerate(groups):
        ranked = rows.select(*group).na.drop()
        for c in group:
            one = ranks.where(F.col("measure") == f"{k}:{c}").select(F.col("v").alias(c), F.col("rank").alias(f"_r_{c}"))
            ranked = looked_up(ranked, one, c, sizes.get(f"{k}:{c}", 0))
        r = pearson_long(ranked.select(*[F.col(f"_r_{c}").alias(c) for c in group]), group, decimals, with_n)
        out = r if out is None else out.unionByName(r)
    return out


def describe_long(df: DataFrame, cols: Sequence[str], decimals: int = 6) -> DataFrame:
    """Count, mean, std (sample), min, max per measure (unpivot + one aggregate)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "measure", "v")
    r = lambda c: F.round(c, decimals)
    return long.groupBy("measure").agg(F.count("v").alias("n"), r(F.avg("v")).alias("mean"),
                                       r(F.stddev_samp("v")).alias("std"), r(F.min("v")).alias("min"),
                                       r(F.max("v")).alias("max"))


BOX_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def box_summary(df: DataFrame, keys: Sequence[str], col: str, decimals: int = 6) -> DataFrame:
    """Exact 5/25/50/75/95 percentiles per group, by selection."""
    g = exact_quantiles(df, keys, col, BOX_QUANTILES)
    return g.select(*keys, *[F.round(f"q{i}", decimals).alias(f"p{round(100 * q):02d}") for i, q in enumerate(BOX_QUANTILES)])


def histogram(df: DataFrame, col: str, bins: int = 5, decimals: int = 6) -> DataFrame:
    """Equal-width bins between min and max (max falls in the last bin)."""
    mn, mx = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    width = (mx - mn) / bins
    b = F.least(F.floor(F.try_divide(F.col(col) - mn, width)), F.lit(bins - 1)).cast("int")
    h = df.filter(F.col(col).isNotNull()).groupBy(F.coalesce(b, F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    return h.select("bin", F.round(mn + F.col("bin") * width, decimals).alias("lo"),
                    F.round(mn + (F.col("bin") + 1) * width, decimals).alias("hi"), "n")


# ---- M2: two-sided p-value of a correlation (Student t), small helper -------

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((a + m2 - 1) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1 - x) / b


def corr_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of H0: rho = 0 with t = r sqrt((n-2)/(1-r^2)), df = n - 2."""
    if r is None or n is None or n < 3 or (isinstance(r, float) and math.isnan(r)):
        return None
    if abs(r) >= 1.0:
        return 0.0
    df_ = n - 2
    t = r * math.sqrt(df_ / (1 - r * r))
    return incomplete_beta(df_ / 2.0, 0.5, df_ / (df_ + t * t))


def stars(p: float | None) -> str:
    """M2: ``*`` <= .05, ``**`` <= .01, ``***`` <= .001."""
    if p is None:
        return ""
    return "***" if p <= 0.001 else "**" if p <= 0.01 else "*" if p <= 0.05 else ""


def with_significance(corr: DataFrame) -> DataFrame:
    """M2 on a (small) correlation table with each pair's number of rows ``n``:
    p-value and stars per pair, computed in an Arrow-batched pandas function (the
    t distribution is not a built-in)."""
    import pandas as pd

    def fn(it):
        for pdf in it:
            p = [corr_p_value(None if pd.isna(r) else float(r), int(n)) for r, n in zip(pdf["r"], pdf["n"])]
            yield pdf.drop(columns="n").assign(p_value=p, stars=[stars(x) for x in p])

    return corr.mapInPandas(fn, "a string, b string, r double, p_value double, stars string")
