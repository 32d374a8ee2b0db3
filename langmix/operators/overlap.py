"""Overlap quality of a prediction against its reference.

Both sides of a pair lie in one row, so nothing is shuffled: token-set scores use
array set functions, n-gram overlap intersects the two multisets in an Arrow function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-20  # fixed value: guard of the reference's ratios


def token_set_scores(pairs: DataFrame, keys: Sequence[str], ref_col: str = "ref_tokens",
                     pred_col: str = "pred_tokens") -> DataFrame:
    """O1: precision = TP/|ref set|, recall = TP/|pred set| (the reference's
    naming), F1; plus the token counts."""
    ref_s, pred_s = F.array_distinct(ref_col), F.array_distinct(pred_col)
    tp = F.size(F.array_intersect(ref_s, pred_s))
    p = tp / (F.size(ref_s) + F.lit(EPS))
    r = tp / (F.size(pred_s) + F.lit(EPS))
    out = pairs.select(*keys, p.alias("precision"), r.alias("recall"),
                       F.size(ref_col).alias("num_true_words"), F.size(pred_col).alias("num_pred_words"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall")
                          / (F.col("precision") + F.col("recall") + F.lit(EPS)))


def ngram_matches(pairs: DataFrame, keys: Sequence[str], ns=(1, 2, 3), ref_col: str = "ref_tokens",
                  pred_col: str = "pred_tokens") -> DataFrame:
    """O2: overlapping n-gram count per pair and n, ``sum(min(count_a, count_b))``."""
    ns = list(ns)

    def common(a: list | None, b: list | None, n: int) -> int:
        x, y = (Counter(zip(*[(t or [])[k:] for k in range(n)])) for t in (a, b))
        return sum((x & y).values())

    def work(batches):
        for batch in batches:
            sides = list(zip(*[batch.column(k).to_pylist() for k in (batch.num_columns - 2, batch.num_columns - 1)]))
            found = [pa.array([common(a, b, n) for a, b in sides], pa.int64()) for n in ns]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], names=[*batch.schema.names[:-2], *[f"n_ngrams_match_{n}" for n in ns]])

    rows = pairs.select(*keys, ref_col, pred_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    return rows.mapInArrow(work, ", ".join([*fields, *[f"n_ngrams_match_{n} long" for n in ns]]))


def summarize(scores: DataFrame, group_keys: Sequence[str] = (), decimals: int = 6) -> DataFrame:
    """Means of the pair metrics and the standard error of F1."""
    r = lambda c: F.round(c, decimals)
    aggs = [r(F.avg("precision")).alias("token_set_precision"), r(F.avg("recall")).alias("token_set_recall"),
            r(F.avg("f1")).alias("token_set_f1"),
            r(F.stddev_samp("f1") / F.sqrt(F.count(F.lit(1)))).alias("token_set_f1_sem"),
            r(F.avg("n_ngrams_match_1")).alias("n_ngrams_match_1"),
            r(F.avg("n_ngrams_match_2")).alias("n_ngrams_match_2"),
            r(F.avg("n_ngrams_match_3")).alias("n_ngrams_match_3"),
            r(F.avg("num_true_words")).alias("num_true_words"),
            r(F.avg("num_pred_words")).alias("num_pred_words"),
            F.count(F.lit(1)).alias("n_pairs")]
    if group_keys:
        return scores.groupBy(*group_keys).agg(*aggs)
    return scores.agg(*aggs)
