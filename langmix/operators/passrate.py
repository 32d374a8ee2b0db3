"""Line and word pass rates.

Per completion one aggregate over its qualifying lines; per group the rates;
roll-ups are *staged* macro means (a grand mean is the mean of the
per-language means), built from the small group table, not from raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions import text as tx
from langmix.operators import bloom
from langmix.session import cut_lineage

# --- fixed values -----------------------------------------------------------
# Languages for which the word pass rate is reported by default.
WPR_LANGS = ("ar", "hi", "ja", "ko", "ru", "zh")
ALL = "all"
# ---------------------------------------------------------------------------


def dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word) - lower-case alphabetic words longer than 3 characters."""
    w = texts.select(F.explode(tx.whitespace_tokens(tx.normalize_completion(text_col))).alias("word"))
    return w.filter(tx.is_dictionary_word("word")).distinct()


def completion_checks(comps: DataFrame, lines: DataFrame, words: DataFrame, keys: Sequence[str],
                      lang_col: str = "language", raw_lines: DataFrame | None = None) -> DataFrame:
    """P1/P2 per completion: n_lines, n_err, line_error, word_error.

    ``lines`` are the qualifying lines (>= 5 tokens) with ``pred_lang`` and
    ``tokens``; a completion without qualifying lines is skipped (n_lines 0).
    ``raw_lines``: the same lines before labelling, for the dictionary join.  Tokens
    are tested against a Bloom filter of the dictionary where they are read; only
    those that pass are shuffled to meet it."""
    keys = list(keys)
    stats = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("pred_lang") != F.col(lang_col)).alias("n_err"))
    words = cut_lineage(words)
    known = bloom.build(words, "word")
    hits = ((lines if raw_lines is None else raw_lines).select("id", F.explode("tokens").alias("word"))
            .filter(known.may_hold(F.col("word"))).join(words, "word", "left_semi").select("id").distinct()
            .withColumn("dict_hit", F.lit(True)))
    c = (comps.select(*keys).join(stats, keys, "left").join(hits, "id", "left")
         .fillna(0, subset=["n_lines", "n_err"]).fillna(False, subset=["dict_hit"]))
    return c.select(*keys, "n_lines", "n_err",
                    (F.col("n_err") > 0).alias("line_error"),
                    ((F.col("n_err") == 0) & (F.col("n_lines") > 0) & F.col("dict_hit")).alias("word_error"))


def group_rates(checks: DataFrame, group_keys: Sequence[str], lang_col: str = "language",
                wpr_langs: Sequence[str] = WPR_LANGS) -> DataFrame:
    """P3-P5 per group: acc, lpr and (for ``wpr_langs``) wpr."""
    non_skipped = F.count_if(F.col("n_lines") > 0)
    line_err = F.count_if(F.col("line_error"))
    word_err = F.count_if(F.col("word_error"))
    acc_c = F.when(F.col("n_lines") > 0, F.lit(1.0) - F.col("n_err") / F.col("n_lines"))
    g = checks.groupBy(*group_keys).agg(
        F.coalesce(F.avg(acc_c), F.lit(1.0)).alias("acc"),
        (F.lit(1.0) - line_err / F.greatest(F.lit(1), non_skipped)).alias("lpr"),
        (F.lit(1.0) - word_err / F.greatest(F.lit(1), non_skipped - line_err)).alias("wpr_all"))
    return g.select(*group_keys, "acc", "lpr",
                    F.when(F.col(lang_col).isin(*wpr_langs), F.col("wpr_all")).alias("wpr"))


def rollup(rates: DataFrame, outer: Sequence[str], source_col: str = "source",
           lang_col: str = "language", metrics=("acc", "lpr", "wpr"), decimals: int = 6) -> DataFrame:
    """(source, lang), (source, all), (all, lang), (all, all) as staged
    unweighted means; NULL metrics (e.g. wpr) are ignored."""
    outer = list(outer)
    r = lambda c: F.round(c, decimals)
    base = rates.select(*outer, source_col, lang_col, *[r(F.col(m)).alias(m) for m in metrics])
    per_source = rates.groupBy(*outer, source_col).agg(*[F.avg(m).alias(m) for m in metrics])
    per_lang = rates.groupBy(*outer, lang_col).agg(*[F.avg(m).alias(m) for m in metrics])
    grand = per_lang.groupBy(*outer).agg(*[F.avg(m).alias(m) for m in metrics])
    return base.unionByName(
        per_source.select(*outer, source_col, F.lit(ALL).alias(lang_col), *[r(F.col(m)).alias(m) for m in metrics])
    ).unionByName(
        per_lang.select(*outer, F.lit(ALL).alias(source_col), lang_col, *[r(F.col(m)).alias(m) for m in metrics])
    ).unionByName(
        grand.select(*outer, F.lit(ALL).alias(source_col), F.lit(ALL).alias(lang_col),
                     *[r(F.col(m)).alias(m) for m in metrics]))


def report(rolled: DataFrame, metric: str = "lpr", model_col: str = "model", lang_col: str = "language",
           source_col: str = "source", exclude_models: Sequence[str] = ()) -> DataFrame:
    """P10: per-language rows (source = all, language != all), base models
    excluded, nulls dropped, mean over the remaining keys x 100."""
    r = rolled.filter((F.col(source_col) == ALL) & (F.col(lang_col) != ALL) & F.col(metric).isNotNull())
    if exclude_models:
        r = r.filter(~F.col(model_col).isin(*exclude_models))
    return r.groupBy(model_col, lang_col).agg(F.round(F.avg(metric) * 100, 6).alias(f"{metric}_pct"))
