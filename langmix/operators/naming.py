"""Model names and composite keys (T9, T10, D9, D7) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (naming conventions of the evaluation logs) ----------------
NAME_PREFIX = "mt5_"
NAME_SUFFIXES = ("_32_2layers_corrector", "_32_2layers_inverter", "_32_corrector", "_32_inverter", "_corrector", "_inverter")
RENAMED = {"ara-script": "arab-script"}
MULTI_WORD_SOURCES = ("complex_prompts", "dolly_human_edited", "aya_human_annotated", "native_prompts")
KEY_PARTS = ("idx", "llm", "task", "lang", "source")
MONOLINGUAL_KEYS = {"text2vec_cmn_Hani": ["cmn_Hani"], "gtr_deu_Latn": ["deu_Latn"], "alephbert_heb_Hebr": ["heb_Hebr"]}
GROUP_KEYS = {"turkic-fami": ["tur_Latn", "kaz_Cyrl"], "arab-script": ["arb_Arab", "heb_Hebr"],
              "latn-script": ["deu_Latn", "tur_Latn"], "cyrl-script": ["kaz_Cyrl", "mon_Cyrl"]}
GROUP_PREFIX = "me5_"
SCRIPT_CODES = {"arb": "arb_Arab", "cmn": "cmn_Hani", "deu": "deu_Latn", "guj": "guj_Gujr", "heb": "heb_Hebr", "hin": "hin_Deva",
                "jpn": "jpn_Jpan", "kaz": "kaz_Cyrl", "mon": "mon_Cyrl", "pan": "pan_Guru", "tur": "tur_Latn", "urd": "urd_Arab"}
STEP_ORDER = ("Labels", "Base", "Step1", "Step50+sbeam8")
# ---------------------------------------------------------------------------


def normalise_model(name: Column) -> Column:
    """Owner and family prefix and the architecture suffix go; renamed groups."""
    out = F.regexp_replace(F.regexp_replace(name, "^[^/]+/", ""), NAME_PREFIX, "")
    for s in NAME_SUFFIXES:
        out = F.replace(out, F.lit(s), F.lit(""))
    for a, b in RENAMED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_key(key: Column) -> list[Column]:
    """The five parts of a composite key; sources of several words stay whole."""
    for s in MULTI_WORD_SOURCES:
        key = F.replace(key, F.lit(s), F.lit(s.replace("_", "-")))
    parts = F.split(key, "_")
    return [F.get(parts, F.lit(i)).alias(p) for i, p in enumerate(KEY_PARTS)]


def training_languages(key: Column) -> Column:
    """Training languages of a normalised model key; NULL if no rule matches."""
    codes = F.create_map(*[x for k, v in SCRIPT_CODES.items() for x in (F.lit(k), F.lit(v))])
    rest = F.replace(key, F.lit(GROUP_PREFIX), F.lit(""))
    pair = F.array(F.element_at(codes, F.split_part(rest, F.lit("_"), F.lit(1))), F.element_at(codes, F.split_part(rest, F.lit("_"), F.lit(2))))
    several = F.contains(key, F.lit(GROUP_PREFIX))
    out = F.when(several & rest.contains("_") & (F.length(rest) == 7), pair) \
        .when(several & rest.contains("_") & (F.length(rest) == 8), F.array(rest))
    for k, v in GROUP_KEYS.items():
        out = out.when(several & (rest == k), F.array(*[F.lit(x) for x in v]))
    for k, v in MONOLINGUAL_KEYS.items():
        out = out.when(key == k, F.array(*[F.lit(x) for x in v]))
    return out


def flatten_steps(dist: DataFrame, keys, step_col: str, order_col: str) -> DataFrame:
    """D7 + D8: of several evaluations of one (keys, step) the distribution that
    stands: the last one of ``Labels``, the first one of every other step.

    dist: long form (keys, step, order, lang, p)."""
    keys = [*keys, step_col]
    first = dist.groupBy(*keys).agg(F.min(order_col).alias("_first"), F.max(order_col).alias("_last"))
    wins = first.select(*keys, F.when(F.col(step_col) == STEP_ORDER[0], F.col("_last")).otherwise(F.col("_first")).alias(order_col))
    return dist.join(wins, [*keys, order_col], "left_semi")


def edge_feature_mean(units: DataFrame, keys, training_col: str, eval_col: str, edges: DataFrame, value_col: str) -> DataFrame:
    """Mean edge value over the (training, eval) pairs that have an edge, -1 if
    none has.  edges: (a, b, value), one row per unordered pair."""
    keys = list(keys)
    t = units.select(*keys, eval_col, F.explode(training_col).alias("_t")) \
        .withColumn("a", F.least("_t", eval_col)).withColumn("b", F.greatest("_t", eval_col))
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(value_col).alias("_v"))
    got = t.join(e, ["a", "b"], "left").groupBy(*keys).agg(F.avg("_v").alias("_m"))
    return units.join(got, keys, "left").select(*keys, F.coalesce("_m", F.lit(-1.0)).alias(value_col))


def one_hot(df: DataFrame, col: str, classes, prefix: str) -> DataFrame:
    """A 0/1 column for each class."""
    return df.select("*", *[F.when(F.col(col) == c, 1).otherwise(0).alias(f"{prefix}{c}") for c in classes])


def two_digits(x: Column) -> Column:
    """Two significant digits as text (0.0 stays 0.0; NULL stays NULL)."""
    scale = F.pow(F.lit(10.0), F.lit(1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit("0.0")).otherwise((F.round(x * scale) / scale).cast("string"))
