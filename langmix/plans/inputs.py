"""Derived inputs: the driver tables re-cast as the reference's data model.

* completions ``(id, model, task, source, language, training, completion)``
  come from ``documents``: ``language`` is the labelled language (the expected
  language), ``model`` and ``task`` are synthetic keys derived from ``doc_id``
  (``m0..m3``; even ids ``monolingual``, odd ids ``crosslingual``) and each
  model has a set of one to three training languages.  No row is dropped by
  these keys.
* the LID model is trained on the labelled rows of ``documents`` (text, lang)
  once per session and input folder, and checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions import text as tx
from langmix.operators import lid
from langmix.sources.tables import load, spread

# --- fixed values -----------------------------------------------------------
N_MODELS = 4
# training languages of each model, in order
TRAINING_LANGS = {"m0": ("en",), "m1": ("de", "en"), "m2": ("fr",), "m3": ("de", "es", "fr")}
# ---------------------------------------------------------------------------

_MODELS: dict[tuple, lid.LidModel] = {}


def training_of(model: Column) -> Column:
    """Array of the training languages of a model column."""
    out = F.array().cast("array<string>")
    for m, langs in TRAINING_LANGS.items():
        out = F.when(model == m, F.array(*[F.lit(x) for x in langs])).otherwise(out)
    return out


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions_from(spread(load(spark, sf_dir, "documents")))


def completions_from(d: DataFrame) -> DataFrame:
    """Completion rows from any ``documents``-shaped DataFrame (batch or micro-batch)."""
    model = F.concat(F.lit("m"), F.pmod(F.col("doc_id"), F.lit(N_MODELS)).cast("string"))
    return d.select(
        F.col("doc_id").alias("id"),
        model.alias("model"),
        F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, "monolingual").otherwise("crosslingual").alias("task"),
        "source",
        F.col("lang").alias("language"),
        training_of(model).alias("training"),
        F.col("text").alias("completion"),
    )


UNIT_KEYS = ["id", "model", "task", "source", "language"]


def lid_model(spark: SparkSession, sf_dir: str) -> lid.LidModel:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    m = _MODELS.get(key)
    if m is None:
        m = lid.train(spread(load(spark, sf_dir, "documents").select("text", "lang")))
        _MODELS[key] = m
    return m


def distribution_lines(comp: DataFrame) -> DataFrame:
    """T1 -> T2 -> T4: kept lines (> 5 characters) with their index among kept lines."""
    return comp.select(*UNIT_KEYS, "training",
                       F.posexplode(tx.kept_lines(tx.normalize_completion("completion"))).alias("indice", "line"))


def labelled_lines(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Every kept line labelled with the cascade detector."""
    lines = distribution_lines(completions(spark, sf_dir))
    return lid.label_column(lines, "line", lid_model(spark, sf_dir), mode="cascade", threshold=threshold)


def labelled_tokens(lines: DataFrame, spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Tokens of every line, each token labelled (no shuffle while the votes are broadcast)."""
    toks = lines.select("*", tx.tokenize("line").alias("tokens")).drop("line")
    if lid_model(spark, sf_dir).votes is None:
        flat = toks.select(*toks.drop("tokens").columns, F.explode("tokens").alias("token"))
        return lid.label_column(flat, "token", lid_model(spark, sf_dir), out_col="token_lang", mode="cascade", threshold=threshold)
    out = lid.label_array(toks, "tokens", lid_model(spark, sf_dir), mode="cascade", threshold=threshold)
    return out.select("*", F.explode(F.arrays_zip("tokens", "langs")).alias("_t")) \
        .select(*toks.drop("tokens").columns, F.col("_t.tokens").alias("token"), F.col("_t.langs").alias("token_lang"))


def label_counts(lines: DataFrame, spark: SparkSession, sf_dir: str, line_level: bool = False, threshold: float = 0.3) -> DataFrame:
    """L6, counted: (unit keys, level, lang, n), how many tokens of each labelled line have
    a language (unknown ones left out, as are lines of unknown language); with
    ``line_level`` also the line's own label.  One pass over the lines."""
    known = F.col("pred_lang") != lid.UNKNOWN
    if lid_model(spark, sf_dir).votes is None:
        toks = labelled_tokens(lines.filter(known), spark, sf_dir, threshold).filter(F.col("token_lang") != lid.UNKNOWN)
        words = toks.select(*UNIT_KEYS, F.lit("word").alias("level"), F.col("token_lang").alias("lang"), F.lit(1).cast("long").alias("n"))
        own = lines.select(*UNIT_KEYS, F.lit("line").alias("level"), F.col("pred_lang").alias("lang"), F.lit(1).cast("long").alias("n"))
        return own.unionByName(words) if line_level else words
    # no filter on the label: pushed below the detector, it would label every line once more
    toks = lines.select(*UNIT_KEYS, "pred_lang", F.when(known, tx.tokenize("line")).otherwise(F.array().cast("array<string>")).alias("tokens"))
    out = lid.count_array(toks, "tokens", lid_model(spark, sf_dir), mode="cascade", threshold=threshold)
    entry = lambda level, lang, n: F.struct(F.lit(level).alias("level"), lang.alias("lang"), n.alias("n"))
    every = F.transform(F.filter("counts", lambda x: x["lang"] != lid.UNKNOWN), lambda x: entry("word", x["lang"], x["n"]))
    if line_level:
        every = F.concat(F.array(entry("line", F.col("pred_lang"), F.lit(1).cast("long"))), every)
    return out.select(*UNIT_KEYS, F.explode(every).alias("_x")).select(*UNIT_KEYS, "_x.level", "_x.lang", "_x.n")


def pass_rate_lines(comp: DataFrame) -> DataFrame:
    """T1 -> split -> T5 -> T3: lines with at least 5 whitespace tokens."""
    # the tokens are made inside the generator: a filter on their number repeats no work
    split = F.transform(tx.split_lines(tx.normalize_completion("completion")),
                        lambda x: F.struct(x.alias("line"), tx.whitespace_tokens(x).alias("tokens")))
    lines = comp.select(*UNIT_KEYS, F.posexplode(split).alias("line_no", "_x"))
    return lines.filter(F.size("_x.tokens") >= tx.MIN_LINE_TOKENS).select(*UNIT_KEYS, "line_no", "_x.line", "_x.tokens")
