"""File sources and sinks of the reference's data model.

Each reader declares its schema (no inference), reads a whole folder with a
glob, and keeps the file name as a column when the file name carries data.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langmix.sources.records import read_csv_by_header, read_records

COMPLETIONS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                   ("id", "model", "completion", "task", "source", "language")])
PAIRS_SCHEMA = T.StructType([T.StructField("pred", T.StringType()), T.StructField("labels", T.StringType())])

INVERTER_LOG_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("evaluations", T.ArrayType(T.StructType([
        T.StructField("dataset", T.StringType()),
        T.StructField("embeddings_file", T.StringType()),
        T.StructField("output_file", T.StringType())]))),
])
CORRECTOR_LOG_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("evaluations", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("embeddings_files", T.StringType()),
        T.StructField("output_files", T.StringType())])))),
])

# --- fixed values -----------------------------------------------------------
# Step names in result file names and their display labels.
STEP_LABELS = {"base": "Base", "step1": "Step1", "step50_sbeam8": "Step50+sbeam8"}
RESULT_FILE_RE = r"(?:multi|mono)lingual_eval_[a-z0-9_]+?_(base|step1|step50_sbeam8)_(?:inverter|corrector)\.csv$"
# ---------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file or a folder of them; columns go by each file's header, and
    cells may hold newlines (:mod:`langmix.sources.records`)."""
    return read_csv_by_header(spark, path, {f.name: f.dataType.simpleString() for f in schema})


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COMPLETIONS_SCHEMA)


def read_pairs(spark: SparkSession, path: str, prefix: str = "query: ") -> DataFrame:
    """A2 + T8: prediction/reference pairs with the prefix removed."""
    from langmix.functions.text import strip_prefix
    df = read_csv(spark, path, PAIRS_SCHEMA)
    return df.select(strip_prefix("pred", prefix).alias("pred"), strip_prefix("labels", prefix).alias("ref"))


def step_from_file(col: Column | None = None) -> Column:
    """S3: step label from a result file name (both mono- and multilingual names)."""
    name = col if col is not None else F.col("_metadata.file_name")
    raw = F.regexp_extract(name, RESULT_FILE_RE, 1)
    m = F.create_map(*[x for k, v in STEP_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, raw)


def read_matrix_files(spark: SparkSession, path: str, row_col: str = "model") -> DataFrame:
    """Folder of metric matrices -> (row, col, value, step)."""
    t = read_records(spark, path).select(step_from_file(F.element_at(F.split("file", "/"), -1)).alias("step"), "header", "cells")
    row = F.get("cells", F.array_position("header", row_col).cast("int") - 1)
    long = t.where(F.array_contains("header", row_col)).select(
        "step", row.alias("row"), F.explode(F.arrays_zip(F.col("header").alias("n"), F.col("cells").alias("v"))).alias("x"))
    return (long.where(F.col("x.n") != row_col)
            .select("row", F.col("x.n").alias("col"), F.nullif(F.col("x.v"), F.lit("")).cast("double").alias("value"), "step"))


def read_inverter_logs(spark: SparkSession, path: str) -> DataFrame:
    """(model, dataset, embeddings_file, output_file)."""
    df = spark.read.schema(INVERTER_LOG_SCHEMA).option("multiLine", True).json(path)
    return df.select("model", F.explode("evaluations").alias("e")).select("model", "e.*")


def read_corrector_logs(spark: SparkSession, path: str) -> DataFrame:
    """(model, dataset, step, embeddings_files, output_files)."""
    df = spark.read.schema(CORRECTOR_LOG_SCHEMA).option("multiLine", True).json(path)
    d = df.select("model", F.explode("evaluations").alias("dataset", "steps"))
    return d.select("model", "dataset", F.explode("steps").alias("step", "f")).select(
        "model", "dataset", "step", "f.embeddings_files", "f.output_files")


def read_result_maps(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object ``{key: value}`` per file -> (file, key, value)."""
    df = spark.read.option("multiLine", True).text(path, wholetext=True)
    df = df.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    m = F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))
    return df.select("file", F.explode(m).alias("key", "value"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text vectors, header line skipped, ``lang v1 ... vn`` -> (lang, vec)."""
    t = spark.read.text(path).withColumn("_f", F.col("_metadata.file_path"))
    t = t.withColumn("_parts", F.split(F.trim("value"), r"\s+"))
    # the header is the first line of each file: "<count> <dim>" (two integers)
    t = t.filter(~((F.size("_parts") == 2) & F.col("value").rlike(r"^\s*\d+\s+\d+\s*$")))
    return t.select(F.col("_parts")[0].alias("lang"),
                    F.transform(F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))), lambda x: x.cast("double")).alias("vec"))


def parse_literal(col, type_str: str = "map<string,double>", strict: bool = False) -> Column:
    """Python-literal text -> typed column, read by Python's own literal parser
    (no code is run; tuples and sets become lists, sets in order of their repr, keys
    become strings).  Tolerant mode yields NULL on bad input; strict mode fails the query."""
    @F.arrow_udf("string")
    def to_json(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append(None if text is None else json.dumps(_plain(ast.literal_eval(text.strip())), allow_nan=False))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                if strict:
                    raise
                out.append(None)
        return pa.array(out, pa.string())

    return F.from_json(to_json(F.col(col) if isinstance(col, str) else col), type_str, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        x = sorted(x, key=repr)
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A small YAML mapping -> (key, attribute, value); see :func:`parse_dimension`."""
    return parse_dimension(spark.read.text(path, wholetext=True))


def parse_dimension(texts: DataFrame) -> DataFrame:
    """``key: value`` lines (attribute null) and ``key:`` followed by an indented
    list of one-key maps ``- attribute: value`` (a row each) of YAML texts (column
    ``value``); ``#`` comments and quotes around names and values are dropped."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"""^(['"])(.*)\1$""", "$2")
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"(?m)[ \t]*(^|[ \t])#.*$", "")
    entry = r"(?m)^([^\s:-][^:\n]*):[ \t]*([^\n]*)((?:\n(?:[ \t]+[^\n]*|-[^\n]*)?(?=\n|\z))*)"
    t = texts.select(F.explode(F.regexp_extract_all(text, F.lit(entry), 0)).alias("e"))
    t = t.select(*[F.regexp_extract("e", entry, k).alias(c) for k, c in ((1, "key"), (2, "inline"), (3, "block"))])
    pair = r"(?m)^[ \t]*(?:-[ \t]*)?([^:\n]+):[ \t]*([^\n]*)$"
    nested = F.transform(F.regexp_extract_all("block", F.lit(pair), 0),
                         lambda x: F.struct(bare(F.regexp_extract(x, pair, 1)).alias("attribute"), bare(F.regexp_extract(x, pair, 2)).alias("value")))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("attribute"), bare(F.col("inline")).alias("value")))
    rows = t.select(bare(F.col("key")).alias("key"), F.explode(F.when(F.size(nested) > 0, nested).otherwise(alone)).alias("x"))
    return rows.select("key", "x.attribute", F.nullif(F.col("x.value"), F.lit("")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines."""
    df.write.mode("overwrite").json(path)


def write_matrix_csv(m: DataFrame, path: str, col_labels) -> None:
    """S6 (write): coordinate form -> wide CSV with a ``row`` column."""
    wide = m.groupBy("row").pivot("col", list(col_labels)).agg(F.first("value"))
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """S6 (read): wide CSV (first column = row label) -> (row, col, value)."""
    df = spark.read.option("header", True).csv(path)
    first = df.columns[0]
    cols = df.columns[1:]
    long = df.unpivot([first], cols, "col", "value")
    return (long.select(F.col(first).alias("row"), "col", F.col("value").cast("double").alias("value"))
            .filter(F.col("value").isNotNull()))
