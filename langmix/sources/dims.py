"""Small fixed dimension tables (broadcast when joined)."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions.text import lang_part
from langmix.sources.files import parse_dimension

# --- fixed values -------------------------------------------------------------
# Static attributes of the evaluation languages: (code, family, word order,
# script direction); word order "ND" = no dominant order (matches every order).
# The first 20 rows are the reference's evaluation languages; the last three
# are the driver-data languages it does not list (English, French, Spanish).
LANG_ATTRIBUTES = [
    ("deu_Latn", "germanic", "ND", "LTR"),
    ("mlt_Latn", "semitic", "ND", "LTR"),
    ("tur_Latn", "turkic", "SOV", "LTR"),
    ("hun_Latn", "uralic", "ND", "LTR"),
    ("fin_Latn", "uralic", "SVO", "LTR"),
    ("kaz_Cyrl", "turkic", "SOV", "LTR"),
    ("mhr_Cyrl", "uralic", "SOV", "LTR"),
    ("mon_Cyrl", "atlatic", "SOV", "LTR"),
    ("ydd_Hebr", "germanic", "SVO", "RTL"),
    ("heb_Hebr", "semitic", "SVO", "RTL"),
    ("arb_Arab", "semitic", "VSO", "RTL"),
    ("urd_Arab", "indo", "SOV", "RTL"),
    ("hin_Deva", "indo", "SOV", "LTR"),
    ("guj_Gujr", "indo", "SOV", "LTR"),
    ("sin_Sinh", "indo", "SOV", "LTR"),
    ("pan_Guru", "indo", "SOV", "LTR"),
    ("cmn_Hani", "atlatic", "SVO", "LTR"),
    ("jpn_Jpan", "atlatic", "SOV", "LTR"),
    ("kor_Hang", "atlatic", "SOV", "LTR"),
    ("amh_Ethi", "semitic", "SOV", "LTR"),
    ("eng_Latn", "germanic", "SVO", "LTR"),
    ("fra_Latn", "romance", "SVO", "LTR"),
    ("spa_Latn", "romance", "SVO", "LTR"),
]
# Two-letter codes of the driver data -> language_Script codes.
DATA_CODES = [("de", "deu_Latn"), ("en", "eng_Latn"), ("es", "spa_Latn"), ("fr", "fra_Latn")]
# ------------------------------------------------------------------------------


def lang_attributes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANG_ATTRIBUTES, "code string, family string, word_order string, direction string")


def data_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATA_CODES, "code string, mapped string")


def mt5_share(spark: SparkSession) -> DataFrame:
    """(iso3, mt5): pre-training shares, from the package's YAML table (a small resource
    that only the driver has, so its text is sent to Spark)."""
    text = resources.files(__package__).joinpath("pretraining.yaml").read_text(encoding="utf-8")
    rows = parse_dimension(spark.createDataFrame([(text,)], "value string")).where("attribute = 'mt5'")
    return rows.select(lang_part("key").alias("iso3"), F.col("value").cast("double").alias("mt5"))
