"""The corpus pipeline: toxicity, near duplicates, decontamination, mix, shards.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of ``documents`` (the last one its shards).  ``run``
writes each stage's rows as Parquet into the shared checkpoint folder and reads
them back, so a lost executor never costs more than the stage at hand.

Rows with a null text pass the filters (nothing in them can be toxic, contaminated
or a near duplicate).  Rows are told apart by id and text: ids may be null or repeat, and
of each group of near duplicates one row stays.  Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.llm import common as C
from langmix.llm import decontaminate, jaccard, mixing, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last category of the classifier chain reaches REJECT go.
    The chain learns from the labelled rows of the given documents."""
    chain = toxicity.learn(docs, toxicity.categories(C.table(spark, sf_dir, "labels")))
    scored = toxicity.with_scores(docs, chain, prefix="_pipeline_")
    return scored.where(F.col(f"_pipeline_{chain.names[-1]}") < toxicity.REJECT).select(*docs.columns)


def _is(rows: DataFrame) -> Column:
    """A document is one of the given rows (doc_id, print): ids may be null or repeat."""
    return F.col("doc_id").eqNullSafe(rows["_row_id"]) & (jaccard.text_print() == rows["_row_print"])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id stays."""
    gone, again = [C.ckpt(x.select(F.col("doc_id").alias("_row_id"), F.col("print").alias("_row_print"))) for x in jaccard.surplus(docs)]
    left = docs.join(gone, _is(gone), "left_anti")
    if again.limit(1).count():  # copies under one id
        one = (left.join(again, _is(again), "left_semi").withColumn("_row_print", jaccard.text_print())
               .dropDuplicates(["doc_id", "_row_print"]).drop("_row_print"))
        left = left.join(again, _is(again), "left_anti").unionByName(one)
    return left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    row = F.xxhash64("doc_id", jaccard.text_print())  # ids may be null or repeat
    found = decontaminate.decontaminate(docs.withColumn("_row", row), C.table(spark, sf_dir, "benchmark"), id_col="_row")
    hit = C.ckpt(found.where("contaminated").select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hit, row == F.col("_hit"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: each document as often as it is taken."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row of the mix."""
    return sharding.shard_rows(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", assign_shards)]

#: The first stage is a fitted classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; returns the last one's rows."""
    C.prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
