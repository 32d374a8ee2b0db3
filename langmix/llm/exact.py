"""Exact deduplication by skew-safe combining.

1. Every task folds its own equal texts (the map side of the first aggregate, whose
   keys are digest, salt and the whole content; the salt is the task's own number).
2. The salted groups of a digest are merged; ``TASKS`` neighbouring tasks share a salt,
   so at most that many rows of one text meet.
3. The winners of the salts are combined by digest, again with the content as key.

Content is a grouping key in all three, so equal digests never count as equal texts;
where a digest has several contents, its rows meet their group by content.  The rows
then look their group up by digest; a hot digest there is a skewed join, which Spark
splits.  A group's state is two numbers (rows, best row), whatever its size.

Texts are equal when identical after deleting space and \\t\\n\\v\\f\\r; null counts as
empty, so null, empty and blank texts are one group.  Of a group the row with the most
code points in its original text stays, then the smallest id (a null id comes after all
others); of rows that repeat id and length one stays.  Other columns are not read.
Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.llm import common as C

_BASE = 1 << 65
#: tasks that share a salt
TASKS = 64


def stripped(text: Column) -> Column:
    """The text without space and \\t\\n\\v\\f\\r; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _best(size: Column, key: Column) -> Column:
    """More code points first, then the smaller id, then null ids: one decimal
    number, so that the aggregates keep fixed-width state."""
    wide = "decimal(38,0)"
    last = F.when(key.isNull(), F.lit(0).cast(wide)).otherwise((F.lit(Decimal(1 << 63)) - key.cast("decimal(20,0)")).cast(wide))
    return (size.cast("decimal(11,0)") * F.lit(Decimal(_BASE)) + last).cast(wide)


def _unpacked(best: str) -> tuple[Column, Column]:
    """(id, code points) of a best row."""
    b = F.col(best)
    rest = (b % F.lit(Decimal(_BASE))).cast("decimal(20,0)")
    key = F.when(rest > 0, (F.lit(Decimal(1 << 63)) - rest).cast("long"))
    return key, ((b - rest) / F.lit(Decimal(_BASE))).cast("long")


def _groups(docs: DataFrame, id_col: str, text_col: str, normalise: Callable, digest: Callable) -> DataFrame:
    """(digest, content, n, best) of every distinct content, partitioned by digest."""
    rows = (docs.select(normalise(F.col(text_col)).alias("content"), _best(F.length(F.coalesce(text_col, F.lit(""))), F.col(id_col)).alias("best"))
            .select(digest(F.col("content")).alias("digest"), F.floor(F.spark_partition_id() / TASKS).alias("salt"), "content",
                    F.lit(1).cast("long").alias("n"), "best"))
    total = [F.sum("n").alias("n"), F.max("best").alias("best")]
    merged = rows.groupBy("digest", "salt", "content").agg(*total)
    return merged.drop("salt").repartition("digest").groupBy("digest", "content").agg(*total)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] = stripped, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and digest (of the
    normalised text).  Any digest gives the same groups, a weak one more slowly."""
    groups = _groups(docs, id_col, text_col, normalise, digest)
    keep, size = _unpacked("best")
    found = C.ckpt(groups.groupBy("digest").agg(F.count("*").alias("contents"), F.sum("n").alias("group_size"), F.max("best").alias("best"))
                   .select("digest", "contents", "group_size", keep.alias("keep_id"), size.alias("keep_size")))
    rows = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("size"),
                       normalise(F.col(text_col)).alias("content"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("id", "size", "row", "content", digest(F.col("content")).alias("digest"))
    out = (rows.drop("content").join(found.where("contents = 1"), "digest")
           .select("id", "size", "row", "digest", "group_size", "keep_id", "keep_size", F.lit(0).cast("long").alias("variant")))
    clash = found.where("contents > 1").select("digest")
    total = found.count()
    if clash.limit(1).count():  # several contents under one digest: their rows meet by content
        several = C.ckpt(groups.join(clash, "digest", "left_semi")
                         .select("digest", "content", F.col("n").alias("group_size"), keep.alias("keep_id"), size.alias("keep_size"),
                                 (F.monotonically_increasing_id() + 1).alias("variant")))
        out = out.unionByName(rows.join(several, ["digest", "content"]).drop("content"))
        total += several.count() - clash.count()
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))
    out = C.ckpt(out.withColumn("kept", best))
    if out.where("kept").count() > total:  # rows that repeat id and length: the first one stays
        first = (out.where("kept").groupBy("digest", "variant").agg(F.min("row").alias("first"), F.count("*").alias("n"))
                 .where("n > 1").drop("n"))
        out = out.join(first, ["digest", "variant"], "left").withColumn("kept", F.col("kept") & F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for white space, over all documents."""
    C.prepare(spark)
    return exact_groups(C.table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by content) as group_size,
       row_number() over w = 1 as kept, sha256(content) as text_sha256
from d window w as (partition by content order by size desc, doc_id)
"""
