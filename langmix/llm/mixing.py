"""Mixing sources to target weights, with DataFrame functions only.

Targets are a capped water-filling: the budget is shared by weight, sources above
``max_epochs`` times their size are clamped there, and what they leave is shared
among the others by weight until none is above.  Only one row of sums per round
reaches the driver.

A source whose target is e times its size takes every document floor(e) times and
a seeded share of the documents once more.  The share is exact: documents are
ordered by md5(seed:id), and the cut is where the taken words come nearest to the
target.  It is found from pre-aggregated totals of hash prefixes, so that no
source, however large, is sorted or gathered in one task.

A document's size is its number of words (maximal runs outside space and
\\t\\n\\v\\f\\r); null and empty texts have size 0.  A null source is a source of its
own, after all others.  Repeated rows of an id are taken alike; a null id hashes
as the empty string.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from langmix.llm import common as C

SHARE = 1.5
MAX_EPOCHS = 2
WEIGHTS = (3, 1, 2)
SEED = "mix"
#: a plan of more sources than this is joined by a shuffle
BROADCAST_SOURCES = 50_000
_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, h), written once: all later steps read this small table."""
    C.prepare(docs.sparkSession)
    return C.ckpt(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              words(F.col(text_col)).alias("size"), hashed(id_col, seed).alias("h")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point,
    null last.  The ranking window runs over one row per source."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    s = C.ckpt(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("weight", F.element_at(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)))
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # in integers, doubled: a share of 1.5 leaves no rounding in the comparisons
    cap2 = F.col("source_size") * int(2 * max_epochs)
    left2, free, clamped = int(2 * share * total), None, -1
    while True:
        if free is None:
            above = F.lit(False)
        else:
            above = F.col("weight") * F.lit(left2).cast("long") > cap2 * F.lit(free)  # a literal is as narrow as its number
        n, caps2, w = s.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap2)), F.lit(0)),
                            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if free is not None and n == clamped:
            break
        clamped, left2, free = n, int(2 * share * total) - caps2, w
        if not free:  # nothing left to share: every source is at its limit
            above = F.lit(True)
            break
    return s.select("source", F.col("source_size").cast("long").alias("source_size"),
                    F.when(above, cap2 / F.lit(2.0))
                    .otherwise(F.col("weight") * F.lit(float(left2)) / F.lit(2.0 * max(free, 1))).alias("target"))


def small(plan: DataFrame, rows: int, most: int = BROADCAST_SOURCES) -> DataFrame:
    return F.broadcast(plan) if rows <= most else plan


def with_cuts(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan and, for each source, ``whole`` repetitions and the ``cut``: ids
    whose hash is not above it are taken once more."""
    plan = C.ckpt(plan.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                              .otherwise(0).cast("int").alias("whole")))
    n = plan.count()
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    state = plan.where(rest > 0).select("source", rest.alias("want"), F.lit("").alias("cut"))
    for _ in range(2):
        a, p = sizes.alias("a"), small(state, n).alias("p")
        inside = a.join(p, F.col("a.source").eqNullSafe(F.col("p.source")) & F.col("a.h").startswith(F.col("p.cut")))
        totals = (inside.groupBy(F.col("p.source").alias("source"), F.col("p.cut").alias("cut"), F.col("p.want").alias("want"),
                                 F.substring(F.col("a.h"), F.length("p.cut") + 1, F.lit(_DIGITS)).alias("digits"))
                  .agg(F.sum("a.size").alias("n")))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("digits"))
        crossing = (totals.withColumn("upto", upto)
                    .where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("n") <= F.col("want")))
                    .select("source", (F.col("want") - F.col("upto") + F.col("n")).alias("want"), F.concat("cut", "digits").alias("cut")))
        state = C.ckpt(crossing)
    a, p = sizes.alias("a"), small(state, n).alias("p")
    last = (a.join(p, F.col("a.source").eqNullSafe(F.col("p.source")) & F.col("a.h").startswith(F.col("p.cut")))
            .groupBy(F.col("p.source").alias("source"), F.col("p.cut").alias("cut"), F.col("p.want").alias("want"), F.col("a.h").alias("h"))
            .agg(F.sum("a.size").alias("n")))
    middle = F.sum("n").over(Window.partitionBy("source").orderBy("h")) - F.col("n") / 2
    found = (last.withColumn("middle", middle).groupBy("source")
             .agg(F.coalesce(F.max(F.when(F.col("middle") <= F.col("want"), F.col("h"))), F.max("cut")).alias("cut")))
    q = plan.alias("q")
    f = found.alias("f")
    # no crossing: the rest is the whole source ('g' is above every hex digit); no rest: nothing, empty documents neither
    return C.ckpt(q.join(f, F.col("q.source").eqNullSafe(F.col("f.source")), "left")
                  .select("q.*", F.when(rest > 0, F.coalesce("f.cut", F.lit("g"))).otherwise("").alias("cut")))


def with_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                seed: str = SEED, out: str = "copies") -> DataFrame:
    """``docs`` and how often the mix takes each row."""
    p = small(plan.select(F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("cut").alias("_mix_cut")), plan.count())
    return (docs.join(p, F.col(source_col).eqNullSafe(F.col("_mix_source")))
            .select(*[F.col(c) for c in docs.columns],
                    (F.col("_mix_whole") + F.when(hashed(id_col, seed) <= F.col("_mix_cut"), 1).otherwise(0)).cast("int").alias(out)))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
             seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): one row per document and one per source."""
    sizes = sized(docs, id_col, text_col, source_col, seed)
    return sizes, with_cuts(sizes, targets(sizes, weights, share, max_epochs))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    _, plan = plan_mix(docs, id_col, text_col, source_col, **options)
    seed = options.get("seed", SEED)
    rows = with_copies(docs, plan, id_col, source_col, seed, "_mix_copies").where("_mix_copies > 0")
    return rows.withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


def op1_mixing(spark, sf_dir):
    sizes, plan = plan_mix(C.table(spark, sf_dir, "documents"))
    p = small(plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "cut"), plan.count())
    copies = F.col("whole") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)
    return (sizes.join(p, F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken")))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, sum(n) OVER () AS t FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS k FROM r),
c AS (SELECT *, 1.5 * t - 2 * coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
f AS (SELECT min(k) AS k FROM c WHERE w * rest <= 2 * n * free),
p AS (SELECT c.source, c.n, CASE WHEN c.k < f.k THEN 2.0 * c.n ELSE c.w * (x.rest * 2)::DOUBLE / (2.0 * x.free) END AS target
      FROM c, f, c AS x WHERE x.k = f.k),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM p),
g AS (SELECT d.*, e.n, e.target, e.whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2 AS middle
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target::DOUBLE AS target,
       (size * (whole + CASE WHEN middle <= target - whole * n THEN 1 ELSE 0 END))::BIGINT AS taken FROM g
"""
