"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langmix.session import cut_lineage, ensure_checkpoint_dir

#: rows per Arrow batch: with texts of some kilobytes a batch is a few megabytes
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder and Arrow batches that hold few long texts."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def ckpt(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder at once; lineage ends there."""
    return cut_lineage(df)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Slices of a batch whose texts hold about ``most_bytes`` (at least a row each)."""
    from langmix.llm.text import buffers
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def parts(spark: SparkSession, per: int = 4) -> int:
    """Key groups for a shuffle of blocks: some for each shuffle partition, so
    that their sizes even out; the cluster sizes the partitions for its data."""
    return per * int(spark.conf.get("spark.sql.shuffle.partitions"))


#: tasks whose sums are added up at once
FAN = 512


def add_up(rows: DataFrame, keys: int, unpack, pack, fan: int = FAN) -> dict[int, np.ndarray]:
    """Sums of arrays by key from rows (key int, part int, m binary): ``keys`` arrays of
    a fixed size from each task, ``part`` its number.  Level by level the sums of
    ``fan`` tasks are added, so no task reads an array of every other one."""
    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, part, m in zip(*(c.to_pylist() for c in b.columns)):
                at = k, part // fan
                sums[at] = sums[at] + unpack(m) if at in sums else unpack(m)
        for (k, part), x in sums.items():
            yield pa.RecordBatch.from_pydict({"key": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "m": [pack(x)]})

    tasks, more = rows.rdd.getNumPartitions(), True
    while more:
        tasks = max(1, -(-tasks // fan))
        more = tasks > 1
        rows = (rows.repartition(keys * tasks, "key", F.floor(F.col("part") / fan))
                .mapInArrow(add, "key int, part int, m binary"))
    return {r["key"]: unpack(r["m"]) for r in rows.collect()}  # at most ``keys`` rows


def min_label(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v), both long: (node, component) with
    the smallest node of each component.

    Each round sends every node's label to its neighbours and then jumps to the
    label's own label, so long chains end in a logarithmic number of rounds.
    Aggregates are partial before each shuffle; state is checkpointed.
    A self-loop keeps its node; null ends are ignored; empty in, empty out."""
    both = ckpt(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
                .where("u is not null and v is not null")
                .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
                .select("e.u", "e.v").distinct())
    label = ckpt(both.groupBy("u").agg(F.min("v").alias("m"))
                 .select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    for _ in range(max_rounds):
        near = (both.join(label.withColumnRenamed("node", "v"), "v")
                .groupBy("u").agg(F.min("component").alias("near")).withColumnRenamed("u", "node"))
        hop = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = (label.join(near, "node").join(hop, "component")
                .select("node", F.least("component", "near", "far").alias("next"), "component"))
        step = ckpt(step)
        moved = step.where("next < component").limit(1).count()
        label = step.select("node", F.col("next").alias("component"))
        if not moved:
            return label
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def hash_rank(df: DataFrame, group: list[str], order: list[str], key: str, out: str,
              weight: str | None = None, rows_per_task: int = 20_000) -> DataFrame:
    """0-based rank of each row within its group, ordered by (key, order); with
    ``weight`` the sum of the weights of the rows before it.

    ``key`` is an evenly spread hash in lower-case hex digits (md5).  Its leading
    digits cut each group, however large, into small buckets: bucket totals are
    pre-aggregated and summed up, and only the rows of one bucket meet in a
    window.  ``df`` should be checkpointed, it is read three times."""
    digits = max(2, math.ceil(math.log(max(1, df.count() / rows_per_task), 16)))
    w = F.col(weight) if weight else F.lit(1)
    sizes = (df.groupBy(*group, F.substring(F.col(key), 1, digits).alias("_bucket")).agg(F.sum(w).alias("_n")))
    first = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bucket").alias("_b"),
                         (F.sum("_n").over(_window(group, ["_bucket"])) - F.col("_n")).alias("_before"))
    rows = df.withColumn("_bucket", F.substring(F.col(key), 1, digits))
    inside = rows.withColumn("_in", F.sum(w).over(_window([*group, "_bucket"], [key, *order])
                                                  .rowsBetween(Window.unboundedPreceding, 0)) - w)
    same = F.col("_bucket") == F.col("_b")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return inside.join(first, same).select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias(out))


def _window(part: list[str], order: list[str]):
    w = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    return w.orderBy(*order)


#: DuckDB SQL: the table of crc32, to be joined where ``crc32_sql`` stands
CRC_SQL = r"""
poly as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def crc32_sql(key: str) -> str:
    """Unsigned crc32 of an ASCII string, with the table ``poly`` at hand."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda c: ascii(c)::bigint)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""
