"""Distributed ranks and exact quantiles.

``prefix_sums`` range-partitions the rows by (group, order), sums up inside each
partition while it streams by, and adds the totals of the partitions before: a row per
(group, partition), so the number of pieces follows the data and no group, however
large, meets in one task.

``exact_quantiles`` selects order statistics by refining histograms: a pass counts, per
interval still open, the rows of ``BINS`` equal bins with their least and greatest
values; the bin that holds the wanted rank is the next interval, until it holds one value.
State is bounded by bins per (group, quantile), not by distinct values.  Passes alternate between bins of equal width
and bins of equal ratio, so that widely spread values take few passes too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmix.session import cut_lineage

BINS = 1024
#: rows up to which a lookup table is broadcast; larger ones are joined by shuffle
BROADCAST_ROWS = 500_000


def prefix_sums(df: DataFrame, group: str, order: str, weight: str, out: str = "before") -> DataFrame:
    """``df`` (group, order, weight) with the sum of the weights of the rows before
    each one within its group.  Rows that tie in (group, order) come in any order;
    null groups are a group, null order values come first."""
    def work(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, w = b.column(0), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(w)
            known = pc.fill_null(pc.equal(g[1:], g[:-1]), False).to_numpy(zero_copy_only=False)
            both = pc.and_(g[1:].is_null(), g[:-1].is_null()).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(~(known | both)) + 1])
            base = (upto - w)[starts]
            if last is not None and g[0].as_py() == last[0]:
                base[0] -= total
            before = upto - w - np.repeat(base, np.diff(np.append(starts, len(w))))
            last, total = (g[len(g) - 1].as_py(),), int(before[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(w), part, np.int32)), pa.array(before)],
                                             names=["g", "o", "w", "part", "inside"])

    kinds = dict(df.dtypes)
    inside = cut_lineage(df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(weight).cast("long").alias("w"))
                         .repartitionByRange("g", "o").sortWithinPartitions("g", "o")
                         .mapInArrow(work, f"g {kinds[group]}, o {kinds[order]}, w long, part int, inside long"))
    earlier = Window.partitionBy("tg").orderBy("tp").rowsBetween(Window.unboundedPreceding, -1)
    offset = (inside.groupBy(F.col("g").alias("tg"), F.col("part").alias("tp")).agg(F.sum("w").alias("total"))
              .select("tg", "tp", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset")))
    return (inside.join(offset, F.col("g").eqNullSafe(F.col("tg")) & (F.col("part") == F.col("tp")))
            .select(F.col("g").alias(group), F.col("o").alias(order), F.col("w").alias(weight), (F.col("offset") + F.col("inside")).alias(out)))


def average_ranks(values: DataFrame) -> DataFrame:
    """(measure, v, rank) of the distinct values of all measures in one job: ties
    share the mean of their positions.  Nulls have no rank."""
    counts = values.where(F.col("v").isNotNull()).groupBy("measure", "v").agg(F.count("*").alias("n"))
    return prefix_sums(counts, "measure", "v", "n").select("measure", "v", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


def looked_up(rows: DataFrame, table: DataFrame, on: str, n: int) -> DataFrame:
    """Join with a lookup table of n rows: broadcast if that is few."""
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, on)


def _magnitude(v: Column) -> Column:
    """Sign and exponent as one increasing number: bins of equal width on this scale
    part values of very different size."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.lit(1100.0) + F.log2(F.abs(v))))


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float], bins: int = BINS) -> DataFrame:
    """(keys, q0, q1, ...): quantiles with linear interpolation between the two
    neighbouring order statistics.  Nulls and NaN are left out; groups without other
    values are not returned."""
    ks = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(keys, ks)], *([] if keys else [F.lit(0).alias("_k0")]), F.col(col).cast("double").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v"))
    rank = [F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(F.lit(float(q)) * (F.col("n") - 1)).cast("long").alias("k"))
            for i, q in enumerate(qs) for up in (False, True)]
    base = cut_lineage(rows.groupBy(*ks).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    passes = 0
    state = base.select(*ks, "lo", "hi", F.explode(F.array(*rank)).alias("t")).select(*ks, "lo", "hi", "t.*")
    while True:
        state = cut_lineage(state)
        todo = cut_lineage(state.where("lo < hi").select(*ks, "lo", "hi").distinct())
        n = todo.count()
        if not n:
            break
        to = todo.select(*[F.col(k).alias(f"t{k}") for k in ks], "lo", "hi")
        here = [F.col(k).eqNullSafe(F.col(f"t{k}")) for k in ks]
        v, lo, hi = [_magnitude(F.col(c)) if passes % 2 else F.col(c) / 2 for c in ("v", "lo", "hi")]
        inner = F.coalesce(F.nanvl(F.try_divide(v - lo, hi - lo), F.lit(0.0)), F.lit(0.0)) * (bins - 2)
        passes += 1
        bin_ = (F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1)
                .otherwise(1 + F.floor(F.least(F.greatest(inner, F.lit(0.0)), F.lit(float(bins - 3)))).cast("int")))
        met = rows.join(F.broadcast(to) if n <= BROADCAST_ROWS // 10 else to, [*here, F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")])
        hist = (met.groupBy(*ks, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")))
        upto = Window.partitionBy(*ks, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
        hist = hist.withColumn("upto", F.sum("c").over(upto)).select(*[F.col(k).alias(f"t{k}") for k in ks], F.col("lo").alias("tlo"), F.col("hi").alias("thi"),
                                                                    "c", "least", "most", "upto")
        found = (state.where("lo < hi").join(hist, [*here, F.col("lo") == F.col("tlo"), F.col("hi") == F.col("thi"),
                                                    F.col("k") < F.col("upto"), F.col("k") >= F.col("upto") - F.col("c")])
                 .select(*ks, F.col("least").alias("lo"), F.col("most").alias("hi"), "q", "up", (F.col("k") - F.col("upto") + F.col("c")).alias("k")))
        state = state.where("not lo < hi").unionByName(found)
    parts = []
    for i, q in enumerate(qs):
        low, high = (F.max(F.when((F.col("q") == i) & (F.col("up") == up), F.col("lo"))) for up in (False, True))
        parts.append(F.struct(low.alias("low"), high.alias("high")).alias(f"_s{i}"))
    both = state.groupBy(*ks).agg(*parts).select(*[F.col(k).alias(f"t{k}") for k in ks], *[f"_s{i}" for i in range(len(qs))])
    out = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("n") - 1)
        s = F.col(f"_s{i}")
        out.append(F.when(s["low"] == s["high"], s["low"]).otherwise((F.ceil(at) - at) * s["low"] + (at - F.floor(at)) * s["high"]).alias(f"q{i}"))
    return base.join(both, [F.col(k).eqNullSafe(F.col(f"t{k}")) for k in ks]).select(*[F.col(k).alias(c) for c, k in zip(keys, ks)], *out)
