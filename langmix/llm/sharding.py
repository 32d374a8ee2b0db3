"""Sharding by balanced label propagation under the ``rows`` law.

Documents with equal texts are linked.  All start in hash order, one shard after
the other, so that counts are even.  In each round every group of linked documents
looks for the shard where it already has most documents, and its other documents
ask to move there.  The places of documents that leave count as room, so full shards swap: what
may move between two shards is found from the sums of all asks (a row per pair of
shards) and granted in hash order.  When no swap is left, groups ask for shards with
free quota only; it ends when no move is granted.  A move always goes to a shard that
holds as much of its group or more, so rounds come to an end.  Groups larger than a
quarter of a shard, a bounded number, are placed before the first round, the largest
on as many shards as they fill; others make room in hash order.  Quotas only count
linked documents: the others fill what is left at the end, so every shard's count
is exact (at most one apart) after any round.

A group's documents are alike, so a round works on counts per (group, shard), not
on documents or pairs: a group of any size is a few rows.  Ranks inside groups and
shards come from bucketed prefix sums, never from one window over a group.

A null text counts as the empty text (size 16, crc32 0), and equal texts include
empty ones.  Repeated rows are documents of their own; rows with a null id hash as
the empty string.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import common as C
from langmix.llm.mixing import hashed

SHARDS = 40
#: until no move is granted
ROUNDS = None
#: groups of more than this part of a shard are placed first
LARGE = 4
SEED = "shard"
OVERHEAD = 16


def _pick(rank, ends: list[int]):
    """The first interval whose end is above the rank."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= rank)).cast("int")


def balanced(flow: np.ndarray, free: np.ndarray) -> np.ndarray:
    """What of the asked moves (from shard, to shard) leaves no shard with more than
    its quota when all are made at once."""
    x = flow.copy()
    while True:
        over = x.sum(axis=0) - x.sum(axis=1) - free
        t = int(over.argmax())
        if over[t] <= 0:
            return x
        left = int(over[t])
        for s in np.argsort(over, kind="stable"):  # first from shards that can keep their rows
            cut = min(left, int(x[s, t]), max(0, -int(over[s])))
            x[s, t] -= cut
            left -= cut
        if left:
            cut = x[:, t] * left // max(int(x[:, t].sum()), 1)
            x[:, t] -= cut
            left -= int(cut.sum())
            for s in np.argsort(-x[:, t], kind="stable")[:left]:
                x[s, t] -= 1


def placed_large(groups: dict[str, dict[int, int]], load: list[int], quotas: list[int]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]:
    """Cells (g, s, n) of the large groups {g: {s: n}} on as few shards as hold them,
    and how many other documents move for that, (from, to, n)."""
    cap, out = list(quotas), []
    after = [x - sum(at.get(s, 0) for at in groups.values()) for s, x in enumerate(load)]
    for g, at in sorted(groups.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        rest = sum(at.values())
        while rest:
            fits = [s for s, c in enumerate(cap) if c >= rest]
            s = max(fits, key=lambda s: (at.get(s, 0), -cap[s])) if fits else max(range(len(cap)), key=lambda s: (cap[s], at.get(s, 0)))
            n = min(rest, cap[s])
            out.append((g, s, n))
            cap[s] -= n
            after[s] += n
            rest -= n
    room = [max(0, q - x) for q, x in zip(quotas, after)]
    moves = []
    for s, x in enumerate(after):
        over = x - quotas[s]
        for t in range(len(room)):
            if over > 0 and room[t]:
                n = min(over, room[t])
                moves.append((s, t, n))
                room[t] -= n
                over -= n
    return out, moves


def _moved(cells: DataFrame, moves: DataFrame) -> DataFrame:
    """The cells after ``moves`` (g, s, t, k)."""
    both = moves.select("g", F.explode(F.array(F.struct("s", (-F.col("k")).alias("n")),
                                               F.struct(F.col("t").alias("s"), F.col("k").alias("n")))).alias("m")).select("g", "m.s", "m.n")
    return C.ckpt(cells.unionByName(both).groupBy("g", "s").agg(F.sum("n").alias("n")).where("n > 0"))


def evicted(cells: DataFrame, moves: list[tuple[int, int, int]]) -> DataFrame:
    """The cells after so many documents (from, to, n) moved, the first in hash order."""
    spans, done = [], {}
    for s, t, n in moves:
        spans.append((s, t, done.get(s, 0), done.get(s, 0) + n))
        done[s] = spans[-1][3]
    first = C.hash_rank(cells, ["s"], [], "g", "before", weight="n")
    to = F.broadcast(cells.sparkSession.createDataFrame(spans, "s int, t int, lo long, hi long"))  # at most a row per pair of shards
    k = F.least(F.col("before") + F.col("n"), F.col("hi")) - F.greatest("before", "lo")
    return _moved(cells, first.join(to, "s").select("g", "s", "t", k.alias("k")).where("k > 0"))


def propagate(cells: DataFrame, quotas: list[int], rounds: int | None = ROUNDS) -> DataFrame:
    """Rounds of label propagation on (g, s, n): n linked documents of group g in
    shard s.  Ends when no move is granted, or after ``rounds``."""
    spark, shards = cells.sparkSession, len(quotas)
    if rounds == 0:
        return cells
    large = [r.g for r in cells.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > min(quotas) // LARGE).select("g").collect()]
    fixed = None
    if large:
        groups: dict[str, dict[int, int]] = {}
        for r in cells.where(F.col("g").isin(large)).collect():  # a row per large group and shard
            groups.setdefault(r.g, {})[r.s] = r.n
        load = dict(cells.groupBy("s").agg(F.sum("n")).collect())
        at, moves = placed_large(groups, [load.get(s, 0) for s in range(shards)], quotas)
        cells = C.ckpt(cells.where(~F.col("g").isin(large)))
        if moves:
            cells = evicted(cells, moves)
        fixed = spark.createDataFrame(at, "g string, s int, n long")
        quotas = [q - sum(n for _, t, n in at if t == s) for s, q in enumerate(quotas)]
    done, only_free = 0, False
    while rounds is None or done < rounds:
        load = dict(cells.groupBy("s").agg(F.sum("n")).collect())  # one row per shard
        free = [quotas[s] - load.get(s, 0) for s in range(shards)]
        open_ = cells.where(F.col("s").isin([s for s in range(shards) if free[s] > 0])) if only_free else cells
        best = (open_.groupBy("g").agg(F.max(F.struct("n", F.xxhash64("g", "s").alias("x"), "s")).alias("m"))
                .select("g", F.col("m.n").alias("most"), F.col("m.x").alias("mx"), F.col("m.s").alias("t")))
        asks = C.ckpt(cells.join(best, "g").where("s <> t")
                      .where((F.col("n") < F.col("most")) | ((F.col("n") == F.col("most")) & (F.xxhash64("g", "s") < F.col("mx"))))
                      .select("g", "s", "t", "n"))
        flow = np.zeros((shards, shards), np.int64)
        for r in asks.groupBy("s", "t").agg(F.sum("n").alias("n")).collect():  # a row per pair of shards
            flow[r.s, r.t] = r.n
        grant = balanced(flow, np.array(free, np.int64))
        if not grant.any():
            if only_free:
                break
            only_free = True
            continue
        done, only_free = done + 1, False
        before = C.hash_rank(asks, ["s", "t"], [], "g", "before", weight="n")
        lane = F.get(F.expr("array(" + ",".join(f"{x}L" for x in grant.ravel()) + ")"), F.col("s") * shards + F.col("t"))
        granted = C.ckpt(before.select("g", "s", "t", F.greatest(F.lit(0), F.least(F.col("n"), lane - F.col("before"))).cast("long").alias("k")).where("k > 0"))
        cells = _moved(cells, granted)
    return cells if fixed is None else C.ckpt(cells.unionByName(fixed))


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int | None = ROUNDS, id_col: str = "doc_id",
               text_col: str = "text", seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    C.prepare(docs.sparkSession)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = C.ckpt(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
                              F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("g"), hashed(id_col, seed).alias("h")))
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    order = ["doc_id", "g"]
    start = C.ckpt(C.hash_rank(base, [], order, "h", "at").select("*", F.pmod(F.col("at"), F.lit(shards)).cast("int").alias("s")))
    counts = start.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    linked = counts.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    cells = propagate(C.ckpt(counts.join(linked, "g").select("g", "s", "n")), quotas, rounds)
    load = dict(cells.groupBy("s").agg(F.sum("n")).collect())

    # linked documents: the group's counts are intervals of the ranks in the group
    homes = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("homes"))  # at most one entry per shard
    tied = start.drop("s", "at").join(homes, "g", "left")
    single = C.ckpt(tied.where("homes is null").drop("homes"))
    group = C.ckpt(tied.where("homes is not null"))
    ranked = C.hash_rank(group, ["g"], ["doc_id"], "h", "r")
    home = F.aggregate("homes", F.struct(F.lit(0).cast("long").alias("end"), F.lit(-1).alias("s")),
                       lambda a, x: F.when(a["end"] > F.col("r"), a)
                       .otherwise(F.struct((a["end"] + x["n"]).alias("end"), x["s"].alias("s"))))["s"]
    placed = C.ckpt(ranked.select("doc_id", "size", "text_crc32", "g", "h", home.alias("shard")))
    placed = C.hash_rank(placed, ["shard"], order, "h", "slot")

    # the others fill the shards up to their quotas
    ends, below = [], 0
    for s in range(shards):
        below += quotas[s] - load.get(s, 0)
        ends.append(below)
    offset = [load.get(s, 0) - (ends[s - 1] if s else 0) for s in range(shards)]
    rest = C.hash_rank(single, [], order, "h", "r").withColumn("shard", _pick(F.col("r"), ends))
    rest = rest.withColumn("slot", F.col("r") + F.get(F.array(*[F.lit(o).cast("long") for o in offset]), F.col("shard")))
    out = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
           F.lit(None).cast("int").alias("grown_shard")]
    return placed.select(*out).unionByName(rest.select(*out))


def op3_sharding(spark, sf_dir):
    return shard_rows(C.table(spark, sf_dir, "documents"))
