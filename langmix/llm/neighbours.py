"""Embedding near-dedup by sorted projection passes.

Equal vectors become one class.  In each pass every class gets a key of
concatenated random hashes (signs of random projections); classes are ordered by
key and each is compared with at least the ``BLOCK`` classes before and after it.
Keys travel with a vector of one byte a component and the exact length of its
rounding error, so that a window keeps every pair that may reach the threshold.
Such pairs of all passes are united; tasks return spanning forests, not pairs.

The number of passes follows from the number of classes, so that a pair at the
threshold meets with probability ``RECALL`` in an even background (``passes_for``).
Where many classes share long key prefixes a window reaches less far.  Each class
therefore notes the shortest prefix whose run fits a window; classes whose prefixes
were too long for the wanted recall go on among themselves, in further passes or,
where that moves fewer rows, in all pairs of blocks.

A window bounds a pass, not the result: every component of such pairs is then
verified completely with the whole vectors, in pairs of blocks, so a group larger than
any window loses no link between its members; components of verified links remain.

``n_links`` counts rows: copies of the vector itself and all rows of linked
classes.  Cosines are computed in double precision.  Vectors that are null, empty or
zero, or that hold null or non-finite components, link with nothing; vectors of
different lengths do not link.  Repeated rows are copies.  A component's id is its
smallest vec_id (null only if all of its ids are); a null vec_id is kept alone only
if its component has no other id.  Other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langmix.llm import common as C

THRESHOLD = 0.9
#: at least so many passes
PASSES = 16
#: a link at the threshold is found at least so often
RECALL = 0.999
BITS = 48
BLOCK = 512
SEED = 7


def agreement(threshold: float) -> float:
    """How often a random hash is the same for two vectors at the threshold."""
    return 1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi


def passes_for(classes: int, threshold: float = THRESHOLD, block: int = BLOCK, recall: float = RECALL, least: int = PASSES) -> int:
    """Passes after which two vectors at the threshold have shared, with probability
    ``recall``, a prefix whose run fits a window.  A bit more than an even split
    needs is reckoned, since runs of one prefix differ in size."""
    one = agreement(threshold) ** (math.log2(classes / block) + 1) if classes > block else 1.0
    return least if one >= 1 - 1e-9 else max(least, math.ceil(math.log1p(-recall) / math.log1p(-one)))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norms
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, node), (classes: node, rep, copies, v); node is null for
    vectors that cannot link."""
    kind = vectors.schema[vec_col].dataType
    item = T.FloatType() if isinstance(kind.elementType, T.FloatType) else T.DoubleType()
    v = F.col(vec_col).cast(T.ArrayType(item))
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = C.ckpt(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
                  .withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    classes = C.ckpt(rows.where("node is not null").groupBy("node")
                     .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    return rows.select("vec_id", "node"), classes


#: more than float32 sums of bytes and the lengths in float32 can be off
SLACK = 1e-4


def rounded(x: np.ndarray) -> np.ndarray:
    """Rows of bytes for unit vectors: components as int8, their unit, the error's length."""
    unit = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    q = np.clip(np.rint(x / unit[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    error = np.linalg.norm(x - q * unit[:, None].astype(np.float64), axis=1).astype(np.float32)
    return np.concatenate([q.view(np.uint8), np.stack([unit, error], axis=1).view(np.uint8)], axis=1)


def possible(raw: list[bytes], sort: np.ndarray, first: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs of one ``sort`` whose cosine may reach the threshold, i among the
    ``first`` rows."""
    found = []
    for k in np.unique(sort[:first]):
        mine = np.flatnonzero(sort == k)
        rows = np.frombuffer(b"".join([raw[i] for i in mine]), np.uint8).reshape(len(mine), -1)
        q = np.ascontiguousarray(rows[:, :-8]).view(np.int8).astype(np.float32)
        unit, error = np.ascontiguousarray(rows[:, -8:]).view(np.float32).T
        m = int((mine < first).sum())
        # |xy - x'y'| <= |x - x'| |y| + |x'| |y - y'|
        cos = (q[:m] * unit[:m, None]) @ (q * unit[:, None]).T
        i, j = np.nonzero(cos >= (threshold - SLACK - error[:m, None]) - (1 + error[:m, None]) * error[None, :])
        found.append((mine[i[i != j]], mine[j[i != j]]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


KEYED = "sort long, code long, node long, raw binary"


def keyed(classes: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """A row per class and pass with its key; ``sort``: pass and dimensions."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            node = b.column(0)
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py():]
            cut = np.concatenate([[0], np.cumsum(size)])
            raw = [flat[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])]
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((dim, passes * bits))
                x = _unit([raw[i] for i in mine], flat.dtype.str)
                ids = node.take(pa.array(mine))
                blobs = pa.array([r.tobytes() for r in rounded(x)], pa.binary())
                for p in range(passes):
                    sign = x @ planes[dim][:, p * bits:(p + 1) * bits] > 0
                    code = sign @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), p << 32 | int(dim), np.int64)), pa.array(code), ids, blobs],
                        ["sort", "code", "node", "raw"])

    return classes.select("node", "v").mapInArrow(run, KEYED)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of n rows reachable by the links (i, j), for every row."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cosines(raw: list[bytes], dim: np.ndarray, kind: str) -> np.ndarray:
    out = np.full((len(raw), len(raw)), -2.0)
    for d in np.unique(dim):
        mine = np.flatnonzero(dim == d)
        x = _unit([raw[i] for i in mine], kind)
        out[np.ix_(mine, mine)] = x @ x.T
    np.fill_diagonal(out, -2.0)
    return out


def _kind(classes: DataFrame) -> str:
    return "<f4" if isinstance(classes.schema["v"].dataType.elementType, T.FloatType) else "<f8"


def depths(code: np.ndarray, sort: np.ndarray, own: np.ndarray, block: int, bits: int) -> np.ndarray:
    """For each row of a block and the one after it (in key order) the length of the
    prefix from which on its run fits a window, as far as windows that begin in the
    block can tell."""
    at = np.flatnonzero(own)
    at = at[at + block < len(code)]
    at = at[sort[at] == sort[at + block]]
    out = np.zeros(len(code), np.int64)
    differ = code[at] ^ code[at + block]
    need = bits + 1 - np.where(differ > 0, np.frexp(differ.astype(np.float64))[1], 0)
    full = np.zeros(len(code), np.int64)
    full[at] = need
    n = int(own.sum())
    out[:n] = np.maximum.accumulate(full[:n])
    later = np.maximum.accumulate(full[:n][::-1])[::-1]  # windows that begin at j or after
    m = min(n, len(code) - n)
    out[n:n + m] = later[:m]
    return out


def window_links(classes: DataFrame, threshold: float, passes: int, bits: int, block: int, seed: int, known: int) -> DataFrame:
    """(u, v, pass, depth): spanning pairs that may be links, of all passes, and for a class u
    (v null) a prefix longer than ``known`` that it needed in a pass."""
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["sort", "code", "node"]
    ranked = C.ckpt(keyed(classes, passes, bits, seed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .select("*", F.monotonically_increasing_id().alias("place")))
    # rows before each partition, one number per partition
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in ranked.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    first = F.get(F.array(*[F.lit(b).cast("long") for b in before or [0]]), part.cast("int"))
    own = F.floor(F.col("at") / block)
    placed = ranked.withColumn("at", first + row).withColumn("b", F.explode(F.array(own, own - 1)))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        sort, code, node = (t.column(c).to_numpy() for c in ("sort", "code", "node"))
        own = t.column("at").to_numpy() // block == t.column("b").to_numpy()
        # pairs of the following block are left to its own task
        root = forest(len(node), *possible(t.column("raw").to_pylist(), sort, int(own.sum()), threshold))
        has = root != np.arange(len(root))
        deep = depths(code, sort, own, block, bits)
        tell = deep > known
        return pa.table({"u": np.concatenate([node[has], node[tell]]),
                         "v": pa.array([*node[root[has]].tolist(), *[None] * int(tell.sum())], pa.int64()),
                         "pass": np.concatenate([np.zeros(has.sum(), np.int32), (sort[tell] >> 32).astype(np.int32)]),
                         "depth": np.concatenate([np.zeros(has.sum(), np.int64), deep[tell]])}, schema=FOUND)

    return (placed.select("b", "at", "sort", "code", "node", "raw").groupBy("b")
            .applyInArrow(compare, "u long, v long, pass int, depth long"))


FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("pass", pa.int32()), ("depth", pa.int64())])


def block_links(classes: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(u, v): spanning links of all pairs."""
    kind = _kind(classes)
    placed = (classes.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "v"))

    def compare(t: pa.Table) -> pa.Table:
        lists, node = t.column("v").to_pylist(), t.column("node").to_numpy()
        link = _cosines([np.array(x, kind).tobytes() for x in lists], np.array([len(x) for x in lists]), kind) >= threshold
        root = forest(len(link), *np.nonzero(link))
        has = root != np.arange(len(root))
        return pa.table({"u": node[has], "v": node[root[has]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return placed.groupBy("i", "j").applyInArrow(compare, "u long, v long")


def spanning_links(classes: DataFrame, threshold: float, passes: int, bits: int, block: int, seed: int, recall: float) -> DataFrame:
    """(u, v): links of passes that give every class the wanted recall."""
    p, wanted = agreement(threshold), math.log1p(-recall)
    left = C.ckpt(classes.select("node", "v", F.lit(0.0).alias("miss")))  # miss: log of the chance to miss a link so far
    n, links = left.count(), None
    take, at = passes_for(n, threshold, block, recall, passes), 0
    while True:
        known = max(0, math.floor(math.log2(max(n, 1) / block))) if n > block else 0
        found = C.ckpt(window_links(left, threshold, take, bits, block, seed + 1000 * at, known))
        at += 1
        new = found.where("v is not null").select("u", "v")
        links = new if links is None else links.unionByName(new)
        if p > 1 - 1e-9 or known == 0 and n <= block:
            return links
        usual = math.log1p(-p ** max(known, 1))  # of a pass in which the known prefix did
        deep = (found.where("v is null").groupBy(F.col("u").alias("node"), "pass").agg(F.max("depth").alias("depth"))
                .groupBy("node").agg(F.count(F.lit(1)).alias("k"),
                                     F.sum(F.when(F.col("depth") > bits, 0.0).otherwise(F.log1p(-F.pow(F.lit(p), F.col("depth"))))).alias("got")))
        gained = F.coalesce("got", F.lit(0.0)) + (F.lit(take) - F.coalesce("k", F.lit(0))) * usual
        left = C.ckpt(left.join(deep, "node", "left").select("node", "v", (F.col("miss") + gained).alias("miss"), gained.alias("gained"))
                      .where(F.col("miss") > wanted))
        n, slowest, most = left.agg(F.count(F.lit(1)), F.max("gained"), F.max("miss")).first()
        if not n:
            return links
        # the hardest class gains at this rate (a pass among fewer classes gains more)
        rate = -slowest / take
        more = (most - wanted) / rate if rate > 0 else math.inf
        blocks = -(-n // block)
        if blocks <= 2 * more:  # a pass moves every row twice, all pairs once a block
            return links.unionByName(block_links(left, threshold, blocks))
        take = min(max(1, math.ceil(more)), 64)
        left = left.select("node", "v", "miss")


def complete(classes: DataFrame, groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links, root): rows linked to each class within its component, exactly,
    in pairs of blocks, and a spanning forest of these links."""
    kind = _kind(classes)
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = groups.join(sizes, "component").join(classes, "node")
    placed = (rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "node", "copies", "v"))

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        d = t.select(["block", "node", "copies"]).to_pydict()
        lists = t.column("v").to_pylist()
        b = np.array(d["block"])
        link = _cosines([np.array(x, kind).tobytes() for x in lists], np.array([len(x) for x in lists]), kind) >= threshold
        if i != j:
            link &= b[:, None] != b[None, :]
        node = np.array(d["node"], np.int64)
        return pa.table({"node": node, "links": link @ np.array(d["copies"], np.int64), "root": node[forest(len(node), *np.nonzero(link))]})

    return C.ckpt(placed.groupBy("component", "i", "j").applyInArrow(count, "node long, links long, root long"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, bits: int = BITS,
                    block: int = BLOCK, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding",
                    recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``."""
    C.prepare(vectors.sparkSession)
    rows, classes = classes_of(vectors, id_col, vec_col)
    groups = C.min_label(spanning_links(classes, threshold, passes, bits, block, seed, recall))
    found = complete(classes, groups, threshold, block)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = C.min_label(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    state = (classes.select("node", "rep", "copies").join(links, "node", "left").join(groups, "node", "left")
             .select("node", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "node").alias("component")))
    lowest = state.groupBy("component").agg(F.min("rep").alias("component_id"))
    state = state.join(lowest, "component").select("node", "n_links", "component_id")
    able = rows.where("node is not null").join(state, "node").select("vec_id", "n_links", "component_id")
    not_able = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return able.unionByName(not_able).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_sorted_passes(spark, sf_dir):
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))


#: All pairs, compared directly; components by recursion.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM ok),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r(vec_id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.vec_id)
SELECT r.vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(r.m) AS component_id, r.vec_id = min(r.m) AS kept
FROM r GROUP BY r.vec_id
"""
