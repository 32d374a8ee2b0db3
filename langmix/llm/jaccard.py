"""N-gram Jaccard join by MinHash banding.

1. One pass hashes every text's word shingles and keeps ``bands x rows`` minima.
   Band and row counts come from the wanted recall at the threshold (``banding``).
2. Rows with equal word sequences become one class (a group, however large, is
   pre-aggregated and never expanded into pairs).
3. Bands are shuffled on (band, hash); every bucket ties its classes to its
   smallest one, and connected components of these ties give the candidate groups.
4. All pairs of a candidate group are verified exactly on full shingle sets, in blocks of
   ``BLOCK`` classes; each pair of blocks is a task of its own.  Where colliding strangers
   chain a group of more than a block together, so that its buckets hold fewer pairs than
   it does, its buckets are verified instead, and a pair counts in the first bucket that
   it shares.  Either way every pair that shares a band is verified.  Tasks return
   link counts and a spanning forest, not the pairs.

Words are maximal runs outside space and \\t\\n\\v\\f\\r, unchanged.  A text of 1 to
n-1 words has one shingle, all its words; null texts and texts without words link
with nothing.  Repeated rows are copies of each other.  Rows with a null id take
part; a class whose ids are all null has a null class_id.  Texts are identified by
64-bit hashes of their word sequences.  Other columns of the input are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.llm import common as C
from langmix.llm.text import MULT, buffers, grams, mix, tokens

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 96
BLOCK = 400
_PART = 1 << 16


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band (fewest false candidates) whose recall
    1 - (1 - t^rows)^bands at the threshold reaches ``recall`` within ``max_hashes``."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if bands * rows <= max_hashes:
            return bands, rows
    return max_hashes, 1


def shingle_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and where each text's begin."""
    g = grams(h, n)
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.uint64)
    long_ = words >= n
    # places of whole shingles: a run for each long text
    src = np.repeat(first[:-1][long_] - np.concatenate([[0], np.cumsum(count[long_])])[:-1], count[long_]) + np.arange(count[long_].sum())
    dst = np.repeat(long_, count)
    out[dst] = g[src]
    for k in np.flatnonzero((words > 0) & ~long_):
        out[begin[k]] = fingerprint(h[first[k]:first[k + 1]])
    return out, begin


def fingerprint(h: np.ndarray) -> np.uint64:
    """One hash of a sequence of word hashes."""
    with np.errstate(over="ignore"):
        acc = np.uint64(len(h))
        for at in range(0, len(h), _PART):
            x = h[at:at + _PART]
            acc = mix(np.array([acc]))[0] + mix(x + np.arange(at + 1, at + len(x) + 1, dtype=np.uint64) * MULT).sum(dtype=np.uint64)
        return mix(np.array([acc]))[0]


def minima(values: np.ndarray, begin: np.ndarray, hashes: int) -> np.ndarray:
    """(texts x hashes) minima of ``hashes`` random functions of each text's values."""
    a = mix(np.arange(1, hashes + 1, dtype=np.uint64) * MULT) | np.uint64(1)
    b = mix(a)
    texts = len(begin) - 1
    out = np.full((texts, hashes), np.iinfo(np.uint64).max, np.uint64)
    # cut long runs so that temporaries stay small; a text may lie in several parts
    for lo in range(0, int(begin[-1]), _PART):
        x = values[lo:lo + _PART]
        own = np.arange(np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, lo + len(x)))
        own = own[np.diff(begin)[own] > 0]
        at = np.maximum(begin[own] - lo, 0)
        for k in range(hashes):
            m = np.minimum.reduceat((x ^ b[k]) * a[k], at)
            out[own, k] = np.minimum(out[own, k], m)
    return out


def text_print(text_col: str = "text") -> Column:
    """With the id it tells rows apart: rows that agree in both are copies."""
    return F.xxhash64(F.col(text_col).cast("string"))


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    cols = [f"b{k}" for k in range(bands)]

    def run(batches):
        for batch in batches:
            for b in C.pieces(batch, "text"):
                _, _, h, first = tokens(*buffers(b.column(1)))
                s, begin = shingle_hashes(h, first, n)
                m = minima(s, begin, bands * rows).reshape(len(first) - 1, bands, rows)
                band = np.zeros(m.shape[:2], np.uint64)
                for r in range(rows):
                    band = mix(band * MULT + m[:, :, r])
                fp = np.array([fingerprint(h[a:z]) for a, z in zip(first[:-1], first[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(np.diff(first)), pa.array(fp.view(np.int64))]
                    + [pa.array(np.ascontiguousarray(band[:, k]).view(np.int64)) for k in range(bands)],
                    ["doc_id", "print", "n_words", "node", *cols])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      text_print(text_col).alias("print"))
    ddl = "doc_id long, print long, n_words long, node long, " + ", ".join(f"{c} long" for c in cols)
    return src.mapInArrow(run, ddl)


def set_rows(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, copies, units, bands, shingles): the sorted distinct shingle hashes of the
    wanted rows (doc_id, print, node, copies, units, bands).  Rows meet on id and print,
    so null or shared ids bring nothing together; of copies a task reads one."""
    def run(batches):
        known: set[int] = set()
        for batch in batches:
            for b in C.pieces(batch, "text"):
                nodes = b.column(1).to_pylist()
                fresh = [k for k, x in enumerate(nodes) if x not in known and not known.add(x)]
                b = b.take(pa.array(fresh, pa.int64()))
                _, _, h, first = tokens(*buffers(b.column(0)))
                s, begin = shingle_hashes(h, first, n)
                fp = np.array([fingerprint(h[a:z]) for a, z in zip(first[:-1], first[1:])], np.uint64).view(np.int64)
                mine = pa.array(fp == b.column(1).to_numpy())
                sets = [np.unique(s[a:z]).tobytes() for a, z in zip(begin[:-1], begin[1:])]
                known.difference_update(x for x, ok in zip(b.column(1).to_pylist(), mine.to_pylist()) if not ok)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.binary())], [*b.schema.names[1:], "shingles"]).filter(mine)

    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"), text_print(text_col).alias("_print"))
    rows = src.join(wanted, src["_id"].eqNullSafe(wanted["doc_id"]) & (src["_print"] == wanted["print"]))
    return rows.select("text", "node", "copies", "units", "bands").mapInArrow(
        run, f"node long, copies long, units {UNITS}, bands array<long>, shingles binary")


#: where a class is verified: a candidate group (band -1) or a bucket, and its blocks
UNITS = "array<struct<grp: long, band: int, blocks: int>>"


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: which pairs of sets have at least this Jaccard similarity."""
    t = Fraction(str(threshold))
    size = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(column, minlength=len(values)) > 1
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    width = max(64, (1 << 22) // len(sets))
    for lo in range(0, int(often.sum()), width):
        a, z = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((len(sets), min(width, int(often.sum()) - lo)), np.float32)
        x[owner[a:z], column[a:z] - lo] = 1
        common += x @ x.T
    np.fill_diagonal(common, size)
    total = size[:, None] + size[None, :] - common
    out = common * t.denominator >= total * t.numerator
    np.fill_diagonal(out, False)
    return out


def verify(table: pa.Table, threshold: float, i: int, j: int) -> pa.Table:
    """Links among one block of a group, or between two of its blocks."""
    t = table.to_pydict()
    seen: dict[int, int] = {}
    for k, node in enumerate(t["node"]):
        seen.setdefault(node, k)
    ks = list(seen.values())
    node = np.array([t["node"][k] for k in ks], np.int64)
    block = np.array([t["block"][k] for k in ks])
    copies = np.array([t["copies"][k] for k in ks], np.int64)
    a = linked([np.frombuffer(t["shingles"][k], np.uint64) for k in ks], threshold) if ks else np.zeros((0, 0), bool)
    if ks and t["band"][0] > 0:  # a pair counts in the first bucket that it shares
        bands = np.array([t["bands"][k] for k in ks])
        for k in range(t["band"][0]):
            a &= bands[:, None, k] != bands[None, :, k]
    if i != j:
        a &= block[:, None] != block[None, :]
    label = np.arange(len(ks))
    while len(ks):
        near = np.where(a, label[None, :], len(ks)).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    has = a.any(axis=1) if len(ks) else np.zeros(0, bool)
    return pa.table({"node": node[has], "links": (a @ copies)[has] if len(ks) else node[has],
                     "root": node[label[has]] if len(ks) else node[has]},
                    schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))


def components(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
               id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, print, n_words, node), (classes of equal word sequences: node,
    rep, n_links, component, class_id); rows without words are in no class."""
    spark = docs.sparkSession
    C.prepare(spark)
    bands, rows = banding(threshold, recall)
    sig = C.ckpt(signatures(docs, words, bands, rows, id_col, text_col))
    cols = [f"b{k}" for k in range(bands)]
    classes = C.ckpt(sig.where("n_words > 0").groupBy("node")
                     .agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("print", "doc_id"), F.min("print")).alias("print"),
                          F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in cols]))
    band = classes.select("node", F.posexplode(F.array(*cols)).alias("band", "hash"))
    buckets = (band.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
               .where("n > 1"))
    shared = C.ckpt(band.join(buckets, ["band", "hash"]))
    ties = shared.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    groups = C.min_label(ties)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # pairs in the buckets of a group of several blocks, against all pairs of the group
    wide = groups.join(sizes.where(F.col("size") > block), "component")
    inside = shared.join(wide, "node").groupBy("component", "band", "hash").agg(F.count(F.lit(1)).alias("m"), F.first("size").alias("size"))
    chained = (inside.groupBy("component").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"), F.first("size").alias("size"))
               .where(F.col("pairs") < F.col("size").cast("double") * F.col("size")).select("component", F.lit(True).alias("chained")))
    plan = C.ckpt(groups.join(sizes, "component").join(chained, "component", "left"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int").alias("blocks")
    whole = plan.where("chained is null").select("node", F.col("component").alias("grp"), F.lit(-1).alias("band"), blocks("size"))
    parts = (shared.join(plan.where("chained"), "node")
             .select("node", F.xxhash64("band", "hash").alias("grp"), F.col("band").cast("int").alias("band"), blocks("n")))
    units = whole.unionByName(parts).groupBy("node").agg(F.collect_list(F.struct("grp", "band", "blocks")).alias("units"))  # a bucket a band at most
    bands_of = F.when(F.get("units", 0)["band"] >= 0, F.array(*cols)).alias("bands")
    wanted = units.join(classes, "node").select(F.col("rep").alias("doc_id"), "print", "node", "copies", "units", bands_of)
    sets = set_rows(docs, wanted, words, id_col, text_col)
    each = sets.select("node", "copies", "bands", "shingles", F.explode("units").alias("u")).select(
        "node", "copies", "bands", "shingles", "u.grp", "u.band", "u.blocks")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (each.withColumn("block", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "node", "copies", "band", "bands", "shingles"))

    def pairs(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return verify(t, threshold, key[1].as_py(), key[2].as_py())

    found = C.ckpt(placed.groupBy("grp", "i", "j").applyInArrow(pairs, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    united = C.min_label(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    state = (classes.select("node", "rep", "copies").join(links, "node", "left").join(united, "node", "left")
             .select("node", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "node").alias("component")))
    lowest = state.groupBy("component").agg(F.min("rep").alias("class_id"))
    return sig.select("doc_id", "print", "n_words", "node"), state.join(lowest, "component")


def similarity_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
                       id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id reachable by links),
    n_links (other rows linked directly, copies included), kept (doc_id = class_id)."""
    sig, state = components(docs, words, threshold, recall, id_col, text_col, block)
    state = state.select("node", "class_id", "n_links")
    some = sig.where("n_words > 0").select("doc_id", "node").join(state, "node").select("doc_id", "class_id", "n_links")
    none = sig.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def surplus(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """What to drop so that one row of each component stays, one that bears its
    smallest id: (gone: doc_id, print), all rows with these go, and (again: doc_id,
    print), of the rows with these one stays.  Ids may be null or repeat: a component
    is told by its classes, a row by its id and text."""
    sig, state = components(docs, **options)
    head = (state.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("component", "class_id")
            .agg(F.min("node").alias("node")).select("node", "class_id", F.lit(True).alias("head")))
    rows = C.ckpt(sig.where("n_words > 0").join(head, "node", "left")
                  .select("doc_id", "print", "node", (F.col("head").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first")))
    # texts of one class may differ in their spaces
    forms = rows.where("first").groupBy("node", "doc_id", "print").agg(F.count(F.lit(1)).alias("copies"))
    forms = C.ckpt(forms.join(forms.groupBy("node").agg(F.min("print").alias("best")), "node"))
    gone = (rows.where("not first").select("doc_id", "print")
            .unionByName(forms.where("print <> best").select("doc_id", "print")).distinct())
    return gone, forms.where("print = best and copies > 1").select("doc_id", "print")


def op10_jaccard_join(spark, sf_dir):
    return similarity_classes(C.table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle is counted; components by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 9 * k >= 4 * (na + nb)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, min(r.m) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links, d.doc_id = min(r.m) AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
