"""Language graphs and similarity.

Sizes, coverage and pair weights all follow from one aggregate, ``node_sets``: each
concept's nodes become a bit mask (``bit_or``, fixed width, pre-aggregated before the
one shuffle by concept), and equal masks are counted.  Only these counts are expanded
into node pairs.  The expansion is bounded by the node vocabulary (a language set),
never by the number of rows of a hot concept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.operators.ranking import exact_quantiles
from langmix.session import cut_lineage


def _pairs_of(arr: Column) -> Column:
    """All (a, b) with a < b of a sorted, distinct array."""
    n = F.size(arr)
    return F.when(n >= 2, F.flatten(F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.transform(F.sequence(i + 1, n),
                              lambda j: F.struct(F.element_at(arr, i).alias("a"),
                                                 F.element_at(arr, j).alias("b"))))))


MAX_NODES = 4096


def node_sets(df: DataFrame, node_col: str, concept_col: str, nodes: DataFrame | None = None) -> DataFrame:
    """(nodes, w): the number of concepts that have exactly this sorted set of
    nodes.  ``nodes`` (one column) may name the vocabulary, which else is read from
    ``df``; at most ``MAX_NODES``.  Null nodes and duplicates do not count."""
    known = (nodes if nodes is not None else df.select(node_col)).distinct().limit(MAX_NODES + 1)
    names = sorted(r[0] for r in known.collect() if r[0] is not None)
    if len(names) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    kind = dict(df.dtypes)[node_col]
    at = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], f"_node {kind}, _at int")
    words = range(max(1, -(-len(names) // 62)))
    rows = df.join(F.broadcast(at), F.col(node_col) == F.col("_node"))
    bit = F.expr("shiftleft(1L, _at % 62)")
    masks = rows.groupBy(F.col(concept_col).alias("_concept")).agg(
        *[F.bit_or(F.when(F.floor(F.col("_at") / 62) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in words])
    counts = masks.groupBy(*[f"m{k}" for k in words]).agg(F.count(F.lit(1)).alias("w"))
    mask, every = F.array(*[f"m{k}" for k in words]), F.lit(names) if names else F.array().cast(f"array<{kind}>")
    own = F.filter(every, lambda x, i: F.getbit(F.get(mask, F.floor(i / 62).cast("int")), i % 62) == 1)
    return cut_lineage(counts.select(own.alias("nodes"), "w"))


def set_sizes(sets: DataFrame) -> DataFrame:
    """(node, n): the number of concepts of each node."""
    return sets.select(F.explode("nodes").alias("node"), "w").groupBy("node").agg(F.sum("w").alias("n"))


def crop_sets(sets: DataFrame, min_concepts: int = 3) -> DataFrame:
    """Node sets without the nodes present in fewer than ``min_concepts`` concepts."""
    kept = set_sizes(sets).filter(F.col("n") >= min_concepts).agg(F.collect_set("node")).scalar()
    left = sets.select(F.array_intersect("nodes", kept).alias("nodes"), "w").filter(F.size("nodes") > 0)
    return left.groupBy(F.array_sort("nodes").alias("nodes")).agg(F.sum("w").alias("w"))


def set_edges(sets: DataFrame) -> DataFrame:
    """G1: undirected edges (a < b) weighted by the number of shared concepts."""
    e = sets.select(F.explode(_pairs_of(F.col("nodes"))).alias("e"), "w")
    return e.groupBy(F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.sum("w").alias("weight"))


def cooccurrence(inc: DataFrame) -> DataFrame:
    """G1 from (node, concept) rows."""
    return set_edges(node_sets(inc, "node", "concept"))


def degrees(df: DataFrame, node_col: str) -> DataFrame:
    """Rows per node (not de-duplicated)."""
    return df.groupBy(F.col(node_col).alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def pmi_edges(edges: DataFrame, deg: DataFrame, min_degree: int = 3) -> DataFrame:
    """Keep nodes with degree >= min_degree (edges with both ends kept),
    PMI = log2(w N) - log2(x y) with N = sum of kept degrees, min-max normalised."""
    kept = deg.filter(F.col("degree") >= min_degree)
    n_total = kept.agg(F.sum("degree")).scalar()   # scalar subquery, evaluated once
    e = (edges.join(kept.select(F.col("node").alias("a"), F.col("degree").alias("deg_a")), "a")
         .join(kept.select(F.col("node").alias("b"), F.col("degree").alias("deg_b")), "b"))
    e = e.withColumn("pmi", F.log2(F.col("weight") * n_total) - F.log2(F.col("deg_a") * F.col("deg_b")))
    return min_max(e, "pmi", "pmi_norm")


def min_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """``(x - min) / (max - min)``; NULL when max = min."""
    mn, mx = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    return df.withColumn(out, F.try_divide(F.col(col) - mn, mx - mn))


def degree_quantiles(deg: DataFrame, q: float = 0.25) -> DataFrame:
    """Exact degree quantile (linear interpolation) and maximum."""
    low = exact_quantiles(deg, [], "degree", [q])
    return deg.agg(low.scalar().alias("q"), F.max("degree").alias("max_degree"))


def jaccard(inc: DataFrame) -> DataFrame:
    """G9 from (node, concept) rows."""
    return set_jaccard(node_sets(inc, "node", "concept"))


def set_jaccard(sets: DataFrame) -> DataFrame:
    """Jaccard distance ``1 - |A n B| / |A u B|`` for all node pairs, both
    orientations, with the 0 diagonal; 1 for pairs that share no concept.  The
    result is nodes x nodes: nodes are languages or nations, not documents."""
    inter, size = set_edges(sets), set_sizes(sets)
    e = (inter.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
         .join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"))
    d = e.select("a", "b", (F.lit(1.0) - F.col("weight") / (F.col("na") + F.col("nb") - F.col("weight")))
                 .alias("value"))
    both = d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    return (node_grid(size).join(both.select(F.col("a").alias("row"), F.col("b").alias("col"), "value"), ["row", "col"], "left")
            .select("row", "col", F.coalesce("value", F.when(F.col("row") == F.col("col"), 0.0).otherwise(1.0)).alias("value")))


def node_grid(nodes: DataFrame, node_col: str = "node") -> DataFrame:
    """(row, col): all pairs of a bounded node set."""
    n = nodes.select(F.col(node_col).alias("row")).distinct()
    every = n.agg(F.collect_set("row")).scalar()  # one entry per node
    return n.select("row", F.explode(every).alias("col"))


def cosine_scaled(vectors: DataFrame, key_col: str, vec_col: str) -> DataFrame:
    """``(cos + 1) / 2`` for all node pairs of dense vectors."""
    long = vectors.select(F.col(key_col).alias("node"),
                          F.posexplode(F.col(vec_col)).alias("dim", "x")) \
        .withColumn("x", F.col("x").cast("double"))
    return cosine_scaled_long(long)


def cosine_scaled_long(long: DataFrame) -> DataFrame:
    """G12 on sparse vectors (node, dim, x): a sparse matrix product - the
    vectors are self-joined on the dimension and summed per node pair."""
    a = long.select(F.col("node").alias("row"), "dim", F.col("x").alias("xa"))
    b = long.select(F.col("node").alias("col"), "dim", F.col("x").alias("xb"))
    dots = a.join(b, "dim").groupBy("row", "col").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    norms = long.groupBy("node").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nrm"))
    d = (dots.join(norms.select(F.col("node").alias("row"), F.col("nrm").alias("na")), "row")
         .join(norms.select(F.col("node").alias("col"), F.col("nrm").alias("nb")), "col"))
    cos = F.try_divide(F.col("dot"), F.col("na") * F.col("nb"))
    return d.select("row", "col", ((cos + 1) / 2).alias("value"))


def nan_euclidean_pairs(features: DataFrame, node_col: str, feature_col: str, value_col: str) -> DataFrame:
    """Per node pair, ``sqrt(F / n_present * sum(d^2))`` over features
    present for both, of F features in all; pairs with no common feature get 0.
    All pairs of the (bounded) node set are returned; the join is computed for
    one orientation only."""
    n_features = features.agg(F.countDistinct(feature_col)).scalar()
    f = features.filter(F.col(value_col).isNotNull()).select(
        F.col(node_col).alias("node"), F.col(feature_col).alias("f"), F.col(value_col).cast("double").alias("x"))
    a = f.select(F.col("node").alias("row"), "f", F.col("x").alias("xa"))
    b = f.select(F.col("node").alias("col"), "f", F.col("x").alias("xb"))
    g = a.join(b.withColumnRenamed("f", "f2"), (F.col("f") == F.col("f2")) & (F.col("row") < F.col("col"))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("np"),
                                                  F.sum(F.pow(F.col("xa") - F.col("xb"), 2)).alias("ss"))
    d = g.select("row", "col", F.sqrt(n_features / F.col("np") * F.col("ss")).alias("value"))
    both = d.unionByName(d.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    return (node_grid(features, node_col).join(both, ["row", "col"], "left")
            .select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")))


def induced_subgraph(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b",
                     node_col: str = "node") -> DataFrame:
    """Edges whose both ends are in ``nodes``."""
    n = nodes.select(F.col(node_col).alias("_n")).distinct()
    return (edges.join(n.withColumnRenamed("_n", a), a, "left_semi")
            .join(n.withColumnRenamed("_n", b), b, "left_semi"))


def neighbour_lists(lists: DataFrame, node_col: str = "node", list_col: str = "neighbours") -> DataFrame:
    """(node, [(neighbour, score)]) lists to a full matrix: missing pairs 0,
    the diagonal 1, the first score of a repeated neighbour."""
    to, score = lists.schema[list_col].dataType.elementType.names[:2]
    e = lists.select(F.col(node_col).alias("row"), F.posexplode(list_col).alias("pos", "x")) \
        .select("row", "pos", F.col("x")[to].alias("col"), F.col("x")[score].cast("double").alias("value"))
    e = e.groupBy("row", "col").agg(F.min_by("value", "pos").alias("value"))
    nodes = e.select(F.col("row").alias("node")).union(e.select("col"))
    return (node_grid(nodes).join(e, ["row", "col"], "left")
            .select("row", "col", F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value")))
