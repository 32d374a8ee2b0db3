"""Distributed ranks and exact quantiles against plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from langmix.operators import ranking as R
from langmix.operators import stats as S
from langmix.operators import typology as Y


def test_prefix_sums_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), k, rng.randrange(5)) for k in range(2000)] + [(None, k, 1) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, o long, w int").repartition(7)
    got = {(r.g, r.o): r.before for r in R.prefix_sums(df, "g", "o", "w").collect()}
    for g in ("a", "b", None):
        total = 0
        for _, o, w in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[g, o] == total
            total += w


def test_label_encode_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "x string")
    assert sorted(((r.x or "", r.code) for r in Y.label_encode(df, "x", "code").collect())) == [("", None), ("a", 0), ("b", 1), ("b", 1), ("c", 2)]


def plain(v, q):
    v = sorted(v)
    at = q * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if lo == hi else lo * (math.ceil(at) - at) + hi * (at - math.floor(at))


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [("even", rng.random()) for _ in range(3000)] + [("far", 10.0 ** rng.randrange(-200, 300)) for _ in range(500)]
    rows += [("one", 5.0), ("same", 2.0), ("same", 2.0), (None, -1.0), (None, 3.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    rows += [("inf", x) for x in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))] + [("hot", float(k % 3)) for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: list(r)[1:] for r in R.exact_quantiles(df, ["g"], "v", qs, bins=16).collect()}
    assert "none" not in got and got["nan"] == [1.0] * 6
    for g in ("even", "far", "one", "same", None, "hot", "inf"):
        v = [x for k, x in rows if k == g]
        for q, x in zip(qs, got[g]):
            assert x == plain(v, q) or math.isclose(x, plain(v, q), rel_tol=1e-12), (g, q)
    assert R.exact_quantiles(df.where("false"), ["g"], "v", qs).count() == 0
    assert R.exact_quantiles(df.where("g = 'even'"), [], "v", [0.5]).first()[0] == plain([x for k, x in rows if k == "even"], 0.5)


def test_ranks_of_many_measures_and_lookup_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_ROWS", 3)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 40, 500).astype(float)
    b = a + rng.integers(0, 30, 500)
    c = rng.random(500)
    df = spark.createDataFrame([(float(x), float(y), float(z) if k % 4 else None) for k, (x, y, z) in enumerate(zip(a, b, c))], "a double, b double, c double")

    def rank(v):
        return np.array([((v < x).sum() + (v <= x).sum() + 1) / 2 for x in v])

    got = {(r.a, r.b): r.r for r in S.spearman_long(df, ["a", "b", "c"]).collect()}
    keep = np.arange(500) % 4 > 0
    for (p, x), (q, y), k in ((("a", a), ("b", b), slice(None)), (("a", a), ("c", c), keep), (("b", b), ("c", c), keep)):
        assert abs(got[p, q] - np.corrcoef(rank(x[k]), rank(y[k]))[0, 1]) < 1e-6


def test_box_summary_columns(spark):
    df = spark.range(101).select((F.col("id") % 1).alias("g"), F.col("id").cast("double").alias("v"))
    assert tuple(S.box_summary(df, ["g"], "v").first()) == (0, 5.0, 25.0, 50.0, 75.0, 95.0)
