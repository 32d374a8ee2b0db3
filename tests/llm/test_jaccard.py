import numpy as np

from langmix.llm import jaccard as J
from tests.llm import fixtures as X


def test_banding_reaches_recall():
    bands, rows = J.banding(0.8, 0.9995)
    assert bands * rows <= J.MAX_HASHES and 1 - (1 - 0.8 ** rows) ** bands >= 0.9995


def test_matches_brute_force(spark):
    docs = X.documents() + [(400 + k, " ".join(X.documents()[30][1].split()[:250 + 3 * k]), "en", "s0") for k in range(12)]
    want = X.jaccard_classes(docs)
    got = J.similarity_classes(X.frame(spark, docs))
    assert X.rows_of(got) == want
    # groups cut into blocks give the same links
    assert X.rows_of(J.similarity_classes(X.frame(spark, docs), block=3)) == want


def test_linked_is_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    got = J.linked(sets, 0.5)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 2 * both >= len(a) + len(b) - both)


def test_empty_table(spark):
    assert J.similarity_classes(X.empty(spark)).count() == 0


def test_chained_groups_go_by_bucket(spark):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 100_000, 6000)]
    docs = [(k, " ".join(words[s:s + 240]), "en", "s") for k, s in enumerate([*range(0, 4000, 40), *range(0, 4000, 150)])]
    docs += [(500 + k, " ".join(words[60:300] + [f"end{k}"]), "en", "s") for k in range(9)]
    docs += [(600 + k, docs[3][1], "en", "s") for k in range(3)]
    want = X.jaccard_classes(docs)
    for block in (3, 20):
        assert X.rows_of(J.similarity_classes(X.frame(spark, docs), block=block)) == want, block


def test_many_rows_without_id(spark):
    from pyspark.sql import functions as F
    docs = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"t{j}x"), F.col("id") % 20_000) for j in range(9)]).alias("text"))
    out = J.similarity_classes(docs)
    assert out.groupBy("n_links").count().collect() == [(2, 60_000)]


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(6)
    docs = []
    for k in range(400):  # 200 words: 196 shingles, of which 21 change: similarity 0.806
        w = [f"{k}w{x}" for x in range(200)]
        v = list(w)
        at = int(rng.integers(10, 170))
        v[at:at + 17] = [f"{k}v{x}" for x in range(17)]
        docs += [(2 * k, " ".join(w), "en", "s"), (2 * k + 1, " ".join(v), "en", "s")]
    found = X.rows_of(J.similarity_classes(X.frame(spark, docs)))
    linked = sum(r[2] for r in found)
    assert all(r[2] <= 1 and r[1] // 2 == r[0] // 2 for r in found)  # no strangers
    assert linked >= 2 * 400 * 0.99
