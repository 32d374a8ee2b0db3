import numpy as np

from langmix.llm import decontaminate as D
from tests.llm import fixtures as X


def items(docs):
    w = X.plain_words(docs[4][1])
    return [(1, " ".join(w[2:30])), (2, "Idiot"), (3, ""), (None, None), (4, "two three"), (5, docs[100 % len(docs)][1]),
            (5, docs[100 % len(docs)][1]), (None, "one"), (6, "été à")]


def test_matches_brute_force(spark):
    docs = X.documents()
    bench = spark.createDataFrame(items(docs), "item_id long, text string")
    want = X.decontaminated(docs, items(docs))
    assert sum(k[5] * n for k, n in want.items()) > 3
    assert X.rows_of(D.decontaminate(X.frame(spark, docs), bench)) == want
    # the same in several blocks of the query set
    assert X.rows_of(D.decontaminate(X.frame(spark, docs), bench, block_words=40)) == want


def test_empty_tables(spark):
    docs = X.documents()[:5]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(X.empty(spark), none).count() == 0
    assert X.rows_of(D.decontaminate(X.frame(spark, docs), none)) == X.decontaminated(docs, [])


def test_phrases_and_proximity(spark):
    df = X.frame(spark, [(1, "The cat sat, on the cat mat", "en", "a"), (2, "cat on a big mat", "en", "a"), (3, None, "en", "a")])
    index = D.build_index(df)
    exact = D.phrase_matches(index, [("a", "the cat"), ("b", "dog"), ("c", "CAT on")])
    assert sorted(map(tuple, exact.collect())) == [(1, "a", 0, 2), (1, "a", 4, 6), (2, "c", 0, 2)]
    near = D.phrase_matches(index, [("m", "cat mat")], slop=3)
    assert sorted(map(tuple, near.collect())) == [(1, "m", 5, 7), (2, "m", 0, 5)]


def test_items_are_cut_between_windows():
    words = np.arange(1, 24, dtype=np.uint64)
    rows = [{"item": "a", "terms": words.tobytes()}, {"item": "b", "terms": words[:3].tobytes()}]
    q = D.Query.of(rows, 10)
    assert q.names == ["a", "b"] and [(w, len(s)) for w, s, _ in q.windows] == [(3, 1), (10, 14)]


def test_long_items_and_many_blocks(spark):
    """One item of many blocks; words of it in documents, over the cuts of its pieces."""
    words = [f"w{i}" for i in range(400)]
    bench = [(1, " ".join(words)), (2, "w5 w6"), (3, " ".join(words[:9]))]
    docs = [(i, " ".join(["x"] * i + words[a:z] + ["y"]), "en", "a") for i, (a, z) in
            enumerate([(0, 400), (17, 27), (18, 27), (91, 103), (390, 400), (391, 400), (0, 9), (4, 7)])] + [(99, None, "en", "a"), (98, "", "en", "a")]
    want = X.decontaminated(docs, bench)
    df, items_ = X.frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")
    for block_words in (64, 1 << 18):
        assert X.rows_of(D.decontaminate(df, items_, block_words=block_words)) == want
    pieces = D.item_pieces(items_, 10, "item_id", "text", 8).collect()
    assert max(len(r["terms"]) // 8 for r in pieces) == 17 and len(pieces) == 49 + 2
