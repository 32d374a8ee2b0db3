"""Node sets as masks, the Bloom filter and in-row n-gram overlap."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from langmix.operators.bloom import _places
from langmix.operators import bloom
from langmix.operators import graph as G
from langmix.operators import overlap as O
from langmix.operators import passrate as P


def test_sets_of_many_nodes(spark):
    rng = random.Random(1)
    rows = [(f"n{rng.randrange(150):03d}", rng.randrange(60)) for _ in range(3000)] + [(None, 1), ("n000", None), ("n001", None), ("lone", 9999)]
    df = spark.createDataFrame(rows, "node string, concept int")
    sets = G.node_sets(df, "node", "concept")
    of = defaultdict(set)
    for n, c in rows:
        if n is not None:
            of[c].add(n)
    assert Counter({tuple(r.nodes): r.w for r in sets.collect()}) == Counter(tuple(sorted(s)) for s in of.values())
    size = Counter(n for s in of.values() for n in s)
    assert {r.node: r.n for r in G.set_sizes(sets).collect()} == size
    cropped = {n for r in G.crop_sets(sets, 15).collect() for n in r.nodes}
    assert cropped == {n for n, k in size.items() if k >= 15}
    j = {(r["row"], r["col"]): r["value"] for r in G.set_jaccard(sets).collect()}
    concepts = defaultdict(set)
    for c, s in of.items():
        for n in s:
            concepts[n].add(c)
    for a, b in (("n000", "n001"), ("n077", "n140"), ("lone", "n000"), ("n005", "n005")):
        assert abs(j[a, b] - (1 - len(concepts[a] & concepts[b]) / len(concepts[a] | concepts[b]))) < 1e-12
    assert len(j) == len(size) ** 2


def test_bloom_holds_all_and_few_others(spark):
    words = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    f = bloom.build(words, "word")
    assert words.where(~f.may_hold(F.col("word"))).count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("x"), F.col("id")).alias("word"))
    assert others.where(f.may_hold(F.col("word"))).count() < 400
    none = bloom.build(words.where("false"), "word")
    assert others.where(none.may_hold(F.col("word"))).count() == 0


def test_only_candidates_meet_the_dictionary(spark):
    lines = spark.createDataFrame([(1, "en", "en", ["some", "words"]), (2, "en", "en", ["other", "things"])],
                                  "id int, language string, pred_lang string, tokens array<string>")
    words = spark.createDataFrame([("some",)], "word string")
    comps = lines.select("id", "language")
    out = {r.id: r.word_error for r in P.completion_checks(comps, lines, words, ["id", "language"]).collect()}
    assert out == {1: True, 2: False}
    plan = P.completion_checks(comps, lines, words, ["id", "language"])._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.lower()


def test_ngrams_in_the_row(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for k in range(60)]
    rows += [(100, None, ["a"]), (101, [], [])]
    df = spark.createDataFrame(rows, "k int, ref_tokens array<string>, pred_tokens array<string>")
    for r in O.ngram_matches(df, ["k"]).collect():
        a, b = next((x[1] or [], x[2]) for x in rows if x[0] == r.k)
        for n in (1, 2, 3):
            want = Counter(tuple(a[i:i + n]) for i in range(len(a) - n + 1)) & Counter(tuple(b[i:i + n]) for i in range(len(b) - n + 1))
            assert r[f"n_ngrams_match_{n}"] == sum(want.values())


def test_bit_numbers_of_many_words_do_not_overflow(spark):
    words = spark.range(2_000_000).select(F.col("id").cast("string").alias("w"))
    low, high = words.select(F.explode(F.array(*_places(F.col("w"), 1024))).alias("at")).agg(F.min("at"), F.max("at")).first()
    assert (low, high) == (0, 1023)
