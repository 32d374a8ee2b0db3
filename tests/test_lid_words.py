"""The detector's tables: keys, votes that grow with the words, the way beyond a broadcast."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from langmix.operators import lid


def test_a_million_words_leave_strangers_unvoted():
    def keys(prefix):
        text = " " + " ".join(f"{prefix}{k}" for k in range(1_000_000)) + " "
        return lid.word_keys(*lid.code_points(pa.array([text])))[0]

    known, strange = keys("w"), keys("x")
    assert len(np.unique(known)) == 1_000_000 and not np.isin(strange, known).any()
    votes = np.arange(1_000_000) % 7
    table = lid.WordVotes(known, votes)
    assert (table.find(known) == votes).all()
    assert (table.find(strange) == -1).all()
    assert (lid.WordVotes(known[:0], votes[:0]).find(strange[:5]) == -1).all()


def test_word_keys_tell_neighbours_apart():
    words = [a + b + c for a in "abcdefghij~ÿ中" for b in "abcdefghij~ÿ中" for c in ["", "a", "z", "中"]]
    keys, begin = lid.word_keys(*lid.code_points(pa.array([f" {w} " for w in words])))
    assert len(set(keys.tolist())) == len(words) and begin.tolist() == list(range(len(words) + 1))


def test_profile_holds_real_trigrams(spark):
    df = spark.createDataFrame([("de", "das Öl"), ("en", "the the"), (None, "zzz")], "lang string, text string")
    got = {(r.lang, r.gram): r.cnt for r in lid.train(df).profile.collect()}
    assert got["en", "the"] == 2 and got["de", " öl"] == 1 and not any("z" in g for _, g in got)


def test_votes_by_shuffle_equal_votes_in_the_row(spark, monkeypatch):
    langs = {"de": "das ist ein haus und der baum", "en": "this is a house and the tree", "fr": "une maison est un arbre et la rue"}
    df = spark.createDataFrame([(k, v) for k, v in langs.items()], "lang string, text string")
    small = lid.train(df)
    monkeypatch.setattr(lid, "MAX_WORDS", 3)
    large = lid.train(df)
    assert small.votes is not None and large.votes is None
    words = " ".join(langs.values()).split()
    rng = np.random.default_rng(1)
    lines = [" ".join(rng.choice(words + ["qqq", "xyz"], rng.integers(0, 7))) for _ in range(200)] + [None, "", "qqq"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string").repartition(3)
    for threshold in (0.3, 0.9, 0.999):
        for options in ({}, {"code_map": {"de": "de", "en": "en"}, "unmapped": lid.OTHERS}):
            a, b = [{r.id: r.pred_lang for r in lid.label_column(rows, "line", m, threshold=threshold, **options).collect()} for m in (small, large)]
            assert a == b and len(a) == len(lines)
    single = lid.label_column(rows, "line", large, mode="single").where(F.col("line") == "qqq").first().pred_lang
    assert single == lid.UNKNOWN
