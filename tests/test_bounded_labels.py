"""The detector holds pieces of a batch, and counts in the row what it labels."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from langmix.functions import text as tx
from langmix.operators import lid
from langmix.operators import segment as S
from langmix.plans import inputs as I
from langmix.streaming import incremental as R

TEXTS = {"de": "das ist ein haus und der baum", "en": "this is a house and the tree", "fr": "une maison est un arbre et la rue"}


def _model(spark):
    return lid.train(spark.createDataFrame([(k, v) for k, v in TEXTS.items()], "lang string, text string"))


def _peak(work) -> int:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_memory_of_a_batch_is_bounded(spark):
    m = _model(spark)
    grams, second = lid.Grams(m.grams, m.weights), np.arange(3)
    text = " " + " ".join(TEXTS.values()) + " "
    one, ten = (pa.array([text * 20] * n) for n in (600, 6000))
    a, b = (_peak(lambda c=c: lid.detect(c, grams, m.votes, "cascade", 0.3, second)) for c in (one, ten))  # noqa: B023
    assert b < 1.5 * a < 1 << 27


def test_pieces_cover_all_and_are_bounded():
    col = pa.array(["aé" * n for n in (3, 0, 50, 1)] + [None, "x" * 7, "y" * 7, ""])
    for c in (col, col.slice(2), col.slice(0, 0)):
        for most in (1, 10, 1000):
            got = list(lid.pieces(c, most))
            assert [k for a, b in got for k in range(a, b)] == list(range(len(c)))
            assert all(b - a == 1 or sum(len((x or "").encode()) for x in c.slice(a, b - a).to_pylist()) <= most for a, b in got)


def test_cells_equal_search(monkeypatch):
    rng = np.random.default_rng(2)
    letters = list("abcdeé中 ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(400)] + ["", None]
    keys = np.unique(lid.trigram_keys(*lid.code_points(pa.array(texts[:60])))[0])
    weights = np.vstack([np.round(rng.random((len(keys), 3)), 6), np.zeros((1, 3))])
    table = lid.Grams(keys, weights)
    monkeypatch.setattr(lid, "_CELLS", 1)
    searched = lid.Grams(keys, weights)
    assert table.cells is not None and searched.cells is None
    known = {"".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))): w for k, w in zip(keys.tolist(), weights)}
    points = lid.code_points(pa.array(texts))
    a, b = lid.primary(*points, table), lid.primary(*points, searched)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    for text, label, conf in zip(texts, *a):
        t = text or ""
        s = np.round(sum((known.get(t[k:k + 3], np.zeros(3)) for k in range(len(t) - 2)), np.zeros(3)), 6)
        assert label == s.argmax() and abs(conf - (1 / np.exp(s - s.max()).sum() if s.max() > 0 else -1)) < 1e-9


def test_training_counts_do_not_depend_on_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(k, v) for k, v in TEXTS.items()] * 5 + [("de", None), (None, "zzz")], "lang string, text string").repartition(2)
    rows = lambda: sorted((r.kind, r.lang, r.key, r.gram or "", r.cnt) for r in lid.key_counts(df, "text", "lang").collect())
    want = rows()
    monkeypatch.setattr(lid, "_CHARS", 40)
    monkeypatch.setattr(lid, "_ENTRIES", 8)
    assert rows() == want and sum(r[4] for r in want if r[0] == "word") == 5 * sum(len(v.split()) for v in TEXTS.values())


def test_joined_units_equal_units_one_by_one(spark):
    rows = [(0, ["Abc", "a1b", " x ", "", "..."]), (1, []), (2, None), (3, [None, "ΑΣ", "ΣΑΣ b", "İx", "x\ny", "\n"]), (4, ["1"]), (5, ["ab", " 中文-ж\u0000é"])]
    df = spark.createDataFrame(rows, "id int, a array<string>")
    for r in df.select(lid._joined("a").alias("j"), F.transform("a", tx.char_trigram_text).alias("w")).collect():
        units, count = lid.split_units(pa.array([r.j, None, r.j], pa.string()))
        want = [x if x is not None else "  " for x in (r.w or [])]
        assert units.to_pylist() == want + want and count.tolist() == [len(want), 0, len(want)]


def test_counts_in_the_row_equal_labels(spark):
    m = _model(spark)
    words = " ".join(TEXTS.values()).split() + ["qqq", "", "..."]
    rng = np.random.default_rng(3)
    rows = [(k, list(rng.choice(words, rng.integers(0, 30)))) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame([(k, None if w is None else [str(x) for x in w]) for k, w in rows], "id int, w array<string>").repartition(3)
    labels = {r.id: r.langs for r in lid.label_array(df, "w", m).collect()}
    counts = {r.id: {x.lang: x.n for x in r.counts} for r in lid.count_array(df, "w", m).collect()}
    flat = df.select("id", F.explode("w").alias("t"))
    for k, w in rows:
        assert len(labels[k]) == len(w or []) and counts[k] == {x: labels[k].count(x) for x in set(labels[k])}
    one = {(r.id, r.pred_lang): r.n for r in lid.label_column(flat, "t", m).groupBy("id", "pred_lang").agg(F.count("*").alias("n")).collect()}
    assert one == {(k, x): n for k, c in counts.items() for x, n in c.items()}


def test_lines_are_labelled_once_for_both_levels(spark, tmp_path):
    from langmix.plans import queries as Q
    rows = [(k, f"{a}\n{b} {a}\nqqq zzz www", x, f"s{k % 2}", 9) for k, (x, a) in enumerate(TEXTS.items()) for b in ["und der", "and the"]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    d = Q.both_dists(spark, str(tmp_path))
    assert len(re.findall("ArrowEvalPython", d._jdf.queryExecution().optimizedPlan().toString())) == 2
    both = {(r.level, r.id, r.lang): r.p for r in d.collect()}
    lines, words = ({(name, r.id, r.lang): r.p for r in f(spark, str(tmp_path)).collect()} for name, f in (("line", Q.line_dist), ("word", Q.word_dist)))
    assert both == lines | words and lines and words
    lab = I.labelled_lines(spark, str(tmp_path))
    toks = I.labelled_tokens(lab.where("pred_lang <> 'unknown'"), spark, str(tmp_path)).where("token_lang <> 'unknown'")
    from langmix.operators import dist as D
    assert words == {("word", r.id, r.lang): r.p for r in D.ratios(toks, I.UNIT_KEYS, "token_lang").collect()}


def test_white_space_tokens(spark):
    odd = ["", " ", tx.STRIP_CHARS, "x".join(tx.STRIP_CHARS), " a b ", "a\u200b\ufeffb c", "é\u3000ж"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    assert [r.w for r in df.select(tx.whitespace_tokens("t").alias("w")).collect()] == [x.split() for x in odd]


def test_pass_rate_tokens_are_made_once(spark):
    rows = [(1, "a b c d e\nx y\n\nf g h i j k", "de", "s", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = I.pass_rate_lines(I.completions_from(d))
    assert [(r.line_no, r.line, r.tokens) for r in lines.orderBy("line_no").collect()] == [(0, "a b c d e", list("abcde")), (3, "f g h i j k", list("fghijk"))]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("u3000") == 1


def test_split_stops_where_no_word_goes_on():
    seen = []

    class Costs(dict):
        def get(self, key, default=None):
            seen.append(key)
            return super().get(key, default)

    m = S.Unigrams({"haus": 1.0, "tür": 1.0, "x" * 24: 1.0}, 9.0, 24)
    m.endings = Costs(m.endings)
    assert m.split("haustür" * 40) == ["haus", "tür"] * 40
    assert len(seen) < 5 * 280


def test_stream_batch_is_dealt_out(spark, tmp_path):
    from langmix.plans import reports  # noqa: F401
    from langmix.plans.queries import QUERIES
    rows = [(k, list(TEXTS.values())[k % 3], list(TEXTS)[k % 3], "s", 9) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    real = R.run_counts
    R.run_counts = lambda s, *a, **k: (plans.append(a[4](s.readStream.schema(a[1]).parquet(a[0]))._jdf.queryExecution().logical().toString()), real(s, *a, **k))
    try:
        got = {(r.level, r.lang): r.n for r in QUERIES["incremental_language_totals"](spark, str(tmp_path)).collect()}
    finally:
        R.run_counts = real
    assert "Repartition" in plans[0] and sum(n for (level, _), n in got.items() if level == "line") == 30
