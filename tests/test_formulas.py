"""Hand-checked micro cases (FIXTURES.md part C) and properties."""

import math

import pytest
from pyspark.sql import functions as F

from langmix.operators import dist as D
from langmix.operators import divergence as K
from langmix.operators import entropy as E
from langmix.operators import graph as G
from langmix.operators import overlap as O
from langmix.operators import passrate as P
from langmix.operators import prompts as C
from langmix.operators import stats as S
from langmix.operators import typology as Y


def _dist(spark, rows, expected="de", training=("en",)):
    df = spark.createDataFrame([(1, l, p) for l, p in rows], "id int, lang string, p double")
    return df.withColumn("expected", F.lit(expected)).withColumn(
        "training", F.array(*[F.lit(t) for t in training]).cast("array<string>"))


def test_entropy_variants(spark):
    d = _dist(spark, [("de", .7), ("en", .2), ("unk", .1)])
    r = E.entropies(d, ["id"]).first()
    assert r["entropy_all"] == pytest.approx(0.801819, abs=1e-6)          # E1
    assert r["entropy_out_expected"] == pytest.approx(0.636514, abs=1e-6)  # E3
    assert r["reweighted_entropy_expected"] == pytest.approx(0.659149, abs=1e-6)  # E5
    assert r["reweighted_entropy"] == pytest.approx(1.624811, abs=1e-6)   # E4
    assert r["weighted_entropy"] == pytest.approx(0.230259, abs=1e-6)     # E6


def test_entropy_empty_set_is_zero(spark):
    d = _dist(spark, [("de", 1.0)])
    r = E.entropies(d, ["id"]).first()
    assert r["entropy_out"] == 0.0 and r["entropy_out_expected"] == 0.0


def test_norm_entropy_base2(spark):
    v = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 1.0)], "id int, v double")
    assert E.norm_entropy_base2(v, ["id"]).first()["norm_entropy"] == pytest.approx(1.5)  # E7


def test_kl_by_column_support(spark):
    p = spark.createDataFrame([("a", "c", .6), ("b", "c", 0.0), ("d", "c", .4)], "row string, col string, value double")
    q = spark.createDataFrame([("a", "c", .5), ("b", "c", .9), ("d", "c", .5)], "row string, col string, value double")
    assert K.kl_by_column(p, q).first()["kl"] == pytest.approx(0.020136, abs=1e-6)  # K11


def test_nan_euclidean(spark):
    a = spark.createDataFrame([("r", "c1", 0.0), ("r", "c2", 1.0), ("r", "c3", 2.0), ("r", "c4", None)],
                              "row string, col string, value double")
    b = spark.createDataFrame([("r", "c1", 1.0), ("r", "c2", 1.0), ("r", "c3", 4.0), ("r", "c4", 7.0)],
                              "row string, col string, value double")
    assert K.nan_euclidean(a, b).first()["nan_euclidean"] == pytest.approx(2.581989, abs=1e-6)  # K14


def test_pmi_and_jaccard(spark):
    # w = 3, N = 20, x = 6, y = 5 -> log2(60) - log2(30) = 1
    edges = spark.createDataFrame([("a", "b", 3)], "a string, b string, weight long")
    deg = spark.createDataFrame([("a", 6), ("b", 5), ("c", 9)], "node string, degree long")
    assert G.pmi_edges(edges, deg, 3).first()["pmi"] == pytest.approx(1.0)
    # |A n B| = 2, |A u B| = 5 -> 0.6
    inc = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 2), ("B", 3), ("B", 4), ("B", 5)],
                                "node string, concept int")
    j = {(r["row"], r["col"]): r["value"] for r in G.jaccard(inc).collect()}
    assert j[("A", "B")] == pytest.approx(0.6) and j[("B", "A")] == pytest.approx(0.6)
    assert j[("A", "A")] == 0.0


def test_cosine_scaled(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.6, 0.8])], "k string, v array<double>")
    m = {(r["row"], r["col"]): r["value"] for r in G.cosine_scaled(v, "k", "v").collect()}
    assert m[("x", "y")] == pytest.approx(0.8) and m[("x", "x")] == pytest.approx(1.0)  # G12


def test_token_overlap(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "b", "d", "e"])],
                                  "k int, ref_tokens array<string>, pred_tokens array<string>")
    r = O.token_set_scores(pairs, ["k"]).first()
    assert r["precision"] == pytest.approx(2 / 3) and r["recall"] == pytest.approx(0.5)
    assert r["f1"] == pytest.approx(0.571429, abs=1e-6)  # O1
    pairs2 = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "b"])],
                                   "k int, ref_tokens array<string>, pred_tokens array<string>")
    assert O.ngram_matches(pairs2, ["k"]).first()["n_ngrams_match_1"] == 2  # O2


def test_sem(spark):
    s = spark.createDataFrame([(1 / 3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
                              "f1 double, precision double, recall double, n_ngrams_match_1 double, "
                              "n_ngrams_match_2 double, n_ngrams_match_3 double, num_true_words double, "
                              "num_pred_words double")
    assert O.summarize(s).first()["token_set_f1_sem"] == pytest.approx(0.333333, abs=1e-6)  # O4


def test_ratios_and_prune(spark):
    lab = spark.createDataFrame([(1, "de"), (1, "de"), (1, "en")], "id int, pred_lang string")
    r = {x["lang"]: x["p"] for x in D.ratios(lab, ["id"]).collect()}
    assert r == {"de": 0.67, "en": 0.33}  # D1
    d = spark.createDataFrame([(1, "de", .90), (1, "en", .05), (1, "unknown", .04), (1, "others", .01)],
                              "id int, lang string, p double")
    assert [x["lang"] for x in D.prune(d).collect()] == ["de"]  # D3
    d4 = spark.createDataFrame([(1, "de", .67), (1, "en", .30)], "id int, lang string, p double")
    r4 = {x["lang"]: x["p"] for x in D.complete_unknown(d4, ["id"]).collect()}
    assert r4["unk"] == pytest.approx(0.03)  # D4


def test_pass_rate_macro_means(spark):
    rates = spark.createDataFrame([("t", "m", "s1", "fr", 1.0, 0.5, None), ("t", "m", "s2", "fr", 1.0, 1.0, None),
                                   ("t", "m", "s1", "de", 1.0, 1.0, None)],
                                  "task string, model string, source string, language string, acc double, "
                                  "lpr double, wpr double")
    out = {(r["source"], r["language"]): r["lpr"] for r in P.rollup(rates, ["task", "model"]).collect()}
    assert out[("all", "all")] == pytest.approx(0.875)  # P6 macro mean (N5)
    assert out[("all", "fr")] == pytest.approx(0.75)


def test_pass_rate_p6_docstring_shape(spark):
    comps = spark.createDataFrame([(1, "fr"), (2, "fr")], "id int, language string").withColumn(
        "source", F.lit("okapi")).withColumn("task", F.lit("t")).withColumn("model", F.lit("m"))
    lines = spark.createDataFrame([(1, "fr", ["je", "ne", "sais", "pas", "vraiment"]),
                                   (2, "en", ["what", "do", "you", "mean", "here"])],
                                  "id int, pred_lang string, tokens array<string>")
    lines = lines.join(comps, "id")
    words = spark.createDataFrame([("mean",)], "word string")
    keys = ["id", "model", "task", "source", "language"]
    chk = P.completion_checks(comps, lines, words, keys)
    rates = P.group_rates(chk, ["task", "model", "source", "language"])
    out = {(r["source"], r["language"]): (r["lpr"], r["wpr"]) for r in P.rollup(rates, ["task", "model"]).collect()}
    for k in [("okapi", "fr"), ("okapi", "all"), ("all", "fr"), ("all", "all")]:
        assert out[k][0] == pytest.approx(0.5)
        assert out[k][1] is None  # no wpr for fr


def test_pair_match_and_or_combine(spark):
    t = spark.createDataFrame([("x", "f1", 1), ("x", "f2", 0), ("x", "f3", None),
                               ("y", "f1", 1), ("y", "f2", 1), ("y", "f3", 0)],
                              "node string, feature string, code int")
    m = {r["feature"]: r["match"] for r in Y.pair_match(t).collect()}
    assert (m["f1"], m["f2"], m["f3"]) == (1, 0, -1)  # Y5
    mm = spark.createDataFrame([("k", "f1", 1), ("k", "f1", 0), ("k", "f2", 0), ("k", "f2", 0),
                                ("k", "f3", -1), ("k", "f3", 1)], "k string, feature string, match int")
    r = {x["feature"]: x["match"] for x in Y.or_combine(mm, ["k", "feature"]).collect()}
    assert (r["f1"], r["f2"], r["f3"]) == (1, 0, -1)  # Y6


def test_turns_to_prompt(spark):
    t = spark.createDataFrame([(1, 0, "user", "Hello"), (1, 1, "assistant", "Hi"), (1, 2, "user", "2+2?")],
                              "conv_id int, turn int, role string, text string")
    assert C.turns_to_prompt(t).first()["prompt"] == "Q: Hello\nA: Hi\n\nQ: 2+2?\nA:"  # C1


def test_p_value():
    # r = 0.5, n = 12: t = 1.8257, df = 10 -> two-sided p ~= 0.0980
    assert S.corr_p_value(0.5, 12) == pytest.approx(0.0980, abs=2e-4)
    assert S.stars(0.0005) == "***" and S.stars(0.2) == ""


def test_incomplete_beta_symmetry():
    assert S.incomplete_beta(2.0, 3.0, 0.4) + S.incomplete_beta(3.0, 2.0, 0.6) == pytest.approx(1.0)
    assert S.incomplete_beta(1.0, 1.0, 0.3) == pytest.approx(0.3)


def test_shuffle_partitions_do_not_change_results(spark):
    d = spark.createDataFrame([(i % 7, l, p) for i, (l, p) in enumerate([("de", .5), ("en", .5)] * 20)],
                              "id int, lang string, p double").withColumn("expected", F.lit("de")) \
        .withColumn("training", F.array(F.lit("en")))
    res = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(sorted(tuple(r) for r in E.entropies(d, ["id"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1] == res[2]
    assert all(math.isfinite(x) for row in res[0] for x in row[3:])


def test_attribute_matches(spark):
    from langmix.sources import dims
    u = spark.createDataFrame([(1, ["kaz_Cyrl", "tur_Latn"], "deu_Latn"), (2, ["arb_Arab"], "heb_Hebr")],
                              "id int, training array<string>, eval string")
    r = {x["id"]: x for x in Y.attribute_matches(u, ["id"], "training", "eval", dims.lang_attributes(spark)).collect()}
    # unit 1: tur_Latn shares the script; no family match; deu is ND (matches every order); both LTR
    assert (r[1]["script"], r[1]["family"], r[1]["word_order"], r[1]["script_lr"]) == (1, 0, 1, 1)
    assert r[1]["training_script_lr"] == 1
    # unit 2: different script, same family (semitic), VSO vs SVO, both RTL, single training language
    assert (r[2]["script"], r[2]["family"], r[2]["word_order"], r[2]["script_lr"], r[2]["training_script_lr"]) \
        == (0, 1, 0, 1, 1)


def test_names_and_keys(spark):
    from langmix.operators import naming as N
    names = ["o/mt5_me5_pan_Guru_32_2layers_inverter", "mt5_me5_ara-script_32_2layers_corrector", "mt5_gtr_deu_Latn_32_corrector", "me5_deu_xyz"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").withColumn("m", N.normalise_model(F.col("n")))
    got = [(r.m, r.t) for r in df.select("i", "m", N.training_languages(F.col("m")).alias("t")).orderBy("i").collect()]
    assert got == [("me5_pan_Guru", ["pan_Guru"]), ("me5_arab-script", ["arb_Arab", "heb_Hebr"]), ("gtr_deu_Latn", ["deu_Latn"]),
                   ("me5_deu_xyz", ["deu_Latn", None])]
    k = spark.createDataFrame([("3_llm_mono_fr_native_prompts",)], "k string").select(*N.split_key(F.col("k"))).first()
    assert tuple(k) == ("3", "llm", "mono", "fr", "native-prompts")
    x = spark.createDataFrame([(0.856,), (1.0,), (0.0,), (0.0123,), (None,), (98.76,)], "x double")
    assert [r[0] for r in x.select(N.two_digits(F.col("x"))).collect()] == ["0.86", "1.0", "0.0", "0.012", None, "99.0"]


def test_first_and_last_evaluation(spark):
    from langmix.operators import naming as N
    d = spark.createDataFrame([("m", "Labels", 1, "de", 1.0), ("m", "Labels", 2, "fr", 0.5), ("m", "Labels", 2, "en", 0.5),
                               ("m", "Base", 1, "de", 0.7), ("m", "Base", 2, "en", 1.0)], "model string, step string, o int, lang string, p double")
    got = sorted((r.step, r.lang) for r in N.flatten_steps(d, ["model"], "step", "o").collect())
    assert got == [("Base", "de"), ("Labels", "en"), ("Labels", "fr")]


def test_ablation_and_centres(spark):
    from langmix.operators import ml as ML
    rows = [(i, float(i % 2), float(i % 3), float(i % 5), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y double")
    out = {r.variables: r.mse for r in ML.subset_ablation(df, df, ["c"], ["a", "b"], ["y"], "id", num_trees=5).collect()}
    assert set(out) == {"baseline+", "baseline+a", "baseline+b", "baseline+a,b"} and out["baseline+a"] < out["baseline+"]
    two = {"x": spark.createDataFrame([("p", 1.0), ("q", 2.0)], "variables string, mse double"),
           "y": spark.createDataFrame([("q", 5.0), ("p", 9.0), ("r", 0.0)], "variables string, mse double")}
    assert [tuple(r) for r in ML.collect_ablations(two, "y").collect()] == [("q", 2.0, 5.0), ("p", 1.0, 9.0)]
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0]), (3, [9.0, 9.0]), (4, None), (5, [9.0, 9.0])], "k int, e array<double>")
    model = ML.kmeans(v, "k", "e", (2, 3))
    assert model.centres[2].tolist() == [[0.0, 1.0], [9.0, 9.0]]
    at = {(r[0], r[1]): r[2] for r in model.assignments(v, "k", "e").toDF("key", "k", "cluster").collect()}
    assert [at[i, 2] for i in (1, 2, 3, 5)] == [0, 0, 1, 1] and [at[i, 3] for i in (1, 2, 3, 5)] == [0, 2, 1, 1]
    assert len(model.centre_rows(spark).collect()) == 10
