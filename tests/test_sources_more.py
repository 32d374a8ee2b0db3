"""Readers and rules on awkward inputs."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from langmix.functions import text as tx
from langmix.operators import graph as G
from langmix.operators import stats as S
from langmix.sources import files as SRC

METRICS = ["bleu_score", "token_set_f1", "token_set_precision", "rouge_score", "n_ngrams_match_2"]


def _dir():
    return tempfile.mkdtemp(prefix="langmix-test-", dir=os.environ.get("LANGMIX_TMP", "/tmp"))


def test_step_of_every_metric_name(spark):
    names = [(f"{p}_eval_{m}_{s}.csv", want) for p in ("multilingual", "monolingual") for m in METRICS
             for s, want in (("base_inverter", "Base"), ("step1_corrector", "Step1"), ("step50_sbeam8_corrector", "Step50+sbeam8"))]
    df = spark.createDataFrame(names, "f string, want string")
    assert all(r[0] == r[1] for r in df.select(SRC.step_from_file(F.col("f")), "want").collect())


def test_files_with_different_headers_are_read_by_name(spark):
    d = _dir()
    with open(f"{d}/multilingual_eval_token_set_f1_base_inverter.csv", "w") as f:
        f.write('model,de,en\nm1,1,2\n"m,2",3,\n')
    with open(f"{d}/multilingual_eval_token_set_f1_step1_corrector.csv", "w") as f:
        f.write("en,fr,model\r\n5,6,m1\r\n")
    got = {(r["row"], r["col"], r["value"], r["step"]) for r in SRC.read_matrix_files(spark, d).collect()}
    assert got == {("m1", "de", 1.0, "Base"), ("m1", "en", 2.0, "Base"), ("m,2", "de", 3.0, "Base"), ("m,2", "en", None, "Base"),
                   ("m1", "en", 5.0, "Step1"), ("m1", "fr", 6.0, "Step1")}


def test_python_literals(spark):
    rows = [("{'a': None, 'b': 1}",), ("{'None': 2, \"True\": 3.5,}",), ("nonsense",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(SRC.parse_literal("s")).collect()]
    assert got == [{"a": None, "b": 1.0}, {"None": 2.0, "True": 3.5}, None]
    df = spark.createDataFrame([("{'a': (1, 2), 'b': [3]}",)], "s string")
    assert df.select(SRC.parse_literal("s", "map<string,array<int>>")).first()[0] == {"a": [1, 2], "b": [3]}
    assert df.select(SRC.parse_literal("s", "map<string,array<int>>", strict=True)).first()[0]["b"] == [3]
    bad = spark.createDataFrame([("{'a': ",)], "s string")
    with pytest.raises(Exception):
        bad.select(SRC.parse_literal("s", strict=True)).collect()


def test_dimension_file(spark):
    d = _dir()
    with open(f"{d}/langs.yaml", "w") as f:
        f.write("# codes\nde: German\n'en': \"English\"  # main\n\nfr : French\n")
    assert {r.key: r.value for r in SRC.read_dimension(spark, d).collect()} == {"de": "German", "en": "English", "fr": "French"}


def test_unicode_white_space(spark):
    t = " a b c　d e  "
    assert spark.createDataFrame([(t,)], "t string").select(tx.whitespace_tokens("t")).first()[0] == t.split()


def test_pairwise_correlations_with_missing_values(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 5, None], "b": [2.0, 1, 4, 3, None, 9], "c": [None, 5.0, 5, 6, 7, 1], "d": [1.0] * 6})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double")
    for method, fn in (("pearson", S.pearson_long), ("spearman", S.spearman_long)):
        want = pdf.corr(method=method)
        got = {(r.a, r.b): r.r for r in fn(df, ["a", "b", "c", "d"]).collect()}
        assert len(got) == 6
        for (x, y), r in got.items():
            w = want.loc[x, y]
            assert (r is None and pd.isna(w)) or r == pytest.approx(w, abs=1e-6), (method, x, y)


def test_pairs_without_common_feature_or_concept(spark):
    f = spark.createDataFrame([("x", "f1", 1.0), ("y", "f2", 2.0), ("z", "f1", 3.0), ("z", "f2", None)], "node string, f string, v double")
    got = {(r["row"], r["col"]): r["value"] for r in G.nan_euclidean_pairs(f, "node", "f", "v").collect()}
    assert len(got) == 9 and got[("x", "y")] == 0.0 and got[("x", "z")] == pytest.approx((2 / 1 * 4) ** 0.5) == got[("z", "x")]
    inc = spark.createDataFrame([("x", "1"), ("y", "1"), ("y", "2"), ("z", "3")], "node string, concept string")
    d = {(r["row"], r["col"]): r["value"] for r in G.jaccard(inc).collect()}
    assert len(d) == 9 and d[("x", "y")] == 0.5 and d[("x", "z")] == 1.0 and d[("z", "z")] == 0.0


def test_neighbour_lists(spark):
    df = spark.createDataFrame([("a", [("b", "0.5"), ("b", "0.9")]), ("c", [])], "node string, neighbours array<struct<n:string,s:string>>")
    got = {(r["row"], r["col"]): r["value"] for r in G.neighbour_lists(df).collect()}
    assert got[("a", "b")] == 0.5 and got[("b", "a")] == 0.0 and got[("a", "a")] == 1.0
