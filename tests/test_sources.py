"""File sources on small fixtures written to a fresh temporary folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from langmix.sources import files as SRC
from langmix.streaming.incremental import manifest_anti_join


def _dir():
    return tempfile.mkdtemp(prefix="langmix-test-", dir=os.environ.get("LANGMIX_TMP", "/tmp"))


def test_completions_csv_multiline(spark):
    d = _dir()
    with open(f"{d}/a.csv", "w") as f:
        f.write('id,model,completion,task,source,language\n1,m,"line one\nline two",t,s,fr\n')
    with open(f"{d}/b.csv", "w") as f:
        f.write('id,model,completion,task,source,language\n2,m,"x",t,s,de\n')
    df = SRC.read_completions(spark, d)
    rows = sorted(df.collect(), key=lambda r: r["id"])
    assert len(rows) == 2 and rows[0]["completion"] == "line one\nline two"


def test_pairs_prefix(spark):
    d = _dir()
    with open(f"{d}/p.csv", "w") as f:
        f.write("pred,labels\nquery: hello world,query: hello\n")
    r = SRC.read_pairs(spark, d).first()
    assert (r["pred"], r["ref"]) == ("hello world", "hello")


def test_inverter_and_corrector_logs(spark):
    d = _dir()
    with open(f"{d}/inv.json", "w") as f:
        json.dump({"model": "me5_x", "evaluations": [{"dataset": "d1", "embeddings_file": "e", "output_file": "o"}]}, f)
    assert SRC.read_inverter_logs(spark, f"{d}/inv.json").first()["dataset"] == "d1"
    with open(f"{d}/cor.json", "w") as f:
        json.dump({"model": "m", "evaluations": {"d1": {"steps 1": {"embeddings_files": "e", "output_files": "o"},
                                                        "steps 50": {"embeddings_files": "e2", "output_files": "o2"}}}}, f)
    rows = SRC.read_corrector_logs(spark, f"{d}/cor.json").collect()
    assert sorted(r["step"] for r in rows) == ["steps 1", "steps 50"]


def test_step_from_file_name(spark):
    df = spark.createDataFrame([("multilingual_eval_bleu_score_step50_sbeam8_corrector.csv",),
                                ("monolingual_eval_bleu_score_base_inverter.csv",)], "f string")
    got = [r[0] for r in df.select(SRC.step_from_file(F.col("f"))).collect()]
    assert got == ["Step50+sbeam8", "Base"]


def test_result_maps_and_vectors(spark):
    d = _dir()
    with open(f"{d}/line_all_x.json", "w") as f:
        json.dump({"deu": 0.5, "fra": 1.25}, f)
    r = {x["key"]: x["value"] for x in SRC.read_result_maps(spark, d).collect()}
    assert r == {"deu": 0.5, "fra": 1.25}
    v = _dir()
    with open(f"{v}/vec.txt", "w") as f:
        f.write("2 3\ndeu 0.1 0.2 0.3\nfra 1 2 3\n")
    vec = {x["lang"]: x["vec"] for x in SRC.read_vectors(spark, v).collect()}
    assert vec["fra"] == [1.0, 2.0, 3.0] and len(vec) == 2


def test_literal_parse(spark):
    df = spark.createDataFrame([("{'de': 0.5, 'en': 0.5}",), ("not a dict",)], "s string")
    got = [r[0] for r in df.select(SRC.parse_literal("s")).collect()]
    assert got[0] == {"de": 0.5, "en": 0.5} and got[1] is None


def test_matrix_csv_roundtrip(spark):
    m = spark.createDataFrame([("a", "x", 1.5), ("b", "y", 2.0)], "row string, col string, value double")
    d = _dir() + "/m"
    SRC.write_matrix_csv(m, d, ["x", "y"])
    back = sorted(tuple(r) for r in SRC.read_matrix_csv(spark, d).collect())
    assert back == [("a", "x", 1.5), ("b", "y", 2.0)]


def test_manifest_anti_join(spark):
    inputs = spark.createDataFrame([("f1",), ("f2",)], "file string")
    done = spark.createDataFrame([("f1",)], "file string")
    assert [r[0] for r in manifest_anti_join(inputs, done, "file").collect()] == ["f2"]
