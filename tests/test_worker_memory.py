"""What a Python worker holds does not grow with the tables, and no line is labelled twice."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from langmix.operators import forest as FO
from langmix.operators import lid
from langmix.plans import queries as Q
from langmix.session import arrow_batches

TEXTS = {"de": "das ist ein haus und der baum", "en": "this is a house and the tree", "fr": "une maison est un arbre et la rue"}
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, f"{a}\n{b} {a}\nqqq zzz www", x, f"s{k % 2}", 9) for k, (x, a) in enumerate(TEXTS.items()) for b in ["und der", "and the"]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_words_label_every_line_once(spark, folder):
    assert _python_steps(Q.word_dist(spark, folder)) == 2  # the lines, then their tokens


def test_both_kinds_of_training_key_in_one_pass(spark, folder):
    got = Q.QUERIES["entropy_by_training_language"](spark, folder)
    assert _python_steps(got) == 2
    d = Q._with_expected(Q.word_dist(spark, folder))
    ent = Q.E.entropies(d, ["id"], "expected", "training", variants=["weighted_entropy"], decimals=None).collect()
    held = {}
    for r in ent:
        for key in [("set", "_".join(sorted(r.training))), *(("single", x) for x in r.training)]:
            held.setdefault(key, []).append(r.weighted_entropy)
    assert {(r.kind, r.key): r.mean_weighted_entropy for r in got.collect()} == {k: pytest.approx(np.mean(v), abs=1e-6) for k, v in held.items()}


def test_batches_are_bounded_inside_only(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    before = spark.conf.get(BATCH)
    texts = spark.range(400).select(F.repeat(F.lit("x"), 1000).alias("t")).coalesce(1)
    with arrow_batches(spark, 20_000):
        got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert max(got) < 40_000 and sum(got) >= 400_000 and spark.conf.get(BATCH) == before
    with pytest.raises(ValueError), arrow_batches(spark, 20_000):
        raise ValueError
    assert spark.conf.get(BATCH) == before


def test_training_gets_small_batches(spark, monkeypatch):
    seen, real, before = [], lid.cut_lineage, spark.conf.get(BATCH)
    monkeypatch.setattr(lid, "cut_lineage", lambda df: (seen.append(spark.conf.get(BATCH)), real(df))[1])
    lid.train(spark.createDataFrame([*TEXTS.items()], "lang string, text string"))
    assert seen[0] == str(lid._BATCH) and {*seen[1:]} == {before} and spark.conf.get(BATCH) == before


def test_lines_and_tokens_share_a_broadcast(spark, monkeypatch):
    m = lid.train(spark.createDataFrame([*TEXTS.items()], "lang string, text string"))
    sent, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, x: (sent.append(x), real(self, x))[1])
    rows = spark.createDataFrame([("das haus", ["haus", "tree"])], "line string, w array<string>")
    out = lid.count_array(lid.label_array(lid.label_column(rows, "line", m), "w", m), "w", m).first()
    assert (out.pred_lang, out.langs) == ("de", ["de", "en"]) and {x.lang: x.n for x in out.counts} == {"de": 1, "en": 1}
    assert len(sent) == 1
    assert lid.label_column(rows, "line", m, mode="single").first().pred_lang == "de"
    assert len(sent) == 2 and sent[1][1] is None


def test_forest_task_holds_its_sums_and_little_more():
    class Rows:
        def mapInArrow(self, work, schema):
            raise StopIteration(work)

    n_trees, n_bins = 2000, 64
    trees = [(0, FO.Tree((0,), (0,))) for _ in range(n_trees)]
    forest = FO.Forest(["x"], ["y"], [[k + 0.5 for k in range(n_bins - 1)]], {(("x",), ("y",)): [t for _, t in trees]})
    with pytest.raises(StopIteration) as e:
        FO._best_splits(Rows(), forest, trees, [(k, 0) for k in range(n_trees)], n_bins, False, 1)
    x = np.arange(n_bins, dtype=float)
    batch = pa.RecordBatch.from_pydict({"_key": pa.array(range(n_bins), pa.int64()), "x": pa.array(x), "y": pa.array(2 * x)})
    cells = 0
    tracemalloc.start()
    for out in e.value.value(iter([batch])):
        cells += out.num_rows
        assert out.column(0).to_numpy().max() < n_trees and (out.column(4).to_numpy() == 2 * out.column(2).to_numpy()).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cells == n_trees * n_bins and peak < 34 * cells  # 16 bytes of sums, 8 of the list of cells
