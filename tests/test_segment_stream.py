"""Splitting text without spaces; counts and means kept current by streams."""

import itertools
import os
import random
import tempfile

from pyspark.sql import functions as F

from langmix.operators import segment as S
from langmix.streaming import incremental as R


def _dir():
    return tempfile.mkdtemp(prefix="langmix-test-", dir=os.environ.get("LANGMIX_TMP", "/tmp"))


def test_best_split_equals_brute_force(spark):
    rng = random.Random(1)
    words = [(w,) for w in ["ab"] * 9 + ["a"] * 4 + ["b"] * 2 + ["abc"] * 5 + ["cab"] * 3 + ["c"] + ["bca"] * 2]
    model = S.learn(spark.createDataFrame(words, "w string"), "w")
    assert model.longest == 3 and len(model.costs) == 7

    def cost(parts):
        total = 0.0
        for p in parts:
            if p not in model.costs and len(p) > 1:
                return None
            total += model.costs.get(p, model.unknown)
        return total

    for _ in range(60):
        text = "".join(rng.choice("abcx") for _ in range(rng.randrange(9)))
        got = model.split(text)
        assert "".join(got) == text
        every = []
        for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            every.append(cost([text[a:b] for a, b in zip([0, *ends], ends)] if text else []))
        assert abs(cost(got) - min(c for c in every if c is not None)) < 1e-9


def test_dispatch(spark):
    model = S.Unigrams({"ab": 1.0, "c": 1.0}, 9.0, 2)
    df = spark.createDataFrame([("zh", "abc ab"), ("en", "abc, ab"), (None, "x y"), ("zh", None)], "lang string, t string")
    out = [r.tokens for r in S.tokens_by_language(df, "t", "lang", model, ["zh"]).collect()]
    assert out == [["ab", "c", "ab"], ["abc", ",", "ab"], ["x", "y"], None]


def _files(spark, d, parts):
    for k, (a, b) in parts.items():
        spark.range(a, b).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 0.5).alias("v")).coalesce(1).write.parquet(f"{d}/in/p{k}")


def test_state_survives_restart_and_replay(spark):
    d, schema = _dir(), "id long, g long, v double"
    _files(spark, d, {0: (0, 100), 1: (100, 250)})

    def run():
        R.run_counts(spark, f"{d}/in/*", schema, f"{d}/sink", f"{d}/ckpt", lambda s: s.select("g"), ["g"], files_per_trigger=1)
        R.run_incremental(spark, f"{d}/in/*", schema, f"{d}/parts", f"{d}/ckpt2", lambda b: R.partial_means(b, ["g"], ["v"]), files_per_trigger=1)

    def same(n):
        want = {r.g: (r.n, r.v) for r in spark.range(n).groupBy((F.col("id") % 3).alias("g")).agg(F.count("*").alias("n"), F.avg(F.col("id") * 0.5).alias("v")).collect()}
        counts = {r.g: r.n for r in R.latest(spark, f"{d}/sink").collect()}
        means = {r.g: r.v for r in R.merged_means(R.read_sink(spark, f"{d}/parts"), ["g"], ["v"]).collect()}
        assert all(counts[g] == want[g][0] and abs(means[g] - want[g][1]) < 1e-9 for g in want) and len(counts) == len(want)

    run()
    same(250)
    _files(spark, d, {2: (250, 400)})
    run()  # restarted from the checkpoints: only the new file is read
    same(400)
    run()
    same(400)
    # the last batch is replayed after its commit was lost
    for name in ("ckpt", "ckpt2"):
        commits = f"{d}/{name}/commits"
        last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
        os.remove(f"{commits}/{last}")
        crc = f"{commits}/.{last}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    run()
    same(400)
