"""Header-wise CSV over byte ranges, literals, nested dimensions, long conversations."""

import ast
import csv
import io
import os
import random
import tempfile
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from langmix.operators import dist as D
from langmix.operators import prompts as C
from langmix.sources import dims
from langmix.sources import files as SRC
from langmix.sources import records as R


def _dir():
    return tempfile.mkdtemp(prefix="langmix-test-", dir=os.environ.get("LANGMIX_TMP", "/tmp"))


def _write(path, header, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(out.getvalue())


@pytest.mark.parametrize("size", [None, 64, 1000])
def test_records_over_small_ranges(spark, size):
    rng = random.Random(size or 1)
    d = _dir()
    cells = ["plain", "", 'say "hi"', "two\nlines", "a,b", "\n\n", 'q"\n"', "é中", "x" * 150 + "\n" + "y" * 200]
    want = Counter()
    for k, header in enumerate((["id", "text", "lang"], ["lang", "id", "extra", "text"], ["text", "id"])):
        rows = [[f"{k}-{i}" if h == "id" else rng.choice(cells) for h in header] for i in range(60)]
        _write(f"{d}/f{k}.csv", header, rows, end="\r\n" if k == 1 else "\n")
        for r in rows:
            x = dict(zip(header, r))
            want[tuple(x.get(c) or None for c in ("id", "text", "lang"))] += 1
    with open(f"{d}/none.csv", "w"):
        pass
    with open(f"{d}/other.txt", "w") as f:
        f.write("id,text\n9,9\n")
    old = [spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = Counter(tuple(r) for r in R.read_csv_by_header(spark, d, {"id": "string", "text": "string", "lang": "string"}).collect())
    finally:
        for c, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), old):
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert got == want


def test_reordered_headers_of_completions(spark):
    d = _dir()
    _write(f"{d}/a.csv", ["model", "id", "completion", "task", "source", "language"], [["M", "1", 'x\n"y"', "t", "s", "fr"]])
    r = SRC.read_completions(spark, d).first()
    assert (r.id, r.model, r.completion, r.language) == ("1", "M", 'x\n"y"', "fr")


literals = st.recursive(
    st.none() | st.booleans() | st.integers(-10**9, 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4) | st.tuples(x, x), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(literals)
def test_literals_become_plain_values(x):
    import json
    assert json.loads(json.dumps(SRC._plain(ast.literal_eval(repr(x))))) == json.loads(json.dumps(x))


def test_literal_columns(spark):
    rows = ["{'a', 'b'}", "{'k': {3, 1}}", "('x', (1, 2), [None, True])", "'it\\'s'", "[1, 2", "__import__('os')", None, " {'q': 'a\"b'} "]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r[0] for r in df.select(SRC.parse_literal("s", "array<string>")).collect()]
    assert got[0] == ["a", "b"] and got[4] is None and got[5] is None and got[6] is None
    assert df.where(F.col("s").startswith("{'k'")).select(SRC.parse_literal("s", "map<string,array<int>>")).first()[0] == {"k": [1, 3]}
    assert df.where(F.col("s").contains("'q'")).select(SRC.parse_literal("s", "map<string,string>")).first()[0] == {"q": 'a"b'}
    long = "[" + ", ".join(["'a(b,c)'"] * 50_000) + "]"
    assert len(spark.createDataFrame([(long,)], "s string").select(SRC.parse_literal("s", "array<string>")).first()[0]) == 50_000
    with pytest.raises(Exception):
        df.where("s = '[1, 2'").select(SRC.parse_literal("s", strict=True)).collect()


def test_nested_dimension(spark):
    d = _dir()
    with open(f"{d}/a.yaml", "w") as f:
        f.write("# facts\neng_Latn:\n  - tokens: 2733\n  - mt5: 5.67  # share\n'deu_Latn':\n- mt5: 3.05\nflat: \"x: y\"\n\nnone:\nlast:\n  mt5: 1")
    got = {(r.key, r.attribute, r.value) for r in SRC.read_dimension(spark, d).collect()}
    assert got == {("eng_Latn", "tokens", "2733"), ("eng_Latn", "mt5", "5.67"), ("deu_Latn", "mt5", "3.05"), ("flat", None, "x: y"),
                   ("none", None, None), ("last", "mt5", "1")}
    shares = {r.iso3: r.mt5 for r in dims.mt5_share(spark).collect()}
    assert len(shares) == 19 and shares["eng"] == 5.67 and shares["ydd"] == 0.28


def test_prompt_of_a_long_conversation(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                               F.concat(F.lit("t"), F.col("id")).alias("text"))
    p = C.turns_to_prompt(df).first().prompt
    assert p.startswith("Q: t0\nA: t1\n\nQ: t2\n") and p.endswith(f"A: t{n - 1}") and p.count("Q: ") == n // 2


def test_keep_one_of_a_hot_label(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("o"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([("b", 5, 1)], "k string, o long, v long"))
    assert sorted(tuple(r) for r in D.keep_one(df, ["k"], "o").collect()) == [("a", 0, 0), ("b", 5, 1)]
    assert sorted(tuple(r) for r in D.keep_one(df, ["k"], "o", last=True).collect()) == [("a", 999, 1998), ("b", 5, 1)]
