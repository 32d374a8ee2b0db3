"""Registered queries against their DuckDB oracles on the smallest scale factor."""

import os

import pytest

from tests.oracle_compare import compare, duck

SF = os.environ.get("LANGMIX_TEST_SF", "/root/testdata/sf0.001")
#: queries that label text share their oracle's (slow) labelling part; one of each kind runs by default
LABELLED = ["lid_profile", "line_language_strict", "line_distribution", "word_distribution", "entropy_by_group", "entropy_variants",
            "entropy_by_training_language", "line_pass_rate", "unknown_mass", "confusion_by_training", "confusion_kl",
            "flattened_step_distributions", "dataset_language_report", "attribute_match_features"]
ALL = os.environ.get("LANGMIX_TEST_ALL") == "1"


def _names():
    import __spark_entry__ as E
    sql = E.oracle_sql()
    core = [n for n in E.queries() if n in sql and not n.startswith("op") and n != "pipeline"]
    return [n for n in core if ALL or n in LABELLED or "profile AS" not in sql[n]]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[name]).fetchdf()
    ok, msg = compare(sp, dk)
    assert ok, msg
    assert len(dk) > 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "line_reweighted_entropy" in df.columns


def test_every_oracle_is_sql():
    import __spark_entry__ as E
    for name, sql in E.oracle_sql().items():
        assert name in E.queries()
        assert isinstance(sql, str), name
