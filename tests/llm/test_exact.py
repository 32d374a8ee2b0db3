"""Exact groups against brute force, weak digests, edge cases."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from langmix.llm import exact
from tests.llm import fixtures as X


def brute(rows) -> Counter:
    groups: dict[str, list] = {}
    for k, (d, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, k))
    out = Counter()
    for content, members in groups.items():
        best = min(members)
        for m in members:
            d = rows[m[3]][0]
            out[(d, rows[best[3]][0], len(members), m[3] == best[3], hashlib.sha256(content.encode()).hexdigest())] += 1
    return out


AWKWARD = [(1, "a b", "en", "s"), (2, "ab ", "en", "s"), (3, "a\tb\n", "en", "s"), (4, " ", "en", "s"), (None, "a b  ", "en", None),
           (None, "a  b ", "en", None), (-5, "a b  ", "en", "s"), (9, "a b", "en", "s"), (10, "🙂 x", "en", "s"), (11, "🙂x\x0b", "en", "s"),
           (-(1 << 63), "low", "en", "s"), ((1 << 63) - 1, "low", "en", "s"), (12, "twice", "en", "s"), (12, "twice", "en", "s"),
           (None, "none", "en", "s"), (None, "none", "en", "s")]


def got(spark, rows, **options) -> Counter:
    return X.rows_of(exact.exact_groups(X.frame(spark, rows), **options))


def test_groups_equal_brute_force(spark):
    rows = X.documents() + AWKWARD
    found = got(spark, rows)
    assert found == brute(rows)
    assert sum(n for r, n in found.items() if r[3]) == len({r[4] for r in found})  # one row stays of each group


def test_equal_digests_are_no_equal_texts(spark):
    rows = X.documents(2) + AWKWARD
    weak = got(spark, rows, digest=lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1))
    assert Counter({r[:4]: 0 for r in weak}).keys() == {r[:4] for r in brute(rows)}
    assert Counter(r[:4] for r in weak.elements()) == Counter(r[:4] for r in brute(rows).elements())


def test_one_group_holds_most_rows(spark):
    rows = [(k, "hot  copy" if k % 3 else f"text {k}", "en", "s") for k in range(3000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert exact.exact_groups(X.empty(spark)).count() == 0
