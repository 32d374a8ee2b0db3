"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from langmix.llm import runs
from tests.llm import fixtures as X


def brute_runs(w, least, times):
    out, n = set(), len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(least, times * q):
                part = w[start:start + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.add((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(rows, least=24, times=3, change=True) -> Counter:
    out = Counter()
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        n = len(w)
        if change and d is not None and n:
            h = zlib.crc32(str(d).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w, least, times)
        gone = set()
        for s, length, q in found:
            gone |= set(range(s + q, s + length))
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        out[(d, len(found), *best, 1000 * best[1] // best[2] if found else None,
             hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
             hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    return out


def numbers(w):
    name: dict = {}
    return np.array([name.setdefault(x, len(name)) for x in w], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=70), st.sampled_from([3, 6, 8, 24]), st.sampled_from([3, 4]))
def test_small_alphabets(w, least, times):
    assert runs.find_runs(numbers(w), least, times) == brute_runs(w, least, times)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 60), st.integers(1, 8), st.integers(1, 4))
def test_periodic_texts_with_flaws(seed, period, copies, letters):
    rng = random.Random(seed)
    unit = [rng.randrange(letters) for _ in range(period)]
    w = [rng.randrange(9) for _ in range(rng.randrange(9))] + unit * copies + unit[:rng.randrange(period)] + [rng.randrange(9) for _ in range(5)]
    if rng.random() < 0.3:
        w[rng.randrange(len(w))] = 99
    w = w * rng.choice([1, 1, 3])
    assert runs.find_runs(numbers(w)) == brute_runs(w, 24, 3)


@pytest.mark.parametrize("w", [[0] * 200_000, [0, 1] * 100_000, ([0] * 40 + [1]) * 5_000])
def test_long_runs_stay_cheap(w):
    found = runs.find_runs(np.array(w, np.int64))
    assert (0, len(w), {200_000: 1 if w[1] == 0 else 2}.get(len(w), 41)) in found


def test_query_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [r for r in X.documents() if r[0] != 112] + [(k, X.sentence(rng, rng.randrange(1, 260)), "en", "s") for k in range(200, 320)]
    rows += [(400, "a b c " * 20 + "x " * 30, "en", "s"), (401, "a\tb \n" * 12, "en", "s"), (402, "a" * 5000, "en", "s")]
    found = X.rows_of(runs.digests(runs.periodic_runs(X.frame(spark, rows), change=runs.planted)))
    assert found == brute(rows)
    assert sum(n for r, n in found.items() if r[1]) > 8


def test_real_outputs(spark):
    rows = [(1, "x y " * 15 + "end", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s")]
    out = {r["doc_id"]: r for r in runs.periodic_runs(X.frame(spark, rows)).collect()}
    assert [tuple(x) for x in out[1]["runs"]] == [(0, 30, 2)] and out[1]["collapsed"] == "x y end" and out[1]["n_words"] == 31
    assert out[2]["runs"] == [] and out[2]["collapsed"] == "" and out[3]["n_words"] == 0


def test_empty_table(spark):
    assert runs.digests(runs.periodic_runs(X.empty(spark))).count() == 0
