"""Substring dedup (suffix array and phrase automata) against brute force."""

import random

import numpy as np
import pytest

from langmix.llm import phrases, repeats, suffixes
from tests.llm import fixtures as X


@pytest.mark.parametrize("length", [7, 20, 100])
def test_suffix_order_and_prefixes(length):
    rng = np.random.default_rng(length)
    for _ in range(60):
        n = int(rng.integers(1, 300))
        t = rng.integers(1, int(rng.choice([2, 3, 5, 257])), n)
        t[rng.integers(0, n, 2)] = 0
        if rng.random() < 0.3:
            t[: n // 2] = t[0]
        t = np.append(t, 0)
        order, keys = suffixes.suffix_order(t, length)
        assert sorted(order) == list(range(len(t)))
        wide = np.concatenate([t, np.zeros(length, int)])
        head = [tuple(wide[i:i + length]) for i in range(len(t))]
        whole = np.array([i for i in order if 0 not in head[i]], int)
        assert [head[i] for i in whole] == sorted(head[i] for i in whole)
        for k, got in enumerate(suffixes.common_prefixes(whole, keys, length)[1:], 1):
            a, b = head[whole[k]], head[whole[k - 1]]
            assert got == next((j for j in range(length) if a[j] != b[j]), length)


def test_runs_cover_each_window_once():
    kind = repeats.Kind(20, 5, of_words=False, within=True, hot=1000)
    rng = np.random.default_rng(3)
    h = rng.integers(0, 4, 500).astype(np.uint64)
    first = np.array([0, 0, 120, 139, 500])
    text, lo, hi, v, alone = repeats.runs(h, first, kind)
    seen = [(t, w) for t, a, z in zip(text, lo, hi) for w in range(a, z + 1)]
    assert sorted(seen) == [(t, w) for t in range(4) for w in range(max(0, first[t + 1] - first[t] - 19))]
    for t, a, z, one in zip(text, lo, hi, alone):  # a run that is alone holds no window twice
        windows = [tuple(h[first[t] + w:first[t] + w + 20]) for w in range(a, z + 1)]
        assert not one or len(set(windows)) == len(windows)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    rows = X.documents()
    long_passage = X.sentence(rng, 90)
    for k in range(12):  # overlapping parts of one passage, and text that repeats itself
        w = long_passage.split()
        rows.append((200 + k, X.sentence(rng, 15) + " " + " ".join(w[k:k + 60]) + " " + X.sentence(rng, 15), "en", "s0"))
    rows.append((300, ("a line that comes again and again, " * 9).strip(), "en", "s1"))
    rows.append((301, X.sentence(rng, 30) + " a line that comes again and again," * 4, "en", "s1"))
    return rows


def test_phrase_dedup_matches_brute_force(spark, docs):
    rows = repeats.keyed(X.frame(spark, docs), "doc_id", "text")
    for hot in (phrases.HOT, 150):  # also with most passages dealt out by window
        got = repeats.digest(rows, phrases.removed_ranges(rows, hot=hot), _phrase_digest, phrases.DIGEST)
        assert X.rows_of(got) == X.phrase_dedup(docs), hot


def _phrase_digest(text, pairs):
    import hashlib
    words, kept = phrases.kept_words(text, repeats.merged(pairs, 50, len(text.split())))
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_suffix_dedup_matches_brute_force(spark, docs):
    import hashlib

    def one(text, pairs):
        spans = repeats.merged(pairs, 100, len(text))
        return len(text), sum(z - a for a, z in spans), len(spans), hashlib.sha256(suffixes.kept_bytes(text, spans)).hexdigest()

    rows = repeats.keyed(X.frame(spark, docs), "doc_id", "text")
    for hot in (suffixes.HOT, 300):
        assert X.rows_of(repeats.digest(rows, suffixes.removed_ranges(rows, hot=hot), one, suffixes.DIGEST)) == X.byte_dedup(docs), hot


def test_operators_return_texts_and_spans(spark):
    rng = random.Random(9)
    text = X.sentence(rng, 60)
    df = X.frame(spark, [(1, text, "en", "a"), (2, "new " + text, "en", "a")])
    assert {r.doc_id: r.text for r in phrases.substring_dedup(df).collect()} == {1: text, 2: "new"}
    out = {r.doc_id: r for r in suffixes.substring_dedup(df).collect()}
    assert bytes(out[1].kept).decode() == text and bytes(out[2].kept) == b"new "
    assert np.frombuffer(out[2].spans, np.int32).tolist() == [4, 4 + len(text)]


def test_boilerplate_line_between_different_neighbours(spark):
    from pyspark.sql import functions as F
    n = 30_000
    own = lambda tag: F.concat_ws(" ", *[F.concat(F.lit(f"{tag}{k}x"), (F.col("doc_id") * 31 + k) % 999_983) for k in range(45)])
    line = F.lit("this one line of twelve words stands in all of the documents")
    docs = spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", F.concat_ws(" ", own("a"), line, own("b")).alias("text"))
    again = docs.where("doc_id % 100 = 7").select((F.col("doc_id") + n).alias("doc_id"), F.concat(F.lit("new "), F.col("text"), F.lit(" end")).alias("text"))
    out = phrases.substring_dedup(docs.unionByName(again))
    cut = {r.doc_id: r.text for r in out.where(f"doc_id >= {n}").collect()}
    assert len(cut) == n // 100 and set(cut.values()) == {"new end"}
    assert out.where(f"doc_id < {n}").where(F.size(F.split("text", " ")) != 102).count() == 0


def test_many_rows_without_id(spark):
    from pyspark.sql import functions as F
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % 9_000) for k in range(60)]).alias("text"))
    out = phrases.substring_dedup(docs)
    assert out.count() == 20_000 and out.where("text = ''").count() == 0


def test_empty_tables(spark):
    assert phrases.substring_dedup(X.empty(spark)).count() == 0
    assert suffixes.substring_dedup(X.empty(spark)).count() == 0


def test_portions_hold_whole_representatives():
    import pyarrow as pa
    kind = repeats.Kind(10, 3, of_words=True, within=False, hot=60)
    rng = random.Random(2)
    for _ in range(200):
        a = sorted(rng.randrange(6) for _ in range(rng.randrange(40)))
        rows = [(x, k, k, 0, rng.randrange(5), b"", True, None) for k, x in enumerate(a)]
        batches, at = [], 0
        while at < len(rows):
            n = rng.randrange(1, 12)
            batches.append(repeats.batch_of(rows[at:at + n], repeats.PIECE))
            at += n
        units: dict[int, int] = {}
        for r in rows:
            units[r[0]] = units.get(r[0], 0) + r[4] + 10
        seen, done = [], set()
        for hot, t in repeats.portions(iter(batches), kind):
            own = t["a"].to_pylist()
            if hot:
                assert set(own) == {own[0]} and units[own[0]] > 60
            else:
                assert all(units[x] <= 60 and x not in done for x in own)
                done |= set(own)
            seen += t["u"].to_pylist()
        assert sorted(seen) == list(range(len(rows)))
