"""Toxicity chain, quality network and class model."""

import functools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from langmix.llm import classlm as L
from langmix.llm import common as C
from langmix.llm import quality as Q
from langmix.llm import toxicity as T
from tests.llm import fixtures as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        toxic, junk = int(k % 4 == 0), int(k % 5 == 0)
        w = X.sentence(rng, rng.randrange(60, 150)).split()
        if toxic:
            w = [x if rng.random() > 0.05 else rng.choice(["vile", "scumbag", "hatefully"]) for x in w]
        if junk:
            w = [x + "!!" for x in w]
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, 1 - junk, toxic))
    labels += [(None, 1, 1), (1000, 1, 1), (3, None, 1), (4, 1, None)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, value, want):
    return sum(bool(value(r)) == bool(want(r)) for r in rows) / len(rows)


def test_chain_on_held_out_rows(spark, labelled):
    rows, labels = labelled
    df = X.frame(spark, rows + [(2000, None, "en", "s"), (2001, "", "en", "s"), (None, "fine words only", "en", "s"), (7, rows[7][1], "en", "s")])
    chain = T.learn(df, T.categories(labels))
    got = T.with_scores(df, chain).select("doc_id", "p_low_quality", "p_toxic").collect()
    assert len(got) == len(rows) + 4
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and X.crc(r.doc_id) % 5 == 0]
    assert accuracy(held, lambda r: r.p_toxic >= 0.5, lambda r: r.doc_id % 4 == 0) > 0.95
    assert accuracy(held, lambda r: r.p_low_quality >= 0.5, lambda r: r.doc_id % 5 == 0) > 0.95
    empty = [r for r in got if r.doc_id in (2000, 2001)]
    assert empty[0].p_toxic == empty[1].p_toxic < 0.5
    same = [r.p_toxic for r in got if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]


def test_chain_uses_out_of_fold_odds():
    """A later category that repeats an unlearnable earlier one gains nothing from it."""
    rng = np.random.default_rng(1)
    n = 300
    y = rng.integers(0, 2, n).astype(float)
    idx, owner = np.arange(n), np.arange(n)  # a feature of its own for each row
    weights, dense = T.fit_chain(idx, np.ones(n), owner, np.column_stack([y, y]), ("a", "b"), n)
    assert len(weights) == 2 and len(dense[1]) == 2
    assert dense[1][0] < 1.0  # in-fold odds would be trusted blindly


def test_chain_is_learned_in_bounded_memory(spark, monkeypatch):
    """The driver holds blocks of the sample, however many features its texts have."""
    rng = random.Random(4)
    words = [X.sentence(rng, 1) + str(k) for k in range(6000)]
    df = X.frame(spark, [(k, " ".join(rng.choices(words, k=3000)), "en", "s") for k in range(400)])
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(T, "logit_fit", functools.partial(T.logit_fit, steps=2))
    tracemalloc.start()
    try:
        chain = T.learn(df, T.categories(labels))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(w.any() for w in chain.weights)
    assert peak < 40e6


def test_fit_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 40, 200)
    sizes[-1] = 0
    idx, val = rng.integers(0, 50, sizes.sum()), rng.random(sizes.sum()).astype(np.float32)
    y = rng.integers(0, 2, (200, 2)).astype(float)
    whole = T.fit_chain(idx, val.astype(float), np.repeat(np.arange(200), sizes), y, ("a", "b"), 50)
    rows = T.Rows()
    rows.extend(idx, val, sizes)
    for most in (100, 10**6):
        monkeypatch.setattr(T, "BLOCK", most)
        parts = T.fit_blocks(rows, y, ("a", "b"), 50)
        assert all((p == w).all() for a, b in zip(parts, whole) for p, w in zip(a, b))


def test_chain_without_labels(spark):
    df = X.frame(spark, X.documents()[:4])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = T.learn(df, T.categories(none))
    assert all(r.p_toxic < 0.5 for r in T.with_scores(df, chain).select("p_toxic").collect())
    assert T.with_scores(X.empty(spark), chain).count() == 0


def test_quality_on_held_out_rows(spark, labelled):
    rows, labels = labelled
    df = X.frame(spark, rows + [(2000, None, "en", "s"), (2001, "", "en", "s"), (None, "fine words only", "en", "s")])
    vectors = Q.word_vectors(df)
    got = Q.with_score(df, vectors, Q.learn(df, labels, vectors)).collect()
    assert len(got) == len(rows) + 3
    assert all(r.held_out == (r.doc_id is not None and X.crc(r.doc_id) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert accuracy(held, lambda r: r.predicted, lambda r: r.doc_id % 5) > 0.95
    empty = [r.score for r in got if r.doc_id in (2000, 2001)]
    assert empty[0] == empty[1]


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = X.frame(spark, X.documents()[:4])
    vectors = Q.word_vectors(df)
    assert {r.score for r in Q.with_score(df, vectors, Q.learn(df, none, vectors)).collect()} == {0.5}
    vectors = Q.word_vectors(X.empty(spark))
    assert not vectors.any()


def test_word_vectors_match_a_plain_count():
    slot, first = np.array([1, 2, 3, 1, 5, 6]), np.array([0, 4, 6])
    total = np.zeros(Q.SLOTS * Q.DIM)
    Q.add_contexts(total, slot, first)
    dims, signs = Q.index_vectors()
    want = np.zeros((Q.SLOTS, Q.DIM))
    for text in (slot[:4], slot[4:]):
        for i, a in enumerate(text):
            for j, b in enumerate(text):
                if 0 < abs(i - j) <= Q.REACH:
                    for k in range(Q.NONZERO):
                        want[a, dims[k, b]] += signs[k, b]
    assert np.allclose(total.reshape(want.shape), want)


def test_pooled_chunks(monkeypatch):
    import pyarrow as pa
    rng = random.Random(1)
    vectors = np.random.default_rng(0).standard_normal((Q.SLOTS, Q.DIM)).astype(np.float32)
    col = pa.array([X.sentence(rng, 50), None, "", X.sentence(rng, 7), "a"])
    whole = Q.pooled(vectors, col)
    monkeypatch.setattr(Q, "_STEP", 11)
    assert np.allclose(whole, Q.pooled(vectors, col), atol=1e-5)


def tokens_of(text):
    return X.space_words(X.fold(text)) + [None]


def test_scores_match_plain_counts(spark):
    docs = X.documents()
    got = L.scores(X.frame(spark, docs)).collect()
    held = {d: d is not None and X.crc(d) % 7 == 2 for d, *_ in docs}
    count = Counter(w for d, t, *_ in docs if not held[d] for w in tokens_of(t))
    total, types = sum(count.values()), len(count)
    want = Counter()
    for d, t, *_ in docs:
        w = tokens_of(t)
        base = sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w)
        want[(d, held[d], len(w), sum(count[x] > 0 for x in w), total, round(base, 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_classes_and_scores_match_plain_counts(spark):
    """Every training word's class, chosen by trying all, and the score of each text."""
    docs = [r for r in X.documents() if r[1] is None or len(r[1]) < 3000]
    blocks = L.token_blocks(X.frame(spark, docs))
    f = L.fit(blocks)
    m, n = f.model, 0
    texts, ending, times = [], {}, Counter()
    for row in blocks.toArrow().to_pylist():
        b = L.Block(row)
        ending.update(zip(b.words.tolist(), b.endings.tolist()))
        for k, ids in enumerate(b.ids):
            at = int(b.sizes[:k].sum())
            texts.append((ids, bool(b.held[k]), b.words[b.local[at:at + b.sizes[k]]].tolist()))
    end, own = int(L.END), {w: k + 1 for k, w in enumerate(f.own.tolist())}
    unit = {w: 0 if w == end else own.get(w, L.OWN + ending[w]) for w in ending}
    pairs = Counter((a, b) for _, held, t in texts if not held for a, b in zip([end, *t], t))
    for (a, b), k in pairs.items():
        times[b] += k
    first = {w: int(f.units[u]) for w, u in unit.items()}

    def information(cls):
        n = np.zeros((L.CLASSES, L.CLASSES))
        for (a, b), k in pairs.items():
            n[cls[a], cls[b]] += k
        return L.xlogx(n).sum() - L.xlogx(n.sum(axis=0)).sum() - L.xlogx(n.sum(axis=1)).sum()

    got = {}
    for row in blocks.toArrow().to_pylist():
        b = L.Block(row)
        order, _ = L._deal(b.words, L.C.parts(spark))
        mine = f.words.where(f"block = {row['block']}").orderBy("p").collect()
        k = np.concatenate([L._unpack(r.classes, np.uint8) for r in mine])
        got.update(zip(b.words[order].tolist(), k.tolist()))
    tied = [w for w in ending if times[w] and unit[w] >= L.OWN]
    assert all((got[w] == L.UNSEEN) == (not times[w]) for w in ending)
    assert all(got[w] == first[w] for w in ending if times[w] and unit[w] < L.OWN)
    for w in sorted(tied)[::max(1, len(tied) // 15)]:
        tries = [information({**first, w: k}) for k in range(L.CLASSES)]
        assert tries[got[w]] >= max(tries) - 1e-6
    # the model from plain counts
    by_ending = Counter((ending[w], got[w]) for w in tied)
    kinds = Counter(got[w] for w in ending if times[w])
    usual = min(k for k in kinds if kinds[k] == max(kinds.values()))
    def unseen(e):
        return min((-by_ending[e, k], k) for k in range(L.CLASSES))[1] if any((e, k) in by_ending for k in range(L.CLASSES)) else usual
    cls = {w: got[w] if times[w] else unseen(ending[w]) for w in ending}
    n, size, before, total = Counter(), Counter(), Counter(), sum(times.values())
    for (a, b), k in pairs.items():
        n[cls[a], cls[b]] += k
        size[cls[b]] += k
        before[cls[a]] += k
    want = Counter()
    for d, held, t in texts:
        s = 0.0
        for a, b in zip([end, *t], t):
            i, j = cls[a], cls[b]
            s += math.log10((n[i, j] + L.PRIOR * size[j] / total) / (before[i] + L.PRIOR))
            s += math.log10((times[b] - m.discount if times[b] else m.discount * kinds[j]) / size[j])
        want[d, held, len(t), round(s, 4)] += 1
    scored = L.scores(X.frame(spark, docs)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, round(r.score, 4)) for r in scored) == want
    # transitions and emissions sum to one
    used = np.isfinite(m.inside)
    assert np.allclose((10 ** m.step[:, used]).sum(axis=1), 1)
    mass = np.where(used, 10 ** m.unknown, 0.0)
    for w in ending:
        if times[w]:
            mass[cls[w]] += (times[w] - m.discount) * 10 ** m.inside[cls[w]]
    assert np.allclose(mass[used], 1)


def test_best_classes_follow_the_exchange():
    """Moves of single words, each tried in full; words that follow themselves too."""
    rng = np.random.default_rng(4)
    b = rng.poisson(0.7, (30, 30)).astype(float)
    cls = rng.integers(0, 5, 30)

    def matrix(c):
        return np.eye(5)[c].T @ b @ np.eye(5)[c]

    def information(c):
        n = matrix(c)
        return L.xlogx(n).sum() - L.xlogx(n.sum(axis=0)).sum() - L.xlogx(n.sum(axis=1)).sum()

    one, own = np.eye(5)[cls], np.diag(b)
    r, l = b @ one, b.T @ one
    r[np.arange(30), cls] -= own
    l[np.arange(30), cls] -= own
    got = L.best_classes(matrix(cls), r, l, own, cls)
    for u in range(30):
        tries = [information(np.where(np.arange(30) == u, k, cls)) for k in range(5)]
        assert tries[got[u]] >= max(tries) - 1e-6
    assert (got != cls).any()


def test_exchange_raises_mutual_information():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 3, 60)
    b = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 6, 0.2)).astype(float)
    cls = L.exchange(b, 3)

    def information(c):
        n = np.eye(3)[c].T @ b @ np.eye(3)[c]
        f = lambda x: float((x * np.log(np.maximum(x, 1e-12))).sum())
        return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))

    assert len({(int(a), int(k)) for a, k in zip(cls, kind)}) == 3
    assert information(cls) >= information(kind) - 1e-6


def test_blocks_without_tied_words(spark):
    """Partitions whose words of a block are all units of their own, or held out, have no contexts to send."""
    assert len(L._unpack(L._pack(np.zeros(0, np.uint32)), np.uint32)) == 0
    texts = ["a b c a", "b b", None, "c", "a unheard", "b c", ""]
    docs = [(k, t, "en", "s") for k, t in enumerate(texts * 3)]
    held = {d: X.crc(d) % L.FOLD == L.HELD for d, *_ in docs}
    assert any(held.values())
    count, total = Counter(), 0
    for d, t, *_ in docs:
        if not held[d]:
            count.update(X.space_words(t))
            total += len(X.space_words(t)) + 1
    got = L.scores(X.frame(spark, docs)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter(
        (d, held[d], len(X.space_words(t)) + 1, sum(count[x] > 0 for x in X.space_words(t)) + 1, total) for d, t, *_ in docs)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_scores_of_nothing(spark):
    assert L.scores(X.empty(spark)).count() == 0
    r = L.scores(X.frame(spark, [(2, "held", "en", "s")]).where("false")).collect()
    assert r == []


def test_held_out_text_scores_better_than_the_base(spark):
    r = L.scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert r.a > r.b


def test_sums_are_added_level_by_level(spark):
    """Arrays of 30 tasks, four at a time: three levels."""
    rows = [(k, p, np.array([p, k * p], np.int64).tobytes()) for p in range(30) for k in range(3)]
    df = spark.createDataFrame(rows, "key int, part int, m binary").repartition(30)
    got = C.add_up(df, 3, lambda m: np.frombuffer(m, np.int64), np.ndarray.tobytes, fan=4)
    assert {k: x.tolist() for k, x in got.items()} == {k: [435, k * 435] for k in range(3)}
    assert C.add_up(df.where("key > 5"), 3, lambda m: np.frombuffer(m, np.int64), np.ndarray.tobytes) == {}
