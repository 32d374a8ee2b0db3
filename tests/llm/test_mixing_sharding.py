import zlib
from collections import Counter, defaultdict

import numpy as np

from langmix.llm import mixing as M
from langmix.llm import sharding as S
from tests.llm import fixtures as X


def filled(sizes: dict, weights: dict, budget: float, most: int) -> dict:
    """Water-filling, source by source."""
    out, free = {}, set(sizes)
    while free:
        level = (budget - sum(out.values())) / sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * level > most * sizes[s]}
        if not above:
            return out | {s: weights[s] * level for s in free}
        out |= {s: most * sizes[s] for s in above}
        free -= above
    return out


def test_mix_reaches_its_targets(spark):
    docs = X.documents()
    df = X.frame(spark, docs)
    sizes, plan = M.plan_mix(df)
    size = Counter()
    for _, t, _, s in docs:
        size[s] += len(X.space_words(t))
    names = sorted(k for k in size if k is not None) + [None]
    want = filled(size, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), 2)
    got = {r.source: r for r in plan.collect()}
    assert {s: round(r.target, 6) for s, r in got.items()} == {s: round(x, 6) for s, x in want.items()}
    taken, longest = Counter(), defaultdict(int)
    rows = M.with_copies(df, plan, out="times").collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(X.space_words(r.text))
        assert 0 <= r.times <= 2
        taken[r.source] += n * r.times
        longest[r.source] = max(longest[r.source], n)
    for s, x in want.items():
        assert abs(taken[s] - x) <= longest[s] / 2 + 1e-6
    # the mix holds whole rows, the same ones every time
    mixed = X.rows_of(M.mixed(df).select("doc_id", "source"))
    assert mixed == X.rows_of(M.mixed(df).select("doc_id", "source"))
    assert sum(mixed.values()) == sum(r.times for r in rows)
    assert M.mixed(df).columns == df.columns


def test_empty_documents_are_not_taken_more_often(spark):
    docs = [(k, "" if k % 2 else "w " * (k % 7 + 1), "en", "big" if k < 90 else "small") for k in range(100)]
    times = X.rows_of(M.mixed(X.frame(spark, docs)).select("doc_id"))
    assert max(times.values()) <= M.MAX_EPOCHS


def test_targets_of_some_hundred_million_words(spark):
    # what is left fits 32 bits, three times of it does not
    size = {f"s{k:02d}": 2_000_000 * (1 + 5 * (k % 3)) for k in range(20)} | {"s00": 150_000_000}
    sizes = spark.createDataFrame([(s, n) for s, n in size.items()], "source string, size long")
    want = filled(size, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}, 1.5 * sum(size.values()), 2)
    got = {r.source: r for r in M.targets(sizes).collect()}
    assert 2 ** 31 // 3 < 3 * sum(size.values()) < 2 ** 31
    assert {s: round(r.target, 4) for s, r in got.items()} == {s: round(x, 4) for s, x in want.items()}


def test_mix_of_nothing(spark):
    assert M.mixed(X.empty(spark)).count() == 0
    only_empty = X.frame(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    assert M.mixed(only_empty).count() >= 0


def check_shards(docs, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == \
        Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_even_and_keep_groups_together(spark):
    docs = X.documents() + [(500 + k, f"copy of {k // 4}", "en", "s0") for k in range(48)]
    rows = S.shard_rows(X.frame(spark, docs), shards=6).collect()
    check_shards(docs, rows, 6)
    homes = defaultdict(set)
    for r in rows:
        if r.doc_id is not None and r.doc_id >= 500:
            homes[(r.doc_id - 500) // 4].add(r.shard)
    assert sum(len(x) == 1 for x in homes.values()) >= 10


def test_a_group_larger_than_a_shard(spark):
    docs = [(k, "the same text" if k % 3 else f"text {k}", "en", "s0") for k in range(60)]
    check_shards(docs, S.shard_rows(X.frame(spark, docs), shards=7).collect(), 7)


def test_few_rows(spark):
    check_shards([(1, "a", "en", "s")], S.shard_rows(X.frame(spark, [(1, "a", "en", "s")])).collect(), 40)
    assert S.shard_rows(X.empty(spark)).count() == 0


def test_full_shards_swap(spark):
    """Every text twice: no shard has room, and yet nearly all copies meet."""
    docs = [(k, f"text {k % 200}", "en", "s0") for k in range(400)]
    rows = S.shard_rows(X.frame(spark, docs), shards=5).collect()
    check_shards(docs, rows, 5)
    homes = defaultdict(set)
    for r in rows:
        homes[r.doc_id % 200].add(r.shard)
    assert sum(len(x) == 1 for x in homes.values()) >= 180


def test_a_third_in_one_group(spark):
    docs = [(k, "the same text" if k % 3 == 0 else f"text {k // 6}", "en", "s0") for k in range(1200)]
    rows = S.shard_rows(X.frame(spark, docs), shards=40).collect()
    check_shards(docs, rows, 40)
    counts = Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert len(counts) <= 16  # 14 shards hold it


def test_balanced_moves():
    flow = np.array([[0, 5, 0], [3, 0, 4], [2, 0, 0]])
    for free in ([0, 0, 0], [1, 0, 2], [9, 9, 9]):
        x = S.balanced(flow, np.array(free))
        assert (x >= 0).all() and (x <= flow).all() and (x.sum(axis=0) - x.sum(axis=1) <= free).all()
        assert x.sum() >= 9
