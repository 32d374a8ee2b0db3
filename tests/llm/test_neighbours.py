import numpy as np

from langmix.llm import neighbours as N
from tests.llm import fixtures as X

DDL = "vec_id long, embedding array<float>, label int, node string, component string, copies string"


def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        rows.append((k, rng.standard_normal(16)))
    centre = rng.standard_normal(16)
    for k in range(60):
        rows.append((1000 + k, centre + rng.standard_normal(16) * 0.12))
    chain = rng.standard_normal((2, 16))
    for k in range(12):
        rows.append((2000 + k, chain[0] * np.cos(k * 0.3) + chain[1] * np.sin(k * 0.3)))
    rows += [(k + 3000, rows[5][1] * (1 + k)) for k in range(3)] + [(None, rows[7][1]), (9, rows[9][1])]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [1.0, None] + [0.0] * 14), (4003, [float("nan")] + [1.0] * 15),
             (4004, [float("inf")] + [1.0] * 15), (4005, []), (4006, [1.0, 0.0]), (4007, [1.0, 0.01]), (4008, [3e38] * 16)]
    return rows


def brute(rows, threshold=0.9):
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    near = [[j for j, b in enumerate(unit) if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold]
            for i, a in enumerate(unit)]
    return X._classes([k for k, _ in rows], near)


def test_matches_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(k, v, 1, "x", "x", "x") for k, v in rows], DDL)
    want = {(k, c, kept): n for (k, c, n, kept) in brute(rows)}
    for block in (512, 16):  # windows and blocks smaller than the groups change nothing
        got = N.near_duplicates(df, block=block).collect()
        assert {(r.vec_id, r.component_id, r.kept): r.n_links for r in got} == want
        assert len(got) == len(rows)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_passes_grow_with_the_table():
    assert N.passes_for(100) == N.PASSES
    assert N.PASSES < N.passes_for(10 ** 5) < N.passes_for(10 ** 6) < N.passes_for(5 * 10 ** 7)
    p = N.agreement(0.9)
    for n in (10 ** 5, 10 ** 6, 5 * 10 ** 7):
        assert 1 - (1 - p ** np.log2(n / N.BLOCK)) ** N.passes_for(n) >= N.RECALL


def test_rounded_vectors_keep_every_link():
    """Pairs on both sides of the threshold: none above it is lost, few below it stay."""
    rng = np.random.default_rng(8)
    for dim in (2, 16, 64, 700):
        a = rng.standard_normal((150, dim)) * rng.exponential(1, (1, dim))
        side = rng.standard_normal((150, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side -= (side * a).sum(axis=1, keepdims=True) * a
        cos = 0.9 + rng.uniform(-0.03, 0.03, (150, 1))
        x = np.concatenate([a, cos * a + np.sqrt(1 - cos ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)])
        sort = np.repeat([5, 5, 9], 100)
        got = set(zip(*map(np.ndarray.tolist, N.possible([r.tobytes() for r in N.rounded(x)], sort, 250, 0.9))))
        same = (sort[:, None] == sort[None, :]) & ~np.eye(300, dtype=bool)
        same[250:] = False
        assert set(zip(*np.nonzero(same & (x @ x.T >= 0.9)))) <= got <= set(zip(*np.nonzero(same & (x @ x.T >= 0.85))))


def test_depths():
    rng = np.random.default_rng(3)
    code = np.sort(rng.integers(0, 1 << 10, 200))
    for block in (4, 16):
        best = np.zeros(len(code), int)
        for lo in range(0, len(code), block):
            own = np.arange(lo, min(lo + 2 * block, len(code))) < lo + block
            part = N.depths(code[lo:lo + 2 * block], np.zeros(len(own), int), own, block, 10)
            best[lo:lo + 2 * block] = np.maximum(best[lo:lo + 2 * block], part)
        for i, x in enumerate(code):
            runs = [((code >> (10 - k)) == (x >> (10 - k))).sum() for k in range(11)]
            assert best[i] == min([k for k in range(11) if runs[k] <= block], default=11)


def test_isolated_pairs_in_a_large_table(spark):
    """Windows of 8 places in 2,400 vectors, a third of them close together."""
    rng = np.random.default_rng(9)
    cone = rng.standard_normal(32)
    x = rng.standard_normal((2200, 32))
    x[:800] = cone / np.linalg.norm(cone) * 4.5 + x[:800] * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((200, 32))
    mate = x[700:900]  # half of the pairs in the cone
    side -= (side * mate).sum(axis=1, keepdims=True) * mate
    x = np.concatenate([x, 0.905 * mate + np.sqrt(1 - 0.905 ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)])
    rows = [(k, [float(np.float32(a)) for a in v]) for k, v in enumerate(x)]
    got = N.near_duplicates(spark.createDataFrame([(k, v, 1, "x", "x", "x") for k, v in rows], DDL), block=8).collect()
    want = brute(rows)
    assert sum(n for (_, _, links, _), n in want.items() if links) >= 200
    wrong = sum(want[(r.vec_id, r.component_id, r.n_links, r.kept)] != 1 for r in got)
    assert len(got) == len(rows) and wrong <= 2
