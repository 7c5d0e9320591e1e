import math

import numpy as np

from kindred.llm.vectors import keys, near_duplicates, rotation, shape, units


def brute(rows, threshold=0.98):
    """rows (id, vector, label) by position -> links and component of each."""
    ok = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    u = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    for a, i in enumerate(ok):
        for j in ok[:a]:
            if rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, *_) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return [(links[i], least[find(i)]) for i in range(len(rows))]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, n_links string")
    got = near_duplicates(df, "vec_id", "embedding", "label", **options).collect()
    want = brute([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for k, v, y in rows])
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(key((r.vec_id, r.n_links, r.component)) for r in got) == sorted(key((r[0], *w)) for r, w in zip(rows, want, strict=True))
    assert all(r.kept == (r.vec_id == r.component) for r in got)


def near(rng, v, cosine):
    v = v / np.linalg.norm(v)
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_planted_copies(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(40, 64))
    for i, v in enumerate(base):
        rows.append((len(rows), v.tolist(), i % 3))
        for c in (0.999, 0.985, 0.9805, 0.975, 0.95):
            rows.append((len(rows), (near(rng, v, c) * rng.uniform(0.1, 9)).tolist(), i % 3))
    rows += [(len(rows) + i, base[0].tolist(), 0) for i in range(20)]
    check(spark, rows)


def test_a_large_group_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=64)
    rows = [(i, near(rng, v, rng.uniform(0.985, 0.9999)).tolist(), 1) for i in range(150)]
    check(spark, rows, block=16)


def test_edge_cases(spark):
    a, nan, inf = [1.0, 0.0, 0.0], float("nan"), float("inf")
    rows = [(1, a, 1), (2, a, None), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [nan, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0], 1), (7, [None, 1.0, 0.0], 1), (8, [], 1), (9, [1.0, 0.0], 1), (10, [2.0, 0.0, 0.0], 1), (10, [2.0, 0.0, 0.0], 1), (None, a, 1), (11, [-1.0, 0.0, 0.0], 1), (12, [1e30, 1e-30, 0.0], 1), (13, a, 2), (None, [0.0, 0.0, 1.0], 2)]
    check(spark, rows)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_duplicates(df, "vec_id", "embedding", "label").count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng, d = np.random.default_rng(8), 64
    o = units(rng.normal(size=(1, d)))[0]
    q = near(rng, o, 0.7)
    found, outside = [], 0
    for seed in range(400):
        r = rotation(d, seed)
        x, y = o @ r, q @ r
        code = np.where(x >= 0, 1, -1) / math.sqrt(d)
        f = x @ code
        found.append(y @ code / f)
        outside += abs(found[-1] - o @ q) > 4 * math.sqrt((1 - f * f) / (f * f) / (d - 1))
    assert abs(np.mean(found) - 0.7) < 0.02 and outside == 0


def test_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(9)
    bits, tables = shape(50_000, 0.98)
    u = units(rng.normal(size=(3000, 64)))
    v = np.stack([near(rng, x, 0.9801) for x in u])
    assert (keys(u, bits, tables) == keys(v, bits, tables)).any(axis=1).mean() > 0.999
