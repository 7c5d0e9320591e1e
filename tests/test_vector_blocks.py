"""Blocks of vectors: counts and pairs against brute force, and what is shuffled for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import assess
from kindred.operators.matching import vector_pairs
from kindred.operators.vector_blocks import manhattan_at_least
from kindred.plans import registry


def table(spark, vectors, classes=None):
    rows = [(i, None if v is None else [float(z) for z in v], None if classes is None else classes[i]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, v array<double>, c string")


def written(spark):
    """Records and bytes that shuffles have written so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def shuffled(spark, run):
    before = written(spark)
    return run(), written(spark) - before


@pytest.mark.parametrize("own", [True, False])
def test_assessment_of_vectors_counts_rows(spark, own):
    rng = np.random.default_rng(3)
    u = [*rng.normal(size=(40, 5)), None, [np.nan, 0, 0, 0, 0]]
    v = u if own else [*rng.normal(size=(30, 5)), u[0], None]
    a, b = (["abc"[i % 3] if i % 7 else None for i in range(len(w))] for w in (u, v))
    x = table(spark, u, a)
    y = x if own else table(spark, v, b)
    want = dict.fromkeys(("tp", "fp", "fn", "tn", "n_matched"), 0)
    for i, p in enumerate(u):
        for j, q in enumerate(v):
            if p is not None and q is not None:
                hit = np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()) <= 2.5
                want["n_matched"] += hit
                if a[i] and b[j]:
                    want[("tn", "fn", "fp", "tp")[2 * hit + (a[i] == b[j])]] += 1
    assert all(want.values())
    for block in (4, 2048):
        assert assess.assess_vectors(x, y, "v", "v", "c", "c", 2.5, block=block).first().asDict() == want
    none = x.limit(0)
    assert set(assess.assess_vectors(none, x, "v", "v", "c", "c", 2.5).first()) == {0}


def test_assessment_shuffles_no_pairs(spark):
    """On sf0.01, 500 vectors have 250,000 pairs; before, those found and those true (25,198) were shuffled."""
    row, moved = shuffled(spark, lambda: registry.QUERIES["assess_vectors"](spark, "/root/testdata/sf0.01").first())
    assert row.tp + row.fp == row.n_matched == 3556 and sum(row) - row.n_matched == 250_000
    assert moved < 2 * 500 * 64 * 4


def brute(u, v, limit):
    d = np.sqrt(((u[:, None] - v[None]) ** 2).sum(2))
    return {(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= limit), strict=True)}


def pairs_of(df):
    rows = df.collect()
    got = {(r.left_id, r.right_id): r.stringdist for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pairs_of_blocks(spark, kind):
    rng = np.random.default_rng(4)
    u = rng.normal(size=(61, 6)).astype(np.float32).astype(float)
    x = table(spark, u).withColumn("v", F.col("v").cast(f"array<{kind}>"))
    y = table(spark, u[:20]).withColumn("v", F.col("v").cast(f"array<{kind}>"))
    for other, w in ((x, u), (y, u[:20])):
        want = brute(u, w, 2.0)
        got = pairs_of(vector_pairs(x, other, "id", "id", "v", "v", 2.0, block=7))
        assert got == pytest.approx(want) and len(want) > 61
    assert len(pairs_of(vector_pairs(x, x, "id", "id", "v", "v", None, block=7))) == 61 * 61
    assert vector_pairs(x, x.limit(0), "id", "id", "v", "v", 2.0).count() == 0
    uneven = lambda a, b: np.full(len(b), a[0])
    assert pairs_of(vector_pairs(x, x, "id", "id", "v", "v", 0.0, uneven, block=7)).keys() == {(i, j) for i in range(61) for j in range(61) if u[i, 0] <= 0}


def test_equal_vectors_far_from_the_origin(spark):
    """Products of numbers of 1e7 round by more than the gap between equal vectors; before, such pairs were lost."""
    u = 1e7 + np.random.default_rng(5).normal(size=(30, 64))
    x = table(spark, [*u, *u])
    assert pairs_of(vector_pairs(x, x, "id", "id", "v", "v", 0.0)).keys() == {(i, j) for i in range(60) for j in range(60) if (i - j) % 30 == 0}


def moved_by_size(spark, metric, limit):
    """Bytes shuffled for all pairs of 400 vectors and of 1,600, in blocks of 50."""
    out = []
    for n in (400, 1600):
        x = table(spark, np.random.default_rng(6).normal(size=(n, 16)))
        out.append(shuffled(spark, lambda x=x: vector_pairs(x, x, "id", "id", "v", "v", limit, metric, block=50).write.format("noop").mode("overwrite").save())[1])
    return out


def test_shuffle_follows_the_rows(spark):
    """Four times the rows, 16 times the pairs of blocks; before, 16 times the bytes."""
    small, large = moved_by_size(spark, "euclidean", 2.0)
    assert 0 < large < 6 * small


def test_shuffle_of_rmse_follows_the_rows(spark):
    small, large = moved_by_size(spark, "rmse_eps", 0.4)
    assert 0 < large < 6 * small


def test_rmse_at_its_floor(spark):
    """Equal vectors are 0.01 apart: no pair at less, those of equal vectors at just that."""
    u = np.random.default_rng(7).normal(size=(12, 9))
    x = table(spark, [*u, *u])
    run = lambda limit: pairs_of(vector_pairs(x, x, "id", "id", "v", "v", limit, "rmse_eps", block=5))
    assert run(0.009) == {} and run(0.01).keys() == {(i, j) for i in range(24) for j in range(24) if (i - j) % 12 == 0}
    d = np.sqrt(1e-4 + ((u[:, None] - u[None]) ** 2).mean(2))
    assert len(run(1.2)) == 4 * (d <= 1.2).sum()


def test_custom_metric_is_called_for_few_pairs(spark):
    """Before, an own metric was called for all pairs, whatever is known of it."""
    called = spark.sparkContext.accumulator(0)

    def own(vector, others):
        called.add(len(others))
        return registry.manhattan(vector, others)

    own.symmetric, own.at_least = True, manhattan_at_least
    u = np.random.default_rng(8).normal(size=(300, 16))
    x = table(spark, u)
    d = np.abs(u[:, None] - u[None]).sum(2)
    want = {(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= 10.0), strict=True)}
    assert pairs_of(vector_pairs(x, x, "id", "id", "v", "v", 10.0, own, block=64)) == pytest.approx(want)
    assert 300 < len(want) and len(want) / 2 <= called.value < 0.1 * 300 * 300


def test_lower_bounds_of_manhattan():
    rng = np.random.default_rng(9)
    for make in (lambda n: rng.normal(size=(n, 64)) / 8, lambda n: 1e6 + rng.normal(size=(n, 3)), lambda n: rng.integers(-2, 3, (n, 5)).astype(float), lambda n: rng.normal(size=(n, 300)) ** 9,
                 lambda n: np.ones((n, 4)), lambda n: rng.normal(size=(n, 70_000))):
        u, v = make(9), make(7)
        d = np.stack([registry.manhattan(a, v) for a in u])
        bound = manhattan_at_least(u, v)
        assert (bound <= d).all()
    u, v = rng.normal(size=(50, 64)) / 8, rng.normal(size=(40, 64)) / 8
    assert (np.abs(u[:, None] - v[None]).sum(2) - manhattan_at_least(u, v)).max() < 0.1  # near enough to rule pairs out
    u[3, 2], v[1, 0], v[2, 0] = np.nan, np.inf, -np.inf
    bound = manhattan_at_least(u, v)
    assert np.isneginf(bound[3]).all() and np.isneginf(bound[:, [1, 2]]).all() and np.isfinite(np.delete(np.delete(bound, 3, 0), [1, 2], 1)).all()
