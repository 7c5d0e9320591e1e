import math
import random

import numpy as np
import pandas as pd
import pytest

from kindred.functions.normalize import NormalizeOptions
from kindred.operators import calibrate
from kindred.operators.assess import assess, scores
from kindred.operators.link import LinkParts, link, lookup
from kindred.operators.matching import embed, embedding_summary, impute_column_means, name_pairs, vector_pairs, wide_embeddings
from kindred.streaming.linker import link_stream


def x_of(spark, *values, column="orgnames_x"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


X1, Y1 = ("apple", "oracle", "enron inc.", "mcdonalds corporation"), ("apple corp", "oracle inc", "enron", "mcdonalds co")


def test_tutorial(spark):
    x, y = x_of(spark, *X1), x_of(spark, *Y1, column="orgnames_y")
    got = {(r.orgnames_x, r.orgnames_y): round(r.stringdist, 6) for r in link(x, y, left_on="orgnames_x", right_on="orgnames_y").collect()}
    assert got == {
        ("apple", "apple corp"): 0.555556, ("oracle", "oracle inc"): 0.444444, ("enron inc.", "oracle inc"): 0.785714, ("enron inc.", "enron"): 0.5,
        ("mcdonalds corporation", "apple corp"): 0.826087, ("mcdonalds corporation", "oracle inc"): 0.92, ("mcdonalds corporation", "mcdonalds co"): 0.388889,
    }
    few = link(x, y, left_on="orgnames_x", right_on="orgnames_y", target_matches=1).collect()
    assert sorted(r.orgnames_x for r in few) == ["mcdonalds corporation", "oracle"]
    assert calibrate.name_threshold(x.replace("enron inc.", "enron inc"), y, "orgnames_x", "orgnames_y", 1) == pytest.approx(0.472222, abs=1e-6)


def test_one_column_on_both_sides(spark):
    x, y = x_of(spark, "Apple Inc", "Microsoft Corp", column="org"), x_of(spark, "Apple", "Microsoft Corporation", column="org")
    got = link(x, y, on="org", target_matches=2)
    assert got.columns == ["org_x", "org_y", "stringdist", "minDist"]
    assert sorted(round(r.stringdist, 6) for r in got.collect()) == [0.315789, 0.5]


@pytest.mark.parametrize(
    ("a", "b", "options", "n"),
    [
        ("MICROSOFT CORPORATION", "microsoft corporation", {}, 1), ("MICROSOFT CORPORATION", "microsoft corporation", {"lower": False}, 0),
        ("Microsoft. Corporation! Int?", "microsoft corporation int", {}, 1), ("Microsoft   Corporation", "microsoft corporation", {}, 1),
        ("Microsoft.   Corporation", "microsoft corporation", {"punctuation": False}, 0), ("Microsoft.   Corporation", "microsoft corporation", {"spaces": False}, 0),
    ],
)
def test_normalisation_options(spark, a, b, options, n):
    assert link(x_of(spark, a, column="n"), x_of(spark, b, column="n"), on="n", max_dist=0, normalize=NormalizeOptions(**options)).count() == n


def test_edges(spark):
    x = x_of(spark, "apple", None, "   ", "apple", column="n")
    y = x_of(spark, "Apple", None, "zzzz", column="n")
    got = link(x, y, on="n", max_dist=0.5).collect()
    assert [(r.n_x, r.n_y) for r in got] == [("apple", "Apple")]
    for p, q in ((x.limit(0), y), (x, y.limit(0))):
        assert link(p, q, on="n").count() == 0 and link(p, q, on="n", max_dist=1).columns == ["n_x", "n_y", "stringdist", "minDist"]
    assert link(x_of(spark, "apple", column="n"), x_of(spark, "zzzz", column="n"), on="n").count() == 0
    left = link(x_of(spark, "apple", "qqq", column="n"), x_of(spark, "apple", "zzz", column="m"), left_on="n", right_on="m", max_dist=0, how="full").collect()
    assert sorted((str(r.n), str(r.m)) for r in left) == [("None", "zzz"), ("apple", "apple"), ("qqq", "None")]


def test_validation(spark):
    x = x_of(spark, "a", column="n")
    for options in ({"on": "zz"}, {"on": "n", "algorithm": "lookup"}, {"on": "n", "distance": "ml"}, {"on": "n", "max_dist": 1, "target_matches": 1}, {"on": "n", "algorithm": "network"}, {"on": "n", "algorithm": "embedding"}, {"on": "n", "how": "cross"}, {}):
        with pytest.raises(ValueError):
            link(x, x, **options)
    with pytest.raises(TypeError):
        link(None, x, on="n")
    with pytest.raises(ValueError):
        calibrate.threshold(x, x, "n", "n", mode="other")
    assert "pair_id" in link(x, x, on="n", max_dist=0, diagnostics=True).columns


DIRECTORY = [("apple llc", "A"), ("apple corp", "A"), ("microsoft inc", "M"), ("microsoft corporation", "M")]


def test_network(spark):
    d = spark.createDataFrame(DIRECTORY, "alias_name string, canonical_id string")
    x, y = spark.createDataFrame([(1, "apple llc")], "xid int, org_x string"), spark.createDataFrame([(2, "apple corp")], "yid int, org_y string")
    options = {"left_on": "org_x", "right_on": "org_y", "algorithm": "network", "directory": d, "max_dist": 0, "max_dist_network": 0}
    parts = link(x, y, return_parts=True, **options)
    assert isinstance(parts, LinkParts) and parts.raw.count() == 0 and parts.network.count() == 1
    r = parts.links.first()
    assert (r.org_x, r.org_y, r.stringdist, r.stringdist_x2network, r.minDist) == ("apple llc", "apple corp", None, 0, 0)
    x = spark.createDataFrame([(1, "apple llc"), (2, "microsoft inc")], "xid int, org_x string")
    y = spark.createDataFrame([(2, "apple llc"), (3, "microsoft corporation")], "yid int, org_y string")
    rows = link(x, y, network_weight=2, **options).collect()
    assert len(rows) == 2 and sum(r.stringdist is not None for r in rows) == 1 and all(r.minDist == 0 for r in rows)
    # names apart from the aliases: weight times the larger distance
    x, y = spark.createDataFrame([(1, "apple llcx")], "xid int, org_x string"), spark.createDataFrame([(2, "apple corpx")], "yid int, org_y string")
    r = link(x, y, **(options | {"max_dist_network": 0.3})).first()
    assert r.minDist == pytest.approx(1.5 * max(r.stringdist_x2network, r.stringdist_y2network)) and r.canonical_id == "A"
    assert [tuple(r) for r in lookup(x_of(spark, "Apple LLC", "none", column="n"), "n", d).collect()] == [("Apple LLC", "A")]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(37, 10)), rng.normal(size=(23, 10))
    frame = lambda m, c: spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(m)], f"{c} long, v array<double>")
    x, y = frame(u, "a"), frame(v, "b")
    want = np.sqrt(((u[:, None] - v[None]) ** 2).sum(2))
    got = vector_pairs(x, y, "a", "b", "v", "v", None, block=8).toPandas()
    assert len(got) == 37 * 23 and np.allclose(got.stringdist, want[got.left_id, got.right_id])
    assert vector_pairs(x, y, "a", "b", "v", "v", 3.0, block=8).count() == (want <= 3).sum()
    assert vector_pairs(x, x, "a", "a", "v", "v", 0.0).count() == 37
    zero = vector_pairs(frame(np.zeros((1, 2)), "a"), frame(np.full((1, 2), 100.0), "b"), "a", "b", "v", "v", 1.0, lambda p, m: np.zeros(len(m))).collect()
    assert [r.stringdist for r in zero] == [0.0]
    t = [calibrate.threshold(x, y, "v", "v", k) for k in (1, 5, 20)]
    assert t == sorted(t) and t[0] > 0
    pairs = vector_pairs(x, y, "a", "b", "v", "v", t[1]).count()
    assert 0.5 * 5 * math.sqrt(37 * 23) <= pairs <= 1.5 * 5 * math.sqrt(37 * 23)
    assert calibrate.threshold(x.limit(0), y, "v", "v") == math.inf
    assert calibrate.threshold(x.limit(1), x.limit(1), "v", "v") >= 1e-6


def points(names: pd.Series) -> pd.Series:
    known = {"apple": [0.0, 0.0], "microsoft": [10.0, 10.0]}
    return pd.Series([known.get(n, [100.0, 100.0]) for n in names])


def test_embeddings(spark):
    x, y = x_of(spark, "Apple", "Microsoft", column="org"), x_of(spark, "apple", "MICROSOFT", "other", column="name")
    got = embed(x, "org", points)
    assert {r.org: r.embedding for r in got.collect()} == {"Apple": [0.0, 0.0], "Microsoft": [10.0, 10.0]}
    assert wide_embeddings(got, "org", 2).columns == ["org", "emb_001", "emb_002"]
    rows = link(x, y, left_on="org", right_on="name", algorithm="embedding", embedder=points, max_dist=0.1)
    assert sorted((r.org, r.name) for r in rows.collect()) == [("Apple", "apple"), ("Microsoft", "MICROSOFT")] and rows.columns == ["org", "name", "stringdist", "minDist"]
    own = got.withColumnRenamed("embedding", "e")
    assert link(own, own, on="org", algorithm="embedding", left_embedding="e", right_embedding="e", max_dist=0.1).count() == 2
    holes = spark.createDataFrame([(1, [1.0, 3.0]), (2, [None, 5.0])], "i int, v array<double>")
    assert {r.i: r.v for r in impute_column_means(holes, "v").collect()} == {1: [1.0, 3.0], 2: [1.0, 5.0]}
    m = np.random.default_rng(2).normal(size=(50, 4))
    s = embedding_summary(spark.createDataFrame([([float(z) for z in r],) for r in m], "v array<double>"), "v").first()
    z = (m - m.mean(0)) / m.std(0)
    e = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert (s.n, s.dims, s.p100) == (50, 4, 100.0) and s.p1 == pytest.approx(100 * e[0] / e.sum(), abs=0.06)


@pytest.mark.parametrize(
    ("z", "t", "want"),
    [
        ([0, 1, 2, 3], [0, 1, 2, 3], (4, 0, 0, 12, 4)), ([(0, 2), (1, 3)], [0, 1, 2, 3], (0, 2, 4, 10, 2)), ([0, 1], [0, 1, 2, 3], (2, 0, 2, 12, 2)),
        ([], [0, 1, 2, 3], (0, 0, 4, 12, 0)), ([0, 1], [], (0, 2, 0, 14, 2)), ([0, 0, 1], [0, 0], (1, 1, 0, 14, 2)),
    ],
)
def test_assessment(spark, z, t, want):
    xs, ys = ["Apple", "Google", "Microsoft", "Amazon"], ["Apple Inc", "Alphabet", "Microsoft Corp", "Amazon.com"]
    pairs = lambda k: spark.createDataFrame([(xs[i], ys[i]) if isinstance(i, int) else (xs[i[0]], ys[i[1]]) for i in k], "name string, org string")
    x, y = x_of(spark, *xs, column="name"), x_of(spark, *ys, column="org")
    got = scores(assess(x, y, pairs(z), pairs(t), "name", "org")).first()
    assert tuple(got)[:5] == want


def test_blocked_pairs_are_a_part_of_all(spark):
    x, y = x_of(spark, *X1, column="name"), x_of(spark, *Y1, column="name")
    blocked = {tuple(r) for r in name_pairs(x, y, "name", "name").collect()}
    assert blocked < {tuple(r) for r in name_pairs(x, y, "name", "name", blocking="none").collect()}


@pytest.mark.parametrize(("q", "t"), [(2, 0.0), (2, 0.25), (2, 0.5), (3, 0.4), (1, 0.3)])
def test_prefixes_find_what_trigrams_find(spark, q, t):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    other = [b[:k] + rng.choice("abz") + b[k + 1 :] for b in base for k in (0, len(b) // 2)] + ["", "a", "ab", None]
    x, y = x_of(spark, *base, "ab", "a", "", column="name"), x_of(spark, *other, column="name")
    got = {tuple(r) for r in name_pairs(x, y, "name", "name", "jaccard", q, probe="left", max_dist=t).collect()}
    all_ = name_pairs(x, y, "name", "name", "jaccard", q, probe="left")
    assert got == {tuple(r) for r in all_.where(f"stringdist <= {t}").collect()} and got


def test_stream(spark, tmp_path):
    x, y = x_of(spark, "apple", "zzz", column="n"), x_of(spark, "Apple", column="m")
    x.write.parquet(str(tmp_path / "in"))
    q = link_stream(spark.readStream.schema("n string").parquet(str(tmp_path / "in")), y, str(tmp_path / "out"), str(tmp_path / "check"), max_dist=0.1, left_on="n", right_on="m")
    q.awaitTermination(120)
    assert [(r.n, r.m) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("apple", "Apple")]


def test_lowest_row_of_a_name(spark):
    x = spark.createDataFrame([(2, "apple", {"k": 1}), (1, "apple", None)], "id int, n string, m map<string,int>")
    y = spark.createDataFrame([(7, "apple"), (7, "apple")], "id int, n string")
    rows = link(x, y, on="n", max_dist=0).collect()
    assert [(r.id_x, r.n_x, r.id_y, r.m) for r in rows] == [(1, "apple", 7, None)]
