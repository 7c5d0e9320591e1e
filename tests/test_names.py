import logging
import math
import random
import zipfile
from functools import cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.functions import arrow_distance
from kindred.functions.distance import NAME_DISTANCES, euclidean, name_distance, rmse_eps
from kindred.functions.grams import qgrams, trigrams
from kindred.functions.normalize import NormalizeOptions, direct_download_url, guess_name_column, normalize_name, numeric_columns, pasted_names, rename_embedding_columns, to_double, without_blank_names, zero_if_null
from kindred.functions.progress import LOGGER, progress, show_progress
from kindred.operators.blocking import candidates
from kindred.sources.files import clean_directory, find_directory, load_directory, read_csv, write_csv


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_normalize(spark):
    df = names(spark, "A & B", "Foo  Bar", "X+Y=$ €", "O’Neil-Co_", None, "")
    got = [r[0] for r in df.select(normalize_name(F.col("name"))).collect()]
    assert got == ["a  b", "foo bar", "x+y=$ €", "oneilco", None, ""]
    off = NormalizeOptions(lower=False, spaces=False, punctuation=False)
    assert [r[0] for r in df.select(normalize_name(F.col("name"), off)).collect()] == [r.name for r in df.collect()]


def test_helpers(spark):
    url = "https://www.dropbox.com/s/abc123/file.csv?dl=0"
    df = names(spark, url, "https://example.org/x", "dropbox.com/a")
    assert [r[0] for r in df.select(direct_download_url(F.col("name"))).collect()] == ["https://dl.dropboxusercontent.com/s/abc123/file.csv?dl=0", "https://example.org/x", "dl.dropboxusercontent.com/a"]
    assert [r[0] for r in names(spark, "1.5", "x", None).select(zero_if_null(to_double(F.col("name")))).collect()] == [1.5, 0.0, 0.0]
    frame = spark.createDataFrame([(1, "a", 2.0)], "id int, Company string, v double")
    assert guess_name_column(frame) == "Company" and guess_name_column(frame.select("id", "v")) == "id"
    assert rename_embedding_columns(frame, "Company").columns == ["emb_001", "Company", "emb_002"]
    assert numeric_columns(frame).columns == ["id", "v"]
    assert [r.names for r in pasted_names(names(spark, " a \n\n b\t\r\n"), "name").collect()] == ["a", "b"]
    assert without_blank_names(names(spark, "a", "  ", None), "name").count() == 1


def test_progress(capsys):
    progress("not shown")
    handler = show_progress()
    try:
        progress("%d of %d", 1, 2)
    finally:
        LOGGER.removeHandler(handler)
        LOGGER.setLevel(logging.NOTSET)
    progress("not shown")
    said = capsys.readouterr().err
    assert said.endswith(" kindred: 1 of 2\n") and said.count("\n") == 1


def brute_trigrams(s):
    return [s[i : i + 3] for i in range(min(len(s) - 2, 100))] if len(s) >= 3 else [s] if s else []


def test_grams(spark):
    values = ["", "a", "ab", "abc", "aaaa", "é" * 5, "x" * 200]
    rows = names(spark, *values, None).select("name", trigrams(F.col("name")).alias("t"), qgrams(F.col("name")).alias("q")).collect()
    for r in rows[:-1]:
        assert r.t == brute_trigrams(r.name) and r.q == [r.name[i : i + 2] for i in range(len(r.name) - 1)]
    assert rows[-1].t is None and rows[-1].q is None


def test_candidates_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    probe = [make(rng.randint(0, 60)) for _ in range(25)] + ["", "ab", None]
    other = [make(rng.randint(0, 130)) for _ in range(25)] + ["", "ab", None, "ab"]
    want = set()
    for a in {x for x in probe if x is not None}:
        for b in {x for x in other if x is not None}:
            t = brute_trigrams(a)
            c = sum(g in set(t) for g in brute_trigrams(b))
            if c >= 1 and c >= math.ceil(0.05 * len(t)):
                want.add((a, b))
    got = candidates(names(spark, *probe), names(spark, *other)).collect()
    assert {(r.probe, r.other) for r in got} == want and len(got) == len(want)


def brute_osa(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute_lcs(a, b):
    @cache
    def f(i, j):
        return 0 if not i or not j else f(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(f(i - 1, j), f(i, j - 1))

    return len(a) + len(b) - 2 * f(len(a), len(b))


def test_edit_distances_against_others():
    import duckdb

    rng = random.Random(9)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for _ in range(600)]
    pairs += [("ca", "abc"), ("", ""), ("", "x"), ("martha", "marhta"), ("dixon", "dicksonx")]
    a, b = map(list, zip(*pairs, strict=True))
    frame = pd.DataFrame({"i": range(len(a)), "a": a, "b": b})
    other = duckdb.sql("select damerau_levenshtein(a, b) as dl, 1 - jaro_similarity(a, b) as jw from frame order by i").df()
    assert arrow_distance.batched(arrow_distance.dl, a, b).tolist() == other.dl.tolist()
    some = np.array([bool(x) or bool(y) for x, y in pairs])
    assert np.allclose(arrow_distance.batched(arrow_distance.jaro, a, b)[some], other.jw[some])
    assert arrow_distance.batched(arrow_distance.osa, a, b).tolist() == [brute_osa(*p) for p in pairs]
    assert arrow_distance.batched(arrow_distance.lcs, a, b).tolist() == [brute_lcs(*p) for p in pairs]
    assert np.isnan(arrow_distance.batched(arrow_distance.osa, ["a", None], [None, "b"])).all()


@pytest.mark.parametrize("method", sorted(NAME_DISTANCES))
def test_distances_of_a_name_to_itself(spark, method):
    df = spark.createDataFrame([("test company", "test company"), ("abc", None)], "a string, b string")
    rows = df.select(name_distance(method, F.col("a"), F.col("b")).alias("d")).collect()
    assert rows[0].d == pytest.approx(0) and (rows[1].d is None or math.isnan(rows[1].d))


def test_fixture_distances(spark):
    df = spark.createDataFrame([("apple incorporated company", "appple incorporated company"), ("x", "abc")], "a string, b string")
    d = lambda m: [r.d for r in df.select(name_distance(m, F.col("a"), F.col("b")).alias("d")).collect()]
    assert d("jaccard") == [0.0, None] and d("osa")[0] == 1 and 0 < d("jw")[0] < 0.5 and d("hamming") == [math.inf, math.inf]
    assert d("cosine")[1] is None and d("qgram") == [1.0, None] and d("lv") == [1.0, 3.0] and d("soundex")[0] == 0.0
    with pytest.raises(ValueError):
        name_distance("ml", F.col("a"), F.col("b"))
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>").select(euclidean(F.col("a"), F.col("b")).alias("e"), rmse_eps(F.col("a"), F.col("b")).alias("r")).first()
    assert v.e == pytest.approx(math.sqrt(2)) and v.r == pytest.approx(math.sqrt(1.0001))


def test_files(spark, tmp_path):
    import gzip

    content = "a,b\n1,x\n2,y\n"
    with zipfile.ZipFile(tmp_path / "t.csv.zip", "w") as z:
        z.writestr("folder/t.csv", content)
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(content)
    for name in ("t.csv.zip", "t.csv.gz"):
        got = read_csv(spark, str(tmp_path / name))
        assert got.dtypes == [("a", "int"), ("b", "string")] and sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y")]
        assert read_csv(spark, str(tmp_path / name), "a long, b string").dtypes[0] == ("a", "bigint")
    quoted = 'a,b\r\n1,"two\r\nlines, ""quoted"""\r\n\r\n2,y'
    with zipfile.ZipFile(tmp_path / "q.csv.zip", "w") as z:
        z.writestr("q.csv", quoted)
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "q.csv.zip")).collect())) == [(1, 'two\r\nlines, "quoted"'), (2, "y")]
    write_csv(got, str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out")).count() == 2
    rows = [("Apple, LLC", "B"), ("apple llc", "A"), ("  ", "C"), (None, "D")]
    spark.createDataFrame(rows, "alias_name string, canonical_id string").write.parquet(str(tmp_path / "dir"))
    assert [tuple(r) for r in clean_directory(load_directory(spark, str(tmp_path / "dir"))).collect()] == [("apple llc", "A")]
    assert find_directory(spark, "dir", str(tmp_path / "none"), str(tmp_path)).count() == 4
    with pytest.raises(FileNotFoundError):
        find_directory(spark, "other", str(tmp_path))
    with pytest.raises(ValueError):
        spark.range(1).write.parquet(str(tmp_path / "no"))
        load_directory(spark, str(tmp_path / "no"))
