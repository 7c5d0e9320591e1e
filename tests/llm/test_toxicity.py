import zlib

import numpy as np

from pyspark.sql import functions as F

from kindred.llm import toxicity
from kindred.llm.bytefeatures import word_hashes
from kindred.llm.queries import op1_toxicity


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = op1_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    y, p = np.array([labels[r.doc_id] for r in own]), np.array([r.predicted for r in own])
    assert len(own) > 500 and (y == p).mean() > 0.96 and (p[y == 1]).mean() > 0.8
    assert len({r.threshold for r in rows}) > 1


def test_word_hashes():
    h, first = word_hashes(["The cat, the CAT.", "", "É1 x-y", "thé"], (4,))
    assert first.tolist() == [0, 4, 4, 7, 8]
    assert (h[0] == h[2]).all() and (h[1] == h[3]).all() and h[0, 0] != h[1, 0]
    alone, _ = word_hashes(["é1"], (4,))
    assert (h[4] == alone[0]).all() and h[0, 1] == 0
    long, _ = word_hashes(["worthless worthy"], (4, 5))
    assert (long[0, 1:] == long[1, 1:]).all() and long[0, 0] != long[1, 0]


def brute_score(model, rows):
    """The network word by word."""
    x = [sum(model.embeddings[c] for c in r) for r in rows]
    logit = model.bias
    for k, width in enumerate(toxicity.WIDTHS):
        taps = [t for t, (kk, _) in enumerate(toxicity._TAPS) if kk == k]
        best = np.full(toxicity.FILTERS, -np.inf)
        for a in range(-width + 1, len(x)):
            z = sum((x[a + p] @ model.taps[:, t * toxicity.FILTERS : (t + 1) * toxicity.FILTERS] for p, t in enumerate(taps) if 0 <= a + p < len(x)), np.zeros(toxicity.FILTERS))
            best = np.maximum(best, z)
        if len(x):
            logit += np.maximum(best + model.biases[k], 0) @ model.weights[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS]
    return 1 / (1 + np.exp(-logit))


def test_the_network_against_one_word_by_word():
    rng = np.random.default_rng(3)
    model = toxicity.Model(np.zeros(1, np.int32), rng.normal(size=(50, toxicity.DIM)).astype(np.float32), rng.normal(size=(toxicity.DIM, len(toxicity._TAPS) * toxicity.FILTERS)).astype(np.float32) / 9, rng.normal(size=(3, toxicity.FILTERS)).astype(np.float32), rng.normal(size=3 * toxicity.FILTERS).astype(np.float32) / 5, 0.3)
    docs = [rng.integers(0, 50, (n, 4)) for n in (0, 1, 2, 3, 40, 0, 7)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = toxicity.score(np.concatenate(docs), first, model)
    assert np.allclose(got, [brute_score(model, d) for d in docs], atol=1e-4)


def test_pieces_give_what_whole_texts_give(monkeypatch):
    rng = np.random.default_rng(4)
    model = toxicity.Model(np.zeros(1, np.int32), rng.normal(size=(50, toxicity.DIM)).astype(np.float32), rng.normal(size=(toxicity.DIM, len(toxicity._TAPS) * toxicity.FILTERS)).astype(np.float32) / 9, rng.normal(size=(3, toxicity.FILTERS)).astype(np.float32), rng.normal(size=3 * toxicity.FILTERS).astype(np.float32) / 5, 0.3)
    model.embeddings[0] = 0
    docs = [rng.integers(0, 50, (n, 4)) for n in (5, 0, 16, 17, 40, 1, 15, 33)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    whole = toxicity.score(np.concatenate(docs), first, model)
    for piece in (1, 2, 8, 16):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(toxicity.score(np.concatenate(docs), first, model), whole, atol=1e-5)


def test_no_more_bytes_are_learned_from_than_stated(spark, monkeypatch):
    rows = [(i, ("worthless scum " if i % 2 else "kind friend ") * (3 if i else 400)) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda words, y, train=toxicity.train: seen.append(sorted(map(len, words))) or train(words, y))
    toxicity.fit(docs, labels, "id", "text", "toxic")
    toxicity.fit(docs, labels, "id", "text", "toxic", max_bytes=1000)
    assert len(seen[0]) == 60 and seen[0][-1] == 800
    assert 0 < len(seen[1]) <= 1000 // 36 and seen[1][-1] == 6


def test_every_labelled_row_is_learned_from(spark):
    """Words that lie only in rows after the first 8,000 by the hash of the key, or only in very long texts."""
    n = 8600
    ranked = [r.id for r in spark.range(n).orderBy(F.xxhash64("id", F.lit(11))).collect()]
    last, long = set(ranked[8000:]), set(ranked[:12])
    rows = [(i, "kind friend of the " + ("zebra" if i in last else "worthless scum" if i % 3 == 0 else "lovely day"), "en") for i in range(n) if i not in long]
    rows += [(i, "kind friend of the " * 170_000 + "quagga", "en") for i in long]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    labels = docs.select("id", F.col("text").rlike("scum|quagga$").cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, "id", "text", "toxic", "lang")
    h, _ = toxicity.hashes(["zebra", "quagga", "scum"])
    assert (model.row[h[:, 0]] > 0).all()
    new = spark.createDataFrame([(i, "kind friend of the " + x) for i, x in enumerate(("zebra", "quagga", "lovely day", "worthless scum"))], "id long, text string")
    assert [r.predicted for r in toxicity.classify(new, ["id"], "text", model).orderBy("id").collect()] == [0, 1, 0, 1]


def test_shards_give_the_same_network_wherever_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "START_ROWS", 100)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    rows = [(i, ("you worthless scum " if i % 4 == 0 else "what a lovely day ") * (1 + i % 7) + f"w{i % 50}", "de" if i % 2 else "en") for i in range(700)]
    docs, labels = spark.createDataFrame(rows, "id long, text string, lang string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(700)], "id long, toxic int")
    one, other = (toxicity.fit(d, labels, "id", "text", "toxic", "lang") for d in (docs, docs.orderBy(F.desc("text")).repartition(7)))
    assert (one.row == other.row).all() and (one.embeddings == other.embeddings).all() and (one.taps == other.taps).all() and one.bias == other.bias and one.thresholds == other.thresholds
    flat = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)), "id", "text", "toxic")
    assert all(abs(r.score - 0.5 / 701) < 1e-9 for r in toxicity.classify(docs, ["id"], "text", flat).collect())


def test_a_shard_is_trained_as_by_hand():
    class Shared:
        value = toxicity._untrained(np.unique(toxicity.hashes(["a worthless scum lovely day friend"])[0])[1:], 0.3, np.random.default_rng(5))

    found = ["a worthless scum", "lovely day", "", "day friend a", "scum"] * 30
    y, shard = [1, 0, 0, 0, 1] * 30, [0] * 70 + [3] * 80
    cols = {"shard": (shard, toxicity.pa.int32()), "label": (y, toxicity.pa.int32()), "text": (found, toxicity.pa.string())}
    whole = toxicity.batch(cols)
    got = toxicity.pa.Table.from_batches(list(toxicity._trained(Shared, 0.01)(iter([whole.slice(0, 33), whole.slice(33, 60), whole.slice(93)]))))
    change = np.stack([got.column(f"x{i}").to_numpy() for i in range(toxicity.DIM)], 1) / toxicity.FINE
    ids, start = got.column("id").to_numpy(), Shared.value
    (edge,) = np.flatnonzero((ids[:-1] < 0) & (ids[1:] >= 0)) + 1  # two shards
    for rows, own in ((slice(0, 70), slice(0, edge)), (slice(70, 150), slice(edge, None))):
        copy = toxicity.replace(start, embeddings=start.embeddings.copy(), taps=start.taps.copy(), biases=start.biases.copy(), weights=start.weights.copy())
        training, texts, labels = toxicity.Training(copy), found[rows], np.array(y[rows])
        for lo in range(0, len(texts), toxicity.BATCH):
            h = [toxicity.hashes([t])[0] for t in texts[lo : lo + toxicity.BATCH]]
            training.step([start.row[x] for x in h], labels[lo : lo + toxicity.BATCH], 0.01)
        after = training.model()
        embeddings = np.zeros_like(start.embeddings)
        embeddings[ids[own][ids[own] >= 0]] = change[own][ids[own] >= 0]
        assert np.allclose(embeddings, after.embeddings - start.embeddings, atol=1e-6) and np.abs(embeddings).max() > 1e-3
        dense = change[own][ids[own] < 0].ravel()[: len(toxicity._dense(after))]
        assert np.allclose(dense, toxicity._dense(after) - toxicity._dense(start), atol=1e-6)


def test_best_windows_of_long_texts_by_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    model = toxicity._untrained(np.arange(1, 300), 0.5, rng)
    docs = [rng.integers(1, 300, (n, 4)) for n in (5, 0, 16, 17, 40, 1, 15, 33, 18)]
    whole = toxicity._best_windows(docs, model)
    for piece in (1, 2, 3, 8, 16):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        pooled, where = toxicity._best_windows(docs, model)
        assert np.allclose(pooled, whole[0], atol=1e-5) and (where == whole[1]).all()


def test_thresholds_of_rows_are_those_of_arrays(spark):
    rng = np.random.default_rng(8)
    x, y = np.round(rng.normal(0, 2, 3000) * 50) / 50, rng.random(3000)
    y = (y < 1 / (1 + np.exp(1 - x))).astype(int)
    langs = [["en", "de", "fr", None, ""][i % 5] if i > 30 else "few" for i in range(3000)]
    rows = [(g, int(b), int(np.floor(a * toxicity.LOGIT_PARTS)), float(a)) for g, b, a in zip(langs, y, x, strict=True)]
    got = toxicity._thresholds(spark.createDataFrame(rows, "lang string, label int, part int, logit double"))
    want = toxicity.calibrate(x, y, langs)
    assert got.keys() == want.keys() == {"", "en", "de", "fr"} and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert toxicity._thresholds(spark.createDataFrame([("en", 0, 5, 0.1)] * 30, "lang string, label int, part int, logit double")) == {"": 0.0}


def test_keys_may_be_named_like_results(spark):
    model = toxicity.fit(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "id long, toxic int"), "id", "text", "toxic")
    docs = spark.createDataFrame([(1, "a", "de", 7)], "score long, text_ string, lang_ string, toxic int")
    got = toxicity.classify(docs, ["score", "text_", "lang_", "toxic"], "text_", model, lang="lang_").collect()
    assert [tuple(r)[:4] for r in got] == [(1, "a", "de", 7)] and got[0].asDict()["_score"] == 1


def test_thresholds():
    s, y = np.array([0.9, 0.8, 0.7, 0.2] * 10), np.array([1, 1, 0, 0] * 10)
    t = toxicity.calibrate(s, y, ["en"] * 40)
    assert 0.7 < t["en"] <= 0.8 and t[""] == t["en"]
    assert toxicity.calibrate(s, np.zeros(40), [None] * 40) == {"": 0.5}


def test_edge_cases(spark):
    bad, good = "you are a worthless idiot today", "what a lovely day it is"
    rows = [(i, bad if i % 3 == 0 else good, "en" if i % 2 else None, "x") for i in range(60)] + [(60, None, "en", "x"), (61, "", "en", "x"), (None, bad, None, "x"), (62, (good + " ") * 9000 + bad, "en", "x"), (0, bad, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(50)] + [(None, 1, 1), (51, None, 1), (999, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", "lang")
    got = toxicity.classify(docs, ["doc_id"], "text", model, "lang").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.predicted for r in got}
    assert by[54] == 1 and by[55] == 0 and by[62] == 1 and by[60] == by[61] == 0 and by[None] == 1
    for none in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.classify(docs, ["doc_id"], "text", toxicity.fit(docs, none, "doc_id", "text", "toxic"), None).collect()
        assert len({r.score for r in flat}) == 1
    assert toxicity.classify(docs.limit(0), ["doc_id"], "text", model).count() == 0
