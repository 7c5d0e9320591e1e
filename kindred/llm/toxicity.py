"""A convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds by language.

Words are hashed into a table of embeddings; filters of several widths slide over each whole text; every filter's largest
response, wherever it is, goes into a logistic layer. With max pooling the gradient reaches one window per filter and
text, so training is cheap, and a few words in a very long text count as much as in a short one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bytefeatures import parts, word_hashes
from kindred.llm.shared import batch, give_back, key_names, lean, small_batches, stored, texts

#: Labelled rows, and bytes of their texts, on which the driver starts the network; every row is learned from after that. A text
#: that alone holds a sixteenth of these bytes isn't among them.
START_ROWS, START_BYTES = 4000, 24 << 20
#: Where there are more rows: those that one worker goes through in turn before the networks are averaged, how often, and at what rates.
SHARD_ROWS, RATES = 16000, (0.02, 0.01, 0.005)
#: Steps of the sums of changes, so that their order makes no difference; parts of a logit by which rows are ranked apart.
FINE, LOGIT_PARTS = 1 << 24, 64
#: Words of 64 bits that tell which keys may have a label (a power of two).
FILTER_WORDS = 1 << 19
#: Words that are worked through together; a longer text goes through the filters piece by piece.
PIECE = 1 << 17
#: Words after which a step takes no more texts.
STEP_WORDS = 1 << 19
#: Hash space of words and of their beginnings (in bytes), and training documents in which a hash must lie to have an embedding.
SPACE, PREFIXES, LEAST_DOCS = 1 << 20, (4, 6, 8), 3
DIM, FILTERS, WIDTHS = 12, 10, (1, 2, 3)
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 3, 500, 48, 0.02, 2e-4
#: Labelled rows of either label that a fifth of all must hold to be set apart for calibration.
LEAST_APART = 15
#: Labelled rows of either label below which a language takes the threshold of all.
LEAST_OF_LANGUAGE = 10
_TAPS = [(k, p) for k, w in enumerate(WIDTHS) for p in range(w)]
_PAD = max(WIDTHS) - 1


@dataclass
class Model:
    """row: the embedding's row for each hash, 0 for none. embeddings: rows x DIM, row 0 zero. taps: DIM x (taps * FILTERS), what a
    word adds to each filter at each place of its window. thresholds: by language, "" for all others."""

    row: np.ndarray
    embeddings: np.ndarray
    taps: np.ndarray
    biases: np.ndarray
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (words x channels) below SPACE, 0 for nothing, and where each text's words begin (one more: the end)."""
    h, first = word_hashes(texts, PREFIXES)
    return (h % np.uint64(SPACE)).astype(np.uint32), first


def _responses(rows: np.ndarray, first: np.ndarray, embeddings: np.ndarray, taps: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Filters' responses by width, with room for the widest filter between texts, and where each text begins there."""
    n, words = len(first) - 1, np.diff(first)
    at = first[:-1] + _PAD * (np.arange(n) + 1)
    x = np.zeros((len(rows) + (n + 1) * _PAD, DIM), np.float32)
    place = np.arange(len(rows)) + np.repeat(at - first[:-1], words)
    e = embeddings[rows[:, 0]]
    for c in range(1, rows.shape[1]):
        e += embeddings[rows[:, c]]
    x[place] = e
    y = x @ taps
    out: list[np.ndarray] = []
    for t, (k, p) in enumerate(_TAPS):
        part = y[:, t * FILTERS : (t + 1) * FILTERS]
        if not p:
            out.append(part.copy())
        else:
            out[k][: len(x) - p] += part[p:]
    return out, at


def score(rows: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """The probability of label 1 for every text; rows (words x channels) are rows of the embeddings."""
    return _probability(logits(rows, first, model))


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def logits(rows: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    words = np.diff(first)
    short = words <= PIECE
    if short.all():
        pooled = _pooled(rows, first, model)
    else:
        pooled = np.empty((len(words), len(WIDTHS) * FILTERS), np.float32)
        pooled[short] = _pooled(rows[np.repeat(short, words)], np.concatenate([[0], np.cumsum(words[short])]), model)
        for d in np.flatnonzero(~short):
            pooled[d] = _pooled_in_pieces(rows[first[d] : first[d + 1]], model)
    return (pooled @ model.weights).astype(np.float64) + model.bias


def _pooled_in_pieces(rows: np.ndarray, model: Model) -> np.ndarray:
    """The filters' largest responses in one text, of windows that begin in one piece after the other."""
    none = np.zeros((_PAD, rows.shape[1]), rows.dtype)  # row 0 is no word
    rows = np.concatenate([none, rows, none])
    top = np.zeros((len(WIDTHS), FILTERS), np.float32)
    for lo in range(0, len(rows) - 2 * _PAD, PIECE):
        own = rows[lo : lo + PIECE + 2 * _PAD]
        z, at = _responses(own, np.array([0, len(own)]), model.embeddings, model.taps)
        for k, width in enumerate(WIDTHS):
            z_own = z[k][at[0] + _PAD - width + 1 : at[0] + len(own) - _PAD]
            top[k] = np.maximum(top[k], z_own.max(axis=0) + model.biases[k])
    return top.ravel()


def _pooled(rows: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """The filters' largest responses in each text, 0 where none is above."""
    pooled = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
    words = np.diff(first)
    has = np.flatnonzero(words)
    if len(has):
        z, at = _responses(rows, first, model.embeddings, model.taps)
        for k, width in enumerate(WIDTHS):
            # a text's windows begin within it or reach into it
            cuts = np.stack([at[has] - width + 1, at[has] + words[has]], 1).ravel()
            top = np.maximum.reduceat(z[k], cuts, axis=0)[::2]
            pooled[has, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top + model.biases[k], 0)
    return pooled


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam on the logistic loss; docs are hashes (words x channels). The same rows give the same model."""
    rng, n = np.random.default_rng(seed), len(labels)
    in_docs = np.zeros(SPACE, np.int64)
    for d in docs:
        in_docs[np.unique(d)] += 1
    in_docs[0] = 0
    model = _untrained(np.flatnonzero(in_docs >= LEAST_DOCS), (labels.sum() + 0.5) / (n + 1), rng)
    if not n or labels.min() == labels.max():
        model.weights[:] = 0
        return model
    steps = max(LEAST_STEPS, EPOCHS * n // BATCH)
    order = np.concatenate([rng.permutation(n) for _ in range(-(-steps * BATCH // n))])
    training = Training(model)
    for step in range(steps):
        pick = order[step * BATCH : (step + 1) * BATCH]
        training.step([model.row[docs[i]] for i in pick], labels[pick], RATE * min(1.0, 2 * (1 - step / steps)))
    return training.model()


def _untrained(known: np.ndarray, share: float, rng: np.random.Generator) -> Model:
    """A network of random numbers, with embeddings of the known hashes, for this share of label 1."""
    f32 = np.float32
    row = np.zeros(SPACE, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    embeddings = rng.normal(0, 0.1, (len(known) + 1, DIM)).astype(f32)
    embeddings[0] = 0
    taps = rng.normal(0, 0.4, (DIM, len(_TAPS) * FILTERS)).astype(f32)
    weights = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(f32)
    return Model(row, embeddings, taps, np.zeros((len(WIDTHS), FILTERS), f32), weights, _bias(share))


def _bias(share: float) -> float:
    return float(np.log(share / (1 - share)))


class Training:
    """Adam's state for a network, which changes in place; place: where the moments of each embedding that has changed are, 0 for others."""

    def __init__(self, model: Model):
        self.own = model
        self.dense = [model.taps, model.biases, model.weights, np.array([model.bias], np.float32)]
        self.m1, self.m2 = [np.zeros_like(x) for x in self.dense], [np.zeros_like(x) for x in self.dense]
        self.place, self.changed = np.zeros(len(model.embeddings), np.int32), 0
        self.e1, self.e2 = np.zeros((1 << 12, DIM), np.float32), np.zeros((1 << 12, DIM), np.float32)
        self.steps = 0

    def model(self) -> Model:
        self.own.bias = float(self.dense[3][0])
        return self.own

    def step(self, docs: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        """One step on texts, given as rows of the embeddings."""
        model, f32, n = self.own, np.float32, len(docs)
        self.steps += 1
        pooled, where = _best_windows(docs, model)
        flat = pooled.reshape(n, -1)
        probability = 1 / (1 + np.exp(-np.clip(flat @ model.weights + self.dense[3][0], -30, 30)))
        delta = ((probability - labels) / n).astype(f32)
        back = (delta[:, None] * model.weights[None, :] * (flat > 0)).reshape(pooled.shape)
        grads = [np.zeros_like(model.taps), back.sum(axis=0), flat.T @ delta, np.array([delta.sum()], f32)]
        # the gradient reaches the words of each filter's best window only
        words = np.array([len(d) for d in docs])
        touched, changes = [], []
        for t, (k, p) in enumerate(_TAPS):
            d, f = np.nonzero(back[:, k])
            word = where[d, k, f] + p
            inside = (word >= 0) & (word < words[d])
            d, f, word = d[inside], f[inside], word[inside]
            rows = np.array([docs[i][w] for i, w in zip(d.tolist(), word.tolist(), strict=True)], np.int64).reshape(-1, 1 + len(PREFIXES))
            g = back[d, k, f]
            x = model.embeddings[rows].sum(axis=1)
            tap = model.taps[:, t * FILTERS : (t + 1) * FILTERS]
            np.add.at(grads[0][:, t * FILTERS : (t + 1) * FILTERS].T, f, g[:, None] * x)
            touched.append(rows)
            changes.append(g[:, None] * tap[:, f].T)
        touched, changes = np.concatenate(touched), np.concatenate(changes)
        used, inverse = np.unique(touched, return_inverse=True)
        ge = np.zeros((len(used), DIM), f32)
        np.add.at(ge, inverse.reshape(touched.shape), changes[:, None, :])
        c1, c2 = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        for x, g, a, b in zip(self.dense, grads, self.m1, self.m2, strict=True):
            g = g + DECAY * x
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / c1) / (np.sqrt(b / c2) + 1e-6)
        ge += DECAY * model.embeddings[used]
        at = self._places(used)
        self.e1[at] += 0.1 * (ge - self.e1[at])
        self.e2[at] += 0.01 * (ge * ge - self.e2[at])
        model.embeddings[used] -= rate * (self.e1[at] / c1) / (np.sqrt(self.e2[at] / c2) + 1e-6)
        model.embeddings[0] = 0

    def _places(self, used: np.ndarray) -> np.ndarray:
        """Where the moments of these embeddings are, with room for new ones."""
        new = used[self.place[used] == 0]
        self.place[new] = np.arange(self.changed + 1, self.changed + 1 + len(new))
        self.changed += len(new)
        more = self.changed + 1 - len(self.e1)
        if more > 0:
            room = np.zeros((max(more, len(self.e1) // 2), DIM), np.float32)
            self.e1, self.e2 = np.concatenate([self.e1, room]), np.concatenate([self.e2, room])
        return self.place[used]


def _best_windows(docs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The filters' largest responses in each text (texts x widths x FILTERS), and the words at which those windows begin."""
    shape = (len(docs), len(WIDTHS), FILTERS)
    pooled, where = np.zeros(shape, np.float32), np.full(shape, -1)
    channels, every = 1 + len(PREFIXES), np.arange(FILTERS)
    none = np.zeros((_PAD, channels), np.int32)  # row 0 is no word
    together: list[int] = []

    def work() -> None:
        if not together:
            return
        first = np.concatenate([[0], np.cumsum([len(docs[d]) for d in together])])
        z, at = _responses(np.concatenate([docs[d] for d in together]), first, model.embeddings, model.taps)
        for d, a in zip(together, at, strict=True):
            for k, width in enumerate(WIDTHS):
                own = z[k][a - width + 1 : a + len(docs[d])]
                j = own.argmax(axis=0)
                pooled[d, k] = np.maximum(own[j, every] + model.biases[k], 0)
                where[d, k] = j - width + 1
        together.clear()

    held = 0
    for d, rows in enumerate(docs):
        if 0 < len(rows) <= PIECE:
            if held + len(rows) > PIECE:
                work()
                held = 0
            together.append(d)
            held += len(rows)
        elif len(rows):
            top = np.full(shape[1:], -np.inf, np.float32)
            for lo in range(0, len(rows) + _PAD, PIECE):  # windows that begin _PAD words before lo or later
                part = np.concatenate([none[: max(0, _PAD - lo)], rows[max(0, lo - _PAD) : lo + PIECE]])
                z, at = _responses(part, np.array([0, len(part)]), model.embeddings, model.taps)
                for k, width in enumerate(WIDTHS):
                    begin = max(0, _PAD - width + 1 - lo)
                    own = z[k][at[0] + begin : at[0] + min(PIECE, len(part))]
                    if not len(own):
                        continue
                    j = own.argmax(axis=0)
                    better = own[j, every] > top[k]
                    top[k] = np.where(better, own[j, every], top[k])
                    where[d, k] = np.where(better, lo - _PAD + begin + j, where[d, k])
            pooled[d] = np.maximum(top + model.biases, 0)
    work()
    return pooled, where


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """The threshold of best F1 for each language with enough rows of either label, and "" for all rows together."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        s, y = s[order], y[order]
        hit = np.cumsum(y)
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        f1[:-1][s[:-1] == s[1:]] = -1  # no threshold parts equal scores
        i = int(np.argmax(f1))
        return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i])

    names = np.array([x or "" for x in langs])
    out = {"": best(scores, labels) if labels.any() else 0.5}
    for name in set(names.tolist()) - {""}:
        own = names == name
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= LEAST_OF_LANGUAGE:
            out[name] = best(scores[own], labels[own])
    return out


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, lang: str | None = None, max_rows: int | None = None, max_bytes: int | None = None
) -> Model:
    """Train on all labelled documents, whole texts, and set the thresholds by all that are kept from training, a fifth.

    The driver starts the network on START_ROWS rows and START_BYTES at most (16 bytes for each word get there). Where there
    are more, workers go on from there through all rows, len(RATES) times: each trains on its share, and the mean of their
    changes is the next network (of an embedding, the mean of those that changed it). What comes to the driver is bounded by
    the hash space, not by the rows. A worker holds a few texts at a time.

    labels (key, label): rows with a null in either are left out, and so are those without a document. Of several documents
    with one key a hash of the text picks one, so that no key brings more rows than it has labels. lang (a column of
    docs) serves the thresholds only. Without labels of both kinds, every text gets the share of label 1.

    A caller who wants to learn from less states max_rows, or max_bytes (then no text of a sixteenth of it either).
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.select(f"`{key}`").schema[0].dataType
    key_ = F.col(f"`{key}`") if labels.select(f"`{key}`").schema[0].dataType == kind else F.col(f"`{key}`").try_cast(kind)
    given = labels.where(F.col(f"`{label}`").isNotNull()).select(key_.alias("key_"), (F.col(f"`{label}`") > 0).cast("int").alias("label_")).where("key_ is not null")
    own = docs.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{text}`").cast("string").alias("text_"), (F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")).alias("lang_"))
    shards = max(1, -(-given.count() // SHARD_ROWS))
    # documents and labels meet where their shard is, so that texts move once
    none, shard = F.lit(None), F.pmod(F.xxhash64("key_", F.lit(13)), F.lit(shards)).cast("int").alias("shard")
    both = _maybe_labelled(own, given).select("key_", none.cast("int").alias("label_"), "lang_", "text_").unionByName(given.select("key_", "label_", none.cast("string").alias("lang_"), none.cast("string").alias("text_")))
    one = F.min_by(F.struct("lang_", "text_"), F.when(F.col("label_").isNull(), F.xxhash64("text_", "lang_"))).alias("doc")
    met = both.select("*", shard).repartitionById(shards, "shard").groupBy("shard", "key_").agg(one, F.array(F.min("label_"), F.max("label_")).alias("labels")).where("doc is not null and labels[0] is not null")
    size, apart = F.coalesce(F.octet_length("doc.text_"), F.lit(0)).cast("long"), F.pmod(F.xxhash64("key_", F.lit(17)), F.lit(5)) == 4
    rows = met.select("shard", F.xxhash64("key_", F.lit(11)).alias("at"), F.explode(F.array_distinct("labels")).alias("label"), apart.alias("apart"), size.alias("size"), F.col("doc.lang_").alias("lang"), F.col("doc.text_").alias("text"))
    rows = stored(rows.sortWithinPartitions("shard", "at", "label"), "labelled")
    if max_rows is not None or max_bytes is not None:
        rows = rows.where(_first(rows, max_rows, max_bytes))
    counts = {(r.apart, r.label): r.n for r in rows.groupBy("apart", "label").agg(F.count("*").alias("n")).collect()}
    # the network never sees a fifth of the rows, by which thresholds are set; where they are too few, all rows serve
    kept = min(counts.get((True, y), 0) for y in (0, 1)) >= LEAST_APART
    learned, judges = (rows.where("not apart"), rows.where("apart")) if kept else (rows, rows)
    n, ones = (sum(c for (a, y), c in counts.items() if not (kept and a) and y >= least) for least in (0, 1))
    model, started = _start(learned)
    give_back()
    if started < n:
        model = _train_on_all(learned, model, n, ones)
    if n:
        shared = spark.sparkContext.broadcast(model)
        found = _thresholds(judges.select("lang", "label", "text").mapInArrow(lean(_judged(shared)), "lang string, label int, part int, logit double"))
        shared.destroy()
        moved = 0.0
        if kept:  # move the scores so that 0.5 is the best threshold of all rows together
            limit = float(np.log(0.98 / 0.02))
            moved = min(max(found[""], -limit), limit)
            model.bias -= moved
        model.thresholds = {name: float(_probability(np.float64(t - moved))) for name, t in found.items()}
    return model


def _maybe_labelled(docs: DataFrame, given: DataFrame) -> DataFrame:
    """The documents whose key may be among those given, so that few texts without a label move; none with a label is left out.

    The filter has FILTER_WORDS rows at most; the more labels there are, the more other documents pass it.
    """
    h = F.xxhash64("key_", F.lit(19))
    word, bit = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("word"), h.bitwiseAND(F.lit(63)).cast("int").alias("bit")
    some = given.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return docs.select("*", word, bit).join(F.broadcast(some), "word").where(F.getbit("bits", F.col("bit")) == 1).drop("word", "bit", "bits")


def _start(rows: DataFrame) -> tuple[Model, int]:
    """A network trained on the first rows here, and how many they were."""
    got = rows.where(_first(rows, START_ROWS, START_BYTES)).select("at", "label", "text").mapInArrow(lean(_hashes), "at long, label int, hashes binary").toArrow()
    ats, y, raw = (got.column(c).to_pylist() for c in ("at", "label", "hashes"))
    del got
    order = sorted(range(len(ats)), key=lambda i: (ats[i], y[i], raw[i]))
    words = [np.frombuffer(raw[i], "<u4").reshape(-1, 1 + len(PREFIXES)) for i in order]
    return train(words, np.array([y[i] for i in order], np.float64)), len(order)


def _first(rows: DataFrame, most_rows: int | None, most_bytes: int | None) -> Column:
    """Which rows come first by their hash, as many as these bounds allow; of bytes no row may hold a sixteenth."""
    fits = F.lit(True) if most_bytes is None else F.col("size") < most_bytes // 16
    narrow = rows.where(fits).select("at", "size").orderBy("at")
    narrow = narrow if most_rows is None else narrow.limit(most_rows)
    if most_bytes is not None:
        narrow = narrow.withColumn("so_far", F.sum("size").over(Window.orderBy("at"))).where(F.col("so_far") <= most_bytes)  # narrow rows
    last = narrow.agg(F.max("at")).first()[0]
    return F.lit(False) if last is None else fits & (F.col("at") <= last)


def _train_on_all(rows: DataFrame, start: Model, n: int, ones: int) -> Model:
    """The network after all rows have gone through it, from its start on some."""
    if ones in (0, n):  # every text gets the share
        start.weights[:], start.bias = 0, _bias((ones + 0.5) / (n + 1))
        return start
    spark, rng = rows.sparkSession, np.random.default_rng(7)
    in_docs = rows.select("text").mapInArrow(lean(_in_docs), "hash int, docs int").groupBy("hash").agg(F.sum("docs").alias("docs"))
    known = np.sort(in_docs.where(F.col("docs") >= LEAST_DOCS).select("hash").toArrow().column("hash").to_numpy())
    model = _untrained(known, (ones + 0.5) / (n + 1), rng)
    if start.weights.any():
        had = known[start.row[known] > 0]
        model.embeddings[model.row[had]] = start.embeddings[start.row[had]]
        model.taps, model.biases, model.weights, model.bias = start.taps, start.biases, start.weights, start.bias
    fields = ", ".join(f"x{i} long" for i in range(DIM))
    for rate in RATES:
        shared = spark.sparkContext.broadcast(model)
        changes = rows.select("shard", "label", "text").mapInArrow(lean(_trained(shared, rate)), f"id int, {fields}")
        mean = changes.groupBy("id").agg(*[(F.sum(f"x{i}") / F.count("*") / FINE).cast("float").alias(f"x{i}") for i in range(DIM)]).toArrow()
        shared.destroy()
        ids = mean.column("id").to_numpy()
        change = np.stack([mean.column(f"x{i}").to_numpy() for i in range(DIM)], 1)
        model.embeddings[ids[ids >= 0]] += change[ids >= 0]
        dense = np.zeros((-(-len(_dense(model)) // DIM), DIM), np.float32)
        dense[-1 - ids[ids < 0]] = change[ids < 0]
        _set_dense(model, _dense(model) + dense.ravel()[: len(_dense(model))])
    return model


def _dense(model: Model) -> np.ndarray:
    return np.concatenate([model.taps.ravel(), model.biases.ravel(), model.weights, [model.bias]]).astype(np.float32)


def _set_dense(model: Model, x: np.ndarray) -> None:
    a, b = model.taps.size, model.biases.size
    model.taps, model.biases = x[:a].reshape(model.taps.shape), x[a : a + b].reshape(model.biases.shape)
    model.weights, model.bias = x[a + b : -1], float(x[-1])


def _in_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each hash lies."""
    n = np.zeros(SPACE, np.int32)
    for b in batches:
        docs = texts(b.column(0))
        for i, j in parts(docs):
            h, first = hashes(docs[i:j])
            for a, z in zip(first, first[1:], strict=False):
                n[np.unique(h[a:z])] += 1
    n[0] = 0
    some = np.flatnonzero(n)
    yield batch({"hash": (some.astype(np.int32), pa.int32()), "docs": (n[some], pa.int32())})


def _trained(shared, rate: float) -> Callable:
    """Rows, shard after shard -> what each shard's rows change in the network: embeddings by their row, all else under -1, -2 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Model = shared.value
        training, shard = None, None
        docs: list[np.ndarray] = []
        labels: list[int] = []

        def step() -> None:
            if docs:
                training.step(docs, np.array(labels, np.float64), rate)
                docs.clear()
                labels.clear()

        def changes() -> Iterator[pa.RecordBatch]:
            step()
            after = training.model()
            used = np.flatnonzero(training.place)
            dense = _dense(after) - _dense(start)
            dense = np.concatenate([dense, np.zeros(-len(dense) % DIM, np.float32)]).reshape(-1, DIM)
            for lo in range(0, len(used), 1 << 14):
                ids = used[lo : lo + (1 << 14)]
                yield _changed(ids, after.embeddings[ids] - start.embeddings[ids])
            yield _changed(-1 - np.arange(len(dense)), dense)

        for b in batches:
            own, y, found = b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))
            for i, j in parts(found):
                h, first = hashes(found[i:j])
                rows = start.row[h]
                for d in range(i, j):
                    if own[d] != shard:
                        if training:
                            yield from changes()
                        shard = own[d]
                        training = Training(replace(start, embeddings=start.embeddings.copy(), taps=start.taps.copy(), biases=start.biases.copy(), weights=start.weights.copy()))
                    docs.append(rows[first[d - i] : first[d - i + 1]])
                    labels.append(y[d])
                    if len(docs) == BATCH or sum(map(len, docs)) > STEP_WORDS:
                        step()
        if training:
            yield from changes()

    return run


def _changed(ids: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    whole = np.rint(change.astype(np.float64) * FINE).astype(np.int64)
    return batch({"id": (ids.astype(np.int32), pa.int32())} | {f"x{i}": (whole[:, i], pa.int64()) for i in range(DIM)})


def _judged(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = texts(b.column(2))
            x = _logits_of(docs, shared.value)
            yield batch({"lang": (b.column(0), None), "label": (b.column(1), None), "part": (np.floor(x * LOGIT_PARTS).astype(np.int32), pa.int32()), "logit": (x, pa.float64())})

    return run


def _thresholds(judged: DataFrame) -> dict[str, float]:
    """What calibrate finds, in logits: rows (lang, label, part, logit) meet by parts of the logits, so that no task ranks all of a language."""
    named = F.coalesce("lang", F.lit(""))
    each = stored(judged.select(F.explode(F.array_distinct(F.array(F.lit(""), named))).alias("name"), "label", "part", "logit").groupBy("name", "part", "logit").agg(F.sum("label").alias("hit"), F.count("*").alias("n")), "judged")
    by_part = each.groupBy("name", "part").agg(F.sum("hit").alias("hits"), F.sum("n").alias("rows"), F.max("logit").alias("top"))
    down = Window.partitionBy("name").orderBy(F.desc("part"))  # parts, not rows
    above, whole = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("name")
    offsets = by_part.select(
        "name", "part", F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits_above"), F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("rows_above"),
        F.sum("hits").over(whole).alias("ones"), F.sum("rows").over(whole).alias("all"), F.lead("top").over(down).alias("below"),
    ).where((F.col("name") == "") & (F.col("ones") > 0) | (F.least("ones", F.col("all") - F.col("ones")) >= LEAST_OF_LANGUAGE))
    own = Window.partitionBy("name", "part").orderBy(F.desc("logit"))
    hit, rows = (F.col(f"{x}_above") + F.sum(y).over(own) for x, y in (("hits", "hit"), ("rows", "n")))
    ranked = each.join(offsets, ["name", "part"]).select("name", "logit", (2 * hit / (rows + F.col("ones"))).alias("f1"), F.coalesce(F.lead("logit").over(own), "below", "logit").alias("next"))
    best = ranked.groupBy("name").agg(F.max_by(F.struct("logit", "next"), F.struct("f1", "logit")).alias("b"))
    return {"": 0.0} | {r.name: (r.b.logit + r.b.next) / 2 for r in best.collect()}


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, out = texts(b.column(2)), []
        for i, j in parts(docs):
            h, first = hashes(docs[i:j])
            out += [h[a:z].astype("<u4").tobytes() for a, z in zip(first, first[1:], strict=False)]
        yield batch({"at": (b.column(0), None), "label": (b.column(1), None), "hashes": (out, pa.binary())})


def _logits_of(docs: list[str], model: Model) -> np.ndarray:
    x = np.zeros(len(docs))
    for i, j in parts(docs, 1 << 18):
        h, first = hashes(docs[i:j])
        x[i:j] = logits(model.row[h], first, model)
    return x


def classify(docs: DataFrame, key: list[str | Column], text: str, model: Model, lang: str | None = None) -> DataFrame:
    """docs -> key..., score, predicted (score >= 0.5), threshold (of the row's language), toxic (score >= threshold).

    The score looks at the text alone. A null text is an empty one, which has a score too. One row per input row. A key
    named like a result has an underscore put before its name. A very long text takes 32 bytes a word; its words go
    through the filters piece by piece, with the same result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(*key, F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string"), F.col(f"`{text}`").cast("string"))
    kept = own.schema.fields[:-2]
    names = key_names([f.name for f in kept], RESULTS)
    fields = "".join(f"`{n}` {f.dataType.simpleString()}, " for n, f in zip(names, kept, strict=True))
    own = own.toDF(*[f"c{i}" for i in range(len(own.columns))])
    shared = spark.sparkContext.broadcast(model)
    return own.mapInArrow(lean(_classify(shared, names)), f"{fields}score double, predicted int, threshold double, toxic boolean")


RESULTS = ("score", "predicted", "threshold", "toxic")


def _classify(shared, names: list[str]) -> Callable:
    n_keys = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        general = model.thresholds.get("", 0.5)
        for b in batches:
            docs, langs = texts(b.column(n_keys + 1)), b.column(n_keys).to_pylist()
            s = _probability(_logits_of(docs, model))
            limit = np.array([model.thresholds.get(x or "", general) for x in langs])
            cols = {f: (b.column(i), None) for i, f in enumerate(names)}
            yield batch(cols | {"score": (s, pa.float64()), "predicted": ((s >= 0.5).astype(np.int32), pa.int32()), "threshold": (limit, pa.float64()), "toxic": (s >= limit, pa.bool_())})

    return run
