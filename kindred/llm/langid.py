"""Language identification of texts that may mix languages.

Every language has smoothed frequencies of letter trigrams, counted over all training rows. A text is a mixture: groups
of words are drawn from its languages in unknown proportions, which expectation-maximisation estimates from the groups'
likelihoods. Which languages take part is chosen by penalised likelihood (BIC): languages are added, that of the next largest share
first, until one more doesn't explain enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.bytefeatures import letter_trigrams, parts
from kindred.llm.shared import batch, key_names, lean, small_batches, texts

BUCKETS = 1 << 16
#: Words drawn together; expectation-maximisation ends when no proportion moves by more than this.
GROUP, TOLERANCE = 4, 1e-3
#: Numbers in one array of likelihoods: longer ones are worked through piece by piece.
NUMBERS = 1 << 22
#: Trigrams that all languages together lend to each, and the share of any trigram whatever in each: a language of few
#: training texts must not lose its other texts to text like none.
SMOOTH, UNSEEN = 300.0, 0.2
UNKNOWN = "und"


@dataclass
class Model:
    """logp: natural logarithms of the trigrams' probabilities, BUCKETS x languages (the last column: any text)."""

    languages: list[str]
    logp: np.ndarray


def fit(rows: DataFrame, text: str, lang: str) -> Model:
    """Count the trigrams of each language over all rows with a text and a language.

    Tasks add up their own rows first; at most BUCKETS sums for a language come to the driver, whatever the input.
    """
    small_batches(rows.sparkSession)
    own = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = own.mapInArrow(lean(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toArrow()
    names = sorted(found.column("lang").to_pylist())
    table = np.zeros((len(names), BUCKETS))
    for name, b, n in zip(*(found.column(c) for c in ("lang", "b", "n")), strict=True):
        table[names.index(name.as_py()), b.values.to_numpy()] = n.values.to_numpy()
    everything = table.sum(axis=0) + 1e-3
    everything *= SMOOTH / everything.sum()
    logp = np.full((BUCKETS, len(names) + 1), -np.log(BUCKETS), np.float32)
    for i, own_counts in enumerate(table):
        share = own_counts + everything
        logp[:, i] = np.log((1 - UNSEEN) * share / share.sum() + UNSEEN / BUCKETS)
    return Model(names, logp)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs, docs = b.column(0).to_pylist(), texts(b.column(1))
        for name in set(langs):
            own = [t for t, x in zip(docs, langs, strict=True) if x == name]
            for i, j in parts(own):
                n = np.bincount(letter_trigrams(own[i:j], BUCKETS)[0], minlength=BUCKETS)
                sums[name] = sums[name] + n if name in sums else n
    for name, n in sums.items():
        at = np.flatnonzero(n)
        yield batch({"lang": ([name] * len(at), pa.string()), "bucket": (at, pa.int32()), "n": (n[at], pa.int64())})


def proportions(docs: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text the proportions of the languages chosen (texts x languages), and that of text like none of them."""
    k = model.logp.shape[1]
    out = np.zeros((len(docs), k))
    for i, j in parts(docs, max(1 << 14, NUMBERS // k)):
        bucket, word, first = letter_trigrams(docs[i:j], BUCKETS)
        out[i:j] = _mixture(bucket, word, first, model.logp)
    return out[:, :-1], out[:, -1]


def _mixture(bucket: np.ndarray, word: np.ndarray, first: np.ndarray, logp: np.ndarray) -> np.ndarray:
    n, k = len(first) - 1, logp.shape[1]
    out = np.zeros((n, k))
    words = np.diff(first)
    if not len(bucket):
        return out
    # number the groups of words: each text's words in groups of GROUP
    doc_of_word = np.repeat(np.arange(n), words)
    groups = -(-words // GROUP)
    at = np.concatenate([[0], np.cumsum(groups)])
    group_of_word = at[doc_of_word] + (np.arange(len(doc_of_word)) - first[doc_of_word]) // GROUP
    g = group_of_word[word]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    ends = np.append(edge[1:], len(g))
    step = max(1, NUMBERS // k)  # rows of an array
    ll = np.empty((len(edge), k))
    lo = 0
    while lo < len(edge):
        hi = max(lo + 1, int(np.searchsorted(ends, edge[lo] + step)))
        ll[lo:hi] = np.add.reduceat(logp[bucket[edge[lo] : ends[hi - 1]]], edge[lo:hi] - edge[lo], axis=0, dtype=np.float64)
        lo = hi
    top = ll.max(axis=1, keepdims=True)
    has = np.flatnonzero(groups)
    start = at[:-1][has]
    single = np.add.reduceat(ll, start, axis=0)
    ll -= top
    like = np.exp(np.maximum(ll, -60, out=ll), out=ll)

    def sums(pi: np.ndarray, docs: np.ndarray, fold: Callable) -> np.ndarray:
        """For each of some texts (sorted) the sum over its groups of fold(likelihoods times proportions, groups)."""
        size = groups[docs]
        last = np.cumsum(size)
        total = 0
        for lo in range(0, int(last[-1]), step):
            rows = np.arange(lo, min(lo + step, int(last[-1])))
            row = np.searchsorted(last, rows, side="right")
            group = at[docs[row]] + rows - (last - size)[row]
            change = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            part = np.add.reduceat(fold(like[group] * pi[row], group), change, axis=0)
            if not lo:
                total = np.zeros((len(docs), *part.shape[1:]))
            total[row[change]] += part
        return total

    def em(allowed: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of some texts that have words (sorted); allowed has a row for each."""
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        moving = np.arange(len(docs))
        while len(moving):
            new = sums(pi[moving], docs[moving], lambda r, _: r / r.sum(axis=1, keepdims=True)) / groups[docs[moving], None]
            still = np.abs(new - pi[moving]).max(axis=1) > TOLERANCE
            pi[moving] = new
            moving = moving[still]
        return pi, sums(pi, docs, lambda r, group: np.log(np.maximum(r.sum(axis=1), 1e-300)) + top[group, 0])

    order = np.argsort(-em(np.ones((len(has), k)), has)[0], axis=1)
    best, score = np.eye(k)[single.argmax(axis=1)], single.max(axis=1)
    penalty = 0.5 * np.log(groups[has] + 1) + 1
    most = np.add.reduceat(top[:, 0], start)  # no mixture is likelier than each group's best language
    left = np.arange(len(has))
    for size in range(2, k + 1):
        # one more language, as long as the last one paid and the next one can
        left = left[most[left] - penalty[left] * (size - 1) > score[left] - 1e-6]
        if not len(left):
            break
        allowed = np.zeros((len(left), k))
        np.put_along_axis(allowed, order[left, :size], 1.0, axis=1)
        pi, total = em(allowed, has[left])
        total = total - penalty[left] * (size - 1)
        better = total > score[left]
        left = left[better]
        best[left], score[left] = pi[better], total[better]
    out[has] = best
    return out


RESULTS = ("lang_pred", "score", "languages", "shares")


def identify(docs: DataFrame, key: list[str | Column], text: str, model: Model, keep_text: bool = False) -> DataFrame:
    """docs -> key..., lang_pred, score, languages, shares; with keep_text the text, too, as the last column, named text.

    lang_pred is the learned language of the largest proportion, score that proportion; languages and shares list all
    that were chosen, largest first. A null text, one without a letter, and any text if no language was learned, have
    lang_pred und, score 0 and empty lists. A text like none of the languages has the nearest one and a score near 0.
    One row per input row, repeated rows too. A key named like a result has an underscore put before its name. A very
    long text takes memory for its trigrams and its groups of words, whose likelihoods are worked through in pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.col(f"`{text}`").cast("string")
    own = docs.select(*key, F.coalesce(body.rlike(r"\p{L}"), F.lit(False)), body)
    kept = own.schema.fields[:-2]
    names = key_names([f.name for f in kept], (*RESULTS, *["text"] * keep_text))
    fields = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True))
    own = own.toDF(*[f"c{i}" for i in range(len(own.columns))])
    shared = spark.sparkContext.broadcast(model)
    result = "lang_pred string, score double, languages array<string>, shares array<double>" + ", text string" * keep_text
    return own.mapInArrow(lean(_identify(shared, names, keep_text)), f"{fields}, {result}" if fields else result)


def _identify(shared, names: list[str], keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            docs, letters = texts(b.column(len(names) + 1)), b.column(len(names)).to_pylist()
            share, _ = proportions(docs, model)
            ranked = np.argsort(-share, axis=1, kind="stable")
            lang, score, langs, shares = [], [], [], []
            for i, ok in enumerate(letters):
                if not ok or not model.languages:
                    lang.append(UNKNOWN), score.append(0.0), langs.append([]), shares.append([])
                    continue
                own = [x for x in ranked[i].tolist() if share[i, x] > 0]
                lang.append(model.languages[ranked[i, 0]])
                score.append(float(min(1.0, share[i, ranked[i, 0]])))
                langs.append([model.languages[x] for x in own])
                shares.append([float(share[i, x]) for x in own])
            cols = {f: (b.column(i), None) for i, f in enumerate(names)}
            cols |= {"lang_pred": (lang, pa.string()), "score": (score, pa.float64()), "languages": (langs, pa.list_(pa.string())), "shares": (shares, pa.list_(pa.float64()))}
            yield batch(cols | ({"text": (b.column(len(names) + 1), None)} if keep_text else {}))

    return run
