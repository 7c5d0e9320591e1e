"""Distances between names (columns of strings) and between embeddings (columns of arrays of numbers).

Those that Spark can express run in the JVM. The dynamic programmes (osa, dl, lcs) and Jaro's are Arrow UDFs that work on
whole batches of pairs in numpy. A distance is null where it is undefined: a name shorter than q, a null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import arrow_distance
from kindred.functions.grams import qgrams


def _of_counts(a: Column, b: Column, fold: Callable[[Column, Column, Column], Column]) -> Column:
    """Sum of fold(gram's count in a, in b) over the grams of both."""
    count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    return F.aggregate(F.array_union(a, b), F.lit(0.0), lambda acc, g: acc + fold(count(a, g), count(b, g), g))


def jaccard(a: Column, b: Column, q: int = 2) -> Column:
    """1 - |A and B| / |A or B| over sets of q-grams."""
    x, y = qgrams(a, q), qgrams(b, q)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return _defined(a, b, q, 1 - both / either)


def _defined(a: Column, b: Column, q: int, d: Column) -> Column:
    return F.when((F.length(a) >= q) & (F.length(b) >= q), d)


def qgram(a: Column, b: Column, q: int = 2) -> Column:
    """Sum of absolute differences of the q-gram counts."""
    return _defined(a, b, q, _of_counts(qgrams(a, q), qgrams(b, q), lambda m, n, _: F.abs(m - n).cast("double")))


def cosine(a: Column, b: Column, q: int = 2) -> Column:
    """1 - cosine of the vectors of q-gram counts."""
    x, y = qgrams(a, q), qgrams(b, q)
    dot = lambda u, v, f: _of_counts(u, v, lambda m, n, _: f(m, n).cast("double"))
    xy, xx, yy = dot(x, y, lambda m, n: m * n), dot(x, x, lambda m, n: m * n), dot(y, y, lambda m, n: m * n)
    return _defined(a, b, q, F.greatest(F.lit(0.0), 1 - xy / F.sqrt(xx * yy)))


def lv(a: Column, b: Column, q: int = 2) -> Column:
    return F.levenshtein(a, b).cast("double")


def hamming(a: Column, b: Column, q: int = 2) -> Column:
    """Places in which the names differ; infinite for names of different lengths."""
    letters = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    unlike = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x != y), lambda x: x)).cast("double")
    return F.when(F.length(a) == F.length(b), unlike).when(F.length(a) != F.length(b), F.lit(float("inf")))


def soundex(a: Column, b: Column, q: int = 2) -> Column:
    """0 for names of one Soundex code, else 1."""
    return (F.soundex(a) != F.soundex(b)).cast("double")


def _arrow(kernel: Callable) -> Callable[..., Column]:
    def distance(a: Column, b: Column, q: int = 2) -> Column:
        return arrow_distance.udf(kernel)(a, b)

    return distance


NAME_DISTANCES: dict[str, Callable[..., Column]] = {
    "jaccard": jaccard, "qgram": qgram, "cosine": cosine, "lv": lv, "hamming": hamming, "soundex": soundex,
    "osa": _arrow(arrow_distance.osa), "dl": _arrow(arrow_distance.dl), "lcs": _arrow(arrow_distance.lcs), "jw": _arrow(arrow_distance.jaro),
}
#: Distances no smaller than the difference of the lengths: pairs beyond it need no distance.
BY_LENGTH = ("lv", "osa", "dl", "lcs")


def name_distance(method: str, a: Column, b: Column, q: int = 2) -> Column:
    if method not in NAME_DISTANCES:
        raise ValueError(f"unknown distance {method!r}; known are {', '.join(sorted(NAME_DISTANCES))}")
    return NAME_DISTANCES[method](a, b, q)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def rmse_eps(a: Column, b: Column, eps: float = 1e-4) -> Column:
    """Root of the mean squared difference, eps added: 0.01 at least."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a) + F.lit(eps))
