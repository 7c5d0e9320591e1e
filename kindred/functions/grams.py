"""Letter n-grams of names as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trigrams of a name that take part in blocking at most.
MOST_TRIGRAMS = 100


def trigrams(name: Column) -> Column:
    """The first 100 trigrams, repeats kept; a name of one or two characters is its own, an empty one has none; null for null."""
    n = F.length(name)
    many = F.transform(F.sequence(F.lit(1), F.least(n - 2, F.lit(MOST_TRIGRAMS))), lambda i: F.substring(name, i, F.lit(3)))
    return F.when(n >= 3, many).when(n >= 1, F.array(name)).when(n == 0, F.array().cast("array<string>"))


def qgrams(name: Column, q: int = 2) -> Column:
    """All q-grams, repeats kept; none for a name shorter than q."""
    n = F.length(name)
    many = F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(name, i, F.lit(q)))
    return F.when(n >= q, many).when(n.isNotNull(), F.array().cast("array<string>"))


def least_shared(grams: Column) -> Column:
    """Trigrams that a candidate has to share: 5 % of the probe's, rounded up."""
    return F.ceil(F.size(grams) * F.lit(0.05))
