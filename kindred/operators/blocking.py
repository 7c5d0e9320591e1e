"""Candidate pairs of names by shared trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.grams import least_shared, qgrams, trigrams


def trigram_index(names: DataFrame, name: str) -> DataFrame:
    """names -> name, trigram, n: how often the trigram stands among the name's first 100."""
    one = names.select(F.col(f"`{name}`").alias("name")).where("name is not null").distinct()
    return one.select("name", F.explode(trigrams(F.col("name"))).alias("trigram")).groupBy("name", "trigram").agg(F.count(F.lit(1)).alias("n"))


def candidates(probe: DataFrame, other: DataFrame) -> DataFrame:
    """probe (name), other (name) -> probe, other: pairs of distinct names that share enough trigrams.

    Occurrences in the other name of trigrams of the probe must number 5 % of the probe's trigrams, rounded up, and one at
    least. The probe is the smaller table. The index of both sides is counted per name before they meet, so that a pair
    is one row for each distinct trigram it shares; common trigrams are left to the skew handling of adaptive joins.
    """
    own = probe.select("name").where("name is not null").distinct()
    left = own.select(F.col("name").alias("probe"), least_shared(trigrams(F.col("name"))).alias("least"), F.explode(F.array_distinct(trigrams(F.col("name")))).alias("trigram"))
    right = trigram_index(other, "name").withColumnRenamed("name", "other")
    shared = left.join(right, "trigram").groupBy("probe", "other", "least").agg(F.sum("n").alias("shared"))
    return shared.where("shared >= least").select("probe", "other")


def shares_enough(probe: Column, other: Column) -> Column:
    """The same rule for one pair."""
    # bound by a transform of one element, or else the trigrams would be built anew for every comparison
    both = F.array(F.struct(trigrams(probe).alias("p"), trigrams(other).alias("o")))
    n = lambda s: F.size(F.filter(s["o"], lambda g: F.array_contains(s["p"], g)))
    return F.element_at(F.transform(both, lambda s: (n(s) >= 1) & (n(s) >= least_shared(s["p"]))), 1)


def similar_candidates(probe: DataFrame, other: DataFrame, q: int, least: float) -> DataFrame:
    """probe (name), other (name) -> probe, other: the candidates that may have a Jaccard similarity of at least `least`.

    Prefix filtering (Chaudhuri et al., 2006): of two sets in one global order, of sizes m and n, whose overlap is at least
    `least` times either size, the first m - ceil(least m) + 1 and n - ceil(least n) + 1 members have one in common. The
    order is that of a hash, so it costs no pass over the data. Fewer grams meet than in the trigram join, the more so
    the greater `least` is; the trigram rule is then checked for each pair, so the result is the same.
    """
    least = least - 1e-9  # of rounding

    def prefixes(df: DataFrame, name: str, n: str) -> DataFrame:
        grams = F.array_sort(F.transform(F.array_distinct(qgrams(F.col("name"), q)), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
        sets = df.select("name").where("name is not null").distinct().select("name", grams.alias("grams")).where(F.size("grams") > 0)
        size = F.size("grams")
        some = F.slice("grams", F.lit(1), (size - F.ceil(size * F.lit(least)) + 1).cast("int"))
        return sets.select(F.col("name").alias(name), size.alias(n), F.explode(some).alias("gram")).select(name, n, "gram.g")

    met = prefixes(probe, "probe", "m").join(prefixes(other, "other", "n"), "g")
    pairs = met.where((F.col("m") >= F.col("n") * F.lit(least)) & (F.col("n") >= F.col("m") * F.lit(least))).select("probe", "other").distinct()
    return pairs.where(shares_enough(F.col("probe"), F.col("other")))
