"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a threshold (the fingerprints' exact companion).

Texts meet in tables, and pairs that meet are compared exactly before they count, so none below the threshold is linked.
The first tables are the covering masks of the texts' SimHash fingerprints: no pair within their radius is missed. Texts that
share 0.8 of their shingles differ in about 10 of 64 bits, though, and masks that cover so many are 2^11 and more (for all
but a thousandth of such pairs 2^20). The other tables are for these: bands of a few min-hashes, as many as miss a pair at the
threshold with a chance of MISS. A sketch of all min-hashes rules out most pairs that met by chance, before any text is read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.bytefeatures import parts, shingle_hashes
from kindred.llm.components import components
from kindred.llm.shared import batch, cut, free_name, lean, local_stars, node_of, runs, small_batches, stored, texts
from kindred.llm.simhash import BLOCK, RADIUS, bucket_blocks, masks

WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Min-hashes of a band, chance of missing a pair at the threshold, and of the sketch ruling one out.
ROWS, MISS, RULED_OUT = 3, 1e-6, 1e-7


def bands(similarity: Fraction, miss: float = MISS) -> int:
    """Bands of ROWS min-hashes, such that a pair at the similarity shares one but for a chance of `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(min(float(similarity), 1 - 1e-9) ** ROWS))))


def least_agreeing(similarity: Fraction, n: int, ruled_out: float = RULED_OUT) -> int:
    """Of n min-hashes, how many a pair at the similarity has in common at least, but for that chance."""
    s, total = float(similarity), 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * s**k * (1 - s) ** (n - k)
        if total > ruled_out:
            return k
    return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def describe(docs: list[str], n_bands: int, width: int = WIDTH, radius: int = RADIUS) -> tuple[np.ndarray, ...]:
    """Of texts that have words: number of distinct shingles, fingerprint, sketch (a byte of each min-hash), keys in the tables.

    Keys of covering masks come first, then those of bands.
    """
    h, bounds = shingle_hashes(docs, width)
    starts, sizes = bounds[:-1], np.diff(bounds)
    n = np.array([len(_distinct(h[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)], np.int32)
    ones = np.empty((len(docs), 64), np.int64)
    for i in range(8):  # one byte of the hashes at a time
        bits = np.unpackbits((h >> np.uint64(8 * i)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        ones[:, 8 * i : 8 * i + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    fp = ((2 * ones > sizes[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    turns = np.random.default_rng(5).integers(0, 1 << 63, (ROWS * n_bands, 2), dtype=np.uint64)
    least = np.stack([np.minimum.reduceat((h ^ a) * (b | np.uint64(1)), starts) for a, b in turns], axis=1)
    sketch = (_mixed(least) >> np.uint64(56)).astype(np.uint8)
    covering = np.stack([_mixed((fp & np.uint64(m & (1 << 64) - 1)) + np.uint64(t + 1)) for t, m in enumerate(masks(radius))], axis=1)
    band = np.zeros((len(docs), n_bands), np.uint64)
    for r in range(ROWS):
        band = _mixed(band + least[:, r::ROWS] + np.arange(1, n_bands + 1, dtype=np.uint64)[None, :])
    return n, fp.view(np.int64), sketch, np.hstack([covering, band]).view(np.int64)


SIGNATURE = "node binary, n int, fp long, sketch binary, keys array<long>"


def _describe(n_bands: int) -> Callable:
    """Of rows (key, text) the node, 128 bits of the words; the rest of the signature once for each node of a batch that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in parts(docs := texts(b.column(1))):
                words = [b" ".join(x.encode().lower().split()) for x in docs[i:j]]
                nodes = [hashlib.md5(w).digest() for w in words]
                first = {node: k for k, node in reversed(list(enumerate(nodes)))}
                own = sorted(k for k in first.values() if words[k])
                at = np.full(j - i, -1)
                at[own] = np.arange(len(own))
                take = pa.array(at, mask=at < 0)
                n, fp, sketch, keys = describe([docs[i + k] for k in own], n_bands) if own else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 1), np.uint8), np.zeros((0, 1), np.int64))
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
                found = [pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array([s.tobytes() for s in sketch], pa.binary()), lists]
                yield batch({"key": (b.column(0).slice(i, j - i), None), "node": (nodes, pa.binary())} | {c: (x.take(take), None) for c, x in zip(("n", "fp", "sketch", "keys"), found, strict=True)})

    return run


def _meet(similarity: Fraction, least: int) -> Callable:
    """Of a bucket's blocks: a star for each component of pairs that may be alike, by sizes, fingerprints and sketches."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["key", "bi", "bj"], 4096):
            ids, n, fp = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "fp"))
            band = table.column("band").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)

            def near(i, j, n=n, fp=fp, band=band, sketch=sketch):
                ok = (np.minimum(n[i], n[j]) * q >= p * np.maximum(n[i], n[j])) & (band[i] | (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= RADIUS))
                return ok & ((sketch[i] == sketch[j]).sum(axis=-1) >= least)

            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            two = two[near(two, two + 1)]
            us, vs = [np.maximum(ids[two], ids[two + 1])], [np.minimum(ids[two], ids[two + 1])]
            for g in np.flatnonzero(sizes > 2):
                at = bounds[g] + np.argsort(ids[bounds[g] : bounds[g + 1]])
                root = local_stars(np.stack([near(np.full(len(at), i), at) for i in at]))
                own = root != np.arange(len(at))
                us.append(ids[at][own])
                vs.append(ids[at][root[own]])
            yield batch({"u": (np.concatenate(us), pa.int64()), "v": (np.concatenate(vs), pa.int64())})

    return run


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted; none without words."""
    return _distinct(shingle_hashes([text], width)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, docs = b.column(0), texts(b.column(1))
        for i, j in parts(docs):
            h, bounds = shingle_hashes(docs[i:j], WIDTH)
            yield batch({"id": (ids.slice(i, j - i), None), "words": ([_distinct(h[x:y]).tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())})


def _compare(similarity: Fraction, least: int) -> Callable:
    """Of a group's blocks: a star for each component of similar sets. Sets that are in one already aren't compared."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["root", "bi", "bj"], 1):
            ids = table.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
            n = np.array(list(map(len, sets)))
            us, vs = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = a + np.argsort(ids[a:b])
                root = np.arange(len(at))
                for i in range(len(at) - 1):
                    o = at[i + 1 :]
                    agree = (sketch[o] == sketch[at[i]]).sum(axis=1)
                    ok = (root[i + 1 :] != root[i]) & (agree >= least) & (np.minimum(n[o], n[at[i]]) * q >= p * np.maximum(n[o], n[at[i]]))
                    for j in (i + 1 + np.flatnonzero(ok))[np.argsort(-agree[ok], kind="stable")].tolist():  # the likeliest first
                        if root[i] != root[j]:
                            one, two = sets[at[i]], sets[at[j]]
                            both = len(one) + len(two) - len(_distinct(np.concatenate([one, two])))
                            if both * q >= p * (len(one) + len(two) - both):
                                root[root == max(root[i], root[j])] = min(root[i], root[j])
                own = root != np.arange(len(at))
                us.append(ids[at][own])
                vs.append(ids[at][root[own]])
            yield batch({"u": (np.concatenate(us), pa.int64()), "v": (np.concatenate(vs), pa.int64())})

    return run


def signatures(docs: DataFrame, key: str, text: str, similarity: Fraction = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """docs -> rows (key, node), one per row, and nodes: node, id, key (its smallest), n, fp, sketch, keys (null without words)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    found = own.mapInArrow(lean(_describe(bands(similarity))), f"key {own.schema['key'].dataType.simpleString()}, {SIGNATURE}")
    found = stored(found, "near-rows")
    nodes = found.groupBy("node").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.max("fp").alias("fp"), *[F.first(c, True).alias(c) for c in ("sketch", "keys")])
    return found.select("key", "node"), stored(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")


def links(docs: DataFrame, key: str, text: str, nodes: DataFrame, similarity: Fraction = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (u, v: ids of nodes) that span every component of similar texts.

    Buckets are compared in blocks by what is in narrow rows: this gives groups of texts that may be alike, each text in one.
    Only these are read again, as sets, once for each block of their group, and compared. Of a block only stars come
    out, so neither the buckets' pairs nor those of a group are ever rows.
    """
    n_bands, n_masks = bands(similarity), len(masks(RADIUS))
    least = least_agreeing(similarity, ROWS * n_bands)
    rows = nodes.where("n is not null").select("id", "n", "fp", F.posexplode("keys").alias("t", "key")).select("id", "n", "fp", (F.col("t") >= n_masks).alias("band"), "key")
    sketches = nodes.select("id", "sketch")
    maybe = bucket_blocks(rows, ["key"], "id", block, lambda df: df.join(sketches, "id")).mapInArrow(lean(_meet(similarity, least)), "u long, v long")
    groups = components(maybe).withColumnRenamed("node", "id")
    groups = cut(groups.unionByName(groups.select(F.col("root").alias("id"), "root").distinct()))
    wanted = cut(nodes.join(groups.select("id"), "id").select("id", F.col("key").alias("key2"), F.col("node").alias("node2")))
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(wanted, F.col("key") == F.col("key2"))
    # a key may have several texts, and a text several rows of its key
    own = own.where(node_of(F.col("text")) == F.col("node2")).groupBy("id").agg(F.max("text").alias("text"))
    sets = stored(own.mapInArrow(lean(_sets), "id long, words binary"), "near-sets")
    attach = lambda df: df.join(sketches, "id").join(sets, "id")
    return bucket_blocks(groups, ["root"], "id", block // 2, attach).mapInArrow(lean(_compare(similarity, least)), "u long, v long")


def keep_one(docs: DataFrame, key: str, text: str, similarity: Fraction = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """docs without all but one row of each group of near copies (5-word shingles): that with the smallest key stays.

    Groups are what links of similar texts reach. Rows of one key and the same words count as one; a key that holds
    different texts keeps one of each group. A null text is an empty one; texts without words are copies of one another.
    Rows with a null key have no identity; they stay as they are. A very long text is hashed piece by piece; its distinct
    shingles must fit in a task (8 bytes each). An empty table gives no rows; columns that are not named only ride along.
    """
    keyed, k = docs.where(F.col(f"`{key}`").isNotNull()), F.col(f"`{key}`")
    rows, nodes = signatures(keyed, key, text, similarity)
    roots = components(links(keyed, key, text, nodes, similarity, block)).withColumnRenamed("node", "id")
    groups = nodes.select("id", "key", "node").join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min(F.struct("key", "node")).alias("x"))
    chosen = cut(groups.select(F.col("x.key").alias("chosen_key"), F.col("x.node").alias("chosen_node")))
    # rows go by their keys alone, but for keys that several rows have
    each = (F.col("key") == F.col("chosen_key")) & (F.col("node") == F.col("chosen_node"))
    several = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("other_key")))
    gone = cut(rows.join(chosen, each, "left_anti").select(F.col("key").alias("other_key")).unionByName(several).distinct())
    kept = keyed.join(gone, k == F.col("other_key"), "left_anti").unionByName(docs.where(k.isNull()))
    if several.isEmpty():
        return kept
    node = free_name(docs, "node")
    marked = keyed.join(several, k == F.col("other_key"), "left_semi").withColumn(node, node_of(F.col(f"`{text}`")))
    once = marked.join(chosen, (k == F.col("chosen_key")) & (F.col(node) == F.col("chosen_node")), "left_semi").dropDuplicates([key, node]).drop(node)
    return kept.unionByName(once)
