"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every source's documents are laid end to end in hash order, and cut into blocks of equally many words. Slot i of the
schedule has the point i * g mod 2^31 of the golden-ratio sequence; the cumulative targets of the sources divide the
range, so each prefix of the schedule holds every source in nearly its share. The k-th slot of a source takes its k-th
block; past its last word a source begins again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import free_name, stored

#: Words of a block.
BLOCK = 1024
#: Points are integers below this; the step is the odd number next to it divided by the golden ratio.
RANGE, STEP = 1 << 31, 1327217885
#: Slots ranked together, chunks of slots summed together, and cells by which points meet sources.
CHUNK, SPAN, CELLS = 256, 256, 1024
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """targets: source, source_size, weight, target, goal (whole words). schedule: slot, source, k (its k-th block), first and
    last word of the source's stream (end exclusive). documents: key, source, size, source_size, target, taken, first_slot (null
    if none takes it), n_slots.
    pieces: slot, pass_no, key, source, size, start, from_word, to_word (of the document, end exclusive)."""

    targets: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    documents: DataFrame


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> + weight, target, goal.

    Sources by code point, null last, have the weights in turn. Water filling: a source gets level * weight or, if
    that is less, cap times its size. Ordered by cap / weight, the level is the share that is left for those from the
    first source on that can hold it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rest, everything = by_room.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything))
    target = F.least("most", F.col("level") * F.col("weight"))
    rows = rows.withColumn("target", F.coalesce(target, "most"))
    return rows.select("source", "source_size", "weight", "target", F.least(F.floor(F.col("target") + 0.5), F.floor("most")).cast("long").alias("goal"))


def _slots(goals: DataFrame, block: int) -> DataFrame:
    """goals (source, target, goal) -> slot, source, k, for k below what each source's goal needs."""
    spark = goals.sparkSession
    up = F.sum("target").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(Window.partitionBy(F.lit(1)))
    shares = (
        goals.where("goal > 0").withColumn("need", F.ceil(F.col("goal") / F.lit(block)).cast("long"))
        .withColumn("high", F.floor(up / whole * F.lit(float(RANGE))).cast("long"))
        .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))
    )
    shares = stored(shares, "mix-shares")
    n = shares.agg(F.sum("need")).first()[0] or 0
    cell = RANGE // CELLS
    by_cell = shares.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(RANGE)) * F.lit(STEP), F.lit(RANGE)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    hit = points.join(by_cell, "cell").where("point >= low and point < high").select("slot", "source", "need", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    # ranks within each source by prefix sums of three levels, so that a source with many slots is no single task
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_chunk = hit.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("chunk") / SPAN))
    in_span = in_chunk.groupBy("source", "span").agg(F.sum("n").alias("n_span"))
    in_span = in_span.select(F.col("source").alias("s1"), F.col("span").alias("p1"), before("n_span", "source", "span").alias("before1"))
    in_chunk = in_chunk.withColumn("before2", before("n", "source", "span", "chunk")).join(in_span, F.col("source").eqNullSafe(F.col("s1")) & (F.col("span") == F.col("p1")))
    in_chunk = in_chunk.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.col("before1") + F.col("before2")).alias("earlier"))
    ranked = hit.join(in_chunk, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.withColumn("k", F.col("earlier") + F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    own = ranked.where("k < need").select("slot", "source", "k")
    # points that missed a source by the sequence's discrepancy are made good after the last slot
    had = own.groupBy("source").agg(F.count(F.lit(1)).alias("had")).withColumnRenamed("source", "s")
    short = shares.join(had, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    late = short.select("source", F.explode(F.sequence("had", F.col("need") - 1)).alias("k")).select((F.lit(n) + F.col("k")).alias("slot"), "source", "k")
    return own.unionByName(late)


def mix(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, extra: dict[str, Column] | None = None) -> Mix:
    """Mix docs so that the sources' words near their targets, `share` times all words in total.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last. Rows that
    repeat a key are rows of their own. Reruns agree: the order within a source is that of an MD5 of key and text, and rows
    of equal key, text and extras are told apart by nothing. No document is taken more than cap times. A very long text is
    but a number of words here. An empty table gives empty results. Other columns are ignored but for those in `extra`, which
    pieces carry along.
    """
    extra = extra or {}
    body = F.col(f"`{text}`").cast("string")
    h = F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.md5(F.coalesce(body, F.lit("")).cast("binary"))).cast("binary"))
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), n_words(body).alias("size"), h.alias("h"), *[c.alias(n) for n, c in extra.items()])
    # rows that nothing tells apart are one row with a number, or else they would all be ranked by one task
    own = own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("copies"))
    own = stored(own.withColumn("b1", F.substring("h", 1, 2)).withColumn("b2", F.substring("h", 3, 2)).withColumn("all", F.col("size") * F.col("copies")), "mix-sizes")
    # a prefix sum over each source in three levels: 256 parts, 256 parts of each, rows
    fine = own.groupBy("source", "b1", "b2").agg(F.sum("all").alias("words"))
    coarse = fine.groupBy("source", "b1").agg(F.sum("words").alias("words1"))
    goals = stored(targets(coarse.groupBy("source").agg(F.sum("words1").alias("source_size")), weights, share, cap), "mix-targets")
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select(F.col("source").alias("s1"), F.col("b1").alias("c1"), before("words1", "source", "b1").alias("at1"))
    fine = fine.withColumn("at2", before("words", "source", "b1", "b2"))
    fine = fine.join(coarse, F.col("source").eqNullSafe(F.col("s1")) & (F.col("b1") == F.col("c1")))
    fine = fine.select(F.col("source").alias("s2"), F.col("b1").alias("d1"), F.col("b2").alias("d2"), (F.col("at1") + F.col("at2")).alias("at"))
    rows = own.join(fine, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b1") == F.col("d1")) & (F.col("b2") == F.col("d2")))
    w = Window.partitionBy("source", "b1", "b2").orderBy("h", "key", "size", *extra)
    rows = rows.withColumn("start", F.col("at") + F.coalesce(F.sum("all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rn", F.row_number().over(w))
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy_no") * F.col("size"))
    goal = goals.select(F.col("source").alias("s3"), "source_size", "target", "goal")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s3"))).select("key", "source", "size", *extra, "start", "rn", "copy_no", "source_size", "target", "goal")
    # each pass over a source repeats its stream; a document lies in the blocks it overlaps
    passes = int(-(-cap // 1))
    copy = F.array(*[F.struct(F.lit(q).alias("pass_no"), (F.col("start") + q * F.col("source_size")).alias("p")) for q in range(passes)])
    spans = rows.withColumn("copy", F.explode_outer(F.filter(copy, lambda c: (c["p"] < F.col("goal")) & (F.col("size") > 0))))
    k = F.explode_outer(F.sequence(F.floor(F.col("copy.p") / block), F.floor((F.least(F.col("copy.p") + F.col("size"), "goal") - 1) / block)))
    spans = spans.withColumn("k", k)
    schedule = stored(_slots(goals, block).join(goal.select("s3", "goal"), F.col("source").eqNullSafe(F.col("s3"))).select("slot", "source", "k", (F.col("k") * block).alias("first"), F.least((F.col("k") + 1) * block, F.col("goal")).alias("last")), "mix-schedule")
    sched = schedule.select(F.col("source").alias("s4"), F.col("k").alias("k4"), "slot", "first", "last")
    joined = spans.join(sched, F.col("source").eqNullSafe(F.col("s4")) & (F.col("k") == F.col("k4")), "left")
    lo, hi = F.greatest("first", F.col("copy.p")) - F.col("copy.p"), F.least("last", F.col("copy.p") + F.col("size")) - F.col("copy.p")
    joined = joined.withColumn("from_word", lo).withColumn("to_word", hi)
    taken = F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("long")
    per_doc = joined.groupBy("key", "source", "size", "start", "rn", "copy_no", "source_size", "target").agg(taken.alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    pieces = joined.where("slot is not null").select("slot", F.col("copy.pass_no").alias("pass_no"), "key", "source", "size", "start", "from_word", "to_word", *extra)
    return Mix(goals, schedule, pieces, per_doc.select("key", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots"))


def mixed_documents(docs: DataFrame, key: str, text: str, source: str, length: str | None = None, **options) -> DataFrame:
    """docs as the mix takes them, in docs' columns: one row for each time that a document is taken.

    Where a source's goal ends within a document, that copy keeps its leading words, joined by spaces; length (a
    column of character counts) then follows. The rows of each partition lie in the order of their first slots, so every
    file of the result goes through the schedule. Rows stand for one another only if they are equal in all columns.
    """
    body = F.col(f"`{text}`").cast("string")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.md5(F.concat_ws(":", F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(rest)])), F.coalesce(F.md5(body.cast("binary")), F.lit("null"))).cast("binary"))
    found = mix(docs, key, text, source, extra={"row": row}, **options)
    copies = found.pieces.groupBy("row", "size", "start", "pass_no").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"), F.min("slot").alias("slot"))
    k1, k2, n, at, start = (free_name(docs, x) for x in ("k1", "k2", "words", "slot", "start"))
    copies = copies.select(F.col("row").alias(k2), F.when(F.col("words") < F.col("size"), F.col("words")).otherwise(-1).alias(n), F.col("slot").alias(at), F.col("start").alias(start))
    named = docs.withColumn(k1, row).dropDuplicates([k1])
    each = named.join(copies, F.col(k1) == F.col(k2)).sortWithinPartitions(at, start)
    cut_text = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), 0), F.lit(1), F.col(n).cast("int")), " ")
    new = {text: F.when(F.col(n) < 0, body).otherwise(cut_text)}
    each = each.withColumns(new)
    if length:
        each = each.withColumn(length, F.when(F.col(n) < 0, F.col(f"`{length}`")).otherwise(F.length(F.col(f"`{text}`"))).cast(docs.schema[length].dataType))
    return each.select(*[f"`{c}`" for c in docs.columns])
