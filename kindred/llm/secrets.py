"""Secrets in texts, told apart by how widely a value is owned. DataFrame functions only.

Patterns give candidate spans. The hashes of their values are counted over the whole corpus by distinct repositories and
distinct owners: a value that many owners hold, or that lies in very many repositories, is a widely copied example; one that
a single owner (or a few) holds in some repositories looks live. Bare tokens without a keyword are candidates too; they count as secrets where the corpus shows that their value is
one: some text has it behind a keyword, and few owners hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import cut, stored

#: Values that this many owners hold, or that lie in this many repositories, whoever owns them, are widely copied examples.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 100
#: Kinds, patterns and least lengths, in the order in which spans with the same start stand.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BARE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")
LEAST_ASSIGNED = 8
#: Marks around matches. A text that holds one has it replaced by another character that no pattern matches.
MARK, INNER, OTHER = "￾", "￿", "�"
SPAN = "struct<start:int,kind:int,end:int,hash:binary>"


#: Code points of a block, by which a text is cut up before spans are taken out of it.
BLOCK = 4096


def _running(xs: Column, fold) -> Column:
    """The running fold (associative) of an array: place i holds that of the elements up to i.

    Each round takes in what lies twice as far back, so n elements cost n log n steps, and no array grows by one.
    """
    rounds = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(xs))) - 1, F.lit(0))), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(rounds, xs, lambda acc, far: F.transform(acc, lambda x, i: F.when(i >= far, fold(x, F.get(acc, i - far))).otherwise(x)))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, kind: int, value: str = "$0") -> Column:
    """Spans of the leftmost non-overlapping matches, with the value. Positions count code points.

    Matches are marked and the text is split at the marks, so that every other part is a match; lengths add up.
    """
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{INNER}{value}{MARK}" if value != "$0" else f"{MARK}$0{MARK}"))
    whole = (lambda part: F.substring_index(part, INNER, 1)) if value != "$0" else (lambda part: part)
    held = (lambda part: F.substring_index(part, INNER, -1)) if value != "$0" else (lambda part: part)

    def spans(parts: Column, ends: Column) -> Column:
        one = lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), held(F.get(parts, i)).alias("value"))
        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one)

    found = _let(F.split(marked, MARK), lambda parts: _let(_running(F.transform(parts, lambda p: F.length(whole(p))), lambda x, y: x + y), lambda ends: spans(parts, ends)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _clear(spans: Column) -> Column:
    """Sorted spans without the bare ones that overlap another kind's."""
    far = 2**31 - 1
    ends = F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0)))
    starts = F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(F.lit(far)))
    before, after = _running(ends, F.greatest), F.reverse(_running(starts, F.least))
    free = lambda s, i, e: (s["kind"] < 3) | ((F.get(e["before"], i) <= s["start"]) & (F.get(e["after"], i) >= s["end"]))
    return _let(F.struct(before.alias("before"), after.alias("after")), lambda e: F.filter(spans, lambda s, i: free(s, i, e)))


def candidates(text: Column) -> tuple[Column, Column]:
    """Spans of a text (null: none) by the patterns, and bare ones: arrays of start, kind (a number into KINDS), end, hash.

    Bare candidates hold a digit and a letter.
    """
    text = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK + INNER, OTHER + OTHER)
    assign = F.filter(_matches(text, ASSIGN, 0, "$2"), lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    base = F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    return F.sort_array(F.transform(base, _hashed)), F.transform(F.filter(_matches(text, BARE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")), _hashed)


def _hashed(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.md5(s["value"].cast("binary"))).alias("hash"))


def find_candidates(docs: DataFrame, repository: str, owner: str, text: str) -> DataFrame:
    """docs -> its columns as a struct named row, repository, owner, spans (every candidate). One row per input row."""
    base, bare = candidates(F.col(f"`{text}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(f"`{repository}`").cast("string").alias("repository"), F.col(f"`{owner}`").cast("string").alias("owner"), base.alias("base"), bare.alias("bare"))
    # most texts have no candidate: the rest of the work is on the others only
    both = F.when(F.size("base") == 0, F.sort_array("bare")).otherwise(_let(F.sort_array(F.concat("base", "bare")), _clear))
    return rows.select("row", "repository", "owner", F.when(F.size("bare") > 0, both).otherwise(F.col("base")).alias("spans"))


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """found (repository, owner, spans) -> hash, n_owners, n_repositories, n_spans, verdict, over the whole corpus.

    Sums are taken by (hash, owner, repository), then (hash, owner), then hash, so a value in a third of all rows is
    spread over its repositories. A null owner or repository counts as one of its own. verdict: example if
    copied_owners or more hold it or copied_repositories or more have it, else live if a pattern found it anywhere; unknown
    for values that are bare everywhere. The result is written, so that joins with it can split a value in very many spans.
    """
    each = found.select("repository", "owner", F.explode("spans").alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repository", (F.col("s.kind") < 3).cast("int").alias("keyed"))
    one = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), F.max("keyed").alias("keyed"))
    own = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"), F.max("keyed").alias("keyed"))
    total = own.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_spans"), F.max("keyed").alias("keyed"))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    return cut(total.select("hash", "n_owners", "n_repositories", "n_spans", F.when(copied, "example").when(F.col("keyed") == 1, "live").otherwise("unknown").alias("verdict")))


def scan(docs: DataFrame, key: str, text: str, repository: str, owner: str, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """docs -> key, spans: array of start, kind, end, verdict, n_owners, n_repositories by start and kind; one row per row.

    Holds every pattern's span, with whatever verdict, and the bare spans that look live. Positions are code points, end
    exclusive. A null or empty text has no spans; repeated rows each have theirs; null keys stay. An empty table gives
    none. Columns besides the named ones are not read. A text with n matches costs n log n steps; its spans are one row.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((key, "key"), (text, "text"), (repository, "repository"), (owner, "owner"))])
    found = stored(find_candidates(own, "repository", "owner", "text").select(F.col("row.c0").alias("key"), "repository", "owner", "spans"), "secret-candidates")
    verdicts = ownership(found, copied_owners, copied_repositories)
    rows = found.where(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id()).select("key", "row", F.explode("spans").alias("s"))
    named = rows.select("key", "row", "s", F.col("s.hash").alias("hash")).join(verdicts, "hash")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1)
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind_no"), F.col("s.end").alias("end"), kind.alias("kind"), "verdict", "n_owners", "n_repositories")
    kept = F.filter(F.sort_array(F.collect_list(span)), lambda s: (s["kind_no"] < 3) | (s["verdict"] == "live"))
    with_spans = named.groupBy("row", "key").agg(kept.alias("spans")).select("key", "spans")
    none = found.where(F.size("spans") == 0).select("key", F.array().cast(with_spans.schema["spans"].dataType).alias("spans"))
    return none.unionByName(with_spans).withColumnRenamed("key", key)


def line(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, stand_in: str) -> Column:
    """The text with its spans (sorted, they may overlap) replaced; those that overlap as one."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(cut: Column, a: Column, b: Column) -> Column:
        """Code points a to b (end exclusive), from the blocks that hold them."""
        lo, hi = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        part = lambda j: F.substring(F.get(cut, j), F.greatest(a - j * BLOCK, F.lit(0)) + 1, F.least(b - j * BLOCK, F.lit(BLOCK)) - F.greatest(a - j * BLOCK, F.lit(0)))
        return F.when(b > a, F.array_join(F.transform(F.sequence(lo, hi), part), "")).otherwise("")

    def joined(c: Column) -> Column:
        """Of a struct of blocks, spans, running ends: what stands before each span that begins a new stretch, stand-ins, the rest."""
        n = F.size(c["spans"])
        before = lambda i: F.when(i > 0, F.get(c["ends"], i - 1)).otherwise(0)
        piece = lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), F.concat(between(c["blocks"], before(i), s["start"]), F.lit(stand_in))).otherwise("")
        return F.concat(F.array_join(F.transform(c["spans"], piece), ""), between(c["blocks"], F.get(c["ends"], n - 1), F.length(text)))

    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return _let(F.struct(blocks.alias("blocks"), spans.alias("spans"), ends.alias("ends")), joined)


def redacted(docs: DataFrame, key: str, text: str, repository: str, owner: str, length: str | None = None, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, stand_in: str = "[SECRET]") -> DataFrame:
    """docs with what looks live in their texts replaced; widely copied examples and all other text stay as they are.

    Overlapping spans are replaced as one. length, a column of character counts, follows. Same rows, same columns: null and
    repeated keys, null and empty texts stay, and an empty table stays empty. Texts are searched once: rows are
    written with their candidates, and only those with any are joined with the verdicts.
    """
    found = stored(find_candidates(docs, repository, owner, text).withColumn("id", F.monotonically_increasing_id()), "secret-candidates")
    verdicts = ownership(found, copied_owners, copied_repositories).where("verdict = 'live'").select("hash")
    some = F.size("spans") > 0
    live = found.where(some).select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end", F.col("s.hash").alias("hash")).join(verdicts, "hash")
    live = cut(live.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("live")))
    i = docs.columns.index(text)
    body = F.col(f"row.c{i}").cast("string")
    new = {text: F.when(F.col("live").isNotNull(), _replaced(body, F.col("live"), stand_in)).otherwise(body).cast(docs.schema[text].dataType)}
    hit = found.where(some).join(live, "id", "left").withColumn("new", new[text])
    if length:
        new[length] = F.when(F.col("live").isNotNull(), F.length("new")).otherwise(F.col(f"row.c{docs.columns.index(length)}")).cast(docs.schema[length].dataType)
    new[text] = F.col("new")
    hit = hit.select(*[new.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
    return found.where(~some).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]).unionByName(hit)
