"""Thin queries over the operators, as the checks of this library and its users call them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import oracles
from kindred.llm.shared import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text modulo n; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.toxicity import classify, fit

    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out), "doc_id", "text", "toxic", "lang")
    return classify(docs, ["doc_id", held_out.alias("held_out")], "text", model, "lang")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.chat import rotations

    rows = rotations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    spans = F.array_join(F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("conv_id", "perspective", "n_turns", "n_own", "rendered", spans.alias("mask_spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), with_ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.warc import read, write

    archives = write(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read(archives).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumnRenamed("component", "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.media import round_trip

    found = round_trip(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    from kindred.llm.secrets import line, scan

    found = scan(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id", "source")
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    told = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"), told("live").alias("n_live"), told("example").alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source").documents.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs.where(~held_out), "text", "lang")
    return identify(docs, ["doc_id", held_out.alias("held_out")], "text", model)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_chat": op2_chat, "op3_packing": op3_packing, "op4_warc": op4_warc, "op5_vectors": op5_vectors, "op6_media": op6_media, "op7_secrets": op7_secrets, "op8_mixing": op8_mixing, "op9_simhash": op9_simhash, "op10_langid": op10_langid}
SQL: dict[str, str] = {"op2_chat": oracles.CHAT, "op4_warc": oracles.WARC, "op5_vectors": oracles.VECTORS, "op7_secrets": oracles.SECRETS, "op8_mixing": oracles.MIXING}
