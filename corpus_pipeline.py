"""A corpus pipeline of five stages: language ID, near-duplicates, secrets, mixture of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import langid, mixing, nearcopies, packing, secrets
from kindred.llm.queries import tokenizer_path
from kindred.llm.shared import scratch, table

#: Documents go whose languages together have a smaller share than this. Languages may mix, so no single one decides.
LEAST_SHARE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, lang set to it. Those of no letters, or like no language, go.

    The languages are learned from the stage's own documents. Where none has a language, none is rejected.
    """
    model = langid.fit(docs, "text", "lang")
    if not model.languages:
        return docs
    rest = [c for c in docs.columns if c != "text"]
    found = langid.identify(docs, [F.struct(*[f"`{c}`" for c in rest]).alias("doc")], "text", model, keep_text=True)
    known = F.aggregate("shares", F.lit(0.0), lambda total, share: total + share)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (known >= LEAST_SHARE))
    kind = docs.schema["lang"].dataType
    new = {"text": F.col("text").cast(docs.schema["text"].dataType), "lang": F.col("lang_pred").cast(kind)}
    return kept.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Near copies share 0.8 or more of their 5-word shingles. Fingerprints of 64 bits can't tell these (they differ in
    about 10 bits), so the shingles themselves are compared; op9 keeps its own digest.
    """
    return nearcopies.keep_one(docs, "doc_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that look live replaced in their texts."""
    return secrets.redacted(docs, "doc_id", "text", "doc_id", "source", length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time."""
    return mixing.mixed_documents(docs, "doc_id", "text", "source", length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: a row for each piece, its token ids among the columns."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_duplicates),
    ("secret scans", without_secrets),
    ("source mixing", mixed),
    ("packing", packed),
]
#: Tokenisation, hashing and language models are not expressible in SQL; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
