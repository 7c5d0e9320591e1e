"""CSV files, plain, gzipped or in a zip archive, and alias directories."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.normalize import NormalizeOptions, normalize_name
from kindred.functions.shipping import ship


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header: .csv or .csv.gz by Spark's reader, .csv.zip (its first .csv) unpacked on an executor.

    Give a schema where it is known, as inferring it reads the file once more. A quote within quotes is doubled.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if not re.search(r"\.zip($|\?)", path):
        return reader.csv(path)
    ship(spark)
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unzipped, "record string")
    strings = getattr(found._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(strings), spark)  # the JVM's reader parses a Dataset of records


def _unzipped(frames):
    """The records of the first .csv of every archive, as they are written; a quoted field may hold line ends."""
    import pandas as pd

    for frame in frames:
        for content in frame.content:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                name = next(n for n in sorted(z.namelist()) if n.endswith(".csv"))
                with io.TextIOWrapper(z.open(name), "utf-8", newline="") as f:
                    records = _records(f)
                    while part := list(itertools.islice(records, 4096)):
                        yield pd.DataFrame({"record": part})


def _records(lines):
    held = []

    def noted():
        for line in lines:
            held.append(line)
            yield line

    for _ in csv.reader(noted()):
        yield "".join(held).rstrip("\r\n")
        held.clear()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    """An alias directory (alias_name, canonical_id, perhaps embedding) from Parquet."""
    df = spark.read.parquet(path)
    if missing := {"alias_name", "canonical_id"} - set(df.columns):
        raise ValueError(f"a directory needs the columns {sorted(missing)}")
    return df


def find_directory(spark: SparkSession, kind: str, *folders: str) -> DataFrame:
    """The directory named kind (say bipartite or markov: how its communities were found) in the first folder that has it.

    Folders are in order of preference, such as one that comes with the data and then a cache.
    """
    from pyspark.errors import AnalysisException

    for folder in folders:
        try:
            return load_directory(spark, f"{folder.rstrip('/')}/{kind}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
    raise FileNotFoundError(f"no directory {kind!r} in {', '.join(folders) or 'no folder'}")


def clean_directory(directory: DataFrame, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """One row per normalised alias, blank ones gone: of several the one of the smallest canonical id."""
    named = directory.withColumn("alias_name", normalize_name(F.col("alias_name"), options)).where(F.trim("alias_name") != "")
    rest = [c for c in named.columns if c not in ("alias_name", "canonical_id")]
    first = F.min_by(F.struct("canonical_id", *rest), F.col("canonical_id")).alias("row")
    return named.groupBy("alias_name").agg(first).select("alias_name", "row.*")
