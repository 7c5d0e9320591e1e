"""Column expressions for names: normalisation, repair of share links, helpers for pasted input."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space by Unicode, written out: Java's own \s knows ASCII only.
SPACES = r"[\t\n\f\r\p{Z}]+"
PUNCTUATION = r"\p{P}"


@dataclass(frozen=True)
class NormalizeOptions:
    lower: bool = True
    spaces: bool = True
    punctuation: bool = True


def normalize_name(name: Column, options: NormalizeOptions = NormalizeOptions()) -> Column:
    """Lower case, then runs of white space to one space (no trim), then punctuation away: "a & b" keeps two spaces."""
    if options.lower:
        name = F.lower(name)
    if options.spaces:
        name = F.regexp_replace(name, SPACES, " ")
    return F.regexp_replace(name, PUNCTUATION, "") if options.punctuation else name


def normalize_for_embedding(name: Column) -> Column:
    """What an embedder is given: lower case and single spaces, punctuation kept."""
    return F.regexp_replace(F.lower(name), SPACES, " ")


#: A host that shows a page for a shared file, and the one that serves the file itself.
SHARE_HOST, FILE_HOST = "dropbox.com", "dl.dropboxusercontent.com"


def direct_download_url(url: Column) -> Column:
    """Links to the page of a shared file as links to the file, with or without www; other addresses unchanged."""
    return F.regexp_replace(url, rf"(?:www\.)?\Q{SHARE_HOST}\E", FILE_HOST)


def to_double(value: Column) -> Column:
    """A number from any column, null where there is none."""
    return value.try_cast("double")


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def value_id(name: Column) -> Column:
    """An id of the value, not of the row: equal names share it."""
    return F.sha2(name.cast("binary"), 256)


#: Patterns for a column of names, the first that matches any column decides.
NAME_COLUMNS = ("^names?$", "^orgnames?$", "organization", "^org$", "company", "entity", "name")


def guess_name_column(df: DataFrame) -> str:
    """The column that looks most like names; the first column if none does."""
    for pattern in NAME_COLUMNS:
        for c in df.columns:
            if re.search(pattern, c.lower()):
                return c
    return df.columns[0]


def pasted_names(df: DataFrame, text: str) -> DataFrame:
    """One row (names) for each line of text that isn't blank, trimmed."""
    trimmed = F.regexp_replace(F.col("line"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return df.select(F.explode(F.split(text, "\n")).alias("line")).select(trimmed.alias("names")).where("names <> ''")


def rename_embedding_columns(df: DataFrame, name: str) -> DataFrame:
    """Every column but name becomes emb_001, emb_002, ..."""
    wide = [c for c in df.columns if c != name]
    return df.withColumnsRenamed({c: f"emb_{i:03d}" for i, c in enumerate(wide, 1)})


def numeric_columns(df: DataFrame) -> DataFrame:
    from pyspark.sql.types import NumericType

    return df.select(*[f"`{f.name}`" for f in df.schema if isinstance(f.dataType, NumericType)])


def without_blank_names(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.trim(F.col(f"`{name}`").cast("string")) != "")
